"""SQL that says what must come out of planted schedules, pages and catalogs."""

from __future__ import annotations

from rosterloom.operators import catalog as cat
from rosterloom.plans.roster_queries import DIGITS, GREEK, NUMBERS
from rosterloom.plans.sql import latin_sql as latin
from rosterloom.plans.sql import plain_upper_sql as plain_upper
from rosterloom.plans.sql import similar_sql as similar


def _letters(n: str) -> str:
    return f"translate(lpad(({n})::VARCHAR, 4, '0'), '{DIGITS}', '{GREEK}')"


def _number(n: str) -> str:
    return f"'28310' || (10000 + ({n}))::VARCHAR"


def _filled(template: str, *values: str) -> str:
    """A format string of text values as SQL."""
    parts = template.split("%s")
    out = [f"'{parts[0]}'"]
    for value, part in zip(values, parts[1:], strict=True):
        out += [f"({value})", f"'{part}'"]
    return " || ".join(out)


#: r: the planted catalog, with its names upper-cased, squeezed and in Latin letters.
_CATALOG = f"""
    r0 AS (SELECT n_nationkey AS ref_no, 'Μαρία ' || {_letters("n_nationkey")} AS ref_name, 'Οδός ' || (n_nationkey + 50)::VARCHAR AS ref_address,
           {_number("CASE WHEN n_nationkey = 4 THEN 3 ELSE n_nationkey END")} AS ref_phone FROM nation),
    r1 AS (SELECT *, {plain_upper("ref_name")} AS ref_up, {plain_upper("ref_address")} AS ref_aup FROM r0),
    r AS (SELECT *, replace(ref_up, ' ', '') AS ref_key, {latin("ref_up")} AS ref_latin, {latin("replace(ref_up, ' ', '')")} AS ref_key_latin, {latin("ref_aup")} AS ref_alatin FROM r1)"""
#: q: readings (k, name, address, phone) with the same forms; p: the pick by number; m: the closest name.
_FORMS = f"q AS (SELECT *, replace(name, ' ', '') AS key, {latin('name')} AS lat, {latin("replace(name, ' ', '')")} AS key_latin, {latin('address')} AS alat FROM q0)"


def _pick(spaced: bool) -> str:
    names = (similar("lat", "ref_latin"), similar("name", "ref_up")) if spaced else (similar("key_latin", "ref_key_latin"), similar("key", "ref_key"))
    score = f"greatest({names[0]}, {names[1]}, {similar('alat', 'ref_alatin')})"
    return f"p AS (SELECT k, ref_no, ref_name FROM q JOIN r ON phone = ref_phone QUALIFY row_number() OVER (PARTITION BY k ORDER BY {score} DESC, ref_name, ref_no) = 1)"


_CLOSEST = f"""
    lost AS (SELECT DISTINCT name, key, key_latin FROM q WHERE phone <> '' AND phone NOT IN (SELECT ref_phone FROM r)),
    s AS (SELECT name, ref_no AS cat_no, ref_name AS cat_name, ref_phone AS cat_phone, greatest({similar("key_latin", "ref_key_latin")}, {similar("key", "ref_key")}) AS near FROM lost, r),
    m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY near DESC, cat_name) = 1)"""
_READINGS = f"""
    q0 AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 1 THEN 'ΨΥΧΩΣΤΡΕΦΗΣ' ELSE 'ΜΑΡΙΑ ' || {_letters("c_custkey % 23")} END AS name, 'ΟΔΟΣ ' || (c_custkey % 9)::VARCHAR AS address,
           CASE WHEN c_custkey % 4 < 2 THEN {_number("c_custkey % 25")} WHEN c_custkey % 4 = 2 THEN {_number("c_custkey % 25 + 60")} ELSE '' END AS phone FROM customer)"""
_CLOSEST_NOTE = f"""CASE WHEN near >= {cat.FUZZY_MATCH}::DOUBLE THEN {_filled(cat.NOTE_CLOSEST, "q.name", "cat_name", "cat_phone")}
    WHEN near >= {cat.FUZZY_HINT}::DOUBLE THEN {_filled(cat.NOTE_HINT, "q.name", "cat_name")} ELSE '' END"""
_A = f"""
    q0 AS (SELECT c_custkey AS k, c_custkey % {NUMBERS} AS number, 'ΜΑΡΙΑ ' || {_letters(f"c_custkey % {NUMBERS}")} AS name, 'ΟΔΟΣ ' || (c_custkey % 9 + 1)::VARCHAR AS address,
           {_number(f"c_custkey % {NUMBERS}")} AS phone, DATE '2026-08-01' + (c_custkey % 60)::INT AS date FROM customer)"""
_DAYS = "['ΚΥΡΙΑΚΗ', 'ΔΕΥΤΕΡΑ', 'ΤΡΙΤΗ', 'ΤΕΤΑΡΤΗ', 'ΠΕΜΠΤΗ', 'ΠΑΡΑΣΚΕΥΗ', 'ΣΑΒΒΑΤΟ'][dayofweek(date) + 1]"
_B = f"'ΓΕΩΡΓΙΑ ' || {_letters('k % 7')}"
_BYTE = "CASE WHEN embedding[{}] < 0 THEN 64 ELSE 192 END"
_BOXES = " || ".join("printf('%02x', (" + " + ".join(_BYTE.format(i) for i in (2 * x + 1, 2 * x + 2, 2 * x + 9, 2 * x + 10)) + ") // 4)" for x in range(4))

ORACLE_SQL: dict[str, str] = {
    "roster_parse": f"""
        WITH {_CATALOG}, {_A}, {_FORMS}, {_pick(True)}, {_CLOSEST},
        a AS (SELECT q.*, p.ref_no, p.ref_name, near, cat_no, {_CLOSEST_NOTE} AS note FROM q LEFT JOIN p USING (k) LEFT JOIN m ON q.name = m.name AND p.ref_no IS NULL)
        SELECT k::VARCHAR AS doc_id, strftime(date, '%Y-%m-%d') AS date, {_DAYS} AS day_name, 0 AS shift_no, '08:00' AS from_time, '21:00' AS to_time, 0 AS entry_no,
               CASE WHEN ref_no IS NULL THEN name ELSE {plain_upper("ref_name")} END AS name, CASE WHEN ref_no IS NULL THEN address ELSE 'ΟΔΟΣ ' || (ref_no + 50)::VARCHAR END AS address, phone,
               ref_no IS NOT NULL AS filled, CASE WHEN ref_no IS NOT NULL THEN ref_no WHEN near >= {cat.FUZZY_MATCH}::DOUBLE THEN cat_no END AS match_no,
               CASE WHEN ref_no IS NULL THEN note ELSE '' END AS discrepancy, '' AS warnings, CASE WHEN ref_no IS NULL THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS score FROM a
        UNION ALL
        SELECT k::VARCHAR, strftime(date, '%Y-%m-%d'), {_DAYS}, 1, '21:00', '08:00', 0, {_B}, 'ΟΔΟΣ ' || (k % 5 + 1)::VARCHAR, '', false, NULL, '', '', 0.55::DOUBLE FROM q""",
    "validate_catalog": f"""
        WITH {_CATALOG}, {_READINGS}, {_FORMS}, {_pick(False)}, {_CLOSEST},
        j AS (SELECT q.*, p.ref_no, p.ref_name, near, cat_no, CASE
                WHEN p.ref_no IS NOT NULL AND {similar("lat", latin(plain_upper("p.ref_name")))} < {cat.NAME_MISMATCH}::DOUBLE THEN {_filled(cat.NOTE_MISMATCH, "q.name", "p.ref_name")}
                WHEN p.ref_no IS NOT NULL OR near IS NULL THEN '' ELSE {_CLOSEST_NOTE} END AS discrepancy
              FROM q LEFT JOIN p USING (k) LEFT JOIN m ON q.name = m.name AND p.ref_no IS NULL AND phone <> ''),
        n AS (SELECT *, CASE WHEN ref_no IS NOT NULL THEN ref_no WHEN near >= {cat.FUZZY_MATCH}::DOUBLE THEN cat_no END AS match_no FROM j)
        SELECT k, phone <> '' AS phone_valid, true AS name_greek, true AS address_ok, match_no, discrepancy, '' AS warnings,
               round((CASE WHEN phone <> '' THEN 0.35 ELSE 0 END + 0.55 + CASE WHEN match_no IS NOT NULL AND discrepancy = '' THEN 0.10 ELSE 0 END)::DOUBLE, 4) AS score FROM n""",
    "catalog_pick_shared": f"""
        WITH {_CATALOG}, {_READINGS}, {_FORMS}, {_pick(True)} SELECT ref_no, count(*) AS n, min(k) AS first FROM p GROUP BY 1""",
    "unmatched_customers": f"""
        WITH {_CATALOG}, {_READINGS} SELECT k, CASE WHEN phone <> '' THEN {_filled(cat.LABEL_PHONE, "phone")} ELSE {_filled(cat.LABEL_ENTRY, "name")} END AS label
        FROM q0 WHERE phone NOT IN (SELECT ref_phone FROM r)""",
    "multi_key_explode_join": """
        WITH s AS (SELECT s_suppkey, unnest([s_suppkey % 50, s_suppkey % 50 + 50]) AS number FROM supplier)
        SELECT c_custkey AS k, count(*) AS n, min(s_suppkey) AS first, max(s_suppkey) AS last FROM customer JOIN s ON number = c_custkey % 120 GROUP BY 1""",
    "catalog_fill_orders": """
        SELECT o_orderkey, coalesce(upper(c_name), o_orderpriority) AS name, coalesce(upper(c_mktsegment), '') AS address, c_acctbal AS lat, c_custkey IS NOT NULL AS filled
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "last_wins_score": """
        WITH l AS (SELECT l_orderkey % 1000 AS phone, l_quantity AS score, count(*) OVER (PARTITION BY l_orderkey % 1000) AS n FROM lineitem
                   QUALIFY row_number() OVER (PARTITION BY l_orderkey % 1000 ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC) = 1)
        SELECT phone, n, score::DOUBLE AS confidence, 1 AS kinds FROM l""",
    "link_enrichment": """
        WITH g AS (SELECT c_custkey % 31 AS number, min(c_custkey) AS c FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1)
        SELECT n_nationkey AS ref_no, c / 8 AS lat, CASE WHEN c IS NOT NULL THEN 24.0::DOUBLE END AS lon, lpad(c::VARCHAR, 6, '0') AS place_id
        FROM nation LEFT JOIN g ON number = CASE WHEN n_nationkey = 4 THEN 3 ELSE n_nationkey END""",
    "duty_days": """
        SELECT page_id, 0 AS day_no, '2026-08-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS date, 'ΔΕΥΤΕΡΑ' AS day_name, 0 AS shift_no, '08:00' AS from_time, '21:00' AS to_time, 0 AS entry_no,
               'Φαρμακείο & Α' AS name, 'Οδός 5, 28310 26115' AS address, '2831026115' AS phone FROM pages
        UNION ALL SELECT page_id, 1, '2026-09-05', 'ΣΑΒΒΑΤΟ', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pages""",
    "catalog_rows": "SELECT page_id, 0 AS entry_no, 'Φαρμακείο ' || page_id::VARCHAR AS name, 'Οδός 7' AS address, '28310' || (page_id + 10000)::VARCHAR AS phone FROM pages",
    "tensor_normalize": """
        SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda v: (CASE WHEN v < 0 THEN 64 ELSE 192 END / 255::DOUBLE - 0.5) / 0.5)), 3) AS total FROM embeddings""",
    "raster_shrink": f"SELECT vec_id, {_BOXES} AS top, 16 AS n, 4 AS w, 6 AS h FROM embeddings",
    "token_usage": "SELECT role, count(*) AS requests, coalesce(sum(length(text)), 0)::BIGINT AS input_tokens, coalesce(sum(turn), 0)::BIGINT AS output_tokens FROM conversations GROUP BY 1",
    "decision_puts": """
        SELECT user_id::VARCHAR AS key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS decided_at, event_id, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
}
