"""SQL that gives the results of the registered queries."""

from __future__ import annotations

from rosterloom.functions import checks, text
from rosterloom.functions.dates import DAY_NAMES
from rosterloom.plans import roster_oracle
from rosterloom.plans.sql import digits_sql as _digits
from rosterloom.plans.sql import latin_sql as _latin
from rosterloom.plans.sql import quoted as _quoted
from rosterloom.plans.sql import similar_sql as _similar


_UNIFORM = (
    _quoted(text.DASHES + text.SINGLE_QUOTES + text.DOUBLE_QUOTES + text.SPACES),
    _quoted("-" * len(text.DASHES) + "'" * len(text.SINGLE_QUOTES) + '"' * len(text.DOUBLE_QUOTES) + " " * len(text.SPACES)),
)


def _normalized(c: str) -> str:
    return f"trim(regexp_replace(translate(translate({c}, {_UNIFORM[0]}, {_UNIFORM[1]}), '{text.ACCENTED}', '{text.PLAIN}'), '[ \\t\\r\\n]+', ' ', 'g'), ' ')"


def _case_by_day(c: str) -> str:
    return "CASE dayofweek(" + c + ") " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(DAY_NAMES)) + " END"


_SIGNALS = "SELECT l_discount, l_tax, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL"
_KEY = "upper(replace(replace(replace({}, ' ', ''), '.', ''), '-', ''))"
_MARKS = "'view', 'signup', 'purchase', 'error', 'click'"
_LINE = """
  SELECT lang, line, upper(trim(line, e' \\t\\n\\r\\f\\x0B')) AS up, trim(line, e' \\t\\n\\r\\f\\x0B') AS tr
  FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)"""

ORACLE_SQL: dict[str, str] = {
    "digits_only_phone": f"""
        SELECT c_custkey, CASE WHEN length(x) < 6 THEN '' ELSE x END AS digits,
               regexp_matches('2' || right(c_name, 9), '^2[0-9]{{9}}$') AS valid
        FROM (SELECT c_custkey, c_name, {_digits("translate(c_name, '01', 'Ol')")} AS x FROM customer)""",
    "look_alike_names": f"""
        SELECT p_name, n, greek, {_latin("greek")} AS latin
        FROM (SELECT p_name, count(*) AS n, translate(upper(p_name), '{text.LOOK_ALIKE_LATIN}', '{text.LOOK_ALIKE_GREEK}') AS greek FROM part GROUP BY p_name)""",
    "normalize_dedupe_docs": f"SELECT lang, md5({_normalized('text')}) AS key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1, 2",
    "similarity_top1_part": f"""
        WITH names AS (SELECT DISTINCT p_name, upper(p_name) AS u FROM part),
        pairs AS (SELECT a.p_name, b.p_name AS other, {_similar("a.u", "b.u")} AS score FROM names a JOIN names b ON a.p_name <> b.p_name)
        SELECT p_name, other, round(score, 6) AS score FROM pairs
        QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY pairs.score DESC, other) = 1""",
    "name_bands": f"""
        WITH p AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name),
        words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
        pairs AS (SELECT p_name, n, word, {_KEY.format("p_name")} AS a, {_KEY.format("word")} AS b FROM p, words),
        scored AS (SELECT p_name, n, word, {_similar("a", "b")} AS s FROM pairs),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY s DESC, word) = 1)
        SELECT p_name, n, word AS best_name, round(s, 6) AS best_score, CASE WHEN s >= 0.55 THEN 'match' WHEN s >= 0.3 THEN 'hint' ELSE 'none' END AS level FROM best""",
    "band_first_match": """
        WITH v AS (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT l_quantity, n, min(n_nationkey) AS band FROM v JOIN nation ON l_quantity BETWEEN n_nationkey * 2 - 0.5 AND n_nationkey * 2 + 3 + 0.5 GROUP BY 1, 2""",
    "nearest_band": """
        WITH v AS (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1),
        p AS (SELECT l_quantity, n, n_nationkey AS band, abs(l_quantity - n_nationkey * 12) + abs(l_quantity - n_nationkey * 12 - 4) AS distance FROM v, nation)
        SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY l_quantity ORDER BY distance, band) = 1""",
    "asof_marker": """
        SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
          OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup_id FROM events""",
    "day_split_by_anchor": """
        WITH c AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s,
                   max((event_type = 'signup')::INT) OVER (PARTITION BY user_id) AS marked FROM events)
        SELECT user_id, greatest(s, 1) AS day_no, count(*) AS n, count(*) FILTER (s = 0) AS n_head, min(event_id) AS first_event FROM c WHERE marked = 1 GROUP BY 1, 2""",
    "shift_split_by_marker": """
        WITH l AS (SELECT user_id, event_id, event_type, floor(epoch(ts))::BIGINT AS y0, floor(epoch(ts))::BIGINT + floor(value)::BIGINT * 600 AS y1 FROM events),
        m AS (SELECT user_id, y0 AS top FROM l WHERE event_type = 'signup'),
        f AS (SELECT user_id, min(top) AS first FROM m GROUP BY 1),
        j AS (SELECT l.user_id, l.event_id, l.y1, f.first, (SELECT count(*) FROM m WHERE m.user_id = l.user_id AND m.top <= floor((l.y0 + l.y1) / 2)) AS k
              FROM l LEFT JOIN f USING (user_id) WHERE event_type <> 'signup')
        SELECT user_id, greatest(k - 1, 0) AS shift_no, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event
        FROM j WHERE k > 0 OR first IS NULL OR y1 <= first GROUP BY 1, 2""",
    "entry_split_by_terminator": """
        WITH c AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
                   sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id) AS t FROM events)
        SELECT user_id, least(k, greatest(t - 1, 0)) AS entry_no, count(*) AS n, min(event_id) AS first_event, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS purchase_id
        FROM c GROUP BY 1, 2""",
    "islands_tolerance": """
        WITH d AS (SELECT DISTINCT o_custkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS day FROM orders),
        g AS (SELECT *, coalesce((day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) > 2)::INT, 0) AS new FROM d),
        i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY day) AS island FROM g)
        SELECT o_custkey, min(day) AS first, max(day) AS last, floor((min(day) + max(day)) / 2)::BIGINT AS centre, count(*) AS size FROM i GROUP BY o_custkey, island""",
    "merge_close_fold": """
        WITH RECURSIVE s AS (SELECT p_brand, list_sort(list(DISTINCT p_size)) AS v FROM part GROUP BY 1),
        f AS (SELECT p_brand, v, 1 AS i, [v[1]] AS done FROM s
              UNION ALL
              SELECT p_brand, v, i + 1, CASE WHEN v[i + 1] - done[len(done)] < 5 THEN list_append(done[1:len(done) - 1], floor((done[len(done)] + v[i + 1]) / 2)::INT) ELSE list_append(done, v[i + 1]) END
              FROM f WHERE i < len(v))
        SELECT p_brand, array_to_string(done, ',') AS merged FROM f WHERE i = len(v)""",
    "interval_pick_newest": """
        WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1),
        w AS (SELECT n_nationkey AS ord, DATE '1995-01-01' + n_nationkey * 60 AS lo FROM nation)
        SELECT strftime(day, '%Y-%m-%d') AS day, n, coalesce((SELECT min(ord) FROM w WHERE day BETWEEN lo AND lo + 60), (SELECT max(ord) FROM w)) AS ord FROM d""",
    "date_functions": f"""
        WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1)
        SELECT strftime(day, '%Y-%m-%d') AS day, n, strftime(day, '%Y-%m-%d') AS parsed, {_case_by_day("day")} AS name, dayofweek(day) AS dow,
               printf('week:%04d-W%02d', isoyear(day), weekofyear(day)) AS week, strftime(date_trunc('week', day), '%Y-%m-%d') AS monday,
               strftime((make_date(year(day), 1, 1) + to_months((month(day) + 11)::INT))::DATE + (day(day) + 30)::INT, '%Y-%m-%d') AS rolled,
               length(strftime(day, '%-d/%-m/%Y')) < 10 AS loose, strftime(day, '%Y-%m-%d') || 'T00:00:00Z' AS rfc FROM d""",
    "iso_week_state": """
        SELECT printf('week:%04d-W%02d', isoyear(ts), weekofyear(ts)) AS week_key, event_id, value FROM events
        QUALIFY row_number() OVER (PARTITION BY week_key ORDER BY ts DESC, event_id DESC) = 1""",
    "ttl_fresh": "SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR",
    "fifo_replay_20": "SELECT user_id, min(event_id) AS first_seq, sha256(user_id::VARCHAR) AS sha FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 20",
    "change_only": """
        SELECT event_id, user_id, event_type FROM events
        QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)""",
    "serve_state": """
        WITH p AS (SELECT user_id, event_id AS last FROM events WHERE event_type = 'purchase' AND user_id % 3 > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT CASE WHEN last IS NULL THEN 'miss' WHEN last = event_id THEN 'unchanged' ELSE 'hit' END AS status, count(*) AS n
        FROM events LEFT JOIN p USING (user_id) GROUP BY 1""",
    "single_flight_leaders": "SELECT user_id || '|' || event_type AS key, min(event_id) AS event_id FROM events GROUP BY 1",
    "decision_cache": """
        SELECT o_orderpriority || '|' || o_orderstatus AS key, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * length(o_orderpriority || '|' || o_orderstatus) AS verdict, count(*) AS n
        FROM orders GROUP BY ALL""",
    "gate_identity": f"""
        SELECT l_discount, l_tax, CASE WHEN l_returnflag = 'N' THEN 'none' ELSE 'c' || lower(l_returnflag) END AS choice, n,
               l_returnflag <> 'N' AND 1 - l_discount * 4 >= 0.8::DOUBLE AND CASE WHEN l_tax = 0 THEN -1.0::DOUBLE ELSE 1 - l_tax * 4 END >= 0.8::DOUBLE AS accepted FROM ({_SIGNALS})""",
    "route_merge": f"""
        SELECT l_discount, l_tax, l_returnflag, n, CASE WHEN k = 2 AND 1 - l_discount * 8 < 0.5::DOUBLE THEN 'curator' ELSE ['different', 'curator', 'same'][k + 1] END AS outcome
        FROM (SELECT *, least(greatest(floor(l_tax * 32 + 0.5::DOUBLE)::INT, 0), 2) AS k FROM ({_SIGNALS}))""",
    "implausible_fields": f"""
        SELECT l_discount, l_tax, l_returnflag, n, concat_ws(',', CASE WHEN l_discount * 10 < 0.5::DOUBLE THEN 'name' END, CASE WHEN l_tax * 10 < 0.7::DOUBLE THEN 'address' END) AS fields
        FROM ({_SIGNALS})""",
    "best_outcomes": """
        WITH p AS (SELECT s_suppkey, c_custkey AS candidate, c_acctbal / 5000 AS score, count(*) OVER (PARTITION BY s_nationkey, c_custkey) AS nl, count(*) OVER (PARTITION BY s_suppkey) AS nr
                   FROM supplier JOIN customer ON s_nationkey = c_nationkey),
        o AS (SELECT *, least(greatest(floor(score + 0.5::DOUBLE)::INT, 0), 2) AS k FROM p WHERE nl > 1 OR nr > 1)
        SELECT s_suppkey, candidate, ['different', 'curator', 'same'][k + 1] AS outcome FROM o
        QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY k DESC, score DESC, candidate) = 1""",
    "validate_score": f"""
        WITH r AS (SELECT c_custkey, '2' || right(c_name, 9) AS phone, c_nationkey % 2 = 0 AS greek, c_nationkey % 3 = 0 AS street, c_acctbal > 0 AS match FROM customer),
        v AS (SELECT *, regexp_matches(phone, '^2[0-9]{{9}}$') AS valid FROM r)
        SELECT c_custkey, round((CASE WHEN valid THEN 0.35 ELSE 0 END + CASE WHEN greek THEN 0.30 ELSE 0 END + CASE WHEN street THEN 0.20 ELSE 0 END + 0.05 + CASE WHEN match THEN 0.10 ELSE 0 END)::DOUBLE, 4) AS score,
               concat_ws('; ', CASE WHEN NOT valid THEN '{checks.WARNINGS["phone"]}' END, CASE WHEN NOT greek THEN '{checks.WARNINGS["name"]}' END, CASE WHEN NOT street THEN '{checks.WARNINGS["address"]}' END) AS warnings FROM v""",
    "html_title_links": """
        WITH e AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h,
                   regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links, trim(regexp_replace(html, '<[^>]+>', ' ', 'g'), e' \\t\\n\\r') AS x FROM pages)
        SELECT page_id, trim(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS title,
               trim(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS h1,
               len(links) AS n_links, len(list_distinct(links)) AS n_targets,
               length(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS text_chars FROM e""",
    "image_links": """
        SELECT page_id, 1 AS ord, 'https://x.org/wp-content/uploads/2026/08/' || lpad((page_id % 27 + 1)::VARCHAR, 2, '0') || '.08.2026-28.08.2026.jpg' AS url,
               '2026-08-' || lpad((page_id % 27 + 1)::VARCHAR, 2, '0') AS from_date, '2026-08-28' AS to_date FROM pages""",
    "line_classifier": f"""
        WITH l AS (SELECT *, length(regexp_replace(up, '[^0-9]', '', 'g')) AS nd FROM ({_LINE}))
        SELECT lang, CASE
            WHEN (regexp_matches(up, '(?i)(τηλ|thl)') AND length({_digits("up")}) >= 6) OR (nd >= 6 AND nd / greatest(length(up), 1) > 0.5::DOUBLE) THEN 'phone'
            WHEN tr IN ('', '/', '-', '.') OR NOT regexp_matches(tr, '{checks.READABLE}') THEN 'skip'
            WHEN (contains(line, ':') AND (contains(line, '-') OR contains(line, '/'))) OR regexp_matches(tr, '{checks.DATE_LINE}') OR up IN {DAY_NAMES} THEN 'skip'
            WHEN regexp_matches(line, '(?i)(str\\.?|street|οδος|οδ|στρ\\.?|λεωφ\\.?|πλ\\.?|πλατει)') OR (regexp_matches(line, '[0-9]') AND length(line) > 6 AND NOT regexp_matches(line, '{checks.GREEK_IN_LINE}')) THEN 'address'
            WHEN regexp_matches(up, '{checks.GREEK_IN_LINE}') THEN 'name'
            WHEN regexp_matches(line, '[0-9]') THEN 'address' ELSE 'name' END AS kind, count(*) AS n
        FROM l GROUP BY ALL""",
    "confusion_report": "SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY 1",
    "judge_agreement": "SELECT count(*) AS n, count(*) FILTER (quality = 1 - toxic) AS agree, round(avg(abs(quality - 1 + toxic)), 6) AS mean_gap, max(abs(quality - 1 + toxic)) AS max_gap FROM labels",
    "signal_stats": "SELECT event_type, count(*) AS n, round(min(value), 6) AS first, round(median(value), 6) AS median, round(max(value), 6) AS last FROM events GROUP BY 1",
    "profile_variance": "SELECT hour, round(var_pop(c), 6) AS variance FROM (SELECT ts::DATE AS day, hour(ts) AS hour, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1",
    "argmax_grid": """
        SELECT user_id, hour, score FROM (SELECT user_id, hour(ts) AS hour, count(*) AS score FROM events GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, hour) = 1""",
    "argmax_embedding": "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings",
    "ctc_collapse": f"""
        WITH s AS (SELECT user_id, event_id, value, list_position([{_MARKS}], event_type) - 1 AS b FROM events),
        e AS (SELECT *, b <> 0 AND b <> coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS emit FROM s)
        SELECT user_id, count(*) FILTER (emit) AS n, round(coalesce(avg(value) FILTER (emit), 0), 6) AS confidence FROM e GROUP BY 1""",
    "box_arithmetic": """
        WITH b AS (SELECT p_partkey, p_size, (p_size * 13 + 1)::DOUBLE AS w, (p_partkey % 60 + 2)::DOUBLE AS h, CASE WHEN p_partkey % 2 = 0 THEN p_size % 8 + 1 ELSE 0 END AS g, p_size * 40 AS width FROM part),
        u AS (SELECT *, greatest(1.0::DOUBLE, w * h * 1.5::DOUBLE / (2 * (w + h))) AS grow, CASE WHEN width < 1000 THEN 3 ELSE 4 END AS k FROM b)
        SELECT p_partkey, greatest(320, floor(48 * w / h)::BIGINT + 1) AS width, round(grow, 6) AS grow, least(w, h) >= 3 AND least(w, h) + 2 * grow >= 5 AS keep,
               CASE WHEN g >= 4 THEN g - 1 ELSE k END AS n_columns, CASE WHEN g >= 4 THEN (g - 1) * 40 - 2 ELSE u.width END AS "right" FROM u""",
    "batch_pad_width": """
        WITH b AS (SELECT doc_id, lang, n_chars, ((row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) // 16)::INT AS batch FROM documents)
        SELECT doc_id, lang, batch, (ceil(max(n_chars) OVER (PARTITION BY lang, batch) / 8) * 8)::BIGINT AS padded FROM b""",
    "nest_schedule": """
        SELECT o_custkey, count(DISTINCT o_orderkey) AS n_orders, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity, min(o_orderkey) AS first_order
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "stage_timings": """
        SELECT event_type AS stage, round(avg(floor(s / 1000)), 6) AS mean_ms FROM (SELECT user_id, event_type, sum(floor(value * 1000)) AS s FROM events GROUP BY 1, 2) GROUP BY 1""",
    "raw_dump": """
        SELECT n_regionkey, string_agg(printf('y=%d x=%d c=%.3f %s', n_nationkey * 7 % 25, n_nationkey % 4, n_nationkey / 8, n_name) || chr(10), '' ORDER BY n_nationkey * 7 % 25, n_nationkey % 4, n_nationkey) AS dump
        FROM nation GROUP BY 1""",
    "stream_single_flight": "SELECT DISTINCT user_id, event_type FROM events",
}
ORACLE_SQL["flagship"] = """
    WITH c AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s,
               max((event_type = 'signup')::INT) OVER (PARTITION BY user_id) AS marked FROM events),
    d AS (SELECT *, greatest(s, 1) AS day_no FROM c WHERE marked = 1),
    k AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, day_no ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
          sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, day_no) AS t FROM d),
    r AS (SELECT user_id, day_no, least(k, greatest(t - 1, 0)) AS entry_no, count(*) AS n, round(sum(value), 2) AS value FROM k GROUP BY ALL),
    f AS (SELECT r.*, coalesce(c_name, '') AS name FROM r LEFT JOIN customer ON c_custkey = user_id),
    v AS (SELECT *, CASE WHEN n > 1 THEN 0.35 ELSE 0 END + CASE WHEN name <> '' THEN 0.30 ELSE 0 END + CASE WHEN value > 0 THEN 0.20 ELSE 0 END + 0.05 AS score FROM f)
    SELECT user_id, name, count(DISTINCT day_no) AS n_days, count(*) AS n_entries, sum(n)::BIGINT AS n_events, max(score)::DOUBLE AS best, arg_min(value, day_no * 1000000 + entry_no) AS first_value
    FROM v GROUP BY 1, 2"""
ORACLE_SQL |= roster_oracle.ORACLE_SQL
ORACLE_SQL["stream_week_state"] = ORACLE_SQL["iso_week_state"]
