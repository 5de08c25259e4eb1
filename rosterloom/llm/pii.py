"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Entities (email, ip, card, phone) are found by expressions. What their
surroundings give away is then estimated from the corpus: for a term t in the
context of an entity kind c,

    PMI(t; c) = log2(n(t, c) * N / (n(t) * n(c)))     IC(c) = -log2(n(c) / N)

with counts over all documents. PMI(t; c) = IC(c) would mean that t never occurs
without c. Terms whose share PMI / IC reaches ``generalise`` are replaced by a
class mark, those that reach ``remove`` are removed, wherever they stand in the
corpus. A term must have been seen in the contexts of ``support`` documents.

The expressions are possessive forms of the plain ones: repeated groups need no
stack in Java's matcher, and an email's or address's first run is only tried
where it begins or where the last match ended. Matches are placed and texts
rewritten as in ``spans``, so a text of n signs and m matches takes time in the
order of n + m log m. Spans are in code points, end exclusive.

Null and empty texts have no spans; an empty table gives an empty one. Equal rows
give equal results, and rows of equal or null id are told apart by their text.
Extra columns are not read, whatever their names; sanitise passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.scratch import Scratch
from rosterloom.llm.spans import apart, blocks, let, matches, piece, replaced

#: Kinds in their order within equal starts.
KINDS = ("email", "ip", "card", "phone", "term")
BASE = KINDS[:4]
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
# a maximal run of digits with single separators, if it has twelve digits
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_TERM = r"\p{L}{2,}+"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _of_kind(text: Column, kind: str) -> Column:
    """The passing matches of one kind: array of (start, no, end)."""
    no = KINDS.index(kind)
    pattern = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}[kind]
    passes = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["found"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda s: F.char_length(_digits(s["found"])).between(12, 19) & _luhn(_digits(s["found"])),
        "phone": lambda s: F.char_length(_digits(s["found"])).between(9, 15),
    }[kind]
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": text.contains("+")}[kind]
    found = F.transform(F.filter(matches(text, pattern), passes), lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end")))
    return F.when(may, found).otherwise(F.array().cast("array<struct<start:int,no:int,end:int>>"))


def base_spans(text: Column) -> Column:
    """All entities in order: array of (start, no, end)."""
    return F.array_sort(F.concat(*(_of_kind(text, k) for k in BASE)))


def _context(cut: Column, span: Column, words: int, reach: int) -> Column:
    """The terms next to an entity of a text cut in blocks: array of (no, term, start, end)."""
    left = F.greatest(span["start"] - reach, F.lit(0))
    before = matches(piece(cut, left, span["start"] - left), _TERM)
    after = matches(piece(cut, span["end"], F.lit(reach)), _TERM)
    # a run cut by the reach is no whole term
    before = F.filter(before, lambda s: (s["start"] > 0) | (left == 0))
    after = F.filter(after, lambda s: s["end"] < reach)

    def placed(spans: Column, shift: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(span["no"].alias("no"), F.lower(s["found"]).alias("term"), (shift + s["start"]).alias("start"), (shift + s["end"]).alias("end")))

    near = let(before, lambda x: F.when(F.size(x) > words, F.slice(x, -words, words)).otherwise(x))
    return F.concat(placed(near, left), placed(F.slice(after, 1, words), span["end"]))


def contexts(text: Column, spans: Column, words: int, reach: int) -> Column:
    """The terms next to all entities, those apart from every entity."""

    def found(cut: Column) -> Column:
        return F.flatten(F.transform(spans, lambda s: _context(cut, s, words, reach)))

    every = F.transform(let(blocks(text), found), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["no"].alias("no"), c["term"].alias("term")))
    return let(every, lambda some: apart(some, spans))


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def disclosing_terms(
    df: DataFrame,
    scratch: Scratch,
    words: int = 5,
    reach: int = 100,
    support: int = 5,
    generalise: float = 0.8,
    remove: float = 0.95,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, key (of the text), hits map<term, removed>: one row per text that holds
    terms to hide, anywhere in it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = "array<struct<start:int,end:int,no:int,term:string>>"
    read = df.select(F.col(id_col).alias("id"), text.alias("text"))
    entities = read.withColumn("spans", base_spans(F.col("text"))).select(
        "id",
        _key(F.col("text")).alias("key"),
        F.regexp_count("text", F.lit(_TERM)).cast("long").alias("n_terms"),
        "spans",
        F.when(F.size("spans") > 0, contexts(F.col("text"), F.col("spans"), words, reach)).otherwise(F.array().cast(none)).alias("context"),
    )
    entities = scratch.keep(entities)
    total = entities.agg(F.coalesce(F.sum("n_terms"), F.lit(0))).first()[0]

    context = scratch.keep(entities.select("id", "key", F.explode("context").alias("c")).select("id", "key", "c.no", "c.term"))
    by_doc = context.groupBy("term", "no", "id").agg(F.count("*").alias("n"))
    together = by_doc.groupBy("term", "no").agg(F.sum("n").alias("n_tc"), F.count("*").alias("docs"))
    kinds = context.groupBy("no").agg(F.count("*").alias("n_c"))  # a row for each kind
    everywhere = read.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    ic = -F.log2(F.col("n_c") / F.lit(total))
    pmi = F.log2(F.col("n_tc") * F.lit(total) / (F.col("n_t") * F.col("n_c")))
    shown = (
        together.where(F.col("docs") >= support)
        .join(F.broadcast(kinds), "no")
        .join(everywhere, "term")
        .select("term", "no", (pmi / F.greatest(ic, F.lit(1e-9))).alias("share"))
        .where(F.col("share") >= generalise)
        .groupBy("term")
        .agg((F.max("share") >= remove).alias("removed"))
    )
    shown = scratch.keep(shown)
    # the terms are few: their size decides whether they are broadcast
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)))).alias("found")
    held = read.select("id", _key(F.col("text")).alias("key"), found).select("id", "key", F.lower("found").alias("term")).join(shown, "term").distinct()
    return held.groupBy("id", "key").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("hits"))


def _term_spans(text: Column, hits: Column, spans: Column) -> Column:
    """All occurrences of the terms of hits apart from the entities: array of (start, end, removed)."""
    none = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    every = F.transform(matches(text, _TERM), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.try_element_at(hits, F.lower(s["found"])).alias("removed")))
    hidden = F.filter(every, lambda s: s["removed"].isNotNull())
    return F.when(hits.isNotNull(), let(hidden, lambda some: apart(some, spans))).otherwise(none)


def _with_spans(df: DataFrame, hits: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """df with _pii_spans, the entities, and _pii_terms, the terms to hide."""
    hits = scratch.keep(hits).select(F.col("id").alias("_pii_id"), F.col("key").alias("_pii_key"), F.col("hits").alias("_pii_hits"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = df.join(hits, F.col(id_col).eqNullSafe(F.col("_pii_id")) & (_key(text) == F.col("_pii_key")), "left")
    joined = joined.withColumn("_pii_spans", base_spans(text))
    return joined.withColumn("_pii_terms", _term_spans(text, F.col("_pii_hits"), F.col("_pii_spans")))


def find_pii(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row per input row: id_col and spans array<struct<kind,start,end>>, the
    entities and the disclosing terms, in order of start, then kind."""
    hits = disclosing_terms(df, scratch, id_col=id_col, text_col=text_col, **options)
    term = KINDS.index("term")
    both = _with_spans(df.select(id_col, text_col), hits, scratch, id_col, text_col)
    terms = F.transform("_pii_terms", lambda s: F.struct(s["start"].alias("start"), F.lit(term).alias("no"), s["end"].alias("end")))
    every = F.array_sort(F.concat("_pii_spans", terms))
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(every, lambda s: F.struct(F.get(names, s["no"]).alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    return both.select(id_col, named.alias("spans"))


def rewrite(text: Column, spans: Column, terms: Column) -> Column:
    """The text with entities and generalised terms as marks, and removed terms gone."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    entity = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(marks, s["no"]).alias("mark")))
    term = F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], F.lit("")).otherwise(F.lit("[TERM]")).alias("mark")))
    return replaced(text, F.array_sort(F.concat(entity, term)))


def sanitise(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """df with the text rewritten; all other columns as they are. Null stays null."""
    hits = disclosing_terms(df, scratch, id_col=id_col, text_col=text_col, **options)
    joined = _with_spans(df, hits, scratch, id_col, text_col)
    new = rewrite(F.col(text_col), F.col("_pii_spans"), F.col("_pii_terms"))
    changed = (F.size("_pii_spans") > 0) | (F.size("_pii_terms") > 0)
    return joined.withColumn(text_col, F.when(changed, new).otherwise(F.col(text_col))).select(*df.columns)
