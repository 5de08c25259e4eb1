"""Queries over whole parse results: pages, linkage and validation.

The driver's tables hold no schedules, so each query plants them: every customer
becomes a page of lines, every nation a catalog row, every web page gets a duty
section. What is planted follows from keys, so SQL can say what must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom import schema
from rosterloom.functions import raster
from rosterloom.operators import catalog as cat
from rosterloom.operators import judge, report
from rosterloom.plans import roster
from rosterloom.sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIGITS, GREEK = "0123456789", "ΑΒΓΔΕΖΗΙΚΛ"
#: Numbers of customers' entries run over this many; nations have the first 25 of them.
NUMBERS = 40


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(n: Column) -> Column:
    return F.translate(F.lpad(n.cast("string"), 4, "0"), DIGITS, GREEK)


def _number(n: Column) -> Column:
    return F.concat(F.lit("28310"), (F.lit(10000) + n).cast("string"))


def planted_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A row per nation. The address differs from what pages say; nations 3 and 4 share a number."""
    k = F.col("n_nationkey")
    number = _number(F.when(k == 4, 3).otherwise(k))
    columns = {"ref_no": k.cast("int"), "name": F.concat(F.lit("Μαρία "), _letters(k)), "address": F.concat(F.lit("Οδός "), (k + 50).cast("string")), "phone": number}
    rows = table(spark, d, "nation").select(*(c.alias(n) for n, c in columns.items()))
    return spark.createDataFrame([], schema.CATALOG).unionByName(rows, allowMissingColumns=True).na.fill("", ["name_latin", "address_latin"])


def planted_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A page per customer: a date, a day shift with a full entry, and a night
    shift with an entry without a number."""
    key = F.col("c_custkey")
    number = key % NUMBERS
    said = [
        (100, F.date_format(F.date_add(F.lit("2026-08-01").cast("date"), (key % 60).cast("int")), "dd/MM/yyyy")),
        (130, F.lit("08:00-21:00")),
        (160, F.concat(F.lit("ΜΑΡΙΑ "), _letters(number))),
        (190, F.concat(F.lit("ΟΔΟΣ "), (key % 9 + 1).cast("string"))),
        (220, F.concat(F.lit("ΤΗΛ. 28310 "), (F.lit(10000) + number).cast("string"))),
        (300, F.lit("21:00-08:00")),
        (330, F.concat(F.lit("ΓΕΩΡΓΙΑ "), _letters(key % 7))),
        (360, F.concat(F.lit("ΟΔΟΣ "), (key % 5 + 1).cast("string"))),
    ]
    items = F.array(*(F.struct(F.lit(y).alias("y0"), t.alias("text")) for y, t in said))
    lines = table(spark, d, "customer").select(key.cast("string").alias("doc_id"), F.posexplode(items).alias("line_no", "l")).select(
        "doc_id", F.lit(0).alias("col_index"), "line_no", "l.text", F.lit(0.9).cast("float").alias("confidence"),
        F.lit(20).alias("x0"), "l.y0", F.lit(300).alias("x1"), (F.col("l.y0") + 20).alias("y1"),
    )
    box = {"col_index": 0, "x0": 0, "y0": 50, "x1": 500, "y1": 1000}
    columns = table(spark, d, "customer").select(key.cast("string").alias("doc_id"), *(F.lit(v).alias(n) for n, v in box.items()))
    return lines, columns


def _shown(flat: DataFrame) -> DataFrame:
    return flat.select(
        "doc_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "day_name", "shift_no", "from_time", "to_time", "entry_no", "name", "address", "phone",
        F.coalesce("filled", F.lit(False)).alias("filled"), "match_no", "discrepancy", F.array_join("warnings", "; ").alias("warnings"), F.round(F.col("score").cast("double"), 4).alias("score"),
    )


@query
def roster_parse(spark, d):
    """Lines to days, shifts, entries, linked with the catalog and validated."""
    return _shown(roster.parse(*planted_pages(spark, d), planted_catalog(spark, d)))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """A reading per customer: a known number with its name or with another one, an unknown number, or none."""
    key = F.col("c_custkey")
    kind = key % 4
    name = F.when(kind == 1, "ΨΥΧΩΣΤΡΕΦΗΣ").otherwise(F.concat(F.lit("ΜΑΡΙΑ "), _letters(key % 23)))
    phone = F.when(kind < 2, _number(key % 25)).when(kind == 2, _number(key % 25 + 60)).otherwise("")
    return table(spark, d, "customer").select(key.alias("k"), name.alias("name"), F.concat(F.lit("ΟΔΟΣ "), (key % 9).cast("string")).alias("address"), phone.alias("phone"))


@query
def validate_catalog(spark, d):
    found = cat.validate(_readings(spark, d), planted_catalog(spark, d), ["k"])
    return found.select("k", "phone_valid", "name_greek", "address_ok", "match_no", "discrepancy", F.array_join("warnings", "; ").alias("warnings"), F.round(F.col("score").cast("double"), 4).alias("score"))


@query
def catalog_pick_shared(spark, d):
    """Which of the entries under one number a reading means."""
    pairs = cat.candidates(_readings(spark, d).where("phone <> ''"), planted_catalog(spark, d), ["k"])
    return cat.pick_reference(pairs, ["k"]).groupBy("ref_no").agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query
def unmatched_customers(spark, d):
    found = cat.unmatched(_readings(spark, d), planted_catalog(spark, d))
    return found.select("k", cat.entry_label().alias("label"))


@query
def multi_key_explode_join(spark, d):
    """Suppliers as a catalog with two numbers each, joined by number."""
    key = F.col("s_suppkey")
    refs = table(spark, d, "supplier").select(key.alias("ref_no"), F.col("s_name").alias("name"), F.lit("").alias("address"), F.concat(_number(key % 50), F.lit(", "), _number(key % 50 + 50)).alias("phone"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), _number(F.col("c_custkey") % 120).alias("phone"))
    return cat.candidates(rows, refs, ["k"]).groupBy("k").agg(F.count("*").alias("n"), F.min("ref_no").alias("first"), F.max("ref_no").alias("last"))


@query
def catalog_fill_orders(spark, d):
    """Orders as entries, filled from customers."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("ref_no"), F.col("o_orderpriority").alias("name"), F.lit("").alias("address"))
    refs = table(spark, d, "customer").select(F.col("c_custkey").alias("ref_no"), F.col("c_name").alias("ref_name"), F.col("c_mktsegment").alias("ref_address"), F.col("c_acctbal").alias("ref_lat"))
    picks = rows.select("o_orderkey", "ref_no").join(refs, "ref_no")
    filled = cat.fill(rows.drop("ref_no"), picks, ["o_orderkey"], ("lat",))
    return filled.select("o_orderkey", "name", "address", "lat", "filled")


@query
def last_wins_score(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("phone"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("float").alias("score"))
    found = cat.last_score_by_phone(rows, ["l_orderkey", "l_linenumber", "l_partkey", "score"])
    return found.groupBy("phone").agg(F.count("*").alias("n"), F.max("confidence").cast("double").alias("confidence"), F.countDistinct("confidence").alias("kinds"))


@query
def link_enrichment(spark, d):
    """Nations' catalog linked with customers as enriched records by number."""
    key = F.col("c_custkey")
    block = F.struct(F.concat(F.lit("Μαρία "), _letters(key % 31)).alias("name"), _number(key % 31).alias("phone"))
    rows = table(spark, d, "customer").select(
        block.alias("source"), (key % 5 != 0).alias("matched"), F.lpad(key.cast("string"), 6, "0").alias("placeId"), F.lit("").alias("name"), F.lit("").alias("phone"), (key / 8).alias("latitude"), F.lit(24.0).alias("longitude")
    )
    golden = spark.createDataFrame([], schema.GOLDEN).unionByName(rows, allowMissingColumns=True)
    found = cat.link_enrichment(planted_catalog(spark, d), golden, order="placeId")
    return found.select("ref_no", "lat", "lon", F.col("google.place_id").alias("place_id"))


def _duty(day: str, first: str) -> str:
    return f"""<h3 class="duty-date">{day}</h3><table><tr class="duty-time"><td>08:00 έως - 21:00</td></tr>
<tr><td class="pharmacy-title">Φαρμακείο &amp; {first}</td> <td class="pharmacy-address">Οδός 5, 28310 26115</td></tr></table>"""


@query
def duty_days(spark, d):
    """Duty sections planted into the web pages."""
    day = (F.col("page_id") % 28 + 1).cast("string")
    parts = _duty("Δευτέρα {} Αυγούστου 2026", "Α").split("{}")
    section = F.concat(F.lit(parts[0]), day, F.lit(parts[1]), F.lit('<h3 class="duty-date">Σάββατο 5 Σεπτεμβρίου 2026</h3>'))
    pages = table(spark, d, "pages").select("page_id", F.concat("html", section).alias("html"))
    found = html.duty_days(pages)
    return found.select("page_id", "day_no", F.date_format("date", "yyyy-MM-dd").alias("date"), "day_name", "shift_no", "from_time", "to_time", "entry_no", "name", "address", "phone")


@query
def catalog_rows(spark, d):
    """Blocks of a catalog planted into the web pages."""
    block = F.concat(F.lit("<h3>Φαρμακείο "), F.col("page_id").cast("string"), F.lit(" | Οδός 7</h3><p>Τηλέφωνο:</p> <p> 28310 "), (F.col("page_id") + 10000).cast("string"), F.lit("</p>"))
    pages = table(spark, d, "pages").select("page_id", F.concat("html", block).alias("html"))
    return html.catalog_rows(pages).select("page_id", "entry_no", "name", "address", "phone")


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 x 8 grey pictures: 64 where a component is negative, else 192."""
    byte = F.transform("embedding", lambda v: F.when(v < 0, "40").otherwise("C0"))
    data = F.unhex(F.array_join(byte, ""))
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.struct(data.alias("data"), F.lit(8).alias("w"), F.lit(8).alias("h")).alias("img"))


@query
def tensor_normalize(spark, d):
    planes = _pictures(spark, d).select("vec_id", raster.tensor_planes("img").alias("t"))
    return planes.select("vec_id", F.size("t").cast("long").alias("n"), F.round(F.aggregate("t", F.lit(0.0), lambda a, b: a + b), 3).alias("total"))


@query
def raster_shrink(spark, d):
    """Area means of 2 x 2 boxes, and the middle cut out."""
    box = F.struct(*(F.lit(v).alias(n) for n, v in (("x0", 2), ("y0", 2), ("x1", 6), ("y1", 99))))
    found = _pictures(spark, d).select("vec_id", raster.shrunk("img", F.lit(4), F.lit(4)).alias("s"), raster.cropped("img", box).alias("c"))
    return found.select("vec_id", F.lower(F.hex(F.substring("s.data", 1, 4))).alias("top"), F.octet_length("s.data").alias("n"), F.col("c.w").alias("w"), F.col("c.h").alias("h"))


@query
def token_usage(spark, d):
    used = F.struct(F.char_length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    return report.token_usage(table(spark, d, "conversations").select("role", used.alias("usage")), ["role"])


@query
def decision_puts(spark, d):
    """Events as puts of decisions by user: the last one replaces the others."""
    puts = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("decided_at"), "event_id", "value")
    return judge.latest_decisions(puts)

