"""HTML pages to rows: image links, duty sections, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.functions import dates, text

# --- fixed values ---------------------------------------------------------
IMAGE_URL = r"""https?://[^"'\s]+?/wp-content/uploads/\d{4}/\d{2}/(\d{2})\.(\d{2})\.(\d{4})-(\d{2})\.(\d{2})\.(\d{4})[^"'\s]*?\.(?:jpg|jpeg|png|webp)"""
THUMBNAIL = r"-\d{2,4}x\d{2,4}\.(jpg|jpeg|png|webp)$"
DAY_HEADER = r"""<h3[^>]*class="duty-date"[^>]*>([^<]+)</h3>"""
TIME_ROW = r"""<tr[^>]*class="duty-time"[^>]*><td[^>]*>(.*?)</td></tr>"""
ENTRY_ROW = r"""<tr(?:[^>]*)><td[^>]*class="pharmacy-title"[^>]*>(.*?)</td>\s*<td[^>]*class="pharmacy-address"[^>]*>(.*?)</td></tr>"""
TIME_WORDS = r"(\d{1,2}):(\d{2}).*?[\-–—].*?(\d{1,2}):(\d{2})"
PHONE_BLOCK = r"<p[^>]*>\s*Τηλέφωνο:\s*</p>\s*<p[^>]*>\s*([\d\s\-]+)\s*</p>"
HEADING = r"<h[34][^>]*>([^<]*(?:\|[^<]*)?)</h[34]>"
# --------------------------------------------------------------------------


def _all(c: Column | str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(pattern), F.lit(group))


def schedule_images(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Dated image links of each page, thumbnails dropped, each URL once, by date then place: page, ord, url, from_date, to_date."""
    parts = F.arrays_zip(_all(html, IMAGE_URL, 0).alias("url"), *(_all(html, IMAGE_URL, g).alias(f"g{g}") for g in range(1, 7)))
    found = pages.select(page, F.posexplode(parts).alias("_pos", "p")).select(page, "_pos", "p.*").where(~F.col("url").rlike(THUMBNAIL))
    date = lambda d, m, y: dates.rolled_date(*(F.col(c).cast("int") for c in (d, m, y)))
    dated = found.groupBy(page, "url").agg(F.min(F.struct("_pos", "g1", "g2", "g3", "g4", "g5", "g6")).alias("f")).select(page, "url", "f.*")
    dated = dated.select(page, "url", "_pos", date("g1", "g2", "g3").alias("from_date"), date("g4", "g5", "g6").alias("to_date"))
    return dated.withColumn("ord", F.row_number().over(Window.partitionBy(page).orderBy("from_date", "_pos"))).drop("_pos")


def _sections(c: Column, header: str) -> Column:
    """The parts of a text that begin at each match of header."""
    return F.filter(F.split(c, f"(?={header})", -1), lambda s: s.rlike("^(?:" + header + ")"))


def duty_days(pages: DataFrame, page: str = "page_id", html: str = "html", strict_phone: bool = False) -> DataFrame:
    """Two segmentations, by day header and by time row: page, day_no, date,
    day_name, shift_no, from_time, to_time, entry_no, name, address, phone. A day
    without a time row is one row with null shift."""
    days = pages.select(page, F.posexplode(_sections(F.col(html), DAY_HEADER)).alias("day_no", "day"))
    days = days.withColumn("_title", F.trim(F.regexp_extract("day", DAY_HEADER, 1)))
    days = days.withColumn("_when", dates.parse_long_date(text.basic_entities("_title")))
    shifts = days.withColumn("_times", F.filter(_sections(F.col("day"), TIME_ROW), lambda s: F.regexp_extract(s, TIME_ROW, 1).rlike(TIME_WORDS)))
    shifts = shifts.select(page, "day_no", F.col("_when.date").alias("date"), F.col("_when.day_name").alias("day_name"), F.posexplode_outer("_times").alias("shift_no", "shift"))
    words = F.regexp_extract("shift", TIME_ROW, 1)
    part = [F.regexp_extract(text.strip_tags(words, named_entities=False), TIME_WORDS, g) for g in (1, 2, 3, 4)]
    shifts = shifts.withColumn("from_time", F.concat(text.pad2(part[0]), F.lit(":"), part[1])).withColumn("to_time", F.concat(text.pad2(part[2]), F.lit(":"), part[3]))
    pairs = F.arrays_zip(_all("shift", ENTRY_ROW, 1).alias("n"), _all("shift", ENTRY_ROW, 2).alias("a"))
    rows = shifts.select("*", F.posexplode_outer(pairs).alias("entry_no", "e")).drop("shift")
    both = text.unescape_entities(text.strip_tags("e.a"))
    rows = rows.withColumn("name", text.trim_space(text.unescape_entities(text.strip_tags("e.n")))).withColumn("_both", both)
    rows = rows.withColumn("phone", text.extract_phone("_both", strict_phone))
    without = F.when(F.col("phone") == "", F.col("_both")).otherwise(F.replace("_both", F.col("phone"), F.lit("")))
    return rows.withColumn("address", F.regexp_replace(text.trim_space(without), "^[ ,]+|[ ,]+$", "")).drop("_both", "e")


def catalog_rows(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """A row per phone block: the last heading before it, cut at the first bar."""
    blocks = F.split(F.col(html), PHONE_BLOCK, -1)
    numbers = _all(html, PHONE_BLOCK, 1)
    parts = F.arrays_zip(F.slice(blocks, 1, F.size(numbers)).alias("before"), numbers.alias("number"))
    found = pages.where(F.col(html).rlike(PHONE_BLOCK)).select(page, F.posexplode(parts).alias("entry_no", "p"))
    heading = F.element_at(_all("p.before", HEADING, 1), -1)
    found = found.where(F.size(_all("p.before", HEADING, 1)) > 0).withColumn("_h", text.strip_tags(heading))
    cut = F.split("_h", r"\|", 2)
    rows = found.select(page, "entry_no", text.trim_space(cut[0]).alias("name"), text.trim_space(F.coalesce(F.get(cut, F.lit(1)), F.lit(""))).alias("address"), F.replace("p.number", F.lit(" "), F.lit("")).alias("phone"))
    return rows.where("name <> ''")
