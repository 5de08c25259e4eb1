"""Catalog linkage: multi-valued keys, top-1 picks, fuzzy search, fill, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.functions import checks, text
from rosterloom.operators.geometry import BLOCK_ITEMS, against_blocks
from rosterloom.scratch import Scratch

# --- fixed values ---------------------------------------------------------
FUZZY_MATCH, FUZZY_HINT, NAME_MISMATCH = 0.55, 0.30, 0.45
NOTE_MISMATCH = "name mismatch with catalog (%s vs %s)"
NOTE_CLOSEST = "phone not found in catalog for %s (closest: %s %s)"
NOTE_HINT = "no catalog match for %s (closest: %s)"
SHIFT_TIMES = "invalid shift times %s-%s on %s"
LABEL_PHONE, LABEL_ENTRY, LABEL_NONE = "phone %s", 'entry "%s"', "entry without phone or name"
# --------------------------------------------------------------------------


def by_phone(catalog: DataFrame) -> DataFrame:
    """One row per catalog entry and phone number: the multi-valued key exploded."""
    return catalog.withColumn("digits", F.explode(F.array_distinct(text.phones("phone"))))


def by_name(catalog: DataFrame) -> DataFrame:
    """One entry per name key, the first in the catalog."""
    keyed = catalog.withColumn("key", text.name_key("name")).where("key <> ''")
    first = Window.partitionBy("key").orderBy("ref_no")
    return keyed.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def candidates(entries: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Every catalog entry under an entry's number: ref_* columns, 1:n."""
    refs = by_phone(catalog).select("digits", *(F.col(c).alias(f"ref_{c}" if c != "ref_no" else c) for c in catalog.columns))
    return entries.withColumn("digits", text.digits_only("phone")).where("digits <> ''").join(refs, "digits")


def top1(df: DataFrame, keys: list[str], score: Column, ties: list[Column | str], out: str = "score") -> DataFrame:
    """The best row of each key by score, then by the ties in order. A key with
    one row needs no score; there out is null."""
    alone = Window.partitionBy(*keys)
    scored = df.withColumn("_n", F.count("*").over(alone)).withColumn(out, F.when(F.col("_n") > 1, score))
    best = Window.partitionBy(*keys).orderBy(F.col(out).desc_nulls_last(), *ties)
    return scored.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn", "_n")


def _plain(c: Column) -> Column:
    return text.upper_plain(text.trim_space(c))


def pick_reference(pairs: DataFrame, keys: list[str], spaced: bool = True) -> DataFrame:
    """One reference per entry by name and address similarity; ties go to the
    smaller name, then to the earlier row."""
    form = text.normalize_text if spaced else text.name_key
    # a similarity names its arguments several times, so they are columns of their own
    forms = {f"_{c}": form(c) for c in ("name", "ref_name")}
    forms |= {f"_{c}": text.transliterate(text.normalize_text(c)) for c in ("address", "ref_address")}
    formed = pairs.withColumns({k: _plain(c) for k, c in forms.items()})
    formed = formed.withColumns({f"{c}_latin": _plain(text.transliterate(c)) for c in ("_name", "_ref_name")})
    near = [text.similarity_prepared(F.col(a), F.col(b)) for a, b in (("_name_latin", "_ref_name_latin"), ("_name", "_ref_name"), ("_address", "_ref_address"))]
    return top1(formed, keys, F.greatest(*near), ["ref_name", "ref_no"]).drop(*forms, "_name_latin", "_ref_name_latin")


def most_similar(names: DataFrame, name: str, others: DataFrame, other: str, score: Callable[[Column, Column], Column], block: int = BLOCK_ITEMS) -> DataFrame:
    """The distinct names with best_name, the most similar of the others (itself
    excepted where it is one of them by the score's caller), ties to the smaller,
    and best_score. Names are held against blocks of others; no pair is a row."""
    asked = names.select(F.col(name).alias("_name")).distinct()
    items = others.select(F.col(other).alias("_other")).distinct()

    def best(some: Column) -> Column:
        scored = F.transform(some, lambda o: F.struct((-score(F.col("_name"), o)).alias("s"), o.alias("n")))
        return F.array_min(F.filter(scored, lambda x: x["s"].isNotNull()))

    found = against_blocks(asked, "_name", items, F.col("_other"), best, "_best", block)
    return found.select("_name", F.col("_best.n").alias("best_name"), (-F.col("_best.s")).alias("best_score"))


def fuzzy_best(entries: DataFrame, names: DataFrame, key: str, name: str, ref_name: str, unit: str = "bytes", block: int = BLOCK_ITEMS) -> DataFrame:
    """Each entry's most similar catalog name, ties to the smaller name:
    best_name, best_score, and level (match, hint or none). Distinct names are
    normalised once and compared, not rows."""
    # both sides are prepared before they meet, so a comparison is one edit distance each way
    prepared = lambda df, c: df.select(F.col(c).alias("name")).distinct().withColumn("key", text.name_key("name")).withColumn("latin", text.transliterate("key"))
    sides = [prepared(d, c).select(F.struct("name", "key", "latin").alias("x")) for d, c in ((entries, name), (names, ref_name))]
    near = lambda a, b: F.greatest(text.similarity_prepared(a["latin"], b["latin"], unit), text.similarity_prepared(a["key"], b["key"], unit))
    best = most_similar(sides[0], "x", sides[1], "x", near, block).select(F.col("_name.name").alias("_name"), F.col("best_name.name").alias("best_name"), "best_score")
    level = F.when(F.col("best_score") >= FUZZY_MATCH, "match").when(F.col("best_score") >= FUZZY_HINT, "hint").otherwise("none")
    return entries.join(best.withColumn("level", level), F.col(name) == F.col("_name"), "left").drop("_name")


def fill(entries: DataFrame, picks: DataFrame, keys: list[str], catalog_columns: tuple[str, ...] = ("name_latin", "address_latin", "lat", "lon", "google")) -> DataFrame:
    """Overwrites name and address by the upper-cased catalog values where a pick
    exists, copies the enrichment, and says whether anything changed."""
    refs = picks.select(*keys, "ref_no", "ref_name", "ref_address", *(F.col(f"ref_{c}").alias(c) for c in catalog_columns))
    joined = entries.drop(*catalog_columns).join(refs, keys, "left")
    matched = F.col("ref_no").isNotNull()
    upper = lambda c: text.upper_plain(text.normalize_text(c))
    new = {f: F.when(matched & (F.col(f"ref_{f}") != ""), upper(f"ref_{f}")).otherwise(F.col(f)) for f in ("name", "address")}
    changed = matched & ((new["name"] != F.col("name")) | (new["address"] != F.col("address")))
    return joined.withColumn("filled", changed).withColumns(new).drop("ref_name", "ref_address")


def unmatched(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries whose number is not in the catalog and that are not blank."""
    known = by_phone(catalog).select("digits").distinct()
    asked = entries.withColumn("digits", text.digits_only("phone")).where((F.col("name") != "") | (F.col("address") != ""))
    return asked.join(known, "digits", "left_anti")


def entry_label(phone: Column | str = "phone", name: Column | str = "name") -> Column:
    phone, name = (F.col(c) if isinstance(c, str) else c for c in (phone, name))
    return F.when(phone != "", F.format_string(LABEL_PHONE, phone)).when(name != "", F.format_string(LABEL_ENTRY, name)).otherwise(LABEL_NONE)


def validate(entries: DataFrame, catalog: DataFrame, keys: list[str], picks: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Field checks, catalog match, discrepancy note, warnings and float32 score.
    picks: rows (keys, ref_no) that override the similarity pick. scratch: where the
    entries with their picks are written, since searching and scoring read them both."""
    pairs = candidates(entries.select(*keys, "name", "address", "phone"), catalog, keys)
    picked = pick_reference(pairs, keys, spaced=False).select(*keys, "ref_no", "ref_name", F.col("ref_phone").alias("ref_phone"))
    if picks is not None:
        refs = catalog.select(F.col("ref_no").alias("_no"), F.col("name").alias("_name"), F.col("phone").alias("_phone"))
        other = picks.select(*keys, F.col("ref_no").alias("_no")).join(refs, "_no")
        picked = picked.join(other, keys, "left").select(*keys, F.coalesce("_no", "ref_no").alias("ref_no"), F.coalesce("_name", "ref_name").alias("ref_name"), F.coalesce("_phone", "ref_phone").alias("ref_phone"))
    digits = text.digits_only("phone")
    joined = entries.join(picked, keys, "left")
    joined = joined if scratch is None else scratch.keep(joined)
    # names are only searched where the number is given and unknown
    lost = joined.where(F.col("ref_no").isNull() & (F.col("phone") != "") & (text.name_key("name") != "")).select(*keys, "name")
    names = by_name(catalog).select(F.col("name").alias("cat_name"), F.col("phone").alias("cat_phone"), F.col("ref_no").alias("cat_no"))
    near = fuzzy_best(lost, names, keys[0], "name", "cat_name").join(names.withColumnRenamed("cat_name", "best_name"), "best_name", "left")
    joined = joined.join(near.select(*keys, "best_name", "best_score", "level", "cat_phone", "cat_no"), keys, "left")
    by_number = F.col("ref_no").isNotNull()
    joined = joined.withColumns({f"_{c}": _plain(text.transliterate(c)) for c in ("name", "ref_name")})
    mismatch = text.similarity_prepared(F.col("_name"), F.col("_ref_name")) < NAME_MISMATCH
    note = (
        F.when(by_number & mismatch & (F.col("name") != ""), F.format_string(NOTE_MISMATCH, "name", "ref_name"))
        .when(F.col("level") == "match", F.format_string(NOTE_CLOSEST, "name", "best_name", "cat_phone"))
        .when(F.col("level") == "hint", F.format_string(NOTE_HINT, "name", "best_name"))
        .otherwise("")
    )
    match = F.when(by_number, F.col("ref_no")).when(F.col("level") == "match", F.col("cat_no"))
    out = joined.withColumns(
        {
            "phone_valid": checks.valid_phone("phone"),
            "name_greek": checks.greek_name("name"),
            "address_ok": checks.valid_address("address"),
            "time_valid": F.lit(True),
            "match_no": match,
            "discrepancy": note,
            "warnings": checks.field_warnings("phone", "name", "address"),
            "_digits": digits,
        }
    )
    clean = F.col("match_no").isNotNull() & (F.col("discrepancy") == "")
    return out.withColumn("score", checks.score(F.col("phone_valid"), F.col("name_greek"), F.col("address_ok"), clean)).drop("ref_no", "ref_name", "ref_phone", "best_name", "best_score", "level", "cat_phone", "cat_no", "_digits", "_name", "_ref_name")


def shift_time_warnings(shifts: DataFrame) -> DataFrame:
    """One warning per shift with an invalid time, not one per entry."""
    bad = ~(checks.valid_time("from_time") & checks.valid_time("to_time"))
    return shifts.where(bad).withColumn("warning", F.format_string(SHIFT_TIMES, "from_time", "to_time", F.date_format("date", "dd/MM/yyyy")))


def last_score_by_phone(validated: DataFrame, order: list[str], default: float = 0.6) -> DataFrame:
    """Confidence by number: the last score of each number counts for all its
    rows, also for empty numbers; unknown numbers get the default."""
    last = validated.groupBy("phone").agg(F.max_by("score", F.struct(*order)).alias("_last"))
    return validated.join(last, "phone", "left").withColumn("confidence", F.coalesce("_last", F.lit(default).cast("float"))).drop("_last")


def scores_onto(entries: DataFrame, scores: DataFrame, default: float = 0.6) -> DataFrame:
    """Left join of (phone, score) with a default."""
    return entries.join(scores.select("phone", F.col("score").alias("confidence")), "phone", "left").withColumn("confidence", F.coalesce("confidence", F.lit(default).cast("float")))


def enriched(golden: DataFrame, *more: str) -> DataFrame:
    """Source records (camelCase) to the catalog's enrichment: matched rows with a
    number, photos without content dropped, the block null when it is empty."""
    hours = lambda c: F.when(
        F.col(c).isNotNull(),
        F.struct(
            F.col(f"{c}.weekdayDescriptions").alias("weekday_descriptions"),
            F.transform(f"{c}.periods", lambda p: F.struct(p["open"].alias("open"), p["close"].alias("close"))).alias("periods"),
            F.col(f"{c}.openNow").alias("open_now"),
        ),
    )
    photos = F.transform(F.filter("photos", lambda p: F.coalesce(p["base64"], F.lit("")) != ""), lambda p: F.struct(p["contentType"].alias("content_type"), p["base64"].alias("base64")))
    block = F.struct(
        F.col("placeId").alias("place_id"), F.col("formattedAddress").alias("formatted_address"), F.col("phoneInternational").alias("phone_international"),
        F.col("websiteUrl").alias("website"), F.col("googleMapsUrl").alias("google_maps_url"), "rating", F.col("userRatingCount").alias("user_rating_count"),
        F.col("businessStatus").alias("business_status"), "types", hours("openingHours").alias("opening_hours"),
        hours("currentOpeningHours").alias("current_opening_hours"), photos.alias("photos"),
    )
    empty = (F.coalesce("placeId", F.lit("")) == "") & (F.coalesce("formattedAddress", F.lit("")) == "") & (F.coalesce(F.size(photos), F.lit(0)) <= 0)
    digits = text.digits_only(text.first_non_empty("phone", "source.phone"))
    return golden.where(F.col("matched") & (digits != "")).select(
        digits.alias("digits"), text.first_non_empty("name", "source.name").alias("name"), F.col("source.name").alias("source_name"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.when(~empty, block).alias("google"), *more,
    )


def link_enrichment(catalog: DataFrame, golden: DataFrame, floor: float = 0.4, shared_floor: float = 0.55, order: str | None = None) -> DataFrame:
    """Catalog with the best enriched record of the same number: score at least
    floor, or shared_floor where several entries share the number; ties keep the
    first record, by the column order if one is given, else as they were read. A linked record overwrites position and block, with nulls too."""
    refs = by_phone(catalog).withColumn("_refs", F.count("*").over(Window.partitionBy("digits")))
    found = enriched(golden.withColumn("_ord", F.col(order) if order else F.monotonically_increasing_id()), "_ord")
    pairs = refs.alias("r").join(found.alias("g"), "digits")
    score = text.source_name_score(F.col("r.name"), F.coalesce("g.name", F.lit("")), F.coalesce("g.source_name", F.lit("")))
    least = F.when(F.col("r._refs") > 1, shared_floor).otherwise(floor)
    good = pairs.withColumn("_score", score).where(F.col("_score") >= least)
    # the highest score, and of equal ones the first record
    best = good.groupBy("ref_no").agg(F.min_by(F.struct("g.lat", "g.lon", "g.google"), F.struct(-F.col("_score"), "_ord")).alias("_new"))
    joined = catalog.join(best, "ref_no", "left")
    hit = F.col("_new").isNotNull()
    return joined.withColumns({c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("lat", "lon", "google")}).drop("_new")
