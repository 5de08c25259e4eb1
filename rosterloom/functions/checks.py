"""Line predicates, field checks, scores and gates as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.dates import DAY_NAMES
from rosterloom.functions.text import count_digits, digits_only, trim_space, upper_plain

# --- fixed values ---------------------------------------------------------
STOP_WORDS = ("ΤΗΛ", "ΤΗΛ.", "ΤΗΛ/", "THL", "THL.", "ΦΑΡΜΑΚΕΙΟ", "ΕΦΗΜΕΡΙΕΣ")
DESCRIPTION_PREFIXES = ("ΕΝΑΝΤΙ", "ΑΠΕΝΑΝΤΙ", "ΚΑΤΩ", "ΠΛΗΣΙΟΝ", "ΑΠΕΝΑΝΤΙΑ", "ΔΙΠΛΑ", "ΣΩΜΑΤΕΙΟ", "ΣΩΜΑ", "ΕΝΑΝΤΙΑ", "ΠΕΡΙΟΧΗ")
ADDRESS_WORDS = ("ΟΔΟΣ", "ΣΤΡ", "ΛΕΩΦ", "ΠΛΑΤΕΙΑ", "ΠΛ.", "ΟΔ", "STR", "STREET")
#: Upper case; every longer street word holds one of these.
STREET_STEMS = ("STR", "ΟΔ", "ΣΤΡ", "ΛΕΩΦ", "ΠΛ")
PHONE_WORDS = ("ΤΗΛ", "THL")
GREEK_IN_LINE = r"[Α-Ωα-ωάέήίόύώΐΰ]"
READABLE = r"[Α-Ωα-ωάέήίόύώΐΰA-Za-z0-9]"
GREEK_IN_NAME = r"[Α-Ωα-ωάέήίόύώ]"
DATE_LINE = r"^\d{1,2}[/.]\d{1,2}[/.]\d{4}$"
TIME_LINE = r"^\d{1,2}:\d{2}\s*[-–—]\s*\d{1,2}:\d{2}$"
PHONE = r"^2\d{9}$"
TIME = r"^([01]\d|2[0-3]):[0-5]\d$"
WEIGHTS = {"phone": 0.35, "name": 0.30, "address": 0.20, "time": 0.05, "match": 0.10}
WARNINGS = {
    "phone": "phone does not match Greek landline format",
    "name": "name lacks plausible Greek characters",
    "address": "address lacks street number or known street pattern",
}
# --------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _holds(upper: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (upper.contains(w) for w in words))


def _phone(upper: Column) -> Column:
    n = count_digits(upper)
    return (_holds(upper, PHONE_WORDS) & (F.char_length(digits_only(upper)) >= 6)) | ((n >= 6) & (n / F.greatest(F.char_length(upper), F.lit(1)) > 0.5))


def _name(x: Column, upper: Column) -> Column:
    described = F.lit(False)
    for prefix in DESCRIPTION_PREFIXES:
        described = described | upper.startswith(prefix)
    return x.rlike(GREEK_IN_LINE) & ~x.rlike("[0-9]") & (F.char_length(upper) >= 3) & ~upper.isin(*STOP_WORDS) & ~described


def _address(x: Column, upper: Column) -> Column:
    return _holds(upper, STREET_STEMS) | (x.rlike("[0-9]") & (F.char_length(x) > 6) & ~x.rlike(GREEK_IN_LINE))


def _junk(trimmed: Column) -> Column:
    return trimmed.isin("", "/", "-", ".") | ~trimmed.rlike(READABLE)


def is_date_line(c: Column | str) -> Column:
    return trim_space(c).rlike(DATE_LINE)


def is_time_line(c: Column | str) -> Column:
    return trim_space(c).rlike(TIME_LINE)


def is_phone_line(c: Column | str) -> Column:
    """A phone word with six digits (read leniently), or mostly digits."""
    return _phone(upper_plain(trim_space(c)))


def looks_like_address(c: Column | str) -> Column:
    """A street word, or a number in a line that can be no Greek name."""
    return _address(_col(c), upper_plain(c))


def looks_like_name(c: Column | str) -> Column:
    return _name(_col(c), upper_plain(trim_space(c)))


def is_junk(c: Column | str) -> Column:
    """Nothing but a separator, or no Greek letter, Latin letter or ASCII digit."""
    return _junk(trim_space(c))


def has_time_or_date(c: Column | str) -> Column:
    x = _col(c)
    return x.contains(":") & (x.contains("-") | x.contains("/"))


def is_day_name(c: Column | str) -> Column:
    return upper_plain(trim_space(c)).isin(*DAY_NAMES)


def line_kind(c: Column | str) -> Column:
    """phone, skip, address or name; the first rule that fits decides."""
    x = _col(c)
    return _kind(x, trim_space(x), upper_plain(trim_space(x)))


def with_line_kind(df: DataFrame, line: str, out: str) -> DataFrame:
    """line_kind as a column of df; a line is trimmed and upper-cased once, in
    projections of their own, which Catalyst keeps apart."""
    trimmed = df.withColumn("_trimmed", trim_space(line))
    upper = trimmed.withColumn("_upper", upper_plain("_trimmed"))
    return upper.withColumn(out, _kind(F.col(line), F.col("_trimmed"), F.col("_upper"))).drop("_trimmed", "_upper")


def _kind(x: Column, trimmed: Column, upper: Column) -> Column:
    return (
        F.when(_phone(upper), "phone")
        .when(_junk(trimmed), "skip")
        .when(has_time_or_date(x) | trimmed.rlike(DATE_LINE) | upper.isin(*DAY_NAMES), "skip")
        .when(_address(x, upper), "address")
        .when(_name(x, upper), "name")
        .when(x.rlike("[0-9]"), "address")
        .otherwise("name")
    )


def valid_phone(c: Column | str) -> Column:
    return _col(c).rlike(PHONE)


def valid_time(c: Column | str) -> Column:
    return _col(c).rlike(TIME)


def greek_name(c: Column | str) -> Column:
    """Three signs or more, two Greek letters or more, no digit."""
    x = trim_space(c)
    return (F.char_length(x) >= 3) & (F.regexp_count(x, F.lit(GREEK_IN_NAME)) >= 2) & ~x.rlike("[0-9]")


def valid_address(c: Column | str) -> Column:
    x = upper_plain(_col(c))
    found = x.rlike("[0-9]")
    for word in ADDRESS_WORDS:
        found = found | x.contains(word)
    return found


def score(phone: Column, name: Column, address: Column, match: Column, time: Column | None = None) -> Column:
    """The float32 sum of the weights of what holds."""
    total = F.lit(0.0).cast("float")
    for key, holds in (("phone", phone), ("name", name), ("address", address), ("time", F.lit(True) if time is None else time), ("match", match)):
        total = F.when(holds, (total + F.lit(WEIGHTS[key]).cast("float")).cast("float")).otherwise(total)
    return total


def field_warnings(phone: Column | str, name: Column | str, address: Column | str) -> Column:
    """The fixed warnings of fields that are given and fail, in order."""
    phone, name, address = map(_col, (phone, name, address))
    return F.array_compact(
        F.array(
            F.when(~valid_phone(phone) & (phone != ""), WARNINGS["phone"]),
            F.when(~greek_name(name) & (name != ""), WARNINGS["name"]),
            F.when(~valid_address(address) & (address != ""), WARNINGS["address"]),
        )
    )


def accept_identity(choice: Column | str, confidence: Column | str, same: Column | str, least_confidence: float, least_same: float) -> Column:
    """Whether a verdict passes both gates; -1 means not asked and never passes."""
    confidence, same = _col(confidence), _col(same)
    return (_col(choice) != "none") & (confidence >= 0) & (same >= 0) & (confidence >= least_confidence) & (same >= least_same)


def route_merge(value: Column | str, confidence: Column | str, least_confidence: Column | float) -> Column:
    """different, curator or same by the rounded score; an unsure same goes to the curator."""
    least = least_confidence if isinstance(least_confidence, Column) else F.lit(least_confidence)
    level = F.least(F.greatest(F.floor(_col(value) + 0.5).cast("int"), F.lit(0)), F.lit(2))
    return outcome_name(F.when((level == 2) & (_col(confidence) < least), F.lit(1)).otherwise(level))


def outcome_name(level: Column) -> Column:
    return F.element_at(F.array(F.lit("different"), F.lit("curator"), F.lit("same")), level.cast("int") + 1)


def implausible_fields(name: Column | str, address: Column | str, name_gate: float, address_gate: float) -> Column:
    """The fields that were asked about and fall below their gate; a zero gate is off."""
    name, address = _col(name), _col(address)
    return F.array_compact(F.array(F.when((name >= 0) & (name < name_gate), "name"), F.when((address >= 0) & (address < address_gate), "address")))
