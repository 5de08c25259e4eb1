"""Dates and times as Column expressions. Now is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.functions.text import pad2, strip_accents, trim_space, upper_plain

# --- fixed values ---------------------------------------------------------
#: Day names from Sunday on.
DAY_NAMES = ("ΚΥΡΙΑΚΗ", "ΔΕΥΤΕΡΑ", "ΤΡΙΤΗ", "ΤΕΤΑΡΤΗ", "ΠΕΜΠΤΗ", "ΠΑΡΑΣΚΕΥΗ", "ΣΑΒΒΑΤΟ")
#: Month names in the genitive, without accents, from January on.
MONTH_NAMES = (
    "ΙΑΝΟΥΑΡΙΟΥ", "ΦΕΒΡΟΥΑΡΙΟΥ", "ΜΑΡΤΙΟΥ", "ΑΠΡΙΛΙΟΥ", "ΜΑΙΟΥ", "ΙΟΥΝΙΟΥ",
    "ΙΟΥΛΙΟΥ", "ΑΥΓΟΥΣΤΟΥ", "ΣΕΠΤΕΜΒΡΙΟΥ", "ΟΚΤΩΒΡΙΟΥ", "ΝΟΕΜΒΡΙΟΥ", "ΔΕΚΕΜΒΡΙΟΥ",
)
DATE = r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})$"
TIME_RANGE = r"(\d{1,2}):(\d{2})\s*[-–—]\s*(\d{1,2}):(\d{2})"
# --------------------------------------------------------------------------


def rolled_date(day: Column, month: Column, year: Column) -> Column:
    """A date whose day and month may run over, as in 32/13."""
    start = F.make_date(year, F.lit(1), F.lit(1))
    return F.date_add(F.add_months(start, month - 1), day - 1)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def parse_date(c: Column | str) -> Column:
    """D/M/Y with slashes or dots; null if it is none."""
    x = trim_space(c)
    return rolled_date(*(_part(x, DATE, g) for g in (1, 2, 3)))


def parse_time_range(c: Column | str) -> Column:
    """struct(from_time, to_time) as HH:MM, or null."""
    x = trim_space(c)
    part = [F.regexp_extract(x, TIME_RANGE, g) for g in (1, 2, 3, 4)]
    both = F.struct(F.concat(pad2(part[0]), F.lit(":"), part[1]).alias("from_time"), F.concat(pad2(part[2]), F.lit(":"), part[3]).alias("to_time"))
    return F.when(part[0] != "", both)


def day_of_week(date: Column | str) -> Column:
    """0 on Sundays."""
    return F.dayofweek(date) - 1


def day_name(date: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, DAY_NAMES)), F.dayofweek(date))


def parse_long_date(c: Column | str) -> Column:
    """struct(date, day_name) of "<day name> 12 <month> 2026"; the first number is
    the day, the next month name the month, the next number the year. The day
    name is optional. Null if a part is missing."""
    words = F.split(upper_plain(strip_accents(trim_space(c))), r"[\s,]+")
    months = F.array(*map(F.lit, MONTH_NAMES))
    days = F.array(*map(F.lit, DAY_NAMES))
    empty = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"), F.lit(0).alias("y"), F.lit("").alias("name"))

    def step(got: Column, word: Column) -> Column:
        number = F.when(word.rlike("^[0-9]{1,4}$"), word).try_cast("int")
        month = F.array_position(months, word).cast("int")
        is_day = number.isNotNull() & (got["d"] == 0)
        is_month = (got["d"] > 0) & (got["m"] == 0) & (month > 0)
        is_year = number.isNotNull() & (got["m"] > 0) & (got["y"] == 0)
        return F.struct(
            F.when(is_day, number).otherwise(got["d"]).alias("d"),
            F.when(is_month, month).otherwise(got["m"]).alias("m"),
            F.when(is_year, number).otherwise(got["y"]).alias("y"),
            F.when((got["name"] == "") & F.array_contains(days, word), word).otherwise(got["name"]).alias("name"),
        )

    def whole(got: Column) -> Column:
        date = rolled_date(got["d"], got["m"], got["y"])
        return F.when((got["d"] > 0) & (got["m"] > 0) & (got["y"] > 0), F.struct(date.alias("date"), got["name"].alias("day_name")))

    return F.aggregate(words, empty, step, whole)


def week_key(date: Column | str) -> Column:
    """week:YYYY-Www by ISO year and week."""
    date = F.col(date) if isinstance(date, str) else date
    return F.format_string("week:%04d-W%02d", F.date_part(F.lit("YEAROFWEEK"), date).cast("int"), F.weekofyear(date))


def request_date(c: Column | str) -> Column:
    """DD/MM/YYYY or YYYY-MM-DD, with all digits; otherwise null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_to_date(x, "dd/MM/yyyy"), F.try_to_date(x, "yyyy-MM-dd"))


def next_midnight(now: Column | str) -> Column:
    return F.date_add(F.to_date(now), 1).cast("timestamp_ntz")


def week_start(date: Column | str) -> Column:
    """The Monday of a date's week."""
    return F.date_trunc("week", date).cast("date")


def week_label(dates: Column | str) -> Column:
    """The seven days from the first of an array of dates on."""
    first = F.get(F.col(dates) if isinstance(dates, str) else dates, F.lit(0))
    shown = lambda d: F.date_format(d, "dd/MM/yyyy")
    return F.when(first.isNull(), "no days parsed").otherwise(F.concat(shown(first), F.lit(".."), shown(F.date_add(first, 6))))


def covers_date(dates: Column | str, day: Column) -> Column:
    """Whether an array of dates holds a day."""
    return F.exists(dates, lambda d: d == day)


def rfc3339(date: Column | str) -> Column:
    """A date as midnight UTC, as it is written to JSON."""
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T00:00:00Z"))
