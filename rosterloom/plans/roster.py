"""Positioned lines to filled, validated and nested schedules."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.functions import checks, dates
from rosterloom.operators import catalog as cat
from rosterloom.operators import entries as ent
from rosterloom.operators import geometry, judge, segment
from rosterloom.scratch import Scratch
from rosterloom.sources import sinks

SHIFT = ["doc_id", "col_index", "day_no", "shift_no"]
ENTRY = [*SHIFT, "entry_no"]


class Recogniser(Protocol):
    """Reads images; one that can read single columns has recognise_columns, too."""

    def recognise(self, images: DataFrame) -> DataFrame: ...


def entries_of(lines: DataFrame, columns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """OCR lines of pages and their columns to flat entries with date and shift.
    scratch: where the lines of days are written, since dates and shifts read them both."""
    placed = geometry.column_of_line(geometry.line_role(ent.layout_lines(lines), columns).where("role = 'body'"), columns)
    keys = ["doc_id", "col_index"]
    days = segment.days_from_anchors(placed, keys, ["y0", "x0", "line_no"], checks.is_date_line("norm_text"))
    days = days if scratch is None else scratch.keep(days)
    date = days.where(checks.is_date_line("norm_text") & ~F.col("in_head")).groupBy(*keys, "day_no").agg(F.min_by(dates.parse_date("norm_text"), F.struct("y0", "x0", "line_no")).alias("date"))
    body = days.where(~F.col("in_head") & ~checks.is_date_line("norm_text"))
    shifts = segment.split_by_marker(body, [*keys, "day_no"], checks.is_time_line("norm_text"))
    times = dates.parse_time_range("marker_row.norm_text")
    shifts = shifts.withColumn("from_time", F.coalesce(times["from_time"], F.lit(""))).withColumn("to_time", F.coalesce(times["to_time"], F.lit("")))
    numbered = segment.in_reading_order(shifts, SHIFT)
    rows = ent.entries_from_lines(numbered, [*SHIFT, "from_time", "to_time"], "ord", "norm_text")
    return rows.join(date, [*keys, "day_no"]).withColumn("day_name", dates.day_name("date"))


def read_lines(images: DataFrame, columns: DataFrame, recogniser: Recogniser) -> DataFrame:
    """OCR_LINES of images (doc_id, img). A recogniser with recognise_columns gets
    one row per column and answers in the column's own space; any other reads
    whole images, of which the lines beside the columns' band fall out."""
    by_column = getattr(recogniser, "recognise_columns", None)
    if by_column is None:
        return geometry.inside_band(recogniser.recognise(images), columns)
    lines = geometry.to_image_space(by_column(images.join(columns, "doc_id")), columns, ["doc_id", "col_index"])
    order = Window.partitionBy("doc_id").orderBy("col_index", "line_no")  # columns one after another
    return lines.withColumn("line_no", F.row_number().over(order) - 1)


def linked(lines: DataFrame, columns: DataFrame, catalog: DataFrame, identity: Callable[[DataFrame], DataFrame] | None, gates: judge.Gates) -> tuple[DataFrame, DataFrame]:
    """Distinct entries filled from the catalog and validated, and the warnings of
    the fill: ENTRY, warning. Entries and results are written to shared scratch,
    because linking and warnings read them several times: a plan that reads a
    persisted table holds that table's plan as well, and the driver keeps each."""
    scratch = Scratch(lines.sparkSession)
    found = scratch.keep(ent.distinct_entries(entries_of(lines, columns, scratch), SHIFT, ["entry_no"]))
    pairs = cat.candidates(found.select(*ENTRY, "name", "address", "phone"), catalog, ENTRY)
    picks = scratch.keep(cat.pick_reference(pairs, ENTRY))
    chosen = picks
    notes = found.select(*ENTRY, F.lit(None).cast("string").alias("warning")).where("false")
    if identity is not None:
        groups = judge.identity_groups(pairs, ENTRY)
        decided = judge.judged_picks(groups, identity(groups), picks, ENTRY, gates)
        better = pairs.join(decided.select(*ENTRY, "ref_no"), [*ENTRY, "ref_no"], "left_semi")
        chosen = picks.join(decided.select(*ENTRY), ENTRY, "left_anti").drop("score").unionByName(better.select(*(c for c in picks.columns if c != "score")))
        notes = decided.where("warning is not null").select(*ENTRY, "warning")
    filled = scratch.keep(cat.fill(found, chosen, ENTRY).drop("ref_no"))
    checked = scratch.keep(cat.validate(filled, catalog, ENTRY, chosen.select(*ENTRY, "ref_no"), scratch))
    scratch.drop(filled)
    return checked, notes


def parse(lines: DataFrame, columns: DataFrame, catalog: DataFrame, identity: Callable[[DataFrame], DataFrame] | None = None, gates: judge.Gates | None = None) -> DataFrame:
    """The flat schedule: entries filled from the catalog, validated, scored, each
    once per shift. identity judges ambiguous entries; without it similarity does."""
    checked, _ = linked(lines, columns, catalog, identity, gates or judge.Gates())
    return cat.last_score_by_phone(checked, ENTRY)


def warnings_of(checked: DataFrame, notes: DataFrame, catalog: DataFrame, plausibility: Callable[[DataFrame], DataFrame] | None = None, gates: judge.Gates | None = None) -> DataFrame:
    """One row per document with warnings, in fixed order: the fill's; by shift its
    times, then by entry the discrepancy and the failed fields; last the fields
    that a judge finds implausible in entries that are not in the catalog."""
    none = F.lit(-1)
    ordered = lambda part, entry, field: F.struct(F.lit(part).alias("part"), "col_index", "day_no", "shift_no", F.coalesce(entry, none).alias("entry_no"), field.cast("int").alias("no")).alias("place")
    fill = notes.select("doc_id", ordered(0, F.col("entry_no"), F.lit(0)), "warning")
    shifts = cat.shift_time_warnings(checked.select(*SHIFT, "date", "from_time", "to_time").distinct()).select("doc_id", ordered(1, none, F.lit(0)), "warning")
    each = F.concat(F.when(F.col("discrepancy") != "", F.array("discrepancy")).otherwise(F.array().cast("array<string>")), "warnings")
    fields = checked.select("doc_id", *ENTRY[1:], F.posexplode(each).alias("no", "warning")).select("doc_id", ordered(1, F.col("entry_no"), F.col("no")), "warning")
    found = fill.unionByName(shifts).unionByName(fields)
    if plausibility is not None:
        asked = cat.unmatched(checked.select(*ENTRY, "name", "address", "phone", "date"), catalog).drop("digits")
        judged = judge.plausibility_warnings(asked, plausibility(asked), ENTRY, gates or judge.Gates())
        found = found.unionByName(judged.select("doc_id", ordered(2, F.col("entry_no"), F.col("field_no")), "warning"))
    listed = F.array_sort(F.collect_list(F.struct("place", "warning")))
    return found.groupBy("doc_id").agg(F.transform(listed, lambda x: x["warning"]).alias("warnings"))


def parse_json(lines: DataFrame, columns: DataFrame, catalog: DataFrame) -> DataFrame:
    """doc_id and json: the nested schedule of each document as one JSON text."""
    return sinks.as_json(nested(parse(lines, columns, catalog)), ["doc_id", "days"]).select("doc_id", "json")


def nested(flat: DataFrame) -> DataFrame:
    """One row per document, days in order of column and place."""
    return ent.schedule(flat)
