"""Segmentation, geometry, linkage, judgment, state and reports on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterloom import schema
from rosterloom.functions import checks, dates, raster
from rosterloom.operators import catalog as cat
from rosterloom.operators import entries, geometry, judge, report, segment, state
from rosterloom.plans import queries, roster, roster_queries
from rosterloom.sources import files, html, sinks


def lines(spark, rows, doc="d"):
    data = [(doc, 0, i, t, 0.9, 300, y, 500, y + h) for i, (y, h, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema.OCR_LINES)


def columns(spark):
    return spark.createDataFrame([("d", 0, 271, 106, 572, 1133)], schema.PAGE_COLUMNS)


CATALOG = [
    ("Αλεφαντινού Μαρία", "Ζαμπελίου 19", "2831026115"), ("Δαφνομήλη Γεωργία", "Δημοκρατίας 6", "2831056850"),
    ("Καλογεράκης Ιωάννης", "Μοάτσου 8", "28310 22187"), ("Μαστοράκη - Κεραμιανάκη", "Λ. Πορτάλιου 20", "28310 51113, 28310 55649"),
    ("Βαρούχα - Αναγνωστάκης", "Δημητρακάκη 21", "2831055212"), ("Καλαφατάκη Ελένη - Γεωργία", "Δημητρακάκη 21", "2831055212"),
]


def catalog(spark):
    return spark.createDataFrame([(i, n, a, p, "", "", 35.0 + i, 24.0, None) for i, (n, a, p) in enumerate(CATALOG)], schema.CATALOG)


def entry_rows(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, name string, address string, phone string")


L1 = [(160, 20, "ΔΕΥΤΕΡΑ"), (180, 20, "10/08/2026"), (210, 20, "08:00-21:00"), (240, 20, "ΑΛΕΦΑΝΤΙΝΟΥ ΜΑΡΙΑ"), (260, 20, "ΤΗΛ. 28310 26115"), (470, 20, "21:00-08:00"), (500, 20, "ΔΑΦΝΟΜΗΛΗ"), (520, 20, "2831056850"), (630, 20, "ΠΑΡΑΣΚΕΥΗ"), (650, 20, "14/08/2026"), (680, 20, "08:00-21:00"), (700, 20, "ΑΓΝΩΣΤΟΣ ΝΙΚΟΣ"), (720, 20, "2831099999")]


def test_schedule_end_to_end(spark):
    flat = roster.parse(lines(spark, L1), columns(spark), catalog(spark))
    rows = {(r.day_no, r.shift_no): r for r in flat.collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0)}
    first = rows[1, 0]
    assert (str(first.date), first.day_name, first.from_time, first.to_time) == ("2026-08-10", "ΔΕΥΤΕΡΑ", "08:00", "21:00")
    assert first.name == "ΑΛΕΦΑΝΤΙΝΟΥ ΜΑΡΙΑ" and first.address == "ΖΑΜΠΕΛΙΟΥ 19" and first.score == pytest.approx(1.0)
    assert rows[1, 1].name == "ΔΑΦΝΟΜΗΛΗ ΓΕΩΡΓΙΑ" and rows[1, 1].filled
    assert not rows[2, 0].filled and rows[2, 0].lat is None and rows[2, 0].discrepancy.startswith("phone not found")
    nested = roster.nested(flat).collect()
    assert len(nested) == 1 and [len(d.shifts) for d in nested[0].days] == [2, 1]


def test_order_of_input_does_not_matter(spark):
    a = roster.entries_of(lines(spark, L1), columns(spark)).orderBy("day_no", "shift_no", "entry_no")
    b = roster.entries_of(lines(spark, L1).orderBy(F.rand(3)), columns(spark)).orderBy("day_no", "shift_no", "entry_no")
    assert a.collect() == b.collect()


def test_marker_split_drops_overlap(spark):
    rows = [(100, 10, "head"), (200, 15, "overlap"), (210, 5, "08:00-09:00"), (240, 10, "in"), (300, 5, "10:00-11:00"), (300, 10, "tie"), (330, 5, "last")]
    got = segment.split_by_marker(lines(spark, rows), ["doc_id"], checks.is_time_line("text"))
    assert {(r.text, r.shift_no) for r in got.collect()} == {("head", 0), ("in", 0), ("tie", 1), ("last", 1)}
    none = segment.split_by_marker(lines(spark, [(1, 1, "a")]), ["doc_id"], checks.is_time_line("text")).collect()
    assert [(r.shift_no, r.marker_row) for r in none] == [(0, None)]


def test_terminator_and_anchor_split(spark):
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate("a1b2c")], "k string, o int, t string")
    got = segment.split_by_terminator(rows, ["k"], ["o"], F.col("t").rlike("[0-9]")).orderBy("o").collect()
    assert [r.entry_no for r in got] == [0, 0, 1, 1, 1]
    assert [r.entry_no for r in segment.split_by_terminator(rows.where("t = 'a'"), ["k"], ["o"], F.lit(False)).collect()] == [0]
    days = segment.days_from_anchors(rows, ["k"], ["o"], F.col("t").rlike("[0-9]")).orderBy("o").collect()
    assert [(r.day_no, r.in_head) for r in days] == [(1, True), (1, False), (1, False), (2, False), (2, False)]
    assert segment.days_from_anchors(rows, ["k"], ["o"], F.lit(False)).count() == 0


def test_asof_islands_batches(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 5, 0, "x"), ("k", 5, 1, "y")], "k string, t int, o int, v string")
    assert [r.v for r in segment.asof_backward(left, right, ["k"], "t", "o", ["v"]).orderBy("t").collect()] == [None, "y", "y"]
    runs = segment.island_spans(spark.createDataFrame([("k", v) for v in (1, 2, 4, 7, 8)], "k string, v int"), ["k"], "v").orderBy("first").collect()
    assert [(r.first, r.last, r.centre, r.size) for r in runs] == [(1, 4, 2, 3), (7, 8, 7, 2)]
    fold = spark.range(1).select(segment.merge_close(F.array(*map(F.lit, (10, 40, 55, 70, 200)))).alias("m")).first().m
    assert fold == [10, 58, 200]
    wide = segment.fixed_batches(spark.createDataFrame([("k", w) for w in range(1, 20)], "k string, w int"), ["k"], ["w"], "w").groupBy("batch").agg(F.max("padded").alias("p")).orderBy("batch").collect()
    assert [r.p for r in wide] == [16, 24]
    ctc = spark.range(1).select(segment.ctc_collapse(F.array(*map(F.lit, (1, 1, 0, 1, 2))), F.array(*map(F.lit, (0.5, 0.9, 0.1, 0.7, 0.6)))).alias("c")).first().c
    assert ctc.ids == [1, 1, 2] and ctc.confidence == pytest.approx(0.6)


def test_geometry(spark):
    cols = spark.createDataFrame([("d", 0, 0, 100, 100, 500), ("d", 1, 105, 100, 200, 500)], schema.PAGE_COLUMNS)
    ls = spark.createDataFrame([("d", 9, i, "x", 0.5, x - 5, y, x + 5, y + 4) for i, (x, y) in enumerate([(50, 200), (104, 200), (400, 200), (150, 10), (150, 600)])], schema.OCR_LINES)
    assert [r.col_index for r in geometry.column_of_line(ls, cols).orderBy("line_no").collect()] == [0, 0, 1, 1, 1]
    assert [r.role for r in geometry.line_role(ls, cols).orderBy("line_no").collect()] == ["body", "body", "body", "title", "footer"]
    assert {r.role for r in geometry.line_role(ls, cols.where("false")).collect()} == {"title"}
    assert geometry.inside_band(ls, cols).count() == 3
    moved = geometry.to_image_space(ls.limit(1), cols.withColumn("col_index", F.lit(9)).limit(1), ["doc_id", "col_index"]).first()
    assert (moved.x0, moved.y0) == (45, 300)
    grids = spark.createDataFrame([([10, 100, 200, 300], 400), ([], 1200), ([1], 900)], "g array<int>, w int").select(geometry.columns_from_grid(F.col("g"), F.col("w")).alias("c"))
    assert [[tuple(b) for b in r.c] for r in grids.collect()] == [[(12, 98), (102, 198), (202, 298)], [(0, 300), (300, 600), (600, 900), (900, 1200)], [(0, 300), (300, 600), (600, 900)]]
    box = spark.range(1).select(F.lit(-3).alias("x0"), F.lit(2).alias("y0"), F.lit(20).alias("x1"), F.lit(9).alias("y1")).select(geometry.clip_box("x0", "y0", "x1", "y1", F.lit(10), F.lit(8)).alias("b")).first().b
    assert tuple(box) == (0, 2, 10, 8)


def test_linkage(spark):
    rows = entry_rows(spark, [("ΚΑΛΑΦΑΤΑΚΗ ΕΛΕΝΗ", "ΔΗΜΗΤΡΑΚΑΚΗ 21", "2831055212"), ("ΚΑΛΟΓΕΡΑΚΗΣ", "ΜΟΑΤΣΟΥ 8", "2831022187"), ("ΑΛΕΦΑΝΤΙΝΟΥ ΜΑΡΙΑ", "", "2831099999"), ("Χ", "", "2831055649"), ("", "", "2831000000")])
    pairs = cat.candidates(rows, catalog(spark), ["k"])
    picks = {r.k: r.ref_name for r in cat.pick_reference(pairs, ["k"]).collect()}
    assert picks == {0: "Βαρούχα - Αναγνωστάκης", 1: "Καλογεράκης Ιωάννης", 3: "Μαστοράκη - Κεραμιανάκη"}
    assert {r.k for r in cat.unmatched(rows, catalog(spark)).collect()} == {2}
    checked = {r.k: r for r in cat.validate(rows, catalog(spark), ["k"]).collect()}
    assert checked[2].match_no == 0 and checked[2].discrepancy.startswith("phone not found in catalog for ΑΛΕΦΑΝΤΙΝΟΥ ΜΑΡΙΑ (closest: Αλεφαντινού Μαρία")
    assert checked[1].discrepancy == "" and checked[1].score >= 0.9
    assert len(checked) == 5


def test_judged_picks(spark):
    rows = entry_rows(spark, [("ΚΑΛΑΦΑΤΑΚΗ ΕΛΕΝΗ", "ΔΗΜΗΤΡΑΚΑΚΗ 21", "2831055212")])
    pairs = cat.candidates(rows, catalog(spark), ["k"])
    groups, picks = judge.identity_groups(pairs, ["k"]), cat.pick_reference(pairs, ["k"])

    def decide(choice, confidence, same):
        verdict = spark.createDataFrame([(0, choice, confidence, same)], "k int, choice string, confidence double, same double")
        return judge.judged_picks(groups, verdict, picks, ["k"], judge.Gates()).first()

    good = decide("c1", 0.95, 0.9)
    assert (good.ref_no, good.judged) == (5, True) and "instead of the similarity pick" in good.warning
    for choice, confidence, same in (("none", 0.95, -1.0), ("c0", 0.5, 0.9), ("c0", 0.95, 0.4), ("c9", 0.9, 0.9)):
        bad = decide(choice, confidence, same)
        assert (bad.ref_no, bad.judged) == (4, False) and bad.warning.endswith("kept the similarity pick")
    assert decide("c0", 0.9, 0.9).warning is None
    verdicts = "k int, choice string, confidence double, same double"
    none = judge.judged_picks(groups, spark.createDataFrame([], verdicts), picks, ["k"], judge.Gates()).first()
    assert (none.ref_no, none.warning) == (4, "phone 2831055212 matches several catalog entries and identity adjudication returned 0 verdicts; kept the similarity pick")
    two = judge.judged_picks(groups, spark.createDataFrame([(0, "c1", 0.9, 0.9)] * 2, verdicts), picks, ["k"], judge.Gates()).first()
    assert "returned 2 verdicts" in two.warning
    failed = judge.judged_picks(groups, spark.createDataFrame([(0, None, None, None, "timeout")], verdicts + ", error string"), picks, ["k"], judge.Gates()).first()
    assert "identity adjudication failed (timeout)" in failed.warning
    assert judge.rule_judge(groups, ["k"]).first().choice == "c1"
    assert '"candidates":[{"id":"c0"' in judge.request_payload(groups, ["k"]).first().payload


def test_replay_and_choices(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "i int, key string")
    stored = spark.createDataFrame([("a", 1)], "key string, v int")
    seen = []

    def ask(misses):
        seen.extend(r.key for r in misses.collect())
        return misses.select("key", F.lit(2).alias("v"))

    both, fresh = judge.replay(asked, stored, ask, "key")
    assert sorted((r.i, r.v) for r in both.collect()) == [(1, 1), (2, 2), (3, 2)] and seen == ["b"] and fresh.count() == 1
    ids = F.array(F.lit("x"), F.lit("y"))
    row = spark.range(1).select(judge.stored_choice(F.lit("y"), ids).alias("p"), judge.restored_choice(F.lit(1), ids).alias("c"), judge.restored_choice(F.lit(7), ids).alias("m"), judge.restored_choice(F.lit(-1), ids).alias("n")).first()
    assert tuple(row) == (1, "y", None, "none")
    verdicts = spark.createDataFrame([(1, "b", "curator", 1.2), (1, "a", "same", 1.8), (1, "0", "same", 1.8)], "k int, id string, o string, s double")
    assert judge.best_outcome(verdicts, ["k"], "o", "s", "id").first().id == "0"


def test_best_outcome_by_record(spark):
    refs = spark.createDataFrame([("r1", 1), ("r2", 1), ("r3", 2), ("r4", 3), ("r5", None), ("r1", 4), ("r6", 5)], "ref string, key int")
    data = [("a", 1, "curator", 1.2), ("b", 1, "same", 1.8), ("c", 1, "same", 1.9), ("d", 2, "same", 2.0), ("e", 3, "different", 0.1), ("f", 3, "different", 0.1), ("g", 4, "same", 1.9), ("0", 4, "same", 1.9), ("h", None, "same", 2.0), ("i", 3, "different", None)]
    records = spark.createDataFrame(data, "id string, key int, o string, s double")
    found = judge.best_outcome_by_record(refs, records, "key", ["ref"], "o", "s", "id")
    pairs = judge.merge_pairs(refs, records, "key").select("ref", "id", "o", "s")
    rows = lambda df: sorted((r.ref, r.id, r.o, r.s) for r in df.select("ref", "id", "o", "s").collect())
    # r3 and d are alone under their number, r6 has no record, and r1 has two keys
    assert rows(found) == rows(judge.best_outcome(pairs, ["ref"], "o", "s", "id")) and [r[:2] for r in rows(found)] == [("r1", "0"), ("r2", "c"), ("r4", "i")]


def test_best_outcomes_makes_no_product(spark, tmp_path):
    key = F.lit(7).alias("s_nationkey")
    spark.range(2000).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), key).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(1500).select(F.col("id").alias("c_custkey"), key.alias("c_nationkey"), (F.col("id") % 100 * 100).cast("double").alias("c_acctbal")).write.parquet(str(tmp_path / "customer.parquet"))
    found = queries.QUERIES["best_outcomes"](spark, str(tmp_path))
    assert {(r.candidate, r.outcome) for r in found.collect()} == {(99, "same")} and found.count() == 2000

    def joined(node):
        name = node.nodeName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        own = [node.metrics().apply("numOutputRows").value()] if "Join" in name else []
        return own + [n for x in inner for n in joined(x)]

    rows = joined(found._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 2000  # a product has 3,000,000


def test_plausibility(spark):
    rows = entry_rows(spark, [("A", "", "1"), ("B", "", "")])
    verdicts = spark.createDataFrame([(0, 0.1, 0.9), (1, 0.9, 0.2)], "k int, name_plausible double, address_plausible double")
    rows = rows.withColumn("date", F.lit("2026-08-10").cast("date"))
    got = {r.k: r.warning for r in judge.plausibility_warnings(rows, verdicts, ["k"], judge.Gates()).collect()}
    assert got == {
        0: 'phone 1 is not in the catalog; name "A" reads implausibly (plausibility 0.10 below 0.50) on 10/08/2026',
        1: 'entry "B" is not in the catalog; address "" reads implausibly (plausibility 0.20 below 0.70) on 10/08/2026',
    }
    odd = judge.plausibility_warnings(rows, verdicts.limit(1), ["k"], judge.Gates()).collect()
    assert [(r.k, r.warning) for r in odd] == [(None, "plausibility verification returned 1 verdicts for 2 unmatched entries; skipped")]
    failed = judge.plausibility_warnings(rows, verdicts, ["k"], judge.Gates(), failed="timeout").collect()
    assert [r.warning for r in failed] == ["plausibility verification failed for 2 unmatched pharmacy entries (timeout); the entries are unchanged"]
    assert judge.plausibility_warnings(rows.limit(0), verdicts.limit(0), ["k"], judge.Gates(), failed="x").count() == 0
    assert {(r.k, r.field) for r in judge.plausibility_questions(rows, ["k"]).collect()} == {(0, "name"), (1, "name")}


def test_last_put_wins(spark):
    puts = spark.createDataFrame([("a", 1, "2026-01-02"), ("a", 2, "2026-01-03"), ("a", 3, "2026-01-01"), ("b", 4, None)], "key string, v int, decided_at string")
    assert {(r.key, r.v) for r in judge.latest_decisions(puts).collect()} == {("a", 2), ("b", 4)}
    assert {(r.key, r.v) for r in judge.latest_decisions(puts.drop("decided_at")).collect()} == {("a", 3), ("b", 4)}


@pytest.mark.parametrize("block", [1000, 7])
def test_blocks_give_the_same(spark, block):
    values = spark.range(60).select(F.col("id").alias("v"), (F.col("id") * 1.5).alias("x"))
    bands = spark.range(30).select(F.col("id").alias("o"), (F.col("id") * 3.0).alias("lo"), (F.col("id") * 3.0 + 4).alias("hi"))
    near = {r.v: (r.distance, r.o) for r in geometry.band_nearest(values, bands, "v", "x", "lo", "hi", "o", block).collect()}
    assert near == {v: min((abs(v * 1.5 - 3 * o) + abs(v * 1.5 - 3 * o - 4), o) for o in range(30)) for v in range(60)}
    pick = {r.v: r.o for r in state.interval_pick(values, bands, "v", "x", "lo", "hi", "o", block).collect()}
    assert pick == {v: min((o for o in range(30) if 3 * o <= v * 1.5 <= 3 * o + 4), default=29) for v in range(60)}
    assert {r.o for r in state.interval_pick(values, bands.limit(0), "v", "x", "lo", "hi", "o", block).collect()} == {None}
    names = spark.createDataFrame([(n,) for n in ("ΜΑΡΙΑ", "ΜΑΡΙΟΣ", "ΕΛΕΝΗ", "ΕΛΕΝΑ", "ΓΙΩΡΓΟΣ", "ΝΙΚΟΣ", "ΝΙΚΗ", "ΑΝΝΑ", "ΜΑΡΙΝΑ")], "n string")
    best = {r._name: r.best_name for r in cat.most_similar(names, "n", names, "n", lambda a, b: F.when(a != b, 1 - F.levenshtein(a, b) / 10), block).collect()}
    assert (best["ΜΑΡΙΑ"], best["ΕΛΕΝΗ"], best["ΝΙΚΟΣ"]) == ("ΜΑΡΙΝΑ", "ΕΛΕΝΑ", "ΝΙΚΗ")


def test_warnings_in_order(spark):
    odd = [(100, 20, "10/08/2026"), (130, 20, "08:00-29:00"), (160, 20, "ΓΕΩΡΓΙΟΥ ΑΝΝΑ"), (190, 20, "ΠΛΑΤΕΙΑ"), (220, 20, "ΤΗΛ. 28310 99999")]
    checked, notes = roster.linked(lines(spark, odd), columns(spark), catalog(spark), None, judge.Gates())
    assert checked.count() == 1
    judged = lambda asked: asked.select(*roster.ENTRY, F.lit(0.9).alias("name_plausible"), F.lit(0.1).alias("address_plausible"))
    found = roster.warnings_of(checked, notes, catalog(spark), judged).first().warnings
    assert found[0] == "invalid shift times 08:00-29:00 on 10/08/2026" and found[-1].startswith("phone 2831099999 is not in the catalog; address")
    assert any(w.startswith("phone not found") or w.startswith("no catalog match") for w in found[1:-1])
    assert '"days"' in roster.parse_json(lines(spark, odd), columns(spark), catalog(spark)).first().json


def test_recognisers(spark):
    cols = spark.createDataFrame([("d", 0, 100, 50, 200, 500), ("d", 1, 300, 50, 400, 500)], schema.PAGE_COLUMNS)
    images = spark.createDataFrame([("d", (bytearray(4), 2, 2))], schema.IMAGES.replace("image_id", "doc_id"))

    class Whole:
        def recognise(self, some):
            return spark.createDataFrame([("d", 0, 0, "in", 0.9, 110, 60, 120, 70), ("d", 0, 1, "out", 0.9, 0, 900, 5, 910)], schema.OCR_LINES)

    class ByColumn(Whole):
        def recognise_columns(self, some):
            return some.select("doc_id", "col_index", F.lit(0).alias("line_no"), F.concat(F.lit("t"), "col_index").alias("text"), F.lit(0.5).cast("float").alias("confidence"), *(F.lit(v).alias(c) for c, v in (("x0", 1), ("y0", 2), ("x1", 3), ("y1", 4))))

    assert [r.text for r in roster.read_lines(images, cols, Whole()).collect()] == ["in"]
    got = roster.read_lines(images, cols, ByColumn()).orderBy("line_no").collect()
    assert [(r.line_no, r.text, r.x0, r.y0) for r in got] == [(0, "t0", 101, 52), (1, "t1", 301, 52)]


def test_small_additions(spark):
    row = spark.range(1).select(dates.week_label(F.array(F.lit("2026-08-10").cast("date"))).alias("w"), dates.week_label(F.array().cast("array<date>")).alias("n")).first()
    assert tuple(row) == ("10/08/2026..16/08/2026", "no days parsed")
    marks = spark.createDataFrame([(t,) for t in ("", "-", "Привет", "中文", "Ω", "x", "7", "½")], "t string").select("t", checks.is_junk("t").alias("j"))
    assert {r.t for r in marks.collect() if r.j} == {"", "-", "Привет", "中文", "½"}
    a = np.arange(36, dtype=np.uint8).reshape(6, 6, 1)
    assert raster.resize_area(a, 3, 3)[:, :, 0].tolist() == [[3, 5, 7], [15, 17, 19], [27, 29, 31]]
    assert raster.resize_area(a, 4, 4)[0, 0, 0] == 0 and raster.crop(a, -2, 4, 3, 99).shape == (2, 3, 1)


def test_state(spark):
    puts = spark.createDataFrame([(i, s) for i, s in enumerate(["s0", "s1", "s2", "s0", "s3", "s4"])], "seq int, sha string")
    assert {r.sha for r in state.fifo_bound(puts, "sha", "seq", 3).collect()} == {"s2", "s3", "s4"}
    times = spark.createDataFrame([(dt.datetime(2026, 1, 1, 10),), (dt.datetime(2026, 1, 1, 12),)], "at timestamp")
    assert state.fresh(times, "at", F.lit("2026-01-01 12:30:00").cast("timestamp"), "1 HOUR").count() == 1
    weeks = spark.createDataFrame([(0, "2026-08-03", "2026-08-10"), (1, "2026-08-10", "2026-08-17")], "ord int, lo string, hi string")
    days = spark.createDataFrame([("2026-08-13",), ("2026-09-01",), ("2026-08-10",)], "day string")
    assert [r.ord for r in state.interval_pick(days, weeks, "day", "day", "lo", "hi", "ord").orderBy("day").collect()] == [0, 1, 1]
    kept = state.entry(spark.createDataFrame([(1,)], "x int"), ["x"], F.lit("2026-01-01"))
    assert state.replay_by_hash(kept.select("sha").union(spark.createDataFrame([("no",)], "sha string")), kept).where("found").count() == 1


def test_reports(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "x string, y int")
    assert sorted(tuple(r) for r in report.confusion(rows, "x", "y", [0, 1]).collect()) == [("a", 1, 1), ("b", 0, 1)]
    assert report.counters(rows, a=F.col("x") == "a").first().a == 2
    with pytest.raises(ValueError, match="strict"):
        report.require(rows, b=F.col("x") == "b")
    seen = report.inspect(lines(spark, L1), columns(spark)).first()
    assert (seen.n_lines, seen.in_column) == (13, 13)
    assert report.raw_dump(lines(spark, [(2, 1, "b"), (1, 1, "a")]), ["doc_id"]).first().dump == "y=1 x=300 c=0.900 a\ny=2 x=300 c=0.900 b\n"


def test_html(spark):
    page = '<img src="https://x.gr/wp-content/uploads/2026/08/17.08.2026-24.08.2026_a.jpg"><img src="https://x.gr/wp-content/uploads/2026/08/10.08.2026-17.08.2026_b-1024x724.jpg"><img src="https://x.gr/wp-content/uploads/2026/08/10.08.2026-17.08.2026_b.jpg">'
    images = html.schedule_images(spark.createDataFrame([(1, page)], "page_id int, html string")).orderBy("ord").collect()
    assert [str(r.from_date) for r in images] == ["2026-08-10", "2026-08-17"]
    duty = '<h3 class="duty-date">Τετάρτη 12 Αυγούστου 2026</h3><table><tr class="duty-time"><td>08:00 πμ – 21:00 μμ</td></tr><tr><td class="pharmacy-title">Α &amp; Β</td><td class="pharmacy-address">Οδός, 28310 27264</td></tr><tr><td class="pharmacy-title">Γ</td><td class="pharmacy-address">Ζαμπελίου 19<br />2831026115</td></tr><tr class="duty-time"><td>21:00 - 8:00</td></tr></table><h3 class="duty-date">Πέμπτη 13 Αυγούστου 2026</h3>'
    pages = spark.createDataFrame([(1, duty)], "page_id int, html string")
    rows = html.duty_days(pages).orderBy("day_no", "shift_no", "entry_no").collect()
    assert [(r.day_no, r.shift_no, r.name, r.phone) for r in rows] == [(0, 0, "Α & Β", "2831027264"), (0, 0, "Γ", "9283102611"), (0, 1, None, None), (1, None, None, None)]
    assert str(rows[0].date) == "2026-08-12" and rows[2].to_time == "08:00"
    assert html.duty_days(pages, strict_phone=True).where("name = 'Γ'").first().phone == "2831026115"
    listing = "<h3>Α | Οδός 1</h3><p>Τηλέφωνο:</p><p>28310 1</p><h4>Β</h4><p>Τηλέφωνο:</p> <p>28310 2</p>"
    got = html.catalog_rows(spark.createDataFrame([(1, listing)], "page_id int, html string")).orderBy("entry_no").collect()
    assert [(r.name, r.address, r.phone) for r in got] == [("Α", "Οδός 1", "283101"), ("Β", "", "283102")]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"name": "A", "phone": "1", "lat": 1.5}, {"name": "B"}]')
    rows = files.read_catalog(spark, str(tmp_path / "c.json")).orderBy("ref_no").collect()
    assert [(r.ref_no, r.name, r.phone, r.lat) for r in rows] == [(0, "A", "1", 1.5), (1, "B", "", None)]
    (tmp_path / "g.json").write_text('{"pharmacies": [{"matched": true, "name": "A", "phone": "2831026115", "latitude": 35.5, "source": {"name": "Α", "phone": ""}, "photos": [{"contentType": "x", "base64": ""}], "placeId": "p"}]}')
    golden = files.read_golden(spark, str(tmp_path / "g.json"))
    assert golden.count() == 1 and cat.enriched(golden).first().google.photos == []
    linked = cat.link_enrichment(catalog(spark), golden.withColumn("name", F.lit("ΑΛΕΦΑΝΤΙΝΟΥ ΜΑΡΙΑ"))).where("ref_no = 0").first()
    assert linked.lat == 35.5 and linked.google.place_id == "p"
    for n in ("a.JPG", "b.jpg", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert files.read_folder(spark, str(tmp_path)).count() == 2
    empty = files.read_decisions(spark, str(tmp_path / "none"))
    assert empty.count() == 0
    sinks.put_decisions(spark.createDataFrame([("k", 1)], "key string, choice_index int").select("key", "choice_index", *(F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields[2:])), str(tmp_path / "dec"))
    assert files.read_decisions(spark, str(tmp_path / "dec")).first().key == "k"
    one = sinks.as_json(spark.createDataFrame([("x", "")], "a string, b string").withColumn("b", sinks.omit_empty("b", "string")), ["a", "b"]).first().json
    assert '"a"' in one and '"b"' not in one
    with pytest.raises(ValueError, match="new path"):
        sinks.write_checked(empty, "/a", "/a/")


def test_distinct_entries_keep_first(spark):
    rows = spark.createDataFrame([("s", 1, "Α", "x", "1"), ("s", 0, "Ά", "x", "1"), ("s", 2, "Β", "x", "1")], "k string, o int, name string, address string, phone string")
    assert sorted(r.o for r in entries.distinct_entries(rows, ["k"], ["o"]).collect()) == [0, 2]
    scored = cat.last_score_by_phone(rows.withColumn("score", F.col("o").cast("float")), ["o"])
    assert {r.confidence for r in scored.collect()} == {2.0}


def test_raster(spark):
    a = np.full((24, 40, 1), 255, dtype=np.uint8)
    a[4:8, 8:21] = 0
    a[13:17, 22:36] = 0
    got = raster.text_rows(a)
    assert [b["y0"] for b in got] == [2, 11]
    assert raster.components8(a[:, :, 0] == 0) == [(8, 4, 21, 8), (22, 13, 36, 17)]
    assert raster.components8(np.eye(3)) == [(0, 0, 3, 3)]
    assert raster.bright_border(a) and raster.rect_mean(a, 8, 4, 21, 8) == 0 and raster.skew_angle(a) == pytest.approx(0, abs=6)
    assert raster.resize(a, 20, 12).shape == (12, 20, 1) and raster.tensor(a, [0.5], [0.5]).max() == 1
    img = spark.createDataFrame([("i", (bytearray(a.tobytes()), 40, 24))], schema.IMAGES)
    assert len(img.select(raster.text_row_boxes("img").alias("b")).first().b) == 2


def test_parse_plan_stays_small(spark):
    """The driver keeps plans, and a plan over persisted tables holds theirs, too."""
    d = "/root/testdata/sf0.001"
    parts = roster_queries.planted_pages(spark, d), roster_queries.planted_catalog(spark, d)
    plan = roster.parse(*parts[0], parts[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and plan.count("\n") < 50  # 2,471 nodes when its tables were persisted
