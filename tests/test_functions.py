"""Scalar vectors."""

import pytest
from pyspark.sql import functions as F

from rosterloom.functions import checks, dates, text


def values(spark, inputs, f):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string").select("i", f("x").alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def check(spark, cases, f):
    assert values(spark, list(cases), f) == list(cases.values())


def test_normalize(spark):
    cases = {
        "Παπατζανή Μαρία": "Παπατζανη Μαρια", "Τρανταλίδου 28": "Τρανταλιδου 28", "Γερακάρη—96": "Γερακαρη-96",
        "Γερακάρη – 96": "Γερακαρη - 96", "“ΕΓΚΕΦΑΛΟΣ”": '"ΕΓΚΕΦΑΛΟΣ"', "ΑΛΕΦΑΝΤΙΝΟΥ​ΜΑΡΙΑ": "ΑΛΕΦΑΝΤΙΝΟΥ ΜΑΡΙΑ",
        "  spaces  here  ": "spaces here", "": "", "a_b": "a-b", "«x»": '"x"',
    }
    check(spark, cases, text.normalize_text)
    assert len(set(text.SPACES)) == 8 and len(text.DASHES) == 11
    assert values(spark, ["Ά"], lambda c: text.normalize_text(c, compose=True)) == ["Α"]


def test_upper_and_digits(spark):
    check(spark, {"ΔEYTEPA": "ΔΕΥΤΕΡΑ", "THL": "ΤΗΛ", "GERAKARI 96": "ΓΕΡΑΚΑΡΙ 96", "KOUNTOURIOTI": "ΚΟΥΝΤΟΥΡΙΟΤΙ"}, text.look_alike_upper)
    cases = {"THA.2831023347": "2831023347", "28310 34458": "2831034458", "abc": "", "Ο28310Ο27264": "028310027264", "I2831O34458I": "128310344581", "B2B31027264": "82831027264"}
    check(spark, cases, text.digits_only)
    check(spark, {"28310 51113, 28310 55649": ["2831051113", "2831055649"], "x,": []}, text.phones)
    assert values(spark, ["straße"], text.upper_plain) == ["STRAßE"]


def test_transliterate(spark):
    cases = {"ΔΑΦΝΟΜΗΛΗ": "DAFNOMILI", "ΚΟΥΝΤΟΥΡΙΩΤΟΥ": "KOUNTOURIOTOU", "ΠΑΠΑΤΖΑΝΗ": "PAPATZANI", "Άγνωστο Φαρμακείο": "AGNOSTO FARMAKEIO", "Μοάτσου 8": "MOATSOU 8", "ΓΓΚ": "NGK"}
    check(spark, cases, text.transliterate)


@pytest.mark.parametrize(("a", "b", "unit", "low", "high"), [("x", "x ", "bytes", 1, 1), ("ALEFANTINOU", "ALEFANTINOY", "bytes", 0.8, 1), ("ABC", "XYZ", "bytes", 0, 0.1), ("ΑΒΓ", "ΞΟΠΡΣ", "bytes", 0.5, 0.5), ("ΑΒΓ", "ΞΟΠΡΣ", "chars", 0, 0), ("", "x", "bytes", 0, 0)])
def test_similarity(spark, a, b, unit, low, high):
    got = spark.range(1).select(text.similarity(F.lit(a), F.lit(b), unit).alias("s")).first().s
    assert low <= got <= high


def test_field_text(spark):
    check(spark, {'.-ΜΑΡΙΑ "': "ΜΑΡΙΑ", "α|": "Α"}, text.clean_field)
    check(spark, {"<b>a</b> &amp; b": "a  & b", " <i>&eacute;</i>": "é"}, text.strip_tags)
    check(spark, {"Ζαμπελίου 192831026115": "9283102611", "τηλ 28310 26115": "2831026115", "": ""}, text.extract_phone)
    assert values(spark, ["Ζαμπελίου 19 28310 26115"], lambda c: text.extract_phone(c, strict=True)) == ["2831026115"]
    check(spark, {"c0": 0, "C12": 12, " none ": -1, "café": None, "candidate-a": None, "": None}, text.option_key)
    check(spark, {"ΤΗΛ. 1": "ΤΗΛ 1", "τηλ: 2": "ΤΗΛ 2"}, text.normalize_line)
    assert spark.range(1).select(text.first_non_empty(F.lit(None).cast("string"), F.lit(""), F.lit("x")).alias("y")).first().y == "x"


def test_fields(spark):
    check(spark, {"2831026115": True, "2834061450": True, "12345": False, "3831026115": False, "283102611": False, "28310261155": False, "abc": False}, checks.valid_phone)
    check(spark, {"08:00": True, "23:59": True, "24:00": False, "8:00": False, "08:60": False, "08-00": False, "": False}, checks.valid_time)
    check(spark, {"ΠΑΠΑΤΖΑΝΗ ΜΑΡΙΑ": True, "": False, "ABC": False, "ΠΑΠΑ 123": False}, checks.greek_name)
    check(spark, {"Γερακάρη 96": True, "Αρκαδίου 92": True, "ABC": False, "": False, "ΠΛ. ΑΓΝΩΣΤΟΥ": True}, checks.valid_address)


def test_line_kinds(spark):
    cases = {
        "ΤΗΛ. 28310 26115": "phone", "28310-26115": "phone", "/": "skip", "***": "skip", "ΩΡΑ: 8-9": "skip", "08:00-21:00": "phone",
        "ΔΕΥΤΕΡΑ": "skip", "ΟΔΟΣ ΜΟΑΤΣΟΥ": "address", "GERAKARI 96": "address", "ΠΑΠΑΤΖΑΝΗ ΜΑΡΙΑ": "name", "ΜΟΑΤΣΟΥ 8": "address", "xyz": "name", "ΑΠΕΝΑΝΤΙ ΑΠΟ": "name",
    }
    check(spark, cases, checks.line_kind)
    check(spark, {"ΑΠΕΝΑΝΤΙ ΑΠΟ": False, "ΜΑΡΙΑ": True, "ΤΗΛ": False, "ΜΑ": False}, checks.looks_like_name)


def test_score_is_float32(spark):
    t, f = F.lit(True), F.lit(False)
    row = spark.range(1).select(checks.score(t, t, t, t).alias("full"), checks.score(t, t, t, f).cast("double").alias("part")).first()
    assert row.full == pytest.approx(1.0) and row.part == pytest.approx(0.8999999761581421, abs=1e-15)


@pytest.mark.parametrize(("score", "conf", "least", "want"), [(2, 0.9, 0.5, "same"), (1.6, 0.6, 0.5, "same"), (1.9, 0.4, 0.5, "curator"), (2, 0.4, 0, "same"), (1.4, 0.9, 0.5, "curator"), (0.6, 0.9, 0.5, "curator"), (0.4, 0.9, 0.5, "different"), (0, 0.9, 0.5, "different")])
def test_route(spark, score, conf, least, want):
    assert spark.range(1).select(checks.route_merge(F.lit(float(score)), F.lit(conf), least).alias("o")).first().o == want


@pytest.mark.parametrize(("choice", "conf", "same", "a", "b", "want"), [("a", 0.8, 0.9, 0.5, 0.5, True), ("none", 0.99, 0.99, 0.5, 0.5, False), ("a", 0.4, 0.9, 0.5, 0.5, False), ("a", 0.8, 0.4, 0.5, 0.5, False), ("a", 0.8, 0.9, 0, 0, True), ("a", 0.0, -1.0, 0, 0, False)])
def test_gate(spark, choice, conf, same, a, b, want):
    assert spark.range(1).select(checks.accept_identity(F.lit(choice), F.lit(conf), F.lit(same), a, b).alias("o")).first().o is want


@pytest.mark.parametrize(("n", "a", "g", "want"), [(0.91, 0.88, 0.5, []), (0.12, 0.7, 0.5, ["name"]), (0.9, 0.05, 0.5, ["address"]), (0.1, 0.2, 0.5, ["name", "address"]), (-1.0, -1.0, 0.5, []), (0.1, 0.1, 0.0, [])])
def test_implausible(spark, n, a, g, want):
    assert spark.range(1).select(checks.implausible_fields(F.lit(n), F.lit(a), g, g).alias("o")).first().o == want


def test_dates(spark):
    shown = lambda c: F.date_format(dates.parse_date(c), "yyyy-MM-dd")
    check(spark, {"10/08/2026": "2026-08-10", "1.2.2026": "2026-02-01", "32/13/2026": "2027-02-01", "x": None}, shown)
    check(spark, {"08:00-21:00": ("08:00", "21:00"), "8:00 – 9:30": ("08:00", "09:30"), "none": None}, dates.parse_time_range)
    names = lambda c: dates.day_name(dates.parse_date(c))
    check(spark, {"10/08/2026": "ΔΕΥΤΕΡΑ", "14/08/2026": "ΠΑΡΑΣΚΕΥΗ", "16/08/2026": "ΚΥΡΙΑΚΗ"}, names)
    keys = values(spark, ["2026-08-10", "2026-08-16", "2026-08-17", "2027-01-02"], lambda c: dates.week_key(F.to_date(c)))
    assert keys[0] == keys[1] != keys[2] and keys[3] == "week:2026-W53"
    check(spark, {"15/08/2026": True, "2026-08-15": True, "15.08.2026": False, "1/8/2026": False}, lambda c: dates.request_date(c).isNotNull())
    long = values(spark, ["Τετάρτη 12 Αυγούστου 2026", "3 Μαΐου 2026", "Αυγούστου"], dates.parse_long_date)
    assert (str(long[0].date), long[0].day_name) == ("2026-08-12", "ΤΕΤΑΡΤΗ") and str(long[1].date) == "2026-05-03" and long[2] is None
    night = spark.range(1).select(dates.next_midnight(F.lit("2026-08-14 23:59:59").cast("timestamp_ntz")).cast("string").alias("x")).first().x
    assert night.startswith("2026-08-15 00:00:00")
