"""Golden values for functions on numbers, dates, texts and rectangles."""

import pytest
from pyspark.sql import functions as F

from gridsmith.functions import geometry as g
from gridsmith.functions.dates import parse_dates
from gridsmith.functions.numbers import COMMA_GROUPING, FORMATS, POINT_GROUPING, interpretations, is_ambiguous, merged_positions, parse_numbers, scaled, upper_median
from gridsmith.functions.text import address, clean, column_letter, csv_field, formula_guard, is_missing, is_total_label, matches, normalized, recipe_name, similarity, split_footnote, xml_text

NUMBERS = [
    ("1,234.56", "pointDecimal", "1234.56"), ("9,104,772", "pointDecimal", "9104772"), ("1.234,56", "commaDecimal", "1234.56"), ("1.287,36", "commaDecimal", "1287.36"),
    ("5 762,4", "spaceCommaDecimal", "5762.4"), ("657 856", "spaceCommaDecimal", "657856"), ("1'234.50", "apostrophePointDecimal", "1234.50"), ("(612,300.25)", "pointDecimal", "-612300.25"),
    ("€ 1,250,400.00", "pointDecimal", "1250400.00"), ("-689.9%", "pointDecimal", "-689.9"), ("12,34,567.0", "pointDecimal", None), ("1.2.3,4,5", "commaDecimal", None), ("abc", "pointDecimal", None),
    ("(-5)", "pointDecimal", "5"), ("-0", "pointDecimal", "0"), (".5", "pointDecimal", "0.5"), ("5.", "pointDecimal", "5"), ("007", "pointDecimal", "7"), ("+3", "pointDecimal", "3"), ("−3", "pointDecimal", "-3"),
    ("1.234 567,8", "commaDecimal", None), ("", "pointDecimal", None), (None, "pointDecimal", None), ("CHF 5", "pointDecimal", "5"), ("-$5", "pointDecimal", "-5"), ("()", "pointDecimal", None), ("1'234", "pointDecimal", None),
]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("fmt", sorted({f for _, f, _ in NUMBERS}))
def test_numbers(spark, fmt):
    rows = [(i, raw) for i, (raw, f, _) in enumerate(NUMBERS) if f == fmt]
    got = parse_numbers(spark.createDataFrame(rows, "i int, raw string"), "raw", *FORMATS[fmt], "n").select("i", "n.canonical", "n.error").collect()
    for r in got:
        assert r["canonical"] == NUMBERS[r["i"]][2], NUMBERS[r["i"]]
        assert (r["error"] is None) == (r["canonical"] is not None)


def test_number_flags(spark):
    rows = [("(612,300.25)",), ("€ 1,250,400.00",), ("-689.9%",), ("007",)]
    d = parse_numbers(spark.createDataFrame(rows, "raw string"), "raw", *FORMATS["pointDecimal"], "n")
    a, b, c, z = [r["n"] for r in d.select("n").collect()]
    assert a["parentheses"] and b["currency"] == "€" and b["used_grouping"] and c["is_percent"] and c["fraction_digits"] == 1 and z["had_leading_zeros"]


def test_ambiguity(spark):
    d = interpretations(spark.createDataFrame([("1.234",), ("848,885",), ("1.5",), ("1,234.5",), ("12",)], "raw string"), "raw")
    assert [r[0] for r in d.select(is_ambiguous()).collect()] == [True, True, False, False, False]
    assert len(POINT_GROUPING) == len(COMMA_GROUPING) == 7 and " " in POINT_GROUPING


def test_no_context_has_no_reading(spark):
    d = parse_numbers(spark.createDataFrame([("12",)], "raw string"), "raw", F.lit(None).cast("string"), F.lit(None).cast("string"), "n")
    assert d.first()["n"] is None


def test_scale_and_positions(spark):
    r = one(spark, scaled(F.lit("1.5"), F.lit("1000")), scaled(F.lit("0.1"), F.lit("3")), scaled(F.lit("1.50"), F.lit("1")), upper_median(F.array(*map(F.lit, [4, 1, 3, 2]))), merged_positions(F.array(*map(F.lit, [1.0, 10.0, 2.0])), 3.0))
    assert tuple(r) == ("1500", "0.3", "1.50", 3, [1.5, 10.0])


DATES = [
    ("03/04/2021", "auto", "ambiguous", ["2021-04-03", "2021-03-04"]), ("03/04/2021", "dmy", "2021-04-03", None), ("03/04/2021", "mdy", "2021-03-04", None), ("29/12/2026", "auto", "2026-12-29", None),
    ("31/02/2026", "dmy", None, None), ("2024", "auto", "2024", None), ("01/2024", "auto", "2024-01", None), ("2024-03-05", "mdy", "2024-03-05", None), ("Jan 2024", "auto", "2024-01", None), ("12 March 2024", "auto", "2024-03-12", None),
    ("March 12, 2024", "auto", "2024-03-12", None), ("Market 2024", "auto", "2024-03", None), ("13/2024", "auto", None, None), ("1/2/3", "auto", None, None), ("", "auto", None, None), (None, "auto", None, None), ("déc. 2020", "auto", "2020-12", None), ("05/05/2021", "auto", "2021-05-05", None), ("1/2/2021", "ymd", None, None),
]


def test_dates(spark):
    d = spark.createDataFrame([(i, raw, order) for i, (raw, order, _, _) in enumerate(DATES)], "i int, raw string, o string")
    for r in parse_dates(d, "raw", F.col("o"), "d").collect():
        raw, order, want, candidates = DATES[r["i"]]
        kind = "ambiguous" if candidates else "value" if want else "invalid"
        assert (r["d"]["kind"], r["d"]["iso"], r["d"]["candidates"]) == (kind, None if candidates else want, candidates), (raw, order)


def test_texts(spark):
    lit = F.lit
    pairs = [
        (clean(lit(" a \n b ")), "a b"), (normalized(lit("Área (km²) – X")), "area km² x"), (similarity(lit(""), lit("")), 1.0), (similarity(lit("a"), lit("")), 0.0), (matches(lit("Area (km²)"), F.array(lit("area km2"), lit("Area (km²)"))), True),
        (column_letter(lit(0)), "A"), (column_letter(lit(25)), "Z"), (column_letter(lit(26)), "AA"), (column_letter(lit(701)), "ZZ"), (column_letter(lit(702)), "AAA"), (address(lit(2), lit(1)), "B3"),
        (split_footnote(lit("12.5*"))[0], "12.5"), (split_footnote(lit("12.5*"))[1], "*"), (split_footnote(lit("1,234 (5)"))[0], "1,234"), (split_footnote(lit("*"))[0], "*"), (split_footnote(lit("*"))[1], None), (split_footnote(lit("12²"))[0], "12"),
        (is_missing(lit(" n/a ")), True), (is_missing(lit("0")), False), (is_total_label(lit(" Grand  total of all")), True), (is_total_label(lit("Tot. 2024")), False), (is_total_label(lit("totally")), False), (is_total_label(lit("SUMME")), True),
        (formula_guard(lit("=SUM(A1:A3)")), "'=SUM(A1:A3)"), (formula_guard(lit("+cmd")), "'+cmd"), (formula_guard(lit("Revenue")), "Revenue"), (formula_guard(lit("-5")), "-5"), (formula_guard(lit("-")), "-"),
        (csv_field(lit("a,b")), '"a,b"'), (csv_field(lit('say "hi"')), '"say ""hi"""'), (csv_field(lit("plain")), "plain"), (xml_text(lit("a<b>&\x01")), "a&lt;b&gt;&amp;"), (recipe_name(lit("Table 3"), lit("x.y.pdf")), "x.y, Table 3"), (recipe_name(lit("Sales"), lit("x.pdf")), "Sales"),
        (F.crc32(lit("123456789")), 0xCBF43926), (similarity(lit("Population"), lit("Popolation")) > 0.8, True),
    ]
    got = one(spark, *[c.alias(f"c{i}") for i, (c, _) in enumerate(pairs)])
    for value, (_, want) in zip(got, pairs, strict=True):
        assert value == want


@pytest.mark.parametrize("turn", [0, 90, 180, 270, -90, 450])
def test_display_and_back(spark, turn):
    crop = g.rect(F.lit(10), F.lit(20), F.lit(580), F.lit(740))
    p = g.to_display(F.lit(100.0), F.lit(200.0), crop, F.lit(turn), F.lit(3.0))
    back = g.to_page(p["x"], p["y"], crop, F.lit(turn), F.lit(3.0))
    size, whole = g.display_size(crop, F.lit(turn), F.lit(3.0)), g.rect_to_display(crop, crop, F.lit(turn), F.lit(3.0))
    r = one(spark, back.alias("b"), size.alias("s"), whole.alias("w"))
    assert abs(r["b"]["x"] - 100) < 1e-6 and abs(r["b"]["y"] - 200) < 1e-6
    assert (r["w"]["x"], r["w"]["y"]) == (0, 0) and r["w"]["width"] == r["s"]["width"] and r["w"]["height"] == r["s"]["height"]


def test_rectangles(spark):
    a, b = g.rect(F.lit(0), F.lit(0), F.lit(4), F.lit(4)), g.rect(F.lit(2), F.lit(2), F.lit(4), F.lit(4))
    r = one(spark, g.intersection_area(a, b), g.iou(a, b), g.union(a, b), g.union_all(F.array(a, b)), g.contains(a, F.lit(4), F.lit(4)), g.inset(a, 1.0))
    assert r[0] == 4 and abs(r[1] - 4 / 28) < 1e-12 and r[2] == r[3] and r[2]["width"] == 6 and r[4] and r[5]["width"] == 2


def test_readers_stay_out_of_generated_code(spark):
    """Expressions of a number's reading made methods that the JVM does not compile; a filter on a reading does not read again."""
    d = interpretations(spark.createDataFrame([("1,234.50",), ("x",)], "raw string"), "raw").filter("point.canonical is not null")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("read(raw") == 1 and "translate" not in plan
    assert d.select("point.canonical", "comma.error").collect() == [("1234.50", "invalidGrouping")]


def test_numbers_with_marks_of_their_own_and_line_ends(spark):
    rows = [("1.234,5", ",", "."), ("1,234.5", ".", ","), ("1.234,5", None, None), (None, ".", ","), ("12\n", ".", ","), ("1'234", ".", "'"), ("1.2.3", ".", ",")]
    d = parse_numbers(spark.createDataFrame(rows, "raw string, d string, g string"), "raw", F.col("d"), F.col("g"), "n")
    got = [r["n"] and (r["n"]["canonical"], r["n"]["error"]) for r in d.collect()]
    assert got == [("1234.5", None), ("1234.5", None), None, (None, "empty"), ("12", None), ("1234", None), (None, "multipleDecimalSeparators")]
