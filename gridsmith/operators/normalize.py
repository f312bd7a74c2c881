"""Evidence, contexts, type inference and normalisation of table cells, for all tables of a library at once.

cells: table_id, row, col, text.  columns: table_id, col, type, number_format, scale.  settings: table_id,
number_format, date_order, missing_tokens, strip_footnote_markers.  Evidence is aggregated on (table_id, col) before
it moves, and joined back by key.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.dates import DATE_TYPE, SHOWN_TYPE, order_evidence, parse_dates, read_dates, shown_orders
from gridsmith.functions.numbers import (
    COMMA_GROUPING, NUMBER_TYPE, POINT_GROUPING, both_readings, evidence_grouping, format_decimal, format_grouping, is_ambiguous, read_marked, read_numbers, scaled,
)
from gridsmith.functions.text import BLANKS_AND_ENDS, MISSING_TOKENS, is_missing, without_footnotes

NUMERIC = ["integer", "decimal", "percent", "currency"]
#: fixed values: words in headers of identifier columns
IDENTIFIER_WORDS = [
    "code", "codice", "cod.", "id", "istat", "zip", "cap", "postal", "postcode", "iso", "nuts", "fips",
    "ateco", "nace", "isin", "iban", "vat", "piva", "p.iva", "sku", "ean", "plz", "siren", "insee",
]
#: fixed values: words in headers of scaled columns
SCALES = [
    ("thousand", "1000"), ("migliaia", "1000"), ("'000", "1000"), ("000s", "1000"), ("tausend", "1000"), ("milliers", "1000"),
    ("million", "1000000"), ("milioni", "1000000"), ("millionen", "1000000"), ("billion", "1000000000"), ("miliardi", "1000000000"),
]


def dominant(point: Column, comma: Column) -> tuple[Column, Column]:
    """(decimal mark, weight) of two counts: the only one, or the one four times the other."""
    d = F.when((point > 0) & (point >= comma * 4), ".").when((comma > 0) & (comma >= point * 4), ",")
    return d, F.when(d == ".", point - comma).when(d == ",", comma - point)


def with_readings(cells: DataFrame, text: str = "text", tokens: Column | None = None, strip: Column | None = None) -> DataFrame:
    """cells with `value` (trimmed, footnote mark split off), `skip` (empty or missing), `blank` and both readings.

    blank is empty or missing as it stands, skip also what is a missing marker once its footnote mark is off.  Where
    cells carry a type, only those of numeric columns are read as numbers, and `shown` tells the order that texts of date
    columns show, which else order_evidence() reads from all.
    """
    typed = "type" in cells.columns

    @F.arrow_udf(f"struct<trim: string, value: string, point: {NUMBER_TYPE}, comma: {NUMBER_TYPE}, shown: {SHOWN_TYPE}>")
    def read(texts: pa.Array, strips: pa.Array, numeric: pa.Array, dated: pa.Array) -> pa.Array:
        trimmed = pc.utf8_trim(texts.fill_null(""), BLANKS_AND_ENDS)
        values = without_footnotes(trimmed, strips.fill_null(False))
        readings = both_readings(pc.if_else(numeric.fill_null(False), values, None))
        shown = shown_orders(pc.if_else(dated.fill_null(False), texts, None))
        return pa.StructArray.from_arrays([trimmed, values, *readings, shown], names=["trim", "value", "point", "comma", "shown"])

    numeric, dated = (F.col("type").isin(NUMERIC), F.col("type") == "date") if typed else (F.lit(True), F.lit(False))
    out = cells.withColumn("__r", read.asNondeterministic()(F.col(text), F.lit(True) if strip is None else strip, numeric, dated))
    tokens = F.array(*map(F.lit, MISSING_TOKENS)) if tokens is None else tokens
    blank = (F.col("__r.trim") == "") | F.array_contains(tokens, F.col("__r.trim"))
    skip = blank | is_missing(F.col("__r.value"), tokens)
    out = out.withColumns({"value": F.col("__r.value"), "blank": blank, "skip": skip, "point": F.col("__r.point"), "comma": F.col("__r.comma")} | ({"shown": F.col("__r.shown")} if typed else {}))
    return out.drop("__r")


def only_reading() -> tuple[Column, Column]:
    """(reads with a point only, reads with a comma only)."""
    a, b = F.col("point.canonical").isNotNull(), F.col("comma.canonical").isNotNull()
    return ~F.col("skip") & a & ~b, ~F.col("skip") & b & ~a


def decimal_evidence(readings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, point, comma, decimal, weight: how many values read under one convention only."""
    a, b = only_reading()
    counts = readings.groupBy(*keys).agg(F.count_if(a).alias("point"), F.count_if(b).alias("comma"))
    d, w = dominant(F.col("point"), F.col("comma"))
    return counts.withColumns({"decimal": d, "weight": w})


def contexts(readings: DataFrame, columns: DataFrame, settings: DataFrame) -> DataFrame:
    """table_id, col, decimal, grouping, resolution, date_order, date_resolution.

    A column's format comes before the table's, evidence in the column before that in the table's numeric columns.
    """
    numeric = F.col("type").isin(NUMERIC)
    only_point, only_comma = only_reading()
    shown = F.col("shown") if "shown" in readings.columns else order_evidence(F.col("text"))
    counts = readings.withColumn("__shown", shown).groupBy("table_id", "col")
    counts = counts.agg(F.count_if(only_point).alias("p"), F.count_if(only_comma).alias("q"), F.bool_or("__shown.day").alias("dmy"), F.bool_or("__shown.month").alias("mdy"))
    own, weight = dominant(F.col("p"), F.col("q"))
    counts = counts.select("table_id", "col", own.alias("own"), weight.alias("weight"), "dmy", "mdy")
    c = columns.select("table_id", "col", "type", F.col("number_format").alias("column_format")).join(counts, ["table_id", "col"], "left")
    # over the columns of a table and not joined back, so that cells are read once
    table = Window.partitionBy("table_id")
    of_mark = lambda mark: F.sum(F.when(numeric & (F.col("own") == mark), F.col("weight")).otherwise(0)).over(table)
    c = c.withColumns({"p": of_mark("."), "q": of_mark(",")})
    c = c.withColumn("of_table", dominant(F.col("p"), F.col("q"))[0])
    s = settings.select("table_id", F.col("number_format").alias("table_format"), F.col("date_order").alias("set_order"))
    c = c.join(s, "table_id", "left")
    steps = [("columnSetting", format_decimal(F.col("column_format"))), ("tableSetting", format_decimal(F.col("table_format"))), ("columnEvidence", F.col("own")), ("tableEvidence", F.col("of_table"))]
    how = F.when(~numeric, "notApplicable")
    for name, d in steps:
        how = how.when(d.isNotNull(), name)
    c = c.withColumn("resolution", how.otherwise("unresolved"))
    decimal = F.when(numeric, F.coalesce(*[d for _, d in steps]))
    grouping = F.when(F.col("resolution") == "columnSetting", format_grouping(F.col("column_format"))).when(F.col("resolution") == "tableSetting", format_grouping(F.col("table_format"))).otherwise(evidence_grouping(decimal))
    is_date, fixed = F.col("type") == "date", F.coalesce(F.col("set_order"), F.lit("auto"))
    dmy, mdy = F.coalesce("dmy", F.lit(False)), F.coalesce("mdy", F.lit(False))
    found = F.when(dmy & ~mdy, "dmy").when(mdy & ~dmy, "mdy")
    return c.select(
        "table_id", "col", decimal.alias("decimal"), grouping.alias("grouping"), "resolution",
        F.when(~is_date | (fixed != "auto"), fixed).otherwise(F.coalesce(found, F.lit("auto"))).alias("date_order"),
        F.when(~is_date, "notApplicable").when(fixed != "auto", "tableSetting").when(found.isNotNull(), "columnEvidence").otherwise("unresolved").alias("date_resolution"),
    )


def normalize(cells: DataFrame, text: str = "text") -> DataFrame:
    """cells with a struct `norm`: kind, canonical, fraction_digits, candidates, had_leading_zeros, missing_token, steps, problem.

    cells carry type, scale, decimal, grouping, resolution, date_order, missing_tokens and strip (boolean).  kind is
    empty, missing, value, ambiguous or invalid.
    """
    kept = cells.columns
    numeric = F.col("type").isin(NUMERIC)
    open_ = F.col("decimal").isNull()

    # with the decimal mark of the column, or else with a point; where the mark is open, with a comma as well
    # only what is told below leaves the function: canonical of both, error of the first, zeros in front of that which counts
    @F.arrow_udf(f"struct<t: string, v: string, point: string, comma: string, zeros: boolean, error: string, date: {DATE_TYPE}>")
    def read(texts: pa.Array, types: pa.Array, decimals: pa.Array, groupings: pa.Array, orders: pa.Array, strips: pa.Array) -> pa.Array:
        trimmed = pc.utf8_trim(texts.fill_null(""), BLANKS_AND_ENDS)
        is_number, is_open = pc.is_in(types, pa.array(NUMERIC)), decimals.is_null()
        values = without_footnotes(trimmed, pc.and_(is_number, strips.fill_null(False)))
        numbers = pc.if_else(is_number, values, None)
        point = read_marked(numbers, decimals.fill_null("."), pc.if_else(is_open, POINT_GROUPING, groupings))
        comma = read_numbers(pc.if_else(is_open, numbers, None), ",", COMMA_GROUPING)
        dates = read_dates(pc.if_else(pc.equal(types, "date").fill_null(False), trimmed, None), orders)
        of = lambda x, name: pc.struct_field(x, name)
        first = pc.or_(pc.invert(is_open), of(point, "canonical").is_valid())
        zeros = pc.if_else(first, of(point, "had_leading_zeros"), of(comma, "had_leading_zeros"))
        return pa.StructArray.from_arrays([trimmed, values, of(point, "canonical"), of(comma, "canonical"), zeros, of(point, "error"), dates], names=["t", "v", "point", "comma", "zeros", "error", "date"])

    d = cells.withColumn("__r", read.asNondeterministic()(F.col(text), "type", "decimal", "grouping", "date_order", "strip"))
    d = d.withColumns({"__raw": F.coalesce(F.col(text), F.lit("")), "__t": F.col("__r.t"), "__v": F.col("__r.v"), "__date": F.col("__r.date")})
    d = d.withColumn("__cut", numeric & F.col("strip") & (F.col("__v") != F.col("__t")))
    point, comma = F.col("__r.point"), F.col("__r.comma")
    fixed = F.col("decimal").isNotNull()
    d = d.withColumn("__two", numeric & ~fixed & point.isNotNull() & comma.isNotNull() & (point != comma))
    d = d.withColumn("__n", F.when(fixed | point.isNotNull(), point).otherwise(comma))
    canonical = F.col("__n")
    d = d.withColumns({"__whole": F.regexp_replace(canonical, r"\.0+$", ""), "__bad_int": F.coalesce((F.col("type") == "integer") & canonical.rlike(r"\.\d*[1-9]"), F.lit(False))})
    d = d.withColumn("__base", F.when(F.col("type") == "integer", F.col("__whole")).otherwise(canonical))
    scale = F.coalesce(F.col("scale"), F.lit("1"))
    rescaled = ~scale.isin("1", "")
    d = d.withColumn("__scaled", F.when(rescaled, F.get(F.transform(F.array("__base"), lambda x: scaled(x, scale)), F.lit(0))).otherwise(F.col("__base")))
    t = F.col("__t")
    marks = numeric | (F.col("type") == "date")
    token = F.when(marks & F.array_contains(F.col("missing_tokens"), t), t).when(numeric & F.col("strip") & is_missing(F.col("__v"), F.col("missing_tokens")), F.col("__v"))
    d = d.withColumn("__token", token)
    is_date = F.col("type") == "date"
    kind = (
        F.when(t == "", "empty").when(F.col("__token").isNotNull(), "missing").when(is_date, F.col("__date.kind"))
        .when(~numeric, "value").when(F.col("__two"), "ambiguous")
        .when(canonical.isNull() | F.col("__bad_int") | F.col("__scaled").isNull(), "invalid").otherwise("value")
    )
    d = d.withColumn("__kind", kind)
    of_number = numeric & (F.col("__kind") == "value")
    whole = F.when(of_number, F.col("__scaled")).when(numeric & F.col("__bad_int") & (F.col("__kind") == "invalid"), canonical).when(is_date & (F.col("__kind") == "value"), F.col("__date.iso")).when(~numeric & ~is_date & (F.col("__kind") == "value"), t)
    d = d.withColumn("__canonical", whole)
    fraction = F.length(F.split_part(F.col("__canonical"), F.lit("."), F.lit(2)))
    step = lambda name, a, b: F.struct(F.lit(name).alias("operation"), a.alias("input"), b.alias("output"))
    live = F.col("__kind") != "empty"
    steps = F.array_compact(F.array(
        F.when(live & (t != F.col("__raw")), step("trim", F.col("__raw"), t)),
        F.when(live & F.col("__cut"), step("footnote", t, F.col("__v"))),
        F.when(numeric & ~F.col("__two") & F.col("__token").isNull() & (canonical != F.col("__v")), step("parseNumber", F.col("__v"), canonical)),
        F.when(is_date & (F.col("__kind") == "value") & (F.col("__date.iso") != t), step("parseDate", t, F.col("__date.iso"))),
        F.when(of_number & rescaled, step("scale", F.col("__base"), F.col("__scaled"))),
    ))
    zeros = F.when(numeric, F.col("__kind").isin("value", "invalid") & F.coalesce(F.col("__r.zeros"), F.lit(False))).otherwise((F.col("type") == "identifier") & t.rlike("^0."))
    problem = F.when(F.col("__kind") == "ambiguous", "ambiguous").when(F.col("__kind") != "invalid", None).when(is_date, "date").when(F.col("__bad_int"), "fraction").when(canonical.isNotNull(), "scale").otherwise(F.when(fixed, F.coalesce(F.col("__r.error"), F.lit("notNumeric"))).otherwise("notNumeric"))
    norm = F.struct(
        F.col("__kind").alias("kind"), F.col("__canonical").alias("canonical"), F.when(numeric, fraction).alias("fraction_digits"),
        F.when(F.col("__two"), F.array(point, comma)).when(F.col("__kind") == "ambiguous", F.col("__date.candidates")).alias("candidates"),
        zeros.alias("had_leading_zeros"), F.col("__token").alias("missing_token"), steps.alias("steps"), problem.alias("problem"),
    )
    return d.select(*kept, norm.alias("norm"))


def identifier_header(header: Column) -> Column:
    """Short keywords must be words of the header, longer ones may be anywhere in it."""
    low = F.lower(F.coalesce(header, F.lit("")))
    words = F.split(F.regexp_replace(low, r"[^\p{L}.]+", " "), " ")
    return F.arrays_overlap(words, F.array(*[F.lit(k) for k in IDENTIFIER_WORDS if len(k) <= 3])) | F.exists(F.array(*[F.lit(k) for k in IDENTIFIER_WORDS if len(k) > 3]), lambda k: F.contains(low, k))


def infer_types(readings: DataFrame, headers: DataFrame, number_format: Column | None = None, hints: DataFrame | None = None, by_data: bool = False) -> DataFrame:
    """table_id, col, type: one aggregation over the readings of all cells, then rules on its counts.

    headers: table_id, col, header.  hints: table_id, hint (a decimal mark); a number format, if given, comes first.
    by_data: where a table's hint is null, it is the mark that its data show, told by the same aggregation.
    """
    d = parse_dates(readings.filter(~F.col("blank")), "value", "auto", "date")
    v = F.col("value")
    any_ = F.coalesce(F.col("point"), F.col("comma"))
    any_ = F.when(F.col("point.canonical").isNotNull(), F.col("point")).otherwise(F.col("comma"))
    reads = any_["canonical"].isNotNull()
    whole = lambda s: F.col(f"{s}.canonical").isNull() | (F.col(f"{s}.fraction_digits") > 0)
    fraction = lambda s: F.coalesce(F.col(f"{s}.fraction_digits") > 0, F.lit(False))
    counted = d.groupBy("table_id", "col").agg(
        F.count("*").alias("n"), F.bool_and(v.rlike("^[0-9]*$")).alias("digits"), F.bool_or(v.rlike("^0[0-9]+$")).alias("zero"),
        F.bool_and(~v.rlike(r"[\t\p{Z}]") & (F.length(v) <= 20)).alias("compact"), F.bool_or(v.rlike(r"\p{L}")).alias("letter"),
        F.count_if(reads).alias("numbers"), F.count_if(reads & any_["is_percent"]).alias("percents"), F.count_if(reads & any_["currency"].isNotNull()).alias("currencies"),
        F.count_if(reads & whole("point") & whole("comma")).alias("fractions"), F.count_if(is_ambiguous()).alias("doubtful"),
        F.bool_or(fraction("point")).alias("point_fraction"), F.bool_or(fraction("comma")).alias("comma_fraction"),
        F.count_if(F.col("date.kind") != "invalid").alias("dates"), F.bool_and(v.rlike("^[0-9]{4}$")).alias("years"),
        *([F.count_if(x).alias(f"__only_{name}") for x, name in zip(only_reading(), ("point", "comma"), strict=True)] if by_data else []),
    )
    if by_data:
        of_table = [F.sum(f"__only_{name}").over(Window.partitionBy("table_id")) for name in ("point", "comma")]
        counted = counted.withColumns({"__p": of_table[0], "__q": of_table[1]})
        counted = counted.withColumn("__shown", dominant(F.col("__p"), F.col("__q"))[0])
    c = headers.join(counted, ["table_id", "col"], "left").withColumn("__id", identifier_header(F.col("header")))
    if by_data:
        c = c.join(hints.select("table_id", F.col("hint").alias("__hint"), F.lit(True).alias("__known")), "table_id", "left").withColumn("hint", F.coalesce("__hint", F.when(F.col("__known"), F.col("__shown"))))
    else:
        c = c.join(hints.select("table_id", "hint"), "table_id", "left") if hints is not None else c.withColumn("hint", F.lit(None).cast("string"))
    mark = F.coalesce(format_decimal(number_format), F.col("hint")) if number_format is not None else F.col("hint")
    settled = F.when(mark.isNull(), "decimal").when(F.when(mark == ".", F.col("point_fraction")).otherwise(F.col("comma_fraction")), "decimal").otherwise("integer")
    numbers = F.when(F.col("percents") * 2 >= F.col("numbers"), "percent").when(F.col("currencies") * 2 >= F.col("numbers"), "currency").when(F.col("fractions") > 0, "decimal").when(F.col("doubtful") > 0, settled).otherwise("integer")
    kind = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "text")
        .when(F.col("digits") & (F.col("zero") | F.col("__id")), "identifier")
        .when(F.col("__id") & F.col("compact") & (F.col("letter") | F.col("digits")), "identifier")
        .when(F.col("numbers") >= F.col("n") * 0.8, numbers)
        .when(~F.col("years") & (F.col("dates") >= F.col("n") * 0.8), "date")
        .otherwise("text")
    )
    return c.select("table_id", "col", kind.alias("type"))


def infer_scale(header: Column) -> Column:
    """The factor that a header names; null if none."""
    low = F.lower(header)
    return F.coalesce(*[F.when(low.contains(word), factor) for word, factor in SCALES])
