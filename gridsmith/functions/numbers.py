"""Locale-aware numbers.

Texts are read in Arrow batches, plain numbers as arrays and others once for equal ones: as expressions, the reading of a
number makes generated methods that are too long for the JVM to compile.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.text import BLANKS, BLANKS_AND_ENDS

#: fixed values
MINUS_SIGNS = "-−–‒"
CURRENCIES = ["€", "$", "£", "¥", "₹", "CHF", "EUR", "USD", "GBP", "JPY", "Fr."]
SPACES = " \u00a0\u202f\u2009"
APOSTROPHES = "'’"
POINT_GROUPING = "," + APOSTROPHES + SPACES
COMMA_GROUPING = "." + APOSTROPHES + SPACES
#: format: (decimal mark, grouping marks)
FORMATS = {
    "pointDecimal": (".", ", \u00a0\u202f"),
    "commaDecimal": (",", ". \u00a0\u202f"),
    "spaceCommaDecimal": (",", " \u00a0\u202f."),
    "apostrophePointDecimal": (".", "'’ \u00a0"),
}


def format_decimal(fmt: Column) -> Column:
    """The decimal mark that a number format fixes; null for auto or none."""
    return F.when(fmt.isin(*[k for k, v in FORMATS.items() if v[0] == "."]), ".").when(fmt.isin(*[k for k, v in FORMATS.items() if v[0] == ","]), ",")


def format_grouping(fmt: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (_, marks) in FORMATS.items():
        out = F.when(fmt == name, marks).otherwise(out)
    return out


def evidence_grouping(decimal: Column) -> Column:
    return F.when(decimal == ".", POINT_GROUPING).when(decimal == ",", COMMA_GROUPING)


#: what a plain number looks like once its decimal mark is a point: commas in groups of three, no zeros in front
PLAIN = r"^(?:-?(?:[1-9][0-9]*|[1-9][0-9]{0,2}(?:,[0-9]{3})+)(?:\.[0-9]+)?|0(?:\.[0-9]+)?)$"
#: and what digits and marks must look like to be a number at all
_MARKED = re.compile(r"[0-9.,]*[0-9][0-9.,]*")
_WHOLE = re.compile(r"(?:[0-9]*|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]*)?")
_SWAPPED = str.maketrans(",.", ".,")
_FAMILIES = str.maketrans(SPACES + APOSTROPHES, "    ''")
_NO_DIGITS = str.maketrans("", "", "0123456789")
_GROUPS = re.compile(r"[0-9]{1,3}(?:,[0-9]{3})+")
NUMBER = [
    ("canonical", pa.string()), ("fraction_digits", pa.int32()), ("had_leading_zeros", pa.bool_()), ("used_grouping", pa.bool_()),
    ("is_percent", pa.bool_()), ("currency", pa.string()), ("parentheses", pa.bool_()), ("error", pa.string()),
]
NUMBER_TYPE = "struct<canonical: string, fraction_digits: int, had_leading_zeros: boolean, used_grouping: boolean, is_percent: boolean, currency: string, parentheses: boolean, error: string>"


def _failed(error: str) -> tuple:
    return None, None, False, False, False, None, False, error


EMPTY = _failed("empty")


def usual(decimal: str, grouping: str | None) -> bool:
    """Whether comma and point are the decimal and a grouping mark, in either order."""
    return decimal == "." and "," in (grouping or "") or decimal == "," and "." in (grouping or "")


def read_number(text: str, decimal: str, grouping: str | None) -> tuple:
    """The fields of parse_numbers() of one text."""
    plain = (text if decimal == "." else text.translate(_SWAPPED)) if usual(decimal, grouping) else ""
    if _MARKED.fullmatch(plain) and not _WHOLE.fullmatch(plain):  # spares what is no number under this mark the rest
        return _failed("multipleDecimalSeparators" if plain.count(".") > 1 else "invalidGrouping")
    x = whole = text.strip(BLANKS_AND_ENDS)
    paren = len(x) > 2 and x[0] == "(" and x[-1] == ")"
    x = x[1:-1].strip(BLANKS) if paren else x
    percent = x.endswith("%")
    x = x[:-1].strip(BLANKS) if percent else x
    currency = next((c for c in CURRENCIES if x.startswith(c) or x.endswith(c)), None)
    if currency:
        x = (x[len(currency) :] if x.startswith(currency) else x[: -len(currency)]).strip(BLANKS)
    minus = x != "" and x[0] in MINUS_SIGNS
    x = x[1:].strip(BLANKS) if minus or x.startswith("+") else x
    after_sign = None if currency else next((c for c in CURRENCIES if x.startswith(c)), None)
    x = x[len(after_sign) :].strip(BLANKS) if after_sign else x
    if whole == "" or x == "":
        return EMPTY
    if grouping is not None and any(c not in grouping and c != decimal for c in x.translate(_NO_DIGITS)):
        return _failed("notNumeric")
    if not any(c in "0123456789" for c in x):
        return EMPTY
    marks = x.count(decimal)
    if marks > 1:
        return _failed("multipleDecimalSeparators")
    whole, _, fraction = x.partition(decimal)
    marked = whole.translate(_NO_DIGITS)
    family = marked.translate(_FAMILIES)
    shaped = grouping is None or _GROUPS.fullmatch("".join("," if c in grouping else c for c in whole))
    if fraction.translate(_NO_DIGITS) or marked and not (family.strip(family[0]) == "" and shaped):
        return _failed("invalidGrouping")
    digits = "".join(c for c in whole if c in "0123456789")
    size = (digits.lstrip("0") or "0") + ("." + fraction if fraction else "")
    negative = paren != minus and size.strip("0.") != ""
    return "-" + size if negative else size, len(fraction), len(digits) > 1 and digits[0] == "0", marked != "", percent, currency or after_sign, paren, None


def structs(rows: list[tuple | None], fields: list[tuple[str, pa.DataType]]) -> pa.StructArray:
    """Rows as an array of structs, None as a null one."""
    none = (None,) * len(fields)
    columns = zip(*[none if r is None else r for r in rows], strict=True) if rows else [()] * len(fields)
    arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=[pa.field(*f) for f in fields], mask=pa.array([r is None for r in rows], pa.bool_()))


def of_distinct(texts: pa.Array, read: Callable[[str], tuple], fields: list[tuple[str, pa.DataType]]) -> pa.StructArray:
    """What `read` makes of each text, called once for equal ones; none is null."""
    found = texts.dictionary_encode()
    return structs([read(x) for x in found.dictionary.to_pylist()], fields).take(found.indices)


def read_numbers(texts: pa.Array, decimal: str, grouping: str | None) -> pa.StructArray:
    """read_number() of each text of an array: plain numbers are read as arrays, all others by themselves."""
    known = texts.is_valid()
    x = texts.fill_null("")
    if not usual(decimal, grouping):
        return of_distinct(x, lambda text: read_number(text, decimal, grouping), NUMBER)
    plain = x
    if decimal == ",":
        for old, new in ((",", "\0"), (".", ","), ("\0", ".")):
            plain = pc.replace_substring(plain, old, new)
    rest = pc.invert(pc.and_(known, pc.match_substring_regex(plain, PLAIN)))
    others = of_distinct(x.filter(rest), lambda text: read_number(text, decimal, grouping), NUMBER)
    no, fraction = pa.repeat(False, len(x)), pc.utf8_length(pc.replace_substring_regex(plain, r"^[^.]*\.?", ""))
    no_text = pa.nulls(len(x), pa.string())
    columns = [pc.replace_substring(plain, ",", ""), fraction, no, pc.match_substring(plain, ","), no, no_text, no, no_text]
    return pa.StructArray.from_arrays([pc.replace_with_mask(c, rest, o) for c, o in zip(columns, others.flatten(), strict=True)], fields=[pa.field(*f) for f in NUMBER])


def read_marked(texts: pa.Array, decimals: pa.Array, groupings: pa.Array) -> pa.StructArray:
    """read_numbers() of texts with marks of their own, null where the decimal mark is."""
    d, g = decimals.dictionary_encode("encode"), groupings.dictionary_encode("encode")
    codes = d.indices.to_numpy().astype(np.int64) * (len(g.dictionary) + 1) + g.indices.to_numpy()
    order, parts = [], []
    for code in np.unique(codes).tolist():
        at = np.flatnonzero(codes == code)
        mark = decimals[at[0]].as_py()
        order.append(at)
        parts.append(structs([None] * len(at), NUMBER) if mark is None else read_numbers(texts.take(pa.array(at)), mark, groupings[at[0]].as_py()))
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order)))) if parts else structs([], NUMBER)


def parse_numbers(df: DataFrame, raw: str, decimal: Column | str, grouping: Column | str, out: str) -> DataFrame:
    """df with a struct column `out`: canonical, fraction_digits, flags and error of the text in `raw`.

    A canonical number is a decimal string that keeps its fraction digits.  error is empty, notNumeric,
    multipleDecimalSeparators or invalidGrouping, and null where the text is a number.  A null text gives an
    `empty` error, a null decimal mark a null struct.  Percent signs are noted, not divided out; a minus inside
    parentheses turns the sign back.  The functions are called non-deterministic so that no filter repeats them.
    """

    @F.arrow_udf(NUMBER_TYPE)
    def read(texts: pa.Array, decimals: pa.Array, groupings: pa.Array) -> pa.Array:
        return read_marked(texts, decimals, groupings)

    marks = [F.lit(m) if isinstance(m, str) else m for m in (decimal, grouping)]
    return df.withColumn(out, read.asNondeterministic()(F.col(raw), *marks))


def both_readings(texts: pa.Array) -> list[pa.StructArray]:
    return [read_numbers(texts, ".", POINT_GROUPING), read_numbers(texts, ",", COMMA_GROUPING)]


def interpretations(df: DataFrame, raw: str, point: str = "point", comma: str = "comma") -> DataFrame:
    """Both readings of a text: with a decimal point and with a decimal comma."""

    @F.arrow_udf(f"struct<point: {NUMBER_TYPE}, comma: {NUMBER_TYPE}>")
    def read(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(both_readings(texts), names=["point", "comma"])

    d = df.withColumn("__both", read.asNondeterministic()(F.col(raw)))
    return d.withColumns({point: F.col("__both.point"), comma: F.col("__both.comma")}).drop("__both")


#: what no reading of a number refuses at once: a digit, and digits, marks, signs and currencies alone
_MAY_READ = "^[" + re.escape("0123456789.,()%+" + MINUS_SIGNS + APOSTROPHES + BLANKS_AND_ENDS + "".join(sorted(set("".join(CURRENCIES)) - set(".")))) + "]*$"


def numeric_texts(texts: pa.Array) -> pa.Array:
    """looks_numeric() of texts that are not null: digits and plain numbers by patterns, and what else may be one by its readings."""
    yes = pc.or_(pc.match_substring_regex(texts, "^[0-9]+$"), pc.match_substring_regex(texts, PLAIN))
    open_ = pc.and_(pc.invert(yes), pc.and_(pc.match_substring_regex(texts, "[0-9]"), pc.match_substring_regex(texts, _MAY_READ)))
    rest = texts.filter(open_).dictionary_encode()
    read = [read_number(x, ".", POINT_GROUPING)[0] is not None or read_number(x, ",", COMMA_GROUPING)[0] is not None for x in rest.dictionary.to_pylist()]
    return pc.replace_with_mask(yes, open_, pa.array(read, pa.bool_()).take(rest.indices))


def is_ambiguous(point: str = "point", comma: str = "comma") -> Column:
    a, b = F.col(f"{point}.canonical"), F.col(f"{comma}.canonical")
    return a.isNotNull() & b.isNotNull() & (a != b)


def looks_numeric(point: str = "point", comma: str = "comma") -> Column:
    return F.col(f"{point}.canonical").isNotNull() | F.col(f"{comma}.canonical").isNotNull()


def is_year(x: Column) -> Column:
    return x.rlike(r"^\d{4}$") & F.coalesce(x.try_cast("int").between(1900, 2100), F.lit(False))


def year_texts(texts: pa.Array) -> pa.Array:
    """is_year() of texts; as there, one line end may follow."""
    return pc.match_substring_regex(texts, r"^(?:19[0-9]{2}|20[0-9]{2}|2100)(?:\r?\n|\r)?$")


def scaled(canonical: Column, factor: Column) -> Column:
    """The product of two decimal strings, twelve places at most, without trailing zeros; factor 1 leaves it alone.

    Powers of ten move the point, whatever the number of digits; other factors take 20 digits before the point.
    """
    up = F.when(factor.rlike("^10*$"), F.length(factor) - 1).when(factor.rlike(r"^0\.0*1$"), 2 - F.length(factor))
    whole, part = F.split_part(F.ltrim(canonical, F.lit("-")), F.lit("."), F.lit(1)), F.split_part(canonical, F.lit("."), F.lit(2))
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    digits = F.concat(zeros(-up), whole, part, zeros(up - F.length(part)))
    place = F.length(whole) + F.greatest(-up, F.lit(0)) + up
    moved = F.concat(F.left(digits, place), F.lit("."), F.substring(digits, place + 1, F.length(digits)))
    long = F.length(F.split_part(moved, F.lit("."), F.lit(2))) > 12
    moved = F.when(long, F.round(moved.try_cast("decimal(38,18)"), 12).cast("string")).otherwise(moved)
    moved = F.concat(F.when(canonical.startswith("-"), "-").otherwise(""), F.regexp_replace(moved, r"^0+(?=\d)", ""))
    product = F.when(up.isNotNull(), moved).otherwise(F.round(canonical.try_cast("decimal(32,12)") * factor.try_cast("decimal(12,6)"), 12).cast("string"))
    short = F.regexp_replace(F.when(product.contains("."), F.regexp_replace(product, "0+$", "")).otherwise(product), r"\.$", "")
    return F.when((factor == "1") | (factor == ""), canonical).otherwise(F.when(short == "-0", "0").otherwise(short))


def upper_median(values: Column) -> Column:
    """The element at n / 2 of the sorted values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def merged_positions(values: Column, tolerance: Column | float) -> Column:
    """Sorted positions in which one within the tolerance of the last moves it to their midpoint."""
    empty = F.array().cast("array<double>")

    def step(acc: Column, x: Column) -> Column:
        near = (F.size(acc) > 0) & (x - F.try_element_at(acc, F.lit(-1)) <= tolerance)
        return F.when(near, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array((F.try_element_at(acc, F.lit(-1)) + x) / 2))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(values.cast("array<double>")), empty, step)
