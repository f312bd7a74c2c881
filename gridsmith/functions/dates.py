"""Dates of variable precision: YYYY, YYYY-MM or YYYY-MM-DD, as strings."""

from __future__ import annotations

import re
from calendar import monthrange
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.numbers import of_distinct, structs
from gridsmith.functions.text import BLANKS, BLANKS_AND_ENDS

#: fixed values: starts of month names in five languages
MONTHS = [
    ["jan", "gen", "janv", "ene", "jän"], ["feb", "fev", "fév", "febr"], ["mar", "mär", "mars"], ["apr", "avr", "abr"], ["may", "mag", "mai"], ["jun", "giu", "juin"],
    ["jul", "lug", "juil"], ["aug", "ago", "aoû", "aou"], ["sep", "set", "sept"], ["oct", "ott", "okt"], ["nov"], ["dec", "dic", "déc", "dez"],
]


#: what a number is, with the line end that may follow it
_DIGITS = re.compile(r"[0-9]+(?:\r\n|[\n\r\x85\u2028\u2029])?")
_YEAR = re.compile(r"[0-9]{4}(?:\r\n|[\n\r\x85\u2028\u2029])?")
_MONTH = {name: i + 1 for i, names in enumerate(MONTHS) for name in names}
DATE = [("kind", pa.string()), ("iso", pa.string()), ("candidates", pa.list_(pa.string()))]
DATE_TYPE = "struct<kind: string, iso: string, candidates: array<string>>"
INVALID = ("invalid", None, None)


def _number(text: str) -> int:
    """The whole number of digits and blanks; -1 where an int does not hold it."""
    text = text.strip("\n\r")
    return int(text) if text.isascii() and len(text.lstrip("0")) < 11 and int(text) < 1 << 31 else -1


def _iso(y: int | None, m: int | None, d: int | None = None) -> str | None:
    """The ISO string of numbers that name a real day, or month, of the years 1000 to 2999; else None."""
    if y is None or m is None or not (1000 <= y <= 2999 and 1 <= m <= 12):
        return None
    if d is None:
        return f"{y:04d}-{m:02d}"
    return f"{y:04d}-{m:02d}-{d:02d}" if 1 <= d <= monthrange(y, m)[1] else None


def _worded(text: str) -> str | None:
    """The date of words and numbers: the last number of four digits, the last up to 31, the first name of a month."""
    words = [w for w in re.split(r"[ .\-]", text.lower().replace(",", " ")) if w]
    numbers = [w for w in words if _DIGITS.fullmatch(w)]
    years = [_number(w) for w in numbers if len(w) == 4]
    days = [n for n in (_number(w) for w in numbers if len(w) != 4) if 0 <= n <= 31]
    months = (_MONTH.get(w) or _MONTH.get(w[:4]) or _MONTH.get(w[:3]) for w in words if not _DIGITS.fullmatch(w))
    return _iso(years[-1] if years else None, next((m for m in months if m), None), days[-1] if days else None)


def _parts(text: str) -> list[str] | None:
    """The parts between / . - if there are two or more and all are digits; else None."""
    parts = [p for p in re.split("[/.-]", text) if p]
    return parts if len(parts) >= 2 and all(map(_DIGITS.fullmatch, parts)) else None


@lru_cache(1 << 16)
def read_date(text: str, order: str | None) -> tuple:
    """The fields of parse_dates() of one text."""
    text = text.strip(BLANKS)
    if _YEAR.fullmatch(text) and 1000 <= _number(text) <= 2999:
        return "value", text, None
    parts = _parts(text)
    if parts is None:
        iso = _worded(text)
        return ("value", iso, None) if iso else INVALID
    n, iso = [_number(p) for p in parts], None
    if len(parts) == 3 and len(parts[0]) == 4:
        iso = _iso(n[0], n[1], n[2])
    elif len(parts) == 3 and len(parts[2]) == 4:
        dmy, mdy = _iso(n[2], n[1], n[0]), _iso(n[2], n[0], n[1])
        if order == "auto" and dmy and mdy and dmy != mdy:
            return "ambiguous", None, [dmy, mdy]
        iso = {"dmy": dmy, "mdy": mdy, "auto": dmy or mdy}.get(order)
    elif len(parts) == 2:
        iso = _iso(n[1], n[0]) if len(parts[1]) == 4 else _iso(n[0], n[1]) if len(parts[0]) == 4 else None
    return ("value", iso, None) if iso else INVALID


def read_dates(texts: pa.Array, orders: pa.Array) -> pa.StructArray:
    """read_date() of each text of an array, called once for equal ones."""
    x, o = texts.dictionary_encode("encode"), orders.dictionary_encode("encode")
    codes, at = np.unique(x.indices.to_numpy().astype(np.int64) * (len(o.dictionary) + 1) + o.indices.to_numpy(), return_inverse=True)
    known, order = x.dictionary.to_pylist(), o.dictionary.to_pylist()
    rows = [INVALID if known[i] is None else read_date(known[i], order[j]) for i, j in (divmod(c, len(order) + 1) for c in codes.tolist())]
    return structs(rows, DATE).take(pa.array(at))


def parse_dates(df: DataFrame, raw: str, order: Column | str, out: str) -> DataFrame:
    """df with a struct column `out`: kind (value, ambiguous, invalid), iso, candidates.

    order is dmy, mdy, ymd or auto; auto is ambiguous where both readings are dates and differ.
    """

    @F.arrow_udf(DATE_TYPE)
    def read(texts: pa.Array, orders: pa.Array) -> pa.Array:
        return read_dates(texts, orders)

    return df.withColumn(out, read.asNondeterministic()(F.col(raw), F.lit(order) if isinstance(order, str) else order))


@lru_cache(1 << 16)
def _shown_order(text: str) -> tuple[bool, bool]:
    parts = _parts(text.strip(BLANKS_AND_ENDS)) or []
    if len(parts) != 3 or len(parts[0]) > 2 or len(parts[1]) > 2:
        return False, False
    a, b = _number(parts[0]), _number(parts[1])
    return a > 12 >= b, b > 12 >= a


SHOWN_TYPE = "struct<day: boolean, month: boolean>"


def shown_orders(texts: pa.Array) -> pa.StructArray:
    """Two flags of each text of an array: day (it shows the day first) and month."""
    return of_distinct(texts.fill_null(""), _shown_order, [("day", pa.bool_()), ("month", pa.bool_())])


def order_evidence(x: Column) -> Column:
    """shown_orders() of a column."""

    @F.arrow_udf(SHOWN_TYPE)
    def shown(texts: pa.Array) -> pa.Array:
        return shown_orders(texts)

    return shown.asNondeterministic()(x)
