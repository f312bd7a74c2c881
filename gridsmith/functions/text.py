"""String functions as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space and line ends of any script, as a regex class
SPACE = r"[\t\n\x0B\f\r\x85\p{Z}]"
#: fixed values: markers of missing values
MISSING_TOKENS = ["-", "–", "—", "..", "...", "…", "n/a", "N/A", "n.a.", "NA", "x", ":", "*"]
#: fixed values: what ends a value as a footnote mark
FOOTNOTE = r"(?:\s*(?:[*†‡§¹²³⁴⁵⁶⁷⁸⁹⁰]+|\((?:[a-zA-Z]|\d{1,2})\)))+$"
#: fixed values: labels of total rows
TOTAL_LABEL = r"(?i)^\s*(grand\s+total|total[ei]?s?|tot\.|sum|summe|gesamt|insgesamt|somme|complessivo|totale\s+generale)\b"
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğīįłńňōőřśšşťūůűźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorssstuuuzzz"


#: fixed values: the separators of Unicode, and with line ends
BLANKS = "\t \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BLANKS_AND_ENDS = BLANKS + "\n\x0b\x0c\r\x85\u2028\u2029"


def trim_all(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS_AND_ENDS))


def trim_blanks(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def clean(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def normalized(x: Column) -> Column:
    """Lower case without accents; what is no letter, mark or digit separates words."""
    folded = F.translate(F.lower(x), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{M}\p{N}]+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of normalized texts; 1 if both are empty, 0 if one is."""
    a, b = normalized(a), normalized(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def matches(header: Column, aliases: Column, least: float = 0.8) -> Column:
    return F.exists(aliases, lambda a: similarity(header, a) >= least)


def split_footnote(x: Column) -> tuple[Column, Column]:
    """(value, marker): the marks at the end of a text, unless nothing would be left; no marker is null."""
    last = F.right(x, F.lit(1))
    ends = (last != "") & F.lit("*†‡§¹²³⁴⁵⁶⁷⁸⁹⁰)").contains(last)  # spares most texts the pattern
    mark = F.when(ends, F.regexp_extract(x, FOOTNOTE, 0)).otherwise("")
    value = F.when(mark != "", trim_blanks(F.left(x, F.length(x) - F.length(mark)))).otherwise("")
    return F.when(value != "", value).otherwise(x), F.when(value != "", trim_blanks(mark))


_MARK = re.compile(FOOTNOTE, re.ASCII)


def without_footnotes(texts: pa.Array, where: pa.Array) -> pa.Array:
    """split_footnote()'s values of texts without white space at their ends, where it is asked for."""
    ends = pc.and_(where, pc.match_substring_regex(texts, "[*†‡§¹²³⁴⁵⁶⁷⁸⁹⁰)]$"))
    some = texts.filter(ends).to_pylist()
    return pc.replace_with_mask(texts, ends, pa.array([_MARK.sub("", x, count=1).strip(BLANKS) or x if _MARK.search(x) else x for x in some], pa.string()))


def is_missing(x: Column, tokens: Column | None = None) -> Column:
    tokens = F.array(*map(F.lit, MISSING_TOKENS)) if tokens is None else tokens
    return F.array_contains(tokens, trim_all(x))


def missing_texts(texts: pa.Array) -> pa.Array:
    """is_missing() of texts."""
    return pc.is_in(pc.utf8_trim(texts, BLANKS_AND_ENDS), pa.array(MISSING_TOKENS))


def is_total_label(x: Column, pattern: str = TOTAL_LABEL) -> Column:
    return x.rlike(pattern)


def column_letter(index: Column) -> Column:
    """0 is A, 25 Z, 26 AA, up to three letters."""
    n = index.cast("long")
    letter = lambda k: F.char(k + 65)
    two, three = n - 26, n - 702
    return (
        F.when(n < 26, letter(n))
        .when(n < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def address(row: Column, col: Column) -> Column:
    return F.concat(column_letter(col), (row + 1).cast("string"))


def xml_text(x: Column) -> Column:
    """Escaped for XML; control characters that XML does not allow are dropped."""
    out = F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    return reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], out)


def formula_guard(x: Column, is_number: Column | None = None) -> Column:
    """A quote before texts that a spreadsheet would run; a sign alone or before a number is no formula.

    is_number says whether the text reads as a number under either convention; without it plain digits alone count.
    """
    is_number = x.rlike(r"^[-+]\d+([.,]\d+)?$") if is_number is None else is_number
    risky = x.rlike(r"^[=@\t\r]") | (x.rlike("^[-+]") & (F.length(x) > 1) & ~is_number)
    return F.when(risky, F.concat(F.lit("'"), x)).otherwise(x)


def csv_field(x: Column, delimiter: str = ",") -> Column:
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    needs = x.contains(delimiter) | x.contains('"') | x.contains("\n") | x.contains("\r")
    return F.when(needs, quoted).otherwise(x)


def next_table_name(count: Column) -> Column:
    return F.concat(F.lit("Table "), (count + 1).cast("string"))


def recipe_name(table_name: Column, filename: Column) -> Column:
    """A table's own name, or one after the file for numbered tables."""
    return F.when(table_name.rlike(r"^Table \d+$"), F.concat(F.regexp_replace(filename, r"\.[^.]*$", ""), F.lit(", "), table_name)).otherwise(table_name)
