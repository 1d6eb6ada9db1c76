"""Column-expression building blocks for text: strip, first-matching pattern, amount parsing.

All of these are native Spark expressions (codegen'd, JVM-side); none is a Python UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import PY_WHITESPACE


def _digits() -> tuple[str, str]:
    found = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


#: Digits beyond ASCII (category Nd) and the ASCII digits of their values.
DIGITS = _digits()


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c: Column | str) -> Column:
    """Python ``str.strip()``: remove every Unicode whitespace character from both ends (``trim`` strips spaces only)."""
    return F.trim(col_of(c), F.lit(PY_WHITESPACE))


def is_ascii(c: Column | str) -> Column:
    """As many characters as bytes: ASCII alone (or bytes that are no UTF-8, which no pattern matches)."""
    return F.length(c) == F.octet_length(c)


def first_of(rows: DataFrame, text: str, patterns: dict[str, list[str]], plain: str | None = None,
             plain_patterns: dict[str, list[str]] | None = None, whole: Collection[str] = ()) -> DataFrame:
    """``rows`` with one column per field: group 1 of the first match of its first matching pattern, stripped.

    The n-th patterns of all fields are searched in the n-th projection, and only where the earlier ones found
    nothing. A search stops at its first match; a second, cheap match on that short string takes its group. No
    pattern matches an empty string, so an empty result of the search is a miss. An empty group (after stripping)
    is NULL and does not fall through to a later pattern. The group of a field in ``whole`` is never empty when its
    pattern matches and needs no stripping: its search takes the group at once.

    ``plain`` names a column that holds the text where it is ASCII alone and NULL elsewhere; it is searched with
    ``plain_patterns``, the forms for such texts.
    """
    keep = rows.columns

    def find(source: str, f: str, n: int, group: int) -> Column:
        found = F.regexp_extract(source, patterns[f][n], group)
        if plain is None:
            return found
        return F.when(F.col(plain).isNull(), found).otherwise(F.regexp_extract(plain if source == text else source, plain_patterns[f][n], group))

    hits: list[str] = []
    for n in range(max(map(len, patterns.values()))):
        # NULL where an earlier pattern has found something: the condition compares with its empty result only
        cols = {}
        for f, ps in patterns.items():
            if n < len(ps):
                found = find(text, f, n, 1 if f in whole else 0)
                cols[f"_hit{n}_{f}"] = found if n == 0 else F.when(F.col(f"_hit{n - 1}_{f}") == "", found)
        rows = rows.select(*keep, *hits, *[c.alias(h) for h, c in cols.items()])
        hits += cols

    def group(f: str) -> Column:
        if f in whole:
            return F.nullif(F.coalesce(*[F.col(f"_hit{n}_{f}") for n in reversed(range(len(patterns[f])))]), F.lit(""))
        found = [F.when(F.col(f"_hit{n}_{f}") != "", find(f"_hit{n}_{f}", f, n, 1)) for n in range(len(patterns[f]))]
        return F.nullif(ustrip(F.coalesce(*found)), F.lit(""))

    return rows.select(*keep, *[group(f).alias(f) for f in patterns])


def ascii_digits(s: Column) -> Column:
    """Decimal digits of every script as 0-9, as ``int`` and ``float`` read them; other characters stay."""
    return F.when(is_ascii(s), s).otherwise(F.translate(s, DIGITS[0], DIGITS[1]))


def parse_double(s: Column) -> Column:
    """``float(s)`` for the strings the amount patterns can capture; NULL instead of an exception."""
    return ascii_digits(s).try_cast("double")


def parse_whole(s: Column) -> Column:
    """``int(s)`` of a run of digits, up to 38 of them; NULL beyond."""
    return ascii_digits(s).try_cast("decimal(38,0)")


def parse_amount(s: Column) -> Column:
    """``float(s.replace(',', ''))`` — NULL when not parseable (``''``, ``'.'``)."""
    return parse_double(F.replace(s, F.lit(","), F.lit("")))


def template(tpl: str, **values: Column | str) -> Column:
    """Fill a ``{name}`` text template with columns (cast to string) — one ``concat``."""
    parts = re.split(r"\{(\w+)\}", tpl)
    cols = []
    for i, part in enumerate(parts):
        if i % 2 == 0:
            if part:
                cols.append(F.lit(part))
        else:
            v = values[part]
            cols.append(F.lit(v) if isinstance(v, str) else v.cast("string"))
    return F.concat(*cols) if cols else F.lit("")


def nan_to_null(c: Column) -> Column:
    """Structured inputs may carry NaN; Python compares NaN as false everywhere, Spark as largest. Treat as absent."""
    return F.when(~F.isnan(c), c)
