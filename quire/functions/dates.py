"""V6: invoice-date parsing with strptime's strictness, as native expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import DATE_FORMATS, DATE_SHAPES, JAVA_WS

# Days and months that there are, in the order in which a layout names them. A parse that fails costs an exception: strings of
# the right shape whose month is no month (a day-first date tried month first) are told apart before it.
_DAY, _MONTH = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])"
_IN_RANGE = {"d/M/yyyy": f"^{_DAY}/{_MONTH}/", "M/d/yyyy": f"^{_MONTH}/{_DAY}/", "d-M-yyyy": f"^{_DAY}-{_MONTH}-", "M-d-yyyy": f"^{_MONTH}-{_DAY}-"}


def normalise_spaces(s: Column) -> Column:
    """strptime lets one format space match any whitespace run; collapse runs so the Java parser agrees."""
    return F.regexp_replace(s, F.lit("[" + JAVA_WS + "]+"), F.lit(" "))


def parse_normalised_date(n: Column, formats: list[str] | None = None, shapes: list[str] | None = None) -> Column:
    """First format that parses wins (day-first before month-first); NULL when none does. One parse per format.

    ``n`` is a bound column of :func:`normalise_spaces`. The shape guard enforces what strptime enforces and the Java
    parser does not: a 4-digit year, 1–2 digit day and month, nothing else in the string; only strings of that shape
    are parsed. Year 0 does not exist for strptime either.
    """
    possible = lambda fmt, shape: n.rlike(shape) & n.rlike(_IN_RANGE[fmt]) if fmt in _IN_RANGE else n.rlike(shape)
    tries = [F.when(possible(fmt, shape), F.try_to_date(n, fmt)) for fmt, shape in zip(formats or DATE_FORMATS, shapes or DATE_SHAPES)]
    return F.when(~(F.contains(n, F.lit("0000")) & n.rlike(r"(?:^|[^0-9])0000(?:$|[^0-9])")), F.coalesce(*tries))


def with_parsed_date(df: DataFrame, source: str = "invoice_date", name: str = "invoice_date_parsed") -> DataFrame:
    """V6: ``df`` with the parsed date; whitespace is normalised once, in a projection of its own."""
    return df.withColumn("_date", normalise_spaces(F.col(source).cast("string"))).withColumn(
        name, parse_normalised_date(F.col("_date"))).drop("_date")


def as_of_col(as_of: _dt.date | str | None) -> Column:
    if as_of is None:
        return F.current_date()
    return F.lit(as_of if isinstance(as_of, _dt.date) else _dt.date.fromisoformat(as_of))
