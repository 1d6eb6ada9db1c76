"""X2/X4 for records whose keys differ: one header from the keys that occur, then one projection.

``lines`` are JSON objects as text. One pass unions the names of all keys (what comes back is bounded by the number of distinct names, and
more than ``most`` of them is an error, since such names are data); the tables then have a column for each name. A null and an
absent value are empty; objects and lists become JSON text, as nested values of a record do. Texts that are no JSON object are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .writers import CSV_OPTIONS

MOST_NAMES = 10_000
_SCORES, _ITEMS = "confidence_scores", "line_items"


def _records(lines: DataFrame, column: str, key: str) -> DataFrame:
    """``key`` and ``m``: the record as a map from names to texts."""
    m = F.from_json(F.col(column), "map<string,string>")
    return lines.select(key, m.alias("m")).where(F.col("m").isNotNull())


def _names(maps: DataFrame, most: int) -> list[str]:
    """The distinct keys of the column ``m``, sorted."""
    found = [r[0] for r in maps.select(F.explode(F.map_keys("m")).alias("name")).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} different keys: not a header")
    return sorted(found)


def _value(name: str) -> Column:
    return F.try_element_at("m", F.lit(name))


def _column(name: str) -> Column:
    return _value(name).alias(name)


def ragged_header(lines: DataFrame, column: str = "value", key: str = "doc_id", most: int = MOST_NAMES) -> DataFrame:
    """One row a record: ``key``, a column for each key that occurs, ``line_items_count``, ``confidence_<name>`` for each score."""
    rows = _records(lines, column, key)
    names = _names(rows, most)
    plain = [n for n in names if n not in (_SCORES, _ITEMS)]
    scores = F.from_json(_value(_SCORES), "map<string,string>")
    found = _names(rows.select(scores.alias("m")), most) if _SCORES in names else []
    items = F.coalesce(F.json_array_length(_value(_ITEMS)), F.lit(0)).alias("line_items_count")
    return rows.withColumn("scores", scores).select(
        F.col(key).alias(f"_{key}") if key in plain else key, *[_column(n) for n in plain], *([items] if _ITEMS in names else []),
        *[F.try_element_at("scores", F.lit(n)).alias(f"confidence_{n}") for n in found])


def ragged_items(lines: DataFrame, column: str = "value", key: str = "doc_id", most: int = MOST_NAMES) -> DataFrame:
    """One row an item: ``key``, ``item_no`` and, in sorted order, a column for each key that any item has."""
    items = F.from_json(_value(_ITEMS), "array<map<string,string>>")
    rows = _records(lines, column, key).select(key, F.posexplode_outer(items).alias("at", "m")).where(F.col("m").isNotNull())
    own = [F.col(key).alias(f"_{key}"), (F.col("at") + 1).alias("_item_no")]
    return rows.select(*own, *[_column(n) for n in _names(rows, most)])


def write_ragged_csv(lines: DataFrame, path: str, column: str = "value", key: str = "doc_id", mode: str = "error") -> None:
    """Both tables as CSV: ``path/invoices`` and ``path/line_items``."""
    for name, table in (("invoices", ragged_header(lines, column, key)), ("line_items", ragged_items(lines, column, key))):
        table.write.mode(mode).options(**CSV_OPTIONS).csv(f"{path}/{name}")
