"""Invoices, their line items and their entities as tables hashed by document, so that joining them moves no row."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..operators.extract import explode_items


class ByDocument(NamedTuple):
    invoices: DataFrame
    items: DataFrame
    entities: DataFrame | None


def write_by_document(df: DataFrame, path: str, buckets: int, key: str = "doc_id", name: str | None = None) -> DataFrame:
    """``df`` written at ``path`` as the table ``name``: ``buckets`` files by a hash of the key, each sorted by it.

    Rows are dealt by the same hash first, so every task writes one file. Tables with equal ``buckets`` join and group by the
    key in place. Choose the number so that a bucket of the largest table is some hundred megabytes.
    """
    spark = df.sparkSession
    name = name or f"by_document_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def lay_out(invoices: DataFrame, base: str, buckets: int, entities: DataFrame | None = None, key: str = "doc_id") -> ByDocument:
    """The three tables below ``base``. Items are taken from the written invoices: the extraction runs once."""
    inv = write_by_document(invoices, f"{base}/invoices", buckets, key)
    items = write_by_document(explode_items(inv.select(key, "line_items"), "line_items"), f"{base}/line_items", buckets, key)
    return ByDocument(inv, items, write_by_document(entities, f"{base}/entities", buckets, key) if entities is not None else None)
