"""A folder that fills up. New files are taken once; pages that arrive in any order and batch make one text a document."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.binary import MAX_BYTES, read_checked_documents
from ..sources.files import assemble_pages
from .stream import parquet_batch_sink, stream_chain

PAGE_SCHEMA = "doc_id bigint, page_no bigint, text string, success boolean"


def start_folder_stream(spark: SparkSession, directory: str, checkpoint_dir: str, sink: Callable[[DataFrame, int], None], glob: str = "*.txt",
                        max_bytes: int = MAX_BYTES, max_files_per_trigger: int | None = None, history_profile: DataFrame | None = None, by=(),
                        as_of: _dt.date | str | None = None, mode: str | None = "statistical") -> StreamingQuery:
    """Text files that have arrived in ``directory`` → checked texts → invoices → ``sink(batch, id)``; files it cannot read are failed rows."""
    docs = read_checked_documents(spark, directory, glob, max_bytes, stream=True, max_files_per_trigger=max_files_per_trigger)
    out = stream_chain(docs, history_profile, by=by, as_of=as_of, mode=mode)
    return out.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(sink).trigger(availableNow=True).start()


def start_page_stream(spark: SparkSession, directory: str, checkpoint_dir: str, base: str, schema: str = PAGE_SCHEMA,
                      max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Page rows (Parquet) that have arrived in ``directory`` → the texts of the documents they belong to, under ``base/batch=n``.

    The state of a document is its own pages; state is dealt by document, and a batch writes the documents it has touched
    only. :func:`newest` reads the last text of each.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = assemble_pages(reader.parquet(directory))
    writer = docs.writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir).foreachBatch(parquet_batch_sink(base))
    return writer.trigger(availableNow=True).start()


def newest(spark: SparkSession, base: str, key: str = "doc_id") -> DataFrame:
    """Of every document below ``base`` the row of the last batch that has written it (partial maxima first, then one shuffle by key)."""
    rows = spark.read.parquet(base)
    others = [c for c in rows.columns if c not in (key, "batch")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(key, *[F.col(f"last.{c}").alias(c) for c in others])
