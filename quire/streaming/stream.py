"""Streaming form of a run.

Every stage of ``run_invoices`` is row-local, so the same function runs on a ``readStream`` frame, statuses included. Statistics use a profile computed once from the (static) history and joined to every
micro-batch by broadcast (one row, or one row per key): a stream–static join, no state store, no watermark.
Each micro-batch is written with ``foreachBatch`` to the batch sinks; the checkpoint location makes the
query restartable after an executor or driver loss.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..options import Options
from ..plans.run import observed, run_invoices, summary_of

DOC_SCHEMA = "doc_id bigint, text string"


def parquet_batch_sink(base: str, columns: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """Idempotent ``foreachBatch`` sink: micro-batch ``n`` overwrites ``base/batch=n``.

    A batch replayed after a failure rewrites its own folder instead of appending a second copy.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        out = batch.select(*columns) if columns else batch
        out.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    return sink


def summarized_sink(sink: Callable[[DataFrame, int], None], base: str) -> Callable[[DataFrame, int], None]:
    """``sink`` for runs, and beside it the counts of each micro-batch in ``base/batch=n``, taken while the sink writes it.

    The sink must write its batch once. A batch replayed after a failure replaces its own counts.
    """

    def both(batch: DataFrame, batch_id: int) -> None:
        frame, seen = observed(batch, f"batch-{batch_id}")
        sink(frame, batch_id)
        counts = summary_of(seen)
        row = batch.sparkSession.createDataFrame([(k, v) for k, v in counts.items()], "what string, n long")
        row.coalesce(1).write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    return both


def stream_chain(stream: DataFrame, history_profile: DataFrame | None = None, by=(), as_of: _dt.date | str | None = None,
                 mode: str | None = "statistical") -> DataFrame:
    return run_invoices(stream, options=Options(anomaly_mode=mode), as_of=as_of, by=by, history_profile=history_profile)


def start_invoice_stream(
    spark: SparkSession,
    source_dir: str,
    checkpoint_dir: str,
    sink: Callable[[DataFrame, int], None],
    history_profile: DataFrame | None = None,
    by=(),
    as_of: _dt.date | str | None = None,
    schema: str = DOC_SCHEMA,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Parquet documents arriving in ``source_dir`` → invoices with findings and anomalies → ``sink(batch, id)``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.parquet(source_dir)
    out = stream_chain(docs, history_profile, by=by, as_of=as_of)
    writer = out.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(sink)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
