"""The exported record, JSON and CSV sinks, multi-format fan-out, batch output naming.

An invoice is exported as the record of its eight keys: the six fields, ``line_items`` and ``confidence_scores``. An
amount that was not converted stays the text that was captured. Sinks are DataFrame writers (distributed, one file
per partition). Fields with quotes, commas or line breaks are quoted with doubled quotes, as CSV readers expect; read
the files back with ``multiLine`` and ``escape='"'``.
"""

from __future__ import annotations

import json
import logging
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import AMOUNT_FIELDS, FIELD_ORDER
from ..functions.stage import materialize
from ..operators.extract import explode_items

LOG = logging.getLogger(__name__)
FORMATS = ("json", "csv")
ITEM_CSV_COLUMNS = ["description", "quantity", "total", "unit_price"]  # sorted key names
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_READ_OPTIONS = {**CSV_OPTIONS, "multiLine": "true"}
_KEEP_NULLS = {"ignoreNullFields": "false"}


def to_record(inv: DataFrame) -> DataFrame:
    """``doc_id`` and the eight keys. Amounts are a struct: ``number`` when converted, else ``text`` as captured."""
    kinds = dict(inv.dtypes)

    def amount(f: str) -> Column:
        raw = F.col(f + "_raw") if f + "_raw" in kinds else F.lit(None).cast("string")
        done = F.col("converted")[f] if "converted" in kinds else F.col(f).isNotNull()
        return F.when(done, F.struct(F.col(f).alias("number"), F.lit(None).cast("string").alias("text"))).when(
            raw.isNotNull(), F.struct(F.lit(None).cast("double").alias("number"), raw.alias("text")))

    item = lambda x: F.struct(*[x[c].alias(c) for c in ("description", "quantity", "unit_price", "total")])
    return inv.select(
        "doc_id", *[amount(f).alias(f) if f in AMOUNT_FIELDS else F.col(f) for f in FIELD_ORDER],
        F.transform("line_items", item).alias("line_items"), F.col("confidence").alias("confidence_scores"))


def _json(c: Column) -> Column:
    """Any value as JSON text, ``null`` for NULL."""
    text = F.to_json(F.array(c), _KEEP_NULLS)
    return F.substring(text, F.lit(2), F.length(text) - 2)


def json_records(records: DataFrame, pretty: bool = True) -> DataFrame:
    """X1 as text: one JSON document per record, nulls kept; ``pretty`` puts each key on a line of its own."""
    value = {f: _json(F.col(f)) for f in records.columns if f != "doc_id"}
    for f in AMOUNT_FIELDS:
        value[f] = F.coalesce(_json(F.col(f)["number"]), F.lit("null"))
        value[f] = F.when(F.col(f)["text"].isNotNull(), _json(F.col(f)["text"])).otherwise(value[f])
    gap, end = (",\n  ", "\n}") if pretty else (", ", "}")
    parts = [F.concat(F.lit(f'"{k}": '), v) for k, v in value.items()]
    return records.select(F.concat(F.lit("{" + gap[1:]), F.concat_ws(gap, *parts), F.lit(end)).alias("value"))


def write_json(records: DataFrame, path: str, pretty: bool = False, mode: str = "error") -> None:
    """One record per line (or pretty documents), NULL fields written, UTF-8."""
    json_records(records, pretty).write.mode(mode).text(path)


def flatten_for_csv(records: DataFrame, more: Sequence[Column] = ()) -> DataFrame:
    """Scalar keys as they are; ``line_items`` → ``line_items_count``; ``confidence_scores`` → a column per field; then ``more``."""
    amounts = {f: F.coalesce(F.col(f)["text"], F.col(f)["number"].cast("string")) for f in AMOUNT_FIELDS}
    return records.select(
        "doc_id", *[amounts.get(f, F.col(f)).alias(f) for f in FIELD_ORDER],
        F.coalesce(F.size("line_items"), F.lit(0)).alias("line_items_count"),
        *[F.col("confidence_scores")[f].alias(f"confidence_{f}") for f in FIELD_ORDER], *more)


def line_item_rows(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The child table, columns in sorted key order after the parent key and item number."""
    numbered = F.transform("line_items", lambda x, i: F.struct((i + 1).cast("int").alias("item_no"), *[x[c].alias(c) for c in ITEM_CSV_COLUMNS]))
    return explode_items(df.select(key, numbered.alias("line_items")), "line_items")


def union_item_tables(*tables: DataFrame) -> DataFrame:
    """Union of item tables with different key sets; absent values stay empty."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_csv(records: DataFrame, path: str, mode: str = "error") -> None:
    """X2 + X3: ``path/invoices`` (flattened header row per invoice) and ``path/line_items`` (child rows)."""
    for name, table in (("invoices", flatten_for_csv(records)), ("line_items", line_item_rows(records))):
        table.write.mode(mode).options(**CSV_OPTIONS).csv(os.path.join(path, name))


def _known(formats: list[str] | tuple[str, ...]) -> list[str]:
    """The formats that there are a sink for; others are warned about and skipped. One unknown format alone is an error."""
    formats = list(formats)
    if len(formats) == 1 and formats[0] not in FORMATS:
        raise ValueError(f"Unknown format: {formats[0]}")
    for f in formats:
        if f not in FORMATS:
            LOG.warning("Unknown export format: %s", f)
    return [f for f in formats if f in FORMATS]


def _write(records: DataFrame, fmt: str, target: str, pretty_json: bool, mode: str) -> None:
    if fmt == "json":
        write_json(records, target, pretty=pretty_json, mode=mode)
    else:
        write_csv(records, target, mode=mode)


def _records_once(df: DataFrame, known: list[str]) -> DataFrame:
    """The records, written as a table if more than one output is made of them (CSV alone is two tables)."""
    records = to_record(df)
    return materialize(records, "records") if len(known) > 1 or "csv" in known else records


def write_invoices(df: DataFrame, base: str, formats: list[str] | tuple[str, ...] = FORMATS, pretty_json: bool = False,
                   mode: str = "error") -> bool:
    """One write per known format under ``base/format=<fmt>``; unknown formats are warned about and skipped.

    A single unknown format raises ``ValueError`` (X6). The records are written once as a table, from which every
    format is written, so the extraction runs once and an executor lost midway costs no regex. True when all known formats
    asked for were written; a write that fails raises. An existing output is an error unless ``mode`` says so.
    """
    known = _known(formats)
    records = _records_once(df, known)
    for fmt in known:
        _write(records, fmt, os.path.join(base, f"format={fmt}"), pretty_json, mode)
    return True


MANIFEST = "_MANIFEST.json"


def publish_invoices(df: DataFrame, base: str, formats: list[str] | tuple[str, ...] = FORMATS, pretty_json: bool = False) -> dict[str, str]:
    """X5, all formats or none: the outcome of each format, ``written``, ``unknown``, ``withheld`` or ``failed: <why>``.

    Every format is written into a hidden folder first. Only if all have succeeded are they renamed to ``base/format=<fmt>``, and a manifest
    that lists them is the last file to appear: readers that wait for it see a complete export. After a failure
    nothing of this export is left in place; formats that had succeeded are ``withheld``. A manifest already there is an error.
    """
    spark = df.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(base).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path_of(f"{base}/{MANIFEST}")):
        raise FileExistsError(f"{base} has been published")
    known = _known(formats)
    outcome = {f: "written" if f in known else "unknown" for f in formats}
    staged = f"{base}/_staged-{uuid.uuid4().hex}"
    moved = []
    try:
        records = _records_once(df, known)
        for fmt in known:
            try:
                _write(records, fmt, f"{staged}/format={fmt}", pretty_json, "error")
            except Exception as e:  # noqa: BLE001  the outcome tells; the others are still tried
                outcome[fmt] = f"failed: {type(e).__name__}"
        if all(outcome[f] == "written" for f in known):
            for fmt in known:
                source, target = path_of(f"{staged}/format={fmt}"), path_of(f"{base}/format={fmt}")
                if files.exists(target) or not files.rename(source, target):
                    outcome[fmt] = "failed: the output exists"
                    break
                moved.append(target)
        if all(outcome[f] == "written" for f in known):
            out = files.create(path_of(f"{base}/{MANIFEST}"), False)
            out.write(bytearray(json.dumps({"formats": outcome}, sort_keys=True).encode()))
            out.close()
        else:
            for target in moved:
                files.delete(target, True)
            outcome = {f: "withheld" if o == "written" else o for f, o in outcome.items()}
    finally:
        files.delete(path_of(staged), True)
    return outcome


def output_names(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``invoice_<n>`` by position in path order, without a single-task window.

    A distributed sort (range partitioning) orders the paths; each partition's row count gives its offset (a
    table with one row per partition, broadcast); the position is offset + rank inside the partition.
    """
    ordered = materialize(paths.select(path_col).orderBy(path_col)
                          .withColumn("_pid", F.spark_partition_id())
                          .withColumn("_mid", F.monotonically_increasing_id()), "ordered-paths")
    counts = ordered.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_mid").alias("_mid0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    pos = ordered.join(offsets.select("_pid", "_off", "_mid0"), "_pid")
    n = F.col("_off") + (F.col("_mid") - F.col("_mid0")) + 1
    return pos.select(path_col, F.concat(F.lit("invoice_"), n.cast("string")).alias("output_name"))
