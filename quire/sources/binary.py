"""Documents from files read as bytes. A file that is no text is a failed row, neither lost nor altered.

``checked_texts`` is one projection over ``(content, length)`` and works alike on a folder, a stream and any table of bytes. Its
``ocr_success`` and ``ocr_error`` are what ``run_invoices`` takes: a failed row keeps its status and nothing is extracted from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files above this many bytes are not read (a row must stay well below the JVM's array limit of 2 GB).
MAX_BYTES = 64 * 1024 * 1024
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
NOT_TEXT, MISSING = "not valid UTF-8", "no content"


def _error(max_bytes: int) -> Column:
    return (F.when(F.col("length") > max_bytes, F.concat(F.lit(f"larger than {max_bytes} bytes: "), F.col("length").cast("string")))
            .when(F.col("content").isNull(), F.lit(MISSING)).when(~F.is_valid_utf8(F.col("content").cast("string")), F.lit(NOT_TEXT)))


def checked_texts(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``files`` (content, length and others) with text, ocr_success, ocr_error in place of the two.

    The text of a failed row is NULL. Empty content is an empty text.
    """
    others = [c for c in files.columns if c not in ("content", "length")]
    found = files.select(*others, "content", _error(max_bytes).alias("ocr_error"))
    ok = F.col("ocr_error").isNull()
    return found.select(*others, F.when(ok, F.col("content").cast("string")).alias("text"), ok.alias("ocr_success"), "ocr_error")


def read_checked_documents(spark: SparkSession, directory: str, glob: str = "*.txt", max_bytes: int = MAX_BYTES, stream: bool = False,
                           max_files_per_trigger: int | None = None) -> DataFrame:
    """One row per file of ``directory``: doc_id (the path, which no other file has), path, text, ocr_success, ocr_error.

    The limit is a filter on the length, which reaches the scan: larger files are listed, never read. With ``stream`` every new file
    is taken once. Spark's file scans leave out files of no bytes, so these give no row.
    """
    def scan() -> DataFrame:
        reader = (spark.readStream if stream else spark.read).format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob)
        if stream and max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.load(directory).select(F.col("path").alias("doc_id"), "path", "length", "content")

    small = scan().filter(F.col("length") <= max_bytes)
    large = scan().filter(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
    return checked_texts(small.union(large), max_bytes)
