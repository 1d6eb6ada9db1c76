"""Document sources — file discovery, extension predicate, document text, page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.patterns import PAGE_HEADER, PAGE_JOIN, SUPPORTED_EXTENSIONS
from ..functions.text import template

FILES_SCHEMA = "path string, length bigint, modificationTime timestamp"


def supported_extensions() -> list[str]:
    """S2."""
    return list(SUPPORTED_EXTENSIONS)


def extension(path: Column | str) -> Column:
    """Lower-cased suffix of the last path component, with the dot (``''`` when there is none)."""
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(p, r"[^/](\.[^./]+)$", 1))


def is_supported_file(path: Column | str) -> Column:
    """Case-insensitive membership of the suffix in the supported list."""
    return extension(path).isin(SUPPORTED_EXTENSIONS)


def find_invoices(spark: SparkSession, directory: str) -> DataFrame:
    """Supported files directly inside ``directory`` (not recursive), sorted by path.

    Each extension is matched in lower and UPPER case only (``.Pdf`` is not found), like the original glob pair.
    The binary ``content`` column is never selected, so no file body is read. A missing directory gives an
    empty frame. Spark's file listing skips names starting with ``.`` or ``_``.
    """
    exts = [e[1:] for e in SUPPORTED_EXTENSIONS] + [e[1:].upper() for e in SUPPORTED_EXTENSIONS]
    try:
        df = (spark.read.format("binaryFile")
              .option("pathGlobFilter", "*.{" + ",".join(exts) + "}")
              .option("recursiveFileLookup", "false")
              .load(directory))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILES_SCHEMA)
    return df.select("path", "length", "modificationTime").orderBy("path")


def read_text_documents(spark: SparkSession, directory: str, glob: str = "*.txt") -> DataFrame:
    """S3: one document per text file, ``(doc_id, path, text)``; doc_id is a stable hash of the path."""
    df = spark.read.option("pathGlobFilter", glob).text(directory, wholetext=True)
    path = F.col("_metadata.file_path")
    return df.select(F.xxhash64(path).alias("doc_id"), path.alias("path"), F.col("value").alias("text"))


def assemble_pages(pages: DataFrame, key: str = "doc_id", page_no: str = "page_no", text: str = "text",
                   success: str = "success") -> DataFrame:
    """``(doc_id, pages, text)`` — successful pages as ``--- Page n ---\\n<text>`` joined by a blank line.

    Page numbers are kept as given; ``pages`` counts every page, failed ones included; a document whose pages
    all failed gets ``''``. The per-document group is that document's pages (its own text), sorted by number.
    """
    ok = F.col(success)
    entry = F.when(ok, F.struct(F.col(page_no).cast("bigint").alias("n"), F.col(text).alias("t")))
    agg = pages.groupBy(key).agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(entry)).alias("ps"))
    body = F.array_join(
        F.transform("ps", lambda p: F.concat(template(PAGE_HEADER, n=p["n"]), F.lit("\n"),
                                             F.coalesce(p["t"], F.lit("")))), PAGE_JOIN)
    return agg.select(key, F.col("pages").cast("bigint").alias("pages"), body.alias("text"))
