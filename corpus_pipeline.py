"""From the documents table to a training mix: five stages, each written as Parquet and read again by the next.

1. language_id: documents whose language is unclear (or that have no letters) go.
2. near_dedup: of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays; rows without an
   id take part, and of rows alike in id and text one stays.
3. decontaminate: documents that hold a ten-word window of a benchmark item go.
4. pii: personal data and terms that disclose it are replaced in the texts; no document goes.
5. mix: sources are repeated or thinned to their target weights; one row for each copy.

The first four return the columns of documents; the last adds size, source_size, target, copies, taken and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, langid, mixing, neardup, pii
from quire.llm.shared import written


def _row(docs: DataFrame, columns: list[str]) -> Column:
    """Columns as one, named by their place, out of the way of an operator's own names."""
    return F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"at{i}") for i, c in enumerate(columns)]).alias("row")


def _packed(docs: DataFrame) -> DataFrame:
    """The text beside all other columns as one."""
    return docs.select("text", _row(docs, [c for c in docs.columns if c != "text"]))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    others = [c for c in docs.columns if c != "text"]
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.at{others.index(c)}").alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.select("text", "lang"))
    found = langid.classify(_packed(docs), model, keep=("text", "row"))
    return _unpacked(found.filter(~F.col("rejected")), docs)


#: Documents without an id get one from here on, made of their text; ids of documents are below.
_NO_ID = 1 << 62


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, ids before none; of rows alike in id and text, one row."""
    text_hash = F.xxhash64("text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID).bitwiseOR(text_hash.bitwiseAND(F.lit(_NO_ID - 1))))
    found = neardup.near_duplicates(docs.select(key.alias("doc_id"), "text"), shingle=5, percent=80)
    gone = written(found.filter(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct(), "near-duplicates")
    # rows that repeat are few: only their keys are looked for among all
    repeated = docs.select(key.alias("key"), text_hash.alias("hash")).groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n"))
    repeated = written(repeated.filter("n > 1").select("key", "hash"), "repeated-rows")
    kept = docs.select(key.alias("key"), text_hash.alias("hash"), _row(docs, docs.columns)).join(gone, "key", "left_anti")
    once = kept.join(repeated, ["key", "hash"], "left_semi").groupBy("key", "hash").agg(F.min("row").alias("row"))
    rows = kept.join(repeated, ["key", "hash"], "left_anti").select("row").union(once.select("row"))
    return rows.select(*[F.col(f"row.at{i}").alias(c) for i, c in enumerate(docs.columns)])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.contaminated(_packed(docs), benchmark, keep=("text", "row"))
    return _unpacked(found.filter(F.size("spans") == 0), docs)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(mixing.mix(docs))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("pii", without_pii),
    ("mix", mixed),
]

#: The first stage compresses texts, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
