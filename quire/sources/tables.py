"""Table sources. Parquet is the default; column pruning and filters reach the scan."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def few_files(df: DataFrame) -> bool:
    """Is ``df`` read from fewer files than the cluster has cores? Metadata only: nothing runs."""
    return len(df.inputFiles()) < df.sparkSession.sparkContext.defaultParallelism


def few_tasks(scan: DataFrame) -> bool:
    """Is ``scan`` read by fewer tasks than the cluster has cores? A large file is read by many. Planning only: nothing runs."""
    return scan.rdd.getNumPartitions() < scan.sparkSession.sparkContext.defaultParallelism


def spread(scan: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work (regex extraction) on a table scan at least one task per core.

    Only a scan of fewer files than cores is dealt out; tables of many files stay as they are, so at scale this adds
    no shuffle.
    """
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism) if few_files(scan) else scan
