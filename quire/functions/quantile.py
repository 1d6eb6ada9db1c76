"""A3: exact quantiles (numpy ``percentile``, linear interpolation) without funnelling a group into one task.

``F.percentile`` is exact but its final aggregation holds every distinct value of a group in one buffer; for a
single global history that is the whole column in one task. Here the values are sorted once over the cluster:

1. range partitions by (group, value, row), so that neither a large group nor a value shared by many rows stays in
   one task; the sorted rows are written with their partition and place;
2. one row per group and partition counts them, and running sums of those counts give the rank at which each
   partition begins;
3. a wanted rank is then one known row, found by an equi-join on (partition, place).

The number of jobs does not depend on the values. Infinite values are values like any other, sorted last (or first);
between a finite and an infinite neighbour the interpolation is numpy's (infinite, or NaN at weight 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import materialize


def _lerp(a: Column, b: Column, t: Column) -> Column:
    """numpy's interpolation: ``a + (b-a)*t``, or ``b - (b-a)*(1-t)`` when ``t >= 0.5``."""
    diff = b - a
    return F.when(a == b, a).when(t >= 0.5, b - diff * (1 - t)).otherwise(a + diff * t)


def exact_quantiles(values: DataFrame, value: str, probs: dict[str, float], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per group: ``by…`` plus one DOUBLE column per entry of ``probs`` (name → probability).

    ``values`` must hold only the values to rank (no NULLs). Groups with no values do not appear.
    """
    by = list(by)
    rows = values.select(*by, F.col(value).cast("double").alias("v"), F.monotonically_increasing_id().alias("_tie"))
    ordered = rows.repartitionByRange(*by, "v", "_tie").sortWithinPartitions(*by, "v", "_tie").drop("_tie")
    ordered = materialize(ordered.withColumn("_part", F.spark_partition_id())
                          .withColumn("_place", F.monotonically_increasing_id()), "sorted-values")
    counts = ordered.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    # at most one row per group and partition from here on
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_rank", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*by)))
    wanted = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        low = F.floor(pos).cast("bigint")
        for side, rank in ((0, low), (1, F.least(low + 1, F.col("_total") - 1))):
            wanted.append(F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), rank.alias("rank"),
                                   (pos - low).alias("frac")))
    wanted = counts.select("*", F.explode(F.array(*wanted)).alias("w")).filter(
        (F.col("w.rank") >= F.col("_rank")) & (F.col("w.rank") < F.col("_rank") + F.col("_n")))
    wanted = wanted.select(*by, F.col("_part").alias("_p"), (F.col("_first") + F.col("w.rank") - F.col("_rank")).alias("_at"),
                           "w.q", "w.side", "w.frac")
    found = wanted.join(ordered.select("_part", "_place", "v"), (F.col("_p") == F.col("_part")) & (F.col("_at") == F.col("_place")))
    ends = found.groupBy(*by, "q").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"),
                                       F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"),
                                       F.first("frac").alias("frac"))
    return ends.groupBy(*by).agg(*[
        F.max(F.when(F.col("q") == name, _lerp(F.col("a"), F.col("b"), F.col("frac")))).alias(name) for name in probs])
