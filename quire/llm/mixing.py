"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

``targets`` shares a budget among sources by weight; a source's target stops at ``max_epochs`` times its size and the
excess is shared anew by weight until no target is above its stop. Every round is one aggregate over the sources.

``mix`` turns targets into copies. A source that is to be taken e times has every document floor(e) times, and once
more the documents that come first in a seeded order, up to the one that brings the words taken nearest to the
target. That order is the MD5 of seed and id; its first digits deal the documents of a source into 4096 slices, whose
sizes are summed before anything is shuffled, and only the slice in which the target falls is ordered document by
document. So no task holds a source, however large, and reruns agree whatever the partitioning.

Defined results: null and empty texts have size 0; rows that agree in id and size (repeated rows, null ids) share one draw
and are taken together; a null source is a source, after all others; sources without words have target 0 and their
documents are taken 0 times; an empty table gives no rows. Input columns with the name of a
result are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "copies", "taken")
#: Hexadecimal digits of the draw that choose the slice.
DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """``sources`` (source) with a weight each: the cycle's entries in code-point order of the sources, null last.

    The place of a source is its place in its range partition plus the sizes of the partitions before it.
    """
    last = [F.col("source").isNull(), F.col("source")]
    held = written(sources.repartitionByRange(*last).withColumn("_part", F.spark_partition_id()), "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = held.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*last)) - 1 + F.col("_before")
    weights = F.array(*map(F.lit, cycle))
    return held.join(offsets, "_part").withColumn("weight", F.get(weights, (place % len(cycle)).cast("int")).cast("double")).drop("_part", "_before")


def targets(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target`` each; budget is ``share`` of all sizes.

    Sources are full (at their stop) or open. The level (budget left over open weight) only rises as sources fill, so
    a source once full stays full, and the rounds end when none fills; there are as many rounds as levels at which
    sources fill. A budget above all stops fills every source.
    """
    stop = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.col("weight") * F.lit(level) >= stop
        taken, weight = sources.agg(F.sum(F.when(full, stop)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:
            break
        new = (share * total - (taken or 0.0)) / weight
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(stop, F.col("weight") * F.lit(level)).cast("double"))


def _draw(seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))


def mix(docs: DataFrame, weights: DataFrame | None = None, cycle: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, copies and taken for every row.

    ``weights`` (source, weight) sets the weights; without it they follow ``cycle``.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    others = [c for c in kept if c not in ("doc_id", "text", "source")]
    # all other columns travel as one, out of the way of the names used here
    packed = docs.select("doc_id", "text", "source", F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"at{i}") for i, c in enumerate(others)]).alias("_others"))
    sized = packed.withColumn("size", n_words(F.col("text"))).withColumn("_draw", _draw(seed)).withColumn("_slice", F.substring("_draw", 1, DIGITS))
    # sums by source and slice: at most 4096 rows a source, made before the shuffle
    slices = written(sized.groupBy("source", "_slice").agg(F.sum("size").alias("slice_size")), "slices")
    sources = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    if weights is None:
        weights = cycled_weights(sources.select("source"), cycle)
    weighted = sources.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source"))).select("s.source", "source_size", "weight")
    plan = targets(written(weighted, "weighted"), share, max_epochs).drop("weight")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a hair below a whole number of epochs is that number, so that rounding cannot cost a repetition
    plan = plan.withColumn("whole", F.floor(epochs + 1e-12)).withColumn("extra", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    up_to = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(up_to), F.lit(0)))
    cut = cut.alias("c").join(plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source"))).select("c.source", "_slice", "before", "slice_size", "source_size", "target", "whole", "extra")
    # slices wholly inside the extra are taken; those behind it are not; the one between is ordered
    cut = written(cut.withColumn("part", F.when(F.col("before") >= F.col("extra"), F.lit(0)).when(F.col("before") + F.col("slice_size") <= F.col("extra"), F.lit(1))), "cut")
    ties = sized.join(cut.filter("part IS NULL").select(F.col("source").alias("_s"), F.col("_slice").alias("_k"), "before", "extra"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_k")))
    ties = ties.groupBy("_s", "_slice", "_draw").agg(F.sum("size").alias("tie_size"), F.first("before").alias("before"), F.first("extra").alias("extra"))
    order = Window.partitionBy("_s", "_slice").orderBy("_draw")
    reach = F.col("before") + F.sum("tie_size").over(order)
    # the tie in which the extra ends is taken if that comes nearer
    ties = ties.withColumn("in", (reach - F.col("tie_size") / 2 <= F.col("extra")).cast("int")).filter("in = 1").select(F.col("_s"), F.col("_draw").alias("_d"), F.lit(1).alias("in"))
    out = sized.alias("d").join(cut.select(F.col("source").alias("_c"), F.col("_slice").alias("_k"), "source_size", "target", "whole", "part"), F.col("d.source").eqNullSafe(F.col("_c")) & (F.col("d._slice") == F.col("_k")))
    out = out.join(ties, (F.col("d.source").eqNullSafe(F.col("_s"))) & F.col("part").isNull() & (F.col("d._draw") == F.col("_d")), "left")
    copies = F.col("whole") + F.coalesce(F.col("part"), F.col("in"), F.lit(0))
    out = out.withColumn("copies", F.when(F.col("source_size") > 0, F.least(copies, F.lit(math.ceil(max_epochs)))).otherwise(0).cast("long"))
    return out.select(*[F.col(f"d._others.at{others.index(c)}").alias(c) if c in others else F.col(f"d.{c}") for c in kept], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as its ``copies``, numbered from 0 in ``copy``."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))


def op1(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document: weights 5, 2, 1, 150% of all words, 2 epochs at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS stop, (2.0::DOUBLE * source_size) / weight AS ratio FROM s),
c AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                 - coalesce(sum(stop) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio DESC, source DESC NULLS FIRST) AS open_level,
             row_number() OVER (ORDER BY ratio, source) AS nth FROM r),
lv AS (SELECT coalesce((SELECT open_level FROM c WHERE open_level <= ratio ORDER BY nth LIMIT 1), 'infinity'::DOUBLE) AS level),
t AS (SELECT source, source_size, least(stop, weight * level) AS target FROM r, lv),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, greatest(p.target - p.whole * p.source_size, 0) AS extra,
             d.source, md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size) AS draw
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
y AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw) AS reach, sum(size) OVER (PARTITION BY source, draw) AS tie FROM x)
SELECT doc_id, size, source_size, target,
       (size * least(whole + CASE WHEN extra > 0 AND reach - tie / 2 <= extra THEN 1 ELSE 0 END, 2))::BIGINT AS taken FROM y
"""
