"""S5, J1, A1–A3 over time: for each invoice the profile of the history before its own date, as if it had been handed that list.

``profile_as_of`` gives one profile row for each key and day asked for, made of the rows with an earlier day;
``detect_anomalies(…, by=[*by, at])`` joins them like any keyed profile.

* Counts, mean and deviation: a state (n, mean, M2) for each key and day, made with partial aggregation, and running sums of those
  states around the key's own mean. A window holds one row for each day of a key, never the rows of a key.
* Quartiles, exact: the values are sorted once over range partitions, which numbers them in order; a wanted rank then descends through
  those numbers ``BITS`` bits at a time. At each level the rows that are still wanted are counted by day and digit, and
  running counts over the days tell in which digit the rank lies for each day asked. A key starts at the level at which all its
  rows have one node, so the number of levels is the logarithm of the rows of a key; no task holds the values of a key or of a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantile import _lerp
from ..functions.stage import materialize
from .anomaly import PROFILE_COLUMNS, _truthy

BITS = 5
_QUARTILES = {"q1_total": 0.25, "q3_total": 0.75}


def _clean(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    for c in (*by, at):
        rows = rows.where(F.col(c).isNotNull())
    return rows


def _running(history: DataFrame, asked: DataFrame, by: list[str], at: str) -> DataFrame:
    """by…, at and the counts, means and deviations of earlier days, for each row of ``asked``."""
    parts = [F.count("*").alias("n_rows")]
    for x in ("t", "v"):
        c = F.col("_" + x)
        parts += [F.count(c).alias(f"n_{x}"), F.avg(c).alias(f"mean_{x}"), (F.var_pop(c) * F.count(c)).alias(f"m2_{x}"), F.min(c).alias(f"min_{x}"), F.max(c).alias(f"max_{x}")]
    daily = history.groupBy(*by, at).agg(*parts).withColumn("_asked", F.lit(False))
    rows = daily.unionByName(asked.withColumn("n_rows", F.lit(0)).withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    key = Window.partitionBy(*by)
    # what is asked for a day comes before the day's own rows
    earlier = key.orderBy(at, F.desc("_asked")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    for x in ("t", "v"):
        n, mean = F.coalesce(F.col(f"n_{x}"), F.lit(0)), F.col(f"mean_{x}")
        rows = rows.withColumn("_c", F.sum(n * mean).over(key) / F.nullif(F.sum(n).over(key), F.lit(0)))
        off = zero(mean - F.col("_c"))
        rows = rows.withColumns({"_n": F.sum(n).over(earlier), "_s": F.sum(n * off).over(earlier), "_q": F.sum(zero(F.col(f"m2_{x}")) + n * off * off).over(earlier),
                                 "_low": F.min(f"min_{x}").over(earlier), "_high": F.max(f"max_{x}").over(earlier)})
        some, mean = F.col("_n") > 0, F.col("_s") / F.nullif(F.col("_n"), F.lit(0))
        alike = F.col("_low") == F.col("_high")  # no spread at all, whatever rounding says
        rows = rows.withColumns({f"run_n_{x}": F.col("_n"), f"run_mean_{x}": F.when(some, F.when(alike, F.col("_low")).otherwise(F.col("_c") + mean)),
                                 f"run_std_{x}": F.when(some, F.when(alike, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.col("_q") / F.nullif(F.col("_n"), F.lit(0)) - mean * mean, F.lit(0.0)))))})
    rows = rows.withColumn("run_rows", F.sum("n_rows").over(earlier)).where("_asked")
    names = {"n_rows": "run_rows", "n_total": "run_n_t", "mean_total": "run_mean_t", "std_total": "run_std_t", "n_vat": "run_n_v", "mean_vat": "run_mean_v", "std_vat": "run_std_v"}
    return rows.select(*by, at, *[F.col(c).alias(k) for k, c in names.items()])


def ranked_before(values: DataFrame, asked: DataFrame, value: str, by: list[str], at: str) -> DataFrame:
    """``asked`` (by…, at, rank, …) with ``value``: the one of that rank (from 0) among the rows of ``values`` with an earlier day.

    ``asked`` names ranks that exist; its other columns are passed on. (by…, at, rank) need not be distinct.
    """
    rows = values.select(*by, at, F.col(value).alias("_v"), F.monotonically_increasing_id().alias("_tie"))
    ordered = rows.repartitionByRange(*by, "_v", "_tie").sortWithinPartitions(*by, "_v", "_tie").drop("_tie")
    ordered = materialize(ordered.withColumn("_part", F.spark_partition_id().cast("long")).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sorted-values")
    last = ordered.agg(F.max("_part"), F.max("_place")).first()
    width, high = ((x or 0).bit_length() for x in (last[1], last[0]))
    ordered = ordered.withColumn("_code", F.shiftleft("_part", width).bitwiseOR(F.col("_place"))).drop("_part", "_place")
    levels = max(1, -(-(width + high) // BITS))
    # the numbers of a key lie next to each other: its ranks start at the lowest node that holds all of them
    spans = ordered.groupBy(*by).agg(F.min("_code").alias("_low"), F.max("_code").alias("_high"))
    at_level = lambda c, level: F.shiftright(c, level * BITS)
    start = F.coalesce(*[F.when(at_level("_low", level) == at_level("_high", level), F.lit(level)) for level in range(levels)], F.lit(levels))
    spans = spans.withColumn("_start", start).withColumn("_node", F.coalesce(*[F.when(F.col("_start") == level, at_level("_low", level)) for level in range(levels)], F.lit(0).cast("long")))
    waiting = asked.withColumn("_left", F.col("rank"))
    waiting = materialize(waiting.join(spans.drop("_low", "_high"), by) if by else waiting.crossJoin(F.broadcast(spans.drop("_low", "_high"))), "waiting")
    begins = [r[0] for r in waiting.select("_start").distinct().collect()]  # at most one number a level
    ready = lambda level: waiting.where(F.col("_start") == level).drop("_start")
    node, asked = [*by, "_node"], ready(levels)
    for level in range(min(levels, max(begins, default=0)) - 1, -1, -1):
        if level + 1 < levels and level + 1 in begins:
            asked = asked.unionByName(ready(level + 1))
        inside = ordered.withColumn("_node", F.shiftright("_code", (level + 1) * BITS)).withColumn("_digit", F.shiftright("_code", level * BITS).bitwiseAND(F.lit((1 << BITS) - 1)))
        inside = inside.join(asked.select(*node).distinct(), node, "left_semi")
        counts = materialize(inside.groupBy(*node, "_digit", at).agg(F.count("*").alias("_n")), "digit-counts")
        days = asked.select(*node, at).distinct().join(counts.select(*node, "_digit").distinct(), node).withColumn("_n", F.lit(0).cast("long")).withColumn("_asked", F.lit(True))
        both = counts.withColumn("_asked", F.lit(False)).unionByName(days)
        earlier = Window.partitionBy(*node, "_digit").orderBy(at, F.desc("_asked")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = both.withColumn("_n", F.sum("_n").over(earlier)).where("_asked").drop("_asked")
        upto = upto.withColumn("_to", F.sum("_n").over(Window.partitionBy(*node, at).orderBy("_digit")))
        found = asked.join(upto, [*node, at]).where((F.col("_left") < F.col("_to")) & (F.col("_left") >= F.col("_to") - F.col("_n")))
        asked = materialize(found.select(*[c for c in asked.columns if c not in ("_node", "_left")], F.shiftleft("_node", BITS).bitwiseOR(F.col("_digit")).alias("_node"),
                                         (F.col("_left") - F.col("_to") + F.col("_n")).alias("_left")), "descent")
    if 0 in begins:
        asked = asked.unionByName(ready(0))
    return asked.drop("_left").join(ordered.select(F.col("_code").alias("_node"), F.col("_v").alias(value)), "_node").drop("_node")


def profile_as_of(history: DataFrame, days: DataFrame, by: list[str] | tuple[str, ...] = (), at: str = "invoice_date_parsed", total: str = "total", vat: str = "vat") -> DataFrame:
    """A1–A3 for each distinct (by…, at) of ``days``: by…, at and the columns of :func:`profile`, over ``history`` before that day.

    Rows without a day or a key are in no history, and days without a key or date have no profile; a day without earlier rows has one
    with ``n_rows`` 0. Several rows of one day do not see each other. Amounts that are not numbers are left out. The result is written once.
    """
    by = list(by)
    asked = _clean(days.select(*by, at), by, at).distinct()
    h = _clean(history.select(*by, at, F.col(total).try_cast("double").alias("_t"), F.col(vat).try_cast("double").alias("_v")), by, at)
    h = materialize(h.select(*by, at, *[F.when(_truthy(F.col(c)), F.col(c)).alias(c) for c in ("_t", "_v")]), "history")
    base = materialize(_running(h, asked, by, at), "running")
    wants = []
    for name, p in _QUARTILES.items():
        pos = (F.col("n_total") - 1) * F.lit(float(p))
        low = F.floor(pos).cast("bigint")
        wants += [F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), rank.alias("rank"), (pos - low).alias("frac")) for side, rank in ((0, low), (1, F.least(low + 1, F.col("n_total") - 1)))]
    wanted = base.where("n_total > 0").select(*by, at, F.explode(F.array(*wants)).alias("w")).select(*by, at, "w.*")
    found = ranked_before(h.where("_t IS NOT NULL").select(*by, at, F.col("_t").alias("x")), wanted, "x", by, at)
    ends = found.groupBy(*by, at, "q").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("b"), F.first("frac").alias("frac"))
    quartiles = ends.groupBy(*by, at).agg(*[F.max(F.when(F.col("q") == name, _lerp(F.col("a"), F.col("b"), F.col("frac")))).alias(name) for name in _QUARTILES])
    return materialize(base.join(quartiles, [*by, at], "left").select(*by, at, *PROFILE_COLUMNS), "profile-as-of")
