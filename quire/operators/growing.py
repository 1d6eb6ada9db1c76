"""A2/A3 as a state that grows: a new part of the history is summed up once, and profiles come from the merged states.

A state has one row for each key: counts, mean and M2 of the truthy totals and VATs, their least and greatest value, and a KLL sketch of
the totals. States of disjoint parts merge into the state of the whole in any order (means and M2 pairwise, sketches by their own
merge), so that a new day costs that day's rows and one row for each part and key.

Counts, mean and deviation are those of :func:`quire.operators.anomaly.profile`; quartiles are approximate: with ``k`` = 800 the rank of
a quartile is off by less than 1 % of the values (0.4 % typically; exact while a key has fewer than ``k`` values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import materialize
from .anomaly import PROFILE_COLUMNS, _truthy

SKETCH_K = 800


def profile_state(history: DataFrame, by: list[str] | tuple[str, ...] = (), total: str = "total", vat: str = "vat", k: int = SKETCH_K) -> DataFrame:
    """The state of one part of a history. Rows with a NULL key are left out; so are amounts that are not numbers."""
    h = history.select(*by, F.col(total).try_cast("double").alias("_t"), F.col(vat).try_cast("double").alias("_v"))
    for c in by:
        h = h.where(F.col(c).isNotNull())
    parts = [F.count("*").alias("n_rows")]
    for name, c in (("total", "_t"), ("vat", "_v")):
        x = F.when(_truthy(F.col(c)), F.col(c))
        parts += [F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high")).alias(name)]
    parts.append(F.kll_sketch_agg_double(F.when(_truthy(F.col("_t")), F.col("_t")), F.lit(k)).alias("sketch"))
    return h.groupBy(*by).agg(*parts)


def _merged(name: str) -> Column:
    """The states of one amount, folded pairwise in a fixed order; one entry for each part."""
    some = F.array_sort(F.collect_list(F.when(F.col(name)["n"] > 0, F.col(name))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def add(a: Column, b: Column) -> Column:
        n, off = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + off * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + off * off * a["n"] * b["n"] / n).alias("m2"),
                        F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"))

    return F.aggregate(some, none, add).alias(name)


def merge_states(states: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One state for each key from the rows of ``states``, each the state of another part."""
    sketches = states.select(*by, "n_rows", "total", "vat", "sketch")
    return sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), _merged("total"), _merged("vat"), F.kll_merge_agg_double("sketch").alias("sketch"))


def profile_from(states: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """by… and the columns of a profile, from the states of any number of parts; written once, as :func:`profile` is."""
    whole = merge_states(states, by)
    out = {"n_rows": F.coalesce("n_rows", F.lit(0).cast("long"))}
    for name in ("total", "vat"):
        s = F.col(name)
        alike = s["low"] == s["high"]
        out |= {f"n_{name}": s["n"], f"mean_{name}": F.when(s["n"] > 0, F.when(alike, s["low"]).otherwise(s["mean"])),
                f"std_{name}": F.when(s["n"] > 0, F.when(alike, F.lit(0.0)).otherwise(F.sqrt(s["m2"] / F.nullif(s["n"], F.lit(0)))))}
    for q, p in (("q1_total", 0.25), ("q3_total", 0.75)):
        out[q] = F.when(F.col("total")["n"] > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    return materialize(whole.select(*by, *[out[c].alias(c) for c in PROFILE_COLUMNS]), "profile")


def append_state(part: DataFrame, path: str, name: str, by: list[str] | tuple[str, ...] = (), **amounts: str) -> None:
    """Add the part called ``name`` (a day) to the state at ``path``; the same part again replaces itself."""
    profile_state(part, by, **amounts).write.mode("overwrite").parquet(f"{path}/part={name}")


def stored_profile(spark: SparkSession, path: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The profile of all parts at ``path``."""
    return profile_from(spark.read.parquet(path), by)
