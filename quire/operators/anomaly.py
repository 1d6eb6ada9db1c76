"""History profile, statistical outliers and rule-based anomalies.

The history is reduced once to a profile (one row, or one row per key) — O(history + invoices) instead of
re-scanning the history for every invoice. The profile joins the invoices by broadcast: a global profile is one
row; a keyed profile is joined on its key and left to the optimizer/AQE, which broadcasts it only when its
measured size is under the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ..functions.patterns import (
    MSG_CONVERSION,
    MSG_DUPLICATE_ITEMS,
    MSG_HIGH_VAT_RATE,
    MSG_ROUND_TOTAL,
    MSG_SUPPLIER_MISSING,
    MSG_TOTAL_OUTLIER,
    MSG_VAT_OUTLIER,
    HIGH_VAT_PERCENT,
    IQR_FACTOR,
    ROUND_TOTAL_UNIT,
    Z_SCORE_HIGH,
    Z_SCORE_THRESHOLD,
)
from ..functions.quantile import exact_quantiles
from ..functions.stage import materialize
from ..functions.text import template
from .rules import Rule, applied
from .validate import compact, gt, vat_rate

ANOMALY = "struct<field:string,type:string,value:double,message:string,severity:string>"
PROFILE_COLUMNS = ["n_rows", "n_total", "mean_total", "std_total", "q1_total", "q3_total", "n_vat", "mean_vat",
                   "std_vat"]


def _truthy(c: Column) -> Column:
    """Python truthiness of a number: present and non-zero (NaN counts as absent here, see G11)."""
    return c.isNotNull() & (c != 0) & ~F.isnan(c)


def profile(history: DataFrame, by: list[str] | tuple[str, ...] = (), total: str = "total", vat: str = "vat",
            approx: bool = False) -> DataFrame:
    """A1–A3: ``by… , n_rows, n_total, mean_total, std_total, q1_total, q3_total, n_vat, mean_vat, std_vat``.

    ``n_rows`` counts history rows before A1's filter (the A8 gate). Totals and VATs keep only truthy values.
    Quartiles are exact (numpy linear interpolation) unless ``approx`` (then ``percentile_approx``).
    An empty global history still yields one row (n_rows = 0). Amounts that are not numbers are left out.

    The finished profile is written once (see ``materialize``): whatever joins it, streams included, reads those few
    rows and never the history again. This is the one step of the library that runs jobs when it is called.
    """
    by = list(by)
    h = history.select(*by, F.col(total).try_cast("double").alias("_t"), F.col(vat).try_cast("double").alias("_v"))
    for k in by:  # a NULL key never joins an invoice, so it has no profile
        h = h.where(F.col(k).isNotNull())
    t_ok, v_ok = _truthy(F.col("_t")), _truthy(F.col("_v"))
    t, v = F.when(t_ok, F.col("_t")), F.when(v_ok, F.col("_v"))
    aggs = [
        F.count("*").alias("n_rows"),
        F.count(t).alias("n_total"),
        F.avg(t).alias("mean_total"),
        F.stddev_pop(t).alias("std_total"),
        F.count(v).alias("n_vat"),
        F.avg(v).alias("mean_vat"),
        F.stddev_pop(v).alias("std_vat"),
    ]
    if approx:
        aggs += [F.percentile_approx(t, 0.25, 10000).cast("double").alias("q1_total"),
                 F.percentile_approx(t, 0.75, 10000).cast("double").alias("q3_total")]
        base = h.groupBy(*by).agg(*aggs)
    else:
        base = h.groupBy(*by).agg(*aggs)
        q = exact_quantiles(h.where(t_ok), "_t", {"q1_total": 0.25, "q3_total": 0.75}, by)
        base = base.join(q, by, "left") if by else base.withColumn("_one", F.lit(1)).join(q.withColumn("_one", F.lit(1)), "_one", "left")
    return materialize(base.select(*by, *PROFILE_COLUMNS), "profile")


def z_score(value: Column, n: Column, mean: Column, std: Column) -> Column:
    """A4: 0.0 with fewer than 2 values or zero spread, else ``|(value - mean) / std|``."""
    return F.when((n < 2) | (std == 0), F.lit(0.0)).otherwise(F.abs((value - mean) / std))


def iqr_outlier(value: Column, n: Column, q1: Column, q3: Column) -> Column:
    """A5: at least 4 values and strictly outside ``[q1 - 1.5·iqr, q3 + 1.5·iqr]``."""
    iqr = q3 - q1
    return (n >= 4) & ((value < q1 - IQR_FACTOR * iqr) | gt(value, q3 + IQR_FACTOR * iqr))


def anomaly(field: str | None, typ: str, message: Column | str, severity: Column | str, value: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(field).cast("string").alias("field"), F.lit(typ).alias("type"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        lit(message).cast("string").alias("message"), lit(severity).cast("string").alias("severity"),
    )


def _amount_state(df: DataFrame, f: str) -> tuple[Column, Column, Column]:
    """(truthy, bad, value) for ``data[f]``: ``bad`` means ``float(data[f])`` raises."""
    val = F.col(f)
    if f + "_raw" in df.columns:
        raw = F.col(f + "_raw")
        conv = F.col("converted")[f] if "converted" in df.columns else F.lit(True)
        # a converted number is truthy when non-zero; an unconverted captured string is always truthy
        truthy = raw.isNotNull() & (~conv | _truthy(val))
        bad = raw.isNotNull() & val.isNull()
    else:
        truthy, bad = _truthy(val), F.lit(False)
    return truthy, bad, val


def rule_anomalies(df: DataFrame) -> Column:
    """A9–A12 in order: round total, duplicate items, missing supplier, high VAT rate."""
    t_truthy, _, total = _amount_state(df, "total")
    rnd = F.when(t_truthy & gt(total, 0.0) & ((total % ROUND_TOTAL_UNIT) == 0) & gt(total, ROUND_TOTAL_UNIT),
                 anomaly("total", "suspicious_pattern", MSG_ROUND_TOTAL, "low", total))
    descs = F.transform(F.col("line_items"),
                        lambda x: F.lower(F.coalesce(x["description"], F.lit(""))))
    dup = F.when(F.size("line_items") != F.size(F.array_distinct(descs)),
                 anomaly("line_items", "duplicate_items", MSG_DUPLICATE_ITEMS, "medium"))
    sup = F.when(F.coalesce(F.col("supplier"), F.lit("")) == "",
                 anomaly("supplier", "missing_critical_field", MSG_SUPPLIER_MISSING, "high"))
    rate = vat_rate()
    high = F.when(gt(rate, HIGH_VAT_PERCENT),
                  anomaly("vat", "unusual_rate",
                          template(MSG_HIGH_VAT_RATE, rate=F.format_string("%.2f", rate)),
                          "high", rate))
    return compact([rnd, dup, sup, high], f"array<{ANOMALY}>")


def _conv_error(raw: Column) -> Column:
    return template(MSG_CONVERSION, raw=raw)


def _joined(df: DataFrame, prof: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the profile of its key, if there is one. Rows without a key match nothing and are dealt by their own hash.

    A plain join would send all of them to one partition, which a skewed join cannot split by key either.
    """
    own = ["doc_id"] if "doc_id" in df.columns else [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    missing = reduce(or_, [F.col(k).isNull() for k in by])
    # the profile's side is 0 for every key, but no literal: a literal would be taken out of the join's keys
    none = F.pmod(F.xxhash64(*by), F.lit(1).cast("long"))
    left = df.withColumn("_p_dealt", F.when(missing, F.xxhash64(*own).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long")))
    return left.join(prof.withColumn("_p_dealt", none), [*by, "_p_dealt"], "left")


def detect_anomalies(invoices: DataFrame, history_profile: DataFrame | None = None, by: list[str] | tuple[str, ...] = (),
                     mode: str | None = "statistical", own_rules: Sequence[Rule] = ()) -> DataFrame:
    """Appends ``anomalies``, ``scores``, ``has_anomalies``, ``total_anomalies``, ``anomaly_error``.

    ``history_rows`` holds the number of history rows behind each invoice's profile (statistical mode).
    ``mode``: ``statistical`` (profile + rules; rules only when the profile is missing or has < 2 rows),
    ``rule_based`` (rules only; a non-numeric total is an ``anomaly_error`` that fails the invoice), or ``None``
    (nothing appended). ``history_profile`` comes from :func:`profile` with the same ``by``. ``own_rules`` follow the built-in
    anomalies in the order given; a rule's code is the anomaly's type.
    """
    if mode is None:
        return invoices
    if mode not in ("statistical", "rule_based"):
        raise ValueError(f"Unknown detector type: {mode}")
    df = invoices
    by = list(by)
    use_stats = mode == "statistical" and history_profile is not None
    if use_stats:
        keys = [c for c in history_profile.columns if c not in PROFILE_COLUMNS]
        if sorted(keys) != sorted(by):
            raise ValueError(f"the profile is keyed by {keys}, the invoices are to be joined by {by}")
        prof = history_profile.select(*by, *[F.col(c).alias("_p_" + c) for c in PROFILE_COLUMNS])
        df = df.crossJoin(F.broadcast(prof)) if not by else _joined(df, prof, by)

    t_truthy, t_bad, total = _amount_state(df, "total")
    v_truthy, v_bad, vat = _amount_state(df, "vat")
    rules = rule_anomalies(df)
    empty_scores = F.create_map().cast("map<string,double>")

    if use_stats:
        p = lambda c: F.col("_p_" + c)
        gate = F.coalesce(p("n_rows"), F.lit(0)) >= 2
        run_t = gate & t_truthy & (p("n_total") > 0)
        run_v = gate & v_truthy & (p("n_vat") > 0)
        zt = z_score(total, p("n_total"), p("mean_total"), p("std_total"))
        zv = z_score(vat, p("n_vat"), p("mean_vat"), p("std_vat"))
        out_t = iqr_outlier(total, p("n_total"), p("q1_total"), p("q3_total"))
        a_total = F.when(run_t & (gt(zt, Z_SCORE_THRESHOLD) | out_t),
                         anomaly("total", "statistical_outlier",
                                 template(MSG_TOTAL_OUTLIER, z=F.format_string("%.2f", zt)),
                                 F.when(gt(zt, Z_SCORE_HIGH), "high").otherwise("medium"), total))
        a_vat = F.when(run_v & gt(zv, Z_SCORE_THRESHOLD),
                       anomaly("vat", "statistical_outlier",
                               template(MSG_VAT_OUTLIER, z=F.format_string("%.2f", zv)), "medium", vat))
        stat = compact([a_total, a_vat], f"array<{ANOMALY}>")
        scores = F.map_filter(F.create_map(F.lit("total_z_score"), F.when(run_t, zt),
                                           F.lit("vat_z_score"), F.when(run_v, zv)), lambda k, v: v.isNotNull())
        # float(total) raises whenever total is truthy; float(vat) only where the VAT check runs
        err = F.when(t_truthy & t_bad, _conv_error(F.col("total_raw") if "total_raw" in df.columns else F.lit("")))
        err = err.when(gate & v_truthy & (p("n_vat") > 0) & v_bad,
                       _conv_error(F.col("vat_raw") if "vat_raw" in df.columns else F.lit("")))
        anomalies = F.concat(stat, rules)
    else:
        scores = empty_scores
        err = F.when(t_truthy & t_bad, _conv_error(F.col("total_raw") if "total_raw" in df.columns else F.lit("")))
        anomalies = rules

    own = [F.when(when, anomaly(r.field, r.code, r.message, r.severity, seen)) for r, when, seen in applied(df, own_rules, ("low", "medium", "high"))]
    if own:
        anomalies = F.concat(anomalies, compact(own, f"array<{ANOMALY}>"))
    failed = err.isNotNull()
    empty = F.array().cast(f"array<{ANOMALY}>")
    out = df.select(
        *[c for c in df.columns if not c.startswith("_p_")],
        *([F.col("_p_n_rows").alias("history_rows")] if use_stats else []),
        F.when(failed, empty).otherwise(anomalies).alias("anomalies"),
        F.when(failed, empty_scores).otherwise(scores).alias("scores"),
        err.alias("anomaly_error"),
    )
    return (out.withColumn("has_anomalies", F.size("anomalies") > 0)
            .withColumn("total_anomalies", F.size("anomalies")))
