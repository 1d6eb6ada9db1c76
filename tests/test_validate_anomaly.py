import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import duck
from quire.functions.dates import with_parsed_date
from quire.functions.quantile import exact_quantiles
from quire.operators.anomaly import detect_anomalies, profile
from quire.operators.extract import extract_fields
from quire.operators.validate import validate
from quire.plans import catalog
from quire.plans import oracle as O
from test_extract import random_texts

AS_OF = dt.date(2024, 6, 30)
ITEMS = "array<struct<item_no:int,description:string,quantity:bigint,unit_price:double,total:double>>"
INV = (f"doc_id bigint, invoice_number string, invoice_date string, supplier string, total double, vat double, "
       f"subtotal double, line_items {ITEMS}")


def inv_df(spark, rows):
    return spark.createDataFrame(rows, INV)


def codes(arr):
    return [(f.code, f.item_no if f.code.startswith("item") else f.field) for f in arr]


def test_random_texts_match_the_sql(spark):
    texts = random_texts(3000, seed=21)
    inv = extract_fields(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r.doc_id: r for r in detect_anomalies(validate(inv, as_of=AS_OF), mode="rule_based").collect()}
    for r in duck.rows(texts, "SELECT doc_id, n_err, n_warn FROM verdict", O.val_ctes(str(AS_OF))):
        g = got[r["doc_id"]]
        assert (len(g.errors), len(g.warnings)) == (r["n_err"], r["n_warn"]), texts[r["doc_id"]]
    flags = ("round_total", "duplicate_items", "missing_supplier", "high_vat_rate")
    types = ("suspicious_pattern", "duplicate_items", "missing_critical_field", "unusual_rate")
    for r in duck.rows(texts, "SELECT * FROM rules", catalog._RULES_SQL):
        g = got[r["doc_id"]]
        want = [] if r["failed"] else [t for f, t in zip(flags, types, strict=True) if r[f]]
        assert (g.anomaly_error is not None, [a.type for a in g.anomalies]) == (r["failed"], want), texts[r["doc_id"]]


def test_boundaries(spark):
    items = [(1, "a", 3, 1.0, 3.01), (2, "b", 1, 1.0, 1.011), (3, None, 1, 1.0, 1.0)]
    rows = [
        (1, "A", "01/02/2024", "S", 110.01, 0.0, 110.0, []),     # |110.0+0-110.01| = 0.010000000000005 > 0.01
        (2, "A", "01/02/2024", "S", 110.0, 0.0, 110.0, items),  # item 2 off by 0.011; item 3 misses description
        (3, None, None, None, None, None, None, None),
        (4, "A", "01/02/2024", "", -1.0, 4.7, 100.0, []),       # rate 4.7 → within 0.5 of 5; negative total
        (5, "A", "01/02/2024", "S", 104.5, 4.5, 100.0, []),     # rate 4.5 → not within (strict <0.5)
        (6, "A", "01/02/2024", "S", float("nan"), 1.0, 1.0, []),  # NaN compares false, like Python
    ]
    out = {r.doc_id: r for r in validate(inv_df(spark, rows), as_of=AS_OF).collect()}
    assert codes(out[1].errors) == [("total_mismatch", "total")]
    assert codes(out[2].errors) == [("item_total_mismatch", 2), ("item_field_missing", 3)]
    assert codes(out[3].errors) == [("required_missing", "supplier"), ("required_missing", "total"),
                                    ("required_missing", "invoice_date")]
    assert codes(out[4].errors) == [("negative", "total"), ("total_mismatch", "total")] and out[4].warnings == []   # '' supplier is present
    assert codes(out[5].warnings) == [("unusual_vat_rate", "vat")]
    assert out[6].errors == [] and out[6].valid


def test_strict_mode(spark):
    rows = [(1, "A", "99/99/2024", "S", 104.5, 4.5, 100.0, [])]
    r = validate(inv_df(spark, rows), strict=True, as_of=AS_OF).collect()[0]
    assert r.warnings == [] and [f.code for f in r.errors] == ["unusual_vat_rate", "unparseable_date"]
    assert not r.valid


@pytest.mark.parametrize("s,expected", [
    ("05/03/2024", "2024-03-05"), ("12/25/2024", "2024-12-25"), ("2024-3-5", "2024-03-05"),
    ("05-03-2024", "2024-03-05"), ("12-25-2024", "2024-12-25"), ("15 JAN 2024", "2024-01-15"),
    ("15   January\n2024", "2024-01-15"), ("01/02/24", None), ("1/2/202", None), ("31/02/2024", None),
    ("15 Sept 2024", None), ("5/3/0000", None), ("5/3/12345", None), ("15/03-2024", None),
])
def test_date_cases(spark, s, expected):
    df = spark.createDataFrame([(s,)], "s string")
    got = with_parsed_date(df, "s", "d").select(F.date_format("d", "yyyy-MM-dd").alias("d")).collect()[0].d
    assert got == expected


def test_date_range(spark):
    rows = [(i, "A", d, "S", 1.0, 0.0, 1.0, []) for i, d in enumerate(
        ["30/06/2024", "01/07/2024", "30/06/2014", "29/06/2014", "10/07/2014"])]
    out = {r.doc_id: [f.code for f in r.warnings] for r in validate(inv_df(spark, rows), as_of=AS_OF).collect()}
    # 2014-06-30 is 3653 days before as_of; 3650 days back is 2014-07-03
    assert out[0] == [] and out[1] == ["future_date"] and out[2] == ["very_old_date"]
    assert out[3] == ["very_old_date"] and out[4] == []


def numpy_quartiles(vals):
    return float(np.percentile(vals, 25)), float(np.percentile(vals, 75))


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(6):
        n = [1, 2, 3, 4, 57, 400][g]
        for _ in range(n):
            rows.append((g, float(rnd.choice([rnd.randint(1, 9), rnd.random() * 1e3, -rnd.random()]))))
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r.q1, r.q3) for r in exact_quantiles(df, "v", {"q1": 0.25, "q3": 0.75}, by=["g"]).collect()}
    for g in range(6):
        vals = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx(numpy_quartiles(vals), abs=0, rel=1e-15), g


def test_global_quantiles_with_heavy_ties(spark):
    vals = [5.0] * 300 + [1.0, 2.0, 9.0, 1e9]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = exact_quantiles(df, "v", {"q1": 0.25, "q3": 0.75}).collect()[0]
    assert (r.q1, r.q3) == numpy_quartiles(vals)


def hist_df(spark, totals, vats=None):
    vats = vats or [None] * len(totals)
    return spark.createDataFrame(list(zip(totals, vats)), "total double, vat double")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_history_gate(spark, n):
    hist = hist_df(spark, [10.0, 11.0, 12.0, 13.0][:n])
    inv = inv_df(spark, [(1, "A", None, "S", 1000.0, None, None, [])])
    r = detect_anomalies(inv, profile(hist)).collect()[0]
    if n < 2:
        assert r.scores == {} and [a.type for a in r.anomalies] == []
    else:
        assert "total_z_score" in r.scores
        assert [a.type for a in r.anomalies] == ["statistical_outlier"]


def test_zscore_thresholds_and_iqr(spark):
    hist = hist_df(spark, [0.0, None, 10.0, 10.0, 10.0, 10.0], [1.0, 1.0, 2.0, 2.0, 0.0, None])
    p = profile(hist).collect()[0]
    assert (p.n_rows, p.n_total, p.std_total, p.q1_total, p.q3_total, p.n_vat) == (6, 4, 0.0, 10.0, 10.0, 4)
    inv = inv_df(spark, [(1, "A", None, "S", 10.5, None, None, []), (2, "A", None, "S", 10.0, 1.5, 100.0, [])])
    out = {r.doc_id: r for r in detect_anomalies(inv, profile(hist)).collect()}
    # all-equal history: z = 0 but any different value is an IQR outlier, severity medium
    assert out[1].scores["total_z_score"] == 0.0 and [(a.type, a.severity) for a in out[1].anomalies] == [
        ("statistical_outlier", "medium")]
    assert out[2].anomalies == [] and out[2].scores == {"total_z_score": 0.0, "vat_z_score": 0.0}


def test_severity(spark):
    base = [float(x) for x in range(1, 21)]            # mean 10.5, std 5.766
    hist = hist_df(spark, base)
    inv = inv_df(spark, [(1, "A", None, "S", 10.5 + 5.766281297335398 * 3.5, None, None, []),
                         (2, "A", None, "S", 10.5 + 5.766281297335398 * 4.5, None, None, [])])
    out = {r.doc_id: r for r in detect_anomalies(inv, profile(hist)).collect()}
    assert [a.severity for a in out[1].anomalies] == ["medium"]
    assert [a.severity for a in out[2].anomalies] == ["high"]


def test_error_paths(spark):
    df = spark.createDataFrame([(1, "Total: 1,2,3\nVAT: ,\nSubtotal: 5"), (2, "widget  1  $,  $1.00\nTotal: 1,000.00")],
                               "doc_id bigint, text string")
    inv = extract_fields(df)
    hist = hist_df(spark, [1.0, 2.0, 3.0], [1.0, 1.0, 1.0])
    stat = {r.doc_id: r for r in detect_anomalies(inv, profile(hist)).collect()}
    assert stat[2].anomaly_error == "could not convert string to float: '1,000.00'" and stat[2].anomalies == []
    # '1,2,3' converts at extraction; the VAT ',' stays text and float(',') raises once a VAT history exists
    assert stat[1].anomaly_error == "could not convert string to float: ','"
    no_vat_hist = hist_df(spark, [1.0, 2.0, 3.0])
    assert detect_anomalies(inv, profile(no_vat_hist)).where("doc_id = 1").collect()[0].anomaly_error is None
    rule = {r.doc_id: r for r in detect_anomalies(inv, mode="rule_based").collect()}
    assert rule[2].anomaly_error is not None and rule[1].anomaly_error is None
    with pytest.raises(ValueError):
        detect_anomalies(inv, mode="isolation_forest")


def test_profile_by_key(spark):
    hist = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 100.0), ("b", 5.0), (None, 7.0)],
                                 "supplier string, total double").withColumn("vat", F.lit(None).cast("double"))
    p = {r.supplier: r for r in profile(hist, by=["supplier"]).collect()}
    assert set(p) == {"a", "b"}
    assert (p["a"].q1_total, p["a"].q3_total) == numpy_quartiles([1.0, 2.0, 3.0, 100.0])
    inv = spark.createDataFrame([(1, "a", 100.0), (2, "b", 1.0), (3, None, 1.0)], "doc_id bigint, supplier string, "
                                "total double").withColumn("vat", F.lit(None).cast("double")).withColumn(
        "subtotal", F.lit(None).cast("double")).withColumn("line_items", F.lit(None).cast(ITEMS))
    out = {r.doc_id: r for r in detect_anomalies(inv, profile(hist, by=["supplier"]), by=["supplier"]).collect()}
    assert "total_z_score" in out[1].scores and out[2].scores == {} and out[3].scores == {}


def test_keyed_quantiles_with_a_hot_key(spark):
    # one key holds most rows, the others are tiny
    rnd = random.Random(9)
    rows = [("hot", float(rnd.randint(0, 50))) for _ in range(3000)] + [("hot", 1e6)]
    rows += [(f"k{i}", float(i + j)) for i in range(20) for j in range(3)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.q1, r.q3) for r in exact_quantiles(df, "v", {"q1": 0.25, "q3": 0.75}, by=["k"]).collect()}
    for key in {k for k, _ in rows}:
        assert got[key] == numpy_quartiles([v for k, v in rows if k == key]), key


def test_profile_approx_option(spark):
    vals = [float(v) for v in range(1, 101)]
    hist = hist_df(spark, vals)
    exact = profile(hist).collect()[0]
    approx = profile(hist, approx=True).collect()[0]
    assert (exact.q1_total, exact.q3_total) == numpy_quartiles(vals)
    assert abs(approx.q1_total - exact.q1_total) <= 1 and abs(approx.q3_total - exact.q3_total) <= 1
    assert (approx.n_rows, approx.n_total, approx.mean_total) == (exact.n_rows, exact.n_total, exact.mean_total)


def test_duplicates_differing_in_case(spark):
    items = [(1, "Blue Rod", 1, 1.0, 1.0), (2, "blue rod", 1, 1.0, 1.0)]
    distinct = [(1, "Blue Rod", 1, 1.0, 1.0), (2, "Blue Rods", 1, 1.0, 1.0)]
    inv = inv_df(spark, [(1, "A", None, "S", 2.0, None, None, items), (2, "A", None, "S", 2.0, None, None, distinct)])
    out = {r.doc_id: [a.type for a in r.anomalies] for r in detect_anomalies(inv, mode="rule_based").collect()}
    assert out == {1: ["duplicate_items"], 2: []}


def test_infinite_values_cost_no_more_jobs(spark):
    def jobs(vals):
        spark.sparkContext.setJobGroup("quantiles", "")
        got = exact_quantiles(spark.createDataFrame([(v,) for v in vals], "v double"), "v", {"q1": 0.25, "q3": 0.75}).collect()[0]
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles"))
        spark.sparkContext.setJobGroup("other", "")
        return n, (got.q1, got.q3)

    vals = [float(v) for v in range(1, 2001)]
    plain, with_inf = jobs(vals), jobs([*vals, float("inf")])
    assert with_inf[1] == numpy_quartiles([*vals, float("inf")])
    assert with_inf[0] == 2 * plain[0]  # the group counts both calls: the second ran as many jobs as the first


def test_profile_is_written_once_and_must_fit_its_key(spark):
    hist = spark.createDataFrame([("a", "1.0", 2.0), ("a", "abc", 3.0), ("b", "1,234.00", None)], "supplier string, total string, vat double")
    p = profile(hist, by=["supplier"])
    assert {r.supplier: (r.n_rows, r.n_total) for r in p.collect()} == {"a": (2, 1), "b": (1, 0)}
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "Aggregate" not in plan and "Relation" in plan
    with pytest.raises(ValueError):
        detect_anomalies(inv_df(spark, []), p)
    with pytest.raises(ValueError):
        detect_anomalies(inv_df(spark, []), profile(hist), by=["supplier"])


def test_invoices_without_a_key_are_dealt_out(spark):
    """They match no profile, and a third of all rows without a supplier is no task of its own."""
    text = "Total: {}.00\nVAT: 2.00\n{}"
    rows = [(i, text.format(10 + i % 7, "" if i % 3 == 0 else f"From: Shop {'ABC'[i % 3]}\n")) for i in range(900)]
    inv = extract_fields(spark.createDataFrame(rows, "doc_id bigint, text string"))
    prof = profile(inv, by=["supplier"])
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = detect_anomalies(inv, prof, by=["supplier"]).select("doc_id", "supplier", "history_rows", F.spark_partition_id().alias("part")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 900 and {r.history_rows for r in got if r.supplier} == {300} and all(r.history_rows is None for r in got if not r.supplier)
    parts = [r.part for r in got if r.supplier is None]
    assert len(parts) == 300 and max(parts.count(p) for p in set(parts)) < 100
