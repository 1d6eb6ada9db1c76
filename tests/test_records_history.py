"""Records with absent keys (I1–I3, V1, V9) and histories by date (J1, A1–A3) against plain Python."""

from __future__ import annotations

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators.anomaly import detect_anomalies, profile
from quire.operators.history import profile_as_of, ranked_before
from quire.operators.targets import outbox, to_target
from quire.operators.validate import validate
from quire.sinks.writers import to_record
from quire.sources.records import read_records

_KEYS = {"supplier": [None, "", "A & B"], "invoice_number": [None, "INV-1", 7], "total": [None, 12.5, 3, "7.25", " 8 ", "n/a", True, {"a": 1}, [1]], "vat": [None, 0, 1.5, "x"],
         "subtotal": [None, 2.5], "line_items": [None, [], [{"description": "d", "quantity": 2, "unit_price": 1.5, "total": 3}, {"total": None}, {}]],
         "confidence_scores": [None, {}, {"total": 0.8}], "validation_status": [None, "ok"], "anomaly_flags": [None, [], ["f"]], "other": [1]}


def records(seed: int, n: int) -> list[dict]:
    rnd = random.Random(seed)
    return [{k: rnd.choice(v) for k, v in _KEYS.items() if rnd.random() < 0.7} for _ in range(n)]


def number(x):
    try:
        return None if x is None else float(x)
    except (TypeError, ValueError):
        return None


def test_defaults_follow_each_record(spark):
    rows = records(1, 300)
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "doc_id long, value string")
    got = {r["doc_id"]: r for r in to_target(read_records(lines), "generic").collect()}
    for i, r in enumerate(rows):
        g = got[i]
        text = lambda k: r.get(k, "") if r.get(k, "") is None else str(r.get(k, ""))  # noqa: E731, B023
        assert (g["vendor"], g["invoice_number"], g["invoice_date"]) == (text("supplier"), text("invoice_number"), "")
        assert (g["total_amount"], g["tax_amount"], g["subtotal"]) == tuple(number(r.get(k, 0.0)) for k in ("total", "vat", "subtotal"))
        items = r.get("line_items", [])
        assert g["line_items"] is None if items is None else [x["total"] for x in g["line_items"]] == [number(x.get("total")) for x in items]
        assert (g["metadata"]["extraction_confidence"], g["metadata"]["validation_status"], g["metadata"]["anomaly_flags"]) == (
            r.get("confidence_scores", {}), r.get("validation_status", "unknown"), r.get("anomaly_flags", []))


def test_findings_follow_each_record(spark):
    rows = records(2, 300)
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "doc_id long, value string")
    v = validate(read_records(lines), required_fields=["supplier", "total", "line_items"], as_of="2024-01-01")
    got = {r["doc_id"]: [(e["code"], e["item_no"], e["field"]) for e in r["errors"]] for r in v.select("doc_id", "errors").collect()}
    for i, r in enumerate(rows):
        want = [("required_missing", None, k) for k in ("supplier", "total", "line_items") if r.get(k) is None]
        want += [("not_a_number", None, k) for k in ("total", "vat", "subtotal") if r.get(k) is not None and number(r[k]) is None]
        for n, item in enumerate(r.get("line_items") or [], 1):
            want += [("item_field_missing", n, k) for k in ("description", "quantity", "unit_price", "total") if k not in item]
        assert [g for g in got[i] if g[0] in ("required_missing", "not_a_number", "item_field_missing")] == want


def test_texts_that_are_no_records(spark):
    lines = spark.createDataFrame([(1, "{bad"), (2, "[1]"), (3, None), (4, "null"), (5, "{}"), (6, '{"line_items": [3, "x", {"total": 1}]}'), (7, '{"line_items": {"a": 1}}')], "doc_id long, value string")
    r = read_records(lines)
    assert {x["doc_id"]: (x["record_ok"], x["present"]) for x in r.collect()} == {
        1: (False, []), 2: (False, []), 3: (False, []), 4: (False, []), 5: (True, []), 6: (True, ["line_items"]), 7: (True, ["line_items"])}
    assert {x["doc_id"]: json.loads(x["payload"])["lines"] for x in outbox(r, "oracle").collect()}[5] == []
    assert {x["doc_id"]: x["total_anomalies"] for x in detect_anomalies(r, mode="rule_based").collect()}[5] == 1
    assert to_record(r).count() == 7
    assert read_records(lines.limit(0)).count() == 0


def test_columns_keep_their_defaults_without_keys(spark):
    typed = spark.createDataFrame([(1, None, 2.0)], "doc_id long, supplier string, total double")
    g = to_target(typed, "generic").first()
    assert (g["vendor"], g["invoice_number"], g["total_amount"], g["line_items"]) == (None, "", 2.0, [])


def close(a, b) -> bool:
    return all(x is y if x is None or y is None else abs(x - y) <= 1e-9 * max(1.0, abs(y)) for x, y in zip(a, b, strict=True))


def dated(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    day = dt.date(2020, 1, 1)
    rows = []
    for _ in range(n):
        key = rnd.choice(["hot", "hot", "a", "b", "c"])
        rows.append((key, day + dt.timedelta(days=rnd.randrange(60)), rnd.choice([0.0, None, 5.0, 5.0, rnd.uniform(-10, 1000)]), rnd.choice([None, 1.0, rnd.uniform(0, 5)])))
    return [*rows, (None, day, 1.0, 1.0), ("a", None, 1.0, 1.0), *[("same", day + dt.timedelta(days=k), 0.1, 0.1) for k in range(6)]]


@pytest.mark.parametrize("by", [["k"], []])
def test_profiles_of_earlier_days(spark, by):
    rows = dated(3, 600)
    h = spark.createDataFrame(rows, "k string, day date, total double, vat double").repartition(5)
    got = profile_as_of(h, h, by, "day").collect()
    days = {(r[0] if by else None, r[1]) for r in rows if r[1] is not None and (r[0] is not None or not by)}
    assert len(got) == len(days)
    for g in got:
        before = [r for r in rows if r[1] is not None and r[1] < g["day"] and (not by or r[0] == g["k"])]
        totals, vats = [[r[c] for r in before if r[c]] for c in (2, 3)]
        assert (g["n_rows"], g["n_total"], g["n_vat"]) == (len(before), len(totals), len(vats))
        for name, values in (("total", totals), ("vat", vats)):
            want = (np.mean(values), np.std(values)) if values else (None, None)
            assert close((g[f"mean_{name}"], g[f"std_{name}"]), want)
        want = tuple(np.percentile(totals, [25, 75])) if totals else (None, None)
        assert close((g["q1_total"], g["q3_total"]), want)
    if by:
        assert all(g["std_total"] in (None, 0.0) and g["mean_total"] in (None, 0.1) for g in got if g["k"] == "same")


def test_the_last_day_sees_what_a_plain_profile_sees(spark):
    rows = [r for r in dated(4, 300) if r[0] and r[1]]
    h = spark.createDataFrame(rows, "k string, day date, total double, vat double")
    later = h.select("k").distinct().withColumn("day", F.lit(dt.date(2030, 1, 1)))
    got = {r["k"]: r.asDict() for r in profile_as_of(h, later, ["k"], "day").drop("day").collect()}
    for k, r in {r["k"]: r.asDict() for r in profile(h, ["k"]).collect()}.items():
        names = [c for c in r if c != "k"]
        assert close([r[c] for c in names], [got[k][c] for c in names])


def test_ranks_among_earlier_rows_need_several_levels(spark):
    n = 5000
    rows = spark.range(n).select((F.col("id") % 50).cast("int").alias("day"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    asked = spark.createDataFrame([(d, r) for d in (1, 25, 50) for r in (0, 10, 99)], "day int, rank long")
    values = [((k % 50), float(k * 7919 % n)) for k in range(n)]
    got = {(r["day"], r["rank"]): r["x"] for r in ranked_before(rows, asked, "x", [], "day").collect()}
    assert got == {(d, r): sorted(v for e, v in values if e < d)[r] for d in (1, 25, 50) for r in (0, 10, 99)}


def test_detection_against_earlier_invoices_only(spark):
    day = dt.date(2021, 1, 1)
    rows = [(i, "s", day + dt.timedelta(days=i), 100.0 + i % 3, 10.0, None) for i in range(10)] + [(99, "s", day + dt.timedelta(days=4), 9000.0, 10.0, None), (50, "s", None, 100.0, 1.0, None)]
    inv = spark.createDataFrame(rows, "doc_id long, supplier string, day date, total double, vat double, subtotal double").withColumn("line_items", F.array().cast("array<struct<description:string>>"))
    out = {r["doc_id"]: r for r in detect_anomalies(inv, profile_as_of(inv, inv, ["supplier"], "day"), by=["supplier", "day"]).collect()}
    assert [out[i]["history_rows"] for i in (0, 1, 4, 99, 5)] == [0, 1, 4, 4, 6] and out[50]["history_rows"] is None
    assert "statistical_outlier" in [a["type"] for a in out[99]["anomalies"]]
    assert out[0]["scores"] == {} and "total_z_score" in out[2]["scores"]


def test_no_history(spark):
    h = spark.createDataFrame([], "k string, day date, total double, vat double")
    assert profile_as_of(h, h, ["k"], "day").count() == 0
    some = spark.createDataFrame([("a", dt.date(2020, 1, 1))], "k string, day date")
    assert profile_as_of(h, some, ["k"], "day").select("n_rows", "q1_total").first() == (0, None)
