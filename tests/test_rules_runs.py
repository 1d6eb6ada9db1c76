"""Own rules, runs that count themselves, profiles that grow, ragged tables, exports of all formats or none."""

from __future__ import annotations

import csv
import glob
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators.anomaly import detect_anomalies, profile
from quire.operators.extract import extract_fields
from quire.operators.growing import append_state, merge_states, profile_from, profile_state, stored_profile
from quire.operators.rules import Rule
from quire.operators.validate import validate
from quire.options import Options
from quire.plans.run import export_observed, export_run, observed, run_invoices, summarize, summary_of
from quire.sinks import writers
from quire.sinks.ragged import ragged_header, ragged_items, write_ragged_csv
from quire.streaming.stream import parquet_batch_sink, start_invoice_stream, summarized_sink

TEXT = "INVOICE # A-{0}\nFrom: Shop & Co.\nDate: 01/02/2024\nPaper  2  $5.00  $10.00\nTotal: $1{0}.00\nVAT: $2.00\nSubtotal: $10.00"


def docs(spark, n: int):
    rows = [(i, TEXT.format(i) if i % 3 else "nothing", i % 5 != 4) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, ocr_success boolean")


def rules() -> list[Rule]:
    return [Rule("b_first", "total > 10", "m1", "total", "error", "total"), Rule("a_second", F.col("supplier").isNotNull(), "m2"), Rule("bad", "nowhere = 1"), Rule("text", "supplier"),
            Rule("nulls", "vat > subtotal * 100"), Rule("warn", "vat = 2", severity="warning", observed="vat + 1")]


def test_rules_keep_their_order_and_failures_stay_alone(spark):
    v = validate(extract_fields(docs(spark, 6)), as_of="2024-06-01", rules=rules())
    got = {r["doc_id"]: r for r in v.select("doc_id", "errors", "warnings", "valid").collect()}
    codes = {i: [e["code"] for e in r["errors"]] for i, r in got.items()}
    assert codes[1] == ["total_mismatch", "b_first", "a_second", "rule_failed", "rule_failed"]
    assert codes[0][-2:] == ["rule_failed"] * 2 and "a_second" not in codes[0]
    assert [e["message"] for e in got[1]["errors"][-2:]] == ["Rule 'bad' could not be applied: UNRESOLVED_COLUMN.WITH_SUGGESTION", "Rule 'text' could not be applied: a condition of type string"]
    assert [(w["code"], w["observed"]) for w in got[1]["warnings"]] == [("warn", 3.0)] and not got[1]["valid"]
    strict = validate(extract_fields(docs(spark, 2)), as_of="2024-06-01", rules=rules(), strict=True).where("doc_id = 1").first()
    assert [e["code"] for e in strict["errors"]][-1] == "warn" and strict["warnings"] == []
    with pytest.raises(ValueError, match="severity"):
        validate(extract_fields(docs(spark, 2)), rules=[Rule("x", "true", severity="high")])


def test_own_anomalies_and_options(spark):
    own = (Rule("cheap", "total < 13", "m", "total", "low", "total"), Rule("bad", "nowhere = 1", severity="high"))
    run = run_invoices(docs(spark, 6), options=Options(anomaly_mode="rule_based", rules=tuple(rules()), anomaly_rules=own), as_of="2024-06-01")
    got = {r["doc_id"]: r for r in run.collect()}
    assert [a["type"] for a in got[1]["anomalies"]] == ["cheap", "rule_failed"] and got[1]["total_anomalies"] == 2
    assert got[1]["anomalies"][0]["value"] == 11.0 and got[4]["anomalies"] is None
    plain = detect_anomalies(validate(extract_fields(docs(spark, 3))), mode="rule_based", own_rules=[])
    assert plain.where("doc_id = 1").first()["anomalies"] == []


def test_one_job_writes_and_counts(spark, scratch):
    run = run_invoices(docs(spark, 30).coalesce(2), as_of="2024-06-01", options=Options(rules=(Rule("late", "total > 12", severity="warning"),)))
    context = spark.sparkContext
    context.setJobGroup("observed", "one job")
    ok, counts = export_observed(run, os.path.join(scratch, "out"), ["json"])
    jobs = context.statusTracker().getJobIdsForGroup("observed")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert ok and len(jobs) == 1
    assert {k: counts[k] for k in ("total", "successful", "failed")} == summarize(run).first().asDict()
    errors = [e["code"] for r in run.select("errors").collect() for e in r["errors"] or []]
    assert counts["n_errors"] == len(errors) and {k: v for k, v in counts.items() if k.startswith("errors.")} == {f"errors.{c}": errors.count(c) for c in set(errors)}
    assert sum(1 for f in glob.glob(os.path.join(scratch, "out/format=json/part-*")) for _ in open(f)) == counts["successful"]


def test_counts_of_no_rows(spark, scratch):
    frame, seen = observed(run_invoices(docs(spark, 3).limit(0), as_of="2024-06-01"), "empty")
    assert export_run(frame, os.path.join(scratch, "none"))
    assert summary_of(seen) == {"total": 0, "successful": 0, "failed": 0, "n_errors": 0, "n_warnings": 0, "n_anomalies": 0}


def test_streams_count_their_batches(spark, scratch):
    source = os.path.join(scratch, "in")
    for part in (0, 1):
        docs(spark, 10 + part).drop("ocr_success").coalesce(1).write.mode("append").parquet(source)
    sink = summarized_sink(parquet_batch_sink(os.path.join(scratch, "out"), ["doc_id", "success"]), os.path.join(scratch, "counts"))
    start_invoice_stream(spark, source, os.path.join(scratch, "ckpt"), sink, as_of="2024-06-01", max_files_per_trigger=1).awaitTermination()
    rows = spark.read.parquet(os.path.join(scratch, "counts"))
    assert {r["batch"]: r["n"] for r in rows.where("what = 'total'").collect()} in ({0: 10, 1: 11}, {0: 11, 1: 10})
    assert rows.where("what = 'successful'").agg(F.sum("n")).first()[0] == spark.read.parquet(os.path.join(scratch, "out")).count() == 21


def close(a: dict, b: dict, names: list[str]) -> bool:
    return all(a[n] == b[n] if a[n] is None or b[n] is None else abs(a[n] - b[n]) <= 1e-9 * max(1.0, abs(b[n])) for n in names)


@pytest.mark.parametrize("by", [["k"], []])
def test_merged_states_are_the_whole(spark, scratch, by):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot", "hot", "a"]), rnd.choice([None, 0.0, rnd.uniform(1e6, 1e6 + 10)]), rnd.choice([None, 0.3])) for _ in range(400)] + [(None, 1.0, 1.0), ("zero", 0.0, None)]
    h = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, k string, total double, vat double")
    want = {r["k"] if by else None: r.asDict() for r in profile(h, by).collect()}
    for part in (3, 0, 1, 2, 1):
        append_state(h.where(F.col("i") % 4 == part), os.path.join(scratch, "state"), str(part), by)
    parts = [profile_state(h.where(F.col("i") % 4 == p), by) for p in range(4)]
    left = merge_states(merge_states(parts[0].union(parts[1]), by).union(parts[2]), by).union(parts[3])
    for p in (stored_profile(spark, os.path.join(scratch, "state"), by), profile_from(left, by)):
        got = {r["k"] if by else None: r.asDict() for r in p.collect()}
        assert set(got) == set(want)
        for k, r in got.items():
            assert close(r, want[k], ["n_rows", "n_total", "n_vat", "mean_total", "std_total", "mean_vat", "std_vat"])
            values = sorted(x[1] for x in rows if x[1] and (not by or x[0] == k))
            for q, share in (("q1_total", 0.25), ("q3_total", 0.75)):
                assert (r[q] is None) == (not values)
                if values:
                    assert np.searchsorted(values, r[q], "left") / len(values) - 0.01 <= share <= np.searchsorted(values, r[q], "right") / len(values) + 0.01
        assert not by or got["hot"]["std_vat"] == 0.0
    assert profile_from(profile_state(h.limit(0), by), by).count() == (0 if by else 1)


RAGGED = [{"supplier": "A, \"B\"\nC", "total": 1.5, "confidence_scores": {"total": 0.8}}, {"odd key": [1, {"x": None}], "line_items": [{"b": 1}, {"a": None, "c d": "x,y"}], "total": None},
          {"confidence_scores": {"vat": 0.5, "new": 1}, "line_items": []}, {"line_items": None, "flag": True, "confidence_scores": None}]


def test_headers_hold_the_keys_that_occur(spark, scratch):
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(RAGGED)] + [(9, "{bad"), (10, None)], "doc_id long, value string")
    path = os.path.join(scratch, "ragged")
    write_ragged_csv(lines.coalesce(1), path)
    read = lambda name: [r for f in sorted(glob.glob(f"{path}/{name}/part-*")) for r in csv.DictReader(open(f, newline=""))]
    head = {r["doc_id"]: r for r in read("invoices")}
    assert list(head["0"]) == ["doc_id", "flag", "odd key", "supplier", "total", "line_items_count", "confidence_new", "confidence_total", "confidence_vat"]
    assert head["0"]["supplier"] == "A, \"B\"\nC" and head["0"]["total"] == "1.5" and head["0"]["line_items_count"] == "0"
    assert json.loads(head["1"]["odd key"]) == [1, {"x": None}] and head["1"]["total"] == "" and head["1"]["line_items_count"] == "2"
    assert (head["2"]["confidence_vat"], head["2"]["confidence_new"], head["2"]["confidence_total"], head["3"]["flag"]) == ("0.5", "1", "", "true")
    items = read("line_items")
    assert [list(r) for r in items] == [["_doc_id", "_item_no", "a", "b", "c d"]] * 2 and [r["c d"] for r in items] == ["", "x,y"] and items[0]["b"] == "1"
    with pytest.raises(ValueError, match="not a header"):
        ragged_header(lines, most=3)
    assert ragged_header(lines.limit(0)).columns == ["doc_id"] and ragged_items(lines.limit(0)).columns == ["_doc_id", "_item_no"]


def test_all_formats_or_none(spark, scratch, monkeypatch):
    inv = extract_fields(docs(spark, 6))
    base = os.path.join(scratch, "published")
    assert writers.publish_invoices(inv, base, ["json", "xml", "csv"]) == {"json": "written", "xml": "unknown", "csv": "written"}
    assert sorted(f for f in os.listdir(base) if not f.startswith(".")) == ["_MANIFEST.json", "format=csv", "format=json"]
    assert json.load(open(f"{base}/{writers.MANIFEST}"))["formats"]["csv"] == "written"
    assert spark.read.json(f"{base}/format=json").count() == 6
    with pytest.raises(FileExistsError):
        writers.publish_invoices(inv, base)

    def fails(*args, **kwargs):
        raise OSError("disk")

    monkeypatch.setattr(writers, "write_csv", fails)
    other = os.path.join(scratch, "withheld")
    assert writers.publish_invoices(inv, other, ["json", "csv"]) == {"json": "withheld", "csv": "failed: OSError"}
    assert [f for f in os.listdir(other) if not f.startswith(".")] == []
