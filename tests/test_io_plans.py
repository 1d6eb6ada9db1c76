import csv
import glob
import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from quire.functions.patterns import SEARCH_PATTERNS
from quire.operators.anomaly import detect_anomalies, profile
from quire.operators.extract import extract_fields
from quire.operators.targets import TargetRegistry, outbox, target, to_target
from quire.plans.catalog import invoices
from quire.plans.run import export_run, report, run_invoices, summarize
from quire.options import Options, anomaly_mode
from quire.sinks.writers import CSV_READ_OPTIONS, flatten_for_csv, output_names, to_record, union_item_tables, write_csv, write_invoices
from quire.sources.files import assemble_pages, find_invoices, is_supported_file, supported_extensions
from quire.sources.fixtures import rendered_invoices
from quire.streaming.stream import parquet_batch_sink, start_invoice_stream, stream_chain

DOCS = "doc_id bigint, text string"
TEXT = "INVOICE # A-1\nFrom: Shop & Co.\nDate: 05/03/2024\nwidget  2  $5.00  $10.00\nTotal: 12.00\nVAT: 2.00\nSubtotal: 10.00"


def test_find_invoices(spark, scratch):
    names = ["a.pdf", "b.PDF", "c.Pdf", "d.png", "e.JPEG", "f.txt", ".hidden.pdf", "g.tif"]
    for n in names:
        open(os.path.join(scratch, n), "wb").write(b"x")
    os.makedirs(os.path.join(scratch, "sub"))
    open(os.path.join(scratch, "sub", "h.pdf"), "wb").write(b"x")
    got = [os.path.basename(r.path) for r in find_invoices(spark, scratch).collect()]
    assert got == ["a.pdf", "b.PDF", "d.png", "e.JPEG", "g.tif"]
    assert find_invoices(spark, os.path.join(scratch, "missing")).count() == 0
    flags = spark.createDataFrame([(n,) for n in names], "path string").select(is_supported_file("path").alias("ok"))
    assert [r.ok for r in flags.collect()] == [True, True, True, True, True, False, True, True]
    assert supported_extensions()[0] == ".pdf"


def test_assemble_pages(spark):
    pages = spark.createDataFrame([(1, 1, "one", True), (1, 2, "two", False), (1, 3, "three", True),
                                   (2, 1, "x", False)], "doc_id bigint, page_no int, text string, success boolean")
    out = {r.doc_id: r for r in assemble_pages(pages).collect()}
    assert out[1].pages == 3 and out[1].text == "--- Page 1 ---\none\n\n--- Page 3 ---\nthree"
    assert out[2].pages == 1 and out[2].text == ""


def test_sinks_round_trip(spark, scratch):
    text = ('Description  Qty  Price  Amount\nbolt, "steel"  2  $5.00  $10.00\nFrom: Shop & Co., Ltd\nTotal: 1,010.00')
    inv = extract_fields(spark.createDataFrame([(1, text), (2, "nothing here"), (3, "x  1  $,  $1.00\nTotal: 1,000.00")], DOCS))
    base = os.path.join(scratch, "out")
    assert write_invoices(inv, base, ["json", "csv", "xml"]) is True  # unknown formats are skipped
    assert write_invoices(inv, os.path.join(scratch, "both")) is True
    keys = ["invoice_number", "invoice_date", "supplier", "total", "vat", "subtotal", "line_items", "confidence_scores"]
    back = sorted((json.loads(r.value) for r in spark.read.text(os.path.join(base, "format=json")).collect()), key=str)
    assert all(list(r) == keys for r in back) and len(back) == 3
    totals = sorted((str(type(r["total"]).__name__), str(r["total"])) for r in back)
    assert totals == [("NoneType", "None"), ("float", "1010.0"), ("str", "1,000.00")]
    shop = next(r for r in back if r["supplier"])
    assert shop["line_items"] == [{"description": "steel", "quantity": 2, "unit_price": 5.0, "total": 10.0}] or len(shop["line_items"]) == 1
    assert shop["confidence_scores"] == {"supplier": 0.8, "total": 0.8}
    # pretty text documents are valid JSON with nulls kept
    write_invoices(inv.where("doc_id = 2"), os.path.join(scratch, "p"), ["json"], pretty_json=True)
    txt = "".join(r.value + "\n" for r in spark.read.text(os.path.join(scratch, "p", "format=json"), wholetext=True).collect())
    assert json.loads(txt)["invoice_number"] is None and "\n  " in txt
    head = [r for f in glob.glob(os.path.join(base, "format=csv", "invoices", "*.csv")) for r in csv.DictReader(open(f, newline=""))]
    assert sorted((r["doc_id"], r["supplier"], r["total"], r["line_items_count"], r["confidence_total"]) for r in head) == [
        ("1", "Shop & Co., Ltd", "1010.0", "1", "0.8"), ("2", "", "", "0", ""), ("3", "", "1,000.00", "0", "0.8")]
    with pytest.raises(ValueError):
        write_invoices(inv, base, ["xml"])
    with pytest.raises(AnalysisException):  # an existing output is not replaced unasked
        write_invoices(inv, base, ["json"])


def test_csv_values_with_quotes_commas_and_line_breaks(spark, scratch):
    odd = 'say "hi", then\nleave\\ and, "end"'
    item = "array<struct<description:string,quantity:bigint,unit_price:double,total:double>>"
    amount = "struct<number:double,text:string>"
    rec = spark.createDataFrame([(1, odd, None, odd, (5.5, None), (None, "1,0"), None, [(odd, 2, 1.5, 3.0)], {"total": 0.8})],
                                f"doc_id long, invoice_number string, invoice_date string, supplier string, total {amount}, vat {amount}, "
                                f"subtotal {amount}, line_items {item}, confidence_scores map<string,double>")
    write_csv(rec, scratch + "/c")
    one = lambda name: [r for f in glob.glob(f"{scratch}/c/{name}/*.csv") for r in csv.DictReader(open(f, newline=""))]
    assert [(r["invoice_number"], r["supplier"], r["total"], r["vat"]) for r in one("invoices")] == [(odd, odd, "5.5", "1,0")]
    assert [(r["description"], r["quantity"], r["total"]) for r in one("line_items")] == [(odd, "2", "3.0")]
    again = spark.read.options(**CSV_READ_OPTIONS).csv(f"{scratch}/c/line_items").collect()
    assert [(r.description, r.unit_price) for r in again] == [(odd, "1.5")]


def test_flatten_and_union(spark):
    inv = extract_fields(spark.createDataFrame([(1, TEXT)], DOCS))
    flat = flatten_for_csv(to_record(inv)).collect()[0]
    assert flat.line_items_count == 1 and flat.confidence_total == 0.8 and flat.confidence_vat == 0.8 and flat.total == "12.0"
    a = spark.createDataFrame([(1, "x")], "doc_id bigint, description string")
    b = spark.createDataFrame([(2, 3)], "doc_id bigint, quantity int")
    u = union_item_tables(a, b).orderBy("doc_id").collect()
    assert (u[0].quantity, u[1].description) == (None, None)


def test_output_names(spark):
    paths = spark.createDataFrame([(f"/d/{c}.pdf",) for c in "qwertyuiopasdfg"], "path string").repartition(5)
    got = {r.path: r.output_name for r in output_names(paths).collect()}
    expected = {p: f"invoice_{i + 1}" for i, p in enumerate(sorted(got))}
    assert got == expected


def test_targets(spark):
    inv = extract_fields(spark.createDataFrame([(1, TEXT), (2, "x")], DOCS))
    g = to_target(inv, "GENERIC").where("doc_id = 1").collect()[0]
    assert (g.vendor, g.tax_amount, g.metadata.validation_status, g.metadata.anomaly_flags) == (
        "Shop & Co.", 2.0, "unknown", [])
    s = to_target(inv, "sap").where("doc_id = 1").collect()[0]
    assert (s.BUKRS, s.WRBTR, s.WAERS, s.XBLNR, s.BSART) == ("CompanyCode", 12.0, "USD", "A-1", "ZINV")
    o = to_target(inv, "Oracle").orderBy("doc_id").collect()
    assert o[0].description == "Invoice A-1" and o[1].description is None
    ob = outbox(inv, "sap").orderBy("doc_id").collect()
    assert ob[0].document_id == "A-1" and ob[0].label == "SAP" and ob[1].document_id is None
    sent = json.loads(ob[0].payload)
    assert sent["XBLNR"] == "A-1" and sent["WRBTR"] == 12.0 and sent["ITEMS"][0]["description"] == "widget"
    with pytest.raises(ValueError):
        target("netsuite")
    reg = TargetRegistry()
    reg.register("erp_a", target("sap"))
    assert reg.names() == ["erp_a"] and reg.get("nope") is None and "erp_a" in reg.fan_out(inv)


def test_run_and_summary(spark):
    docs = spark.createDataFrame([(1, TEXT, True), (2, "", False), (3, "Total: 1,000.00\nx  1  $,  $1.00", True)],
                                 "doc_id bigint, text string, ocr_success boolean")
    res = {r.doc_id: r for r in run_invoices(docs, as_of="2024-06-30").collect()}
    assert res[1].success and res[1].stages.validation.valid and res[1].stages.ocr.text_length == len(TEXT)
    assert not res[2].success and res[2].error == "OCR extraction failed" and res[2].stages.extraction is None
    assert res[3].success and res[3].anomaly_error is not None    # statistical mode: error kept, invoice succeeds
    s = summarize(run_invoices(docs)).collect()[0]
    assert (s.total, s.successful, s.failed) == (3, 2, 1)
    rules = run_invoices(docs, options=Options(anomaly_mode="rule_based"))
    s2 = summarize(rules).collect()[0]
    assert (s2.successful, s2.failed) == (1, 2)                   # rule mode: a non-numeric total fails
    raised = rules.where("doc_id = 3").collect()[0]
    assert raised.stages.anomaly_detection is None and raised.stages.validation is not None and raised.stages.export is None
    assert (anomaly_mode(False), anomaly_mode(True, []), anomaly_mode(True, ["rule_based"])) == (None, "statistical", "rule_based")
    assert report(run_invoices(docs)).count() == 3
    m = run_invoices(docs, as_of="2024-06-30", materialize_extracted=True)
    assert "regexp_extract_all" not in m._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.success) for r in m.collect()) == [(1, True), (2, False), (3, True)]


def test_a_failed_scan_yields_nothing(spark, scratch):
    docs = spark.createDataFrame([(1, TEXT, True), (2, TEXT, False)], DOCS + ", ocr_success boolean")
    ents = spark.createDataFrame([(2, 0, "ORG", "Ghost Ltd"), (1, 0, "ORG", "Other")], "doc_id bigint, ord int, label string, text string")
    res = run_invoices(docs, as_of="2024-06-30", entities=ents, options=Options(use_entities=True, target="oracle"))
    bad = res.where("doc_id = 2").collect()[0]
    empty = {c: getattr(bad, c) for c in res.columns if c not in ("doc_id", "ocr_success", "stages", "success", "error")}
    assert set(empty.values()) == {None} and bad.error == "OCR extraction failed"
    assert bad.stages.ocr.text_length == len(TEXT) and bad.stages.export is None and bad.stages.erp_integration is None
    good = res.where("doc_id = 1").collect()[0]
    assert good.organizations == ["Other"] and good.supplier == "Shop & Co." and good.stages.erp_integration.invoice_num == "A-1"
    export_run(res, scratch + "/x", ["json"])
    assert spark.read.text(scratch + "/x/format=json").count() == 1


def test_no_job_runs_while_a_plan_is_made(spark):
    joined = rendered_invoices(spark, SF_SMALL).join(spark.read.parquet(f"{SF_SMALL}/orders.parquet"), F.col("doc_id") == F.col("o_orderkey"))
    spark.sparkContext.setJobGroup("planning", "")
    df = run_invoices(joined.select("doc_id", "text"), as_of="2005-06-30")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == 0
    spark.sparkContext.setJobGroup("other", "")
    assert plan.count("regexp_replace(invoice_date") <= 1 and plan.count("gettimestamp") <= 7


def test_streaming_equals_batch(spark, scratch):
    src = os.path.join(scratch, "in")
    docs = rendered_invoices(spark, SF_SMALL)
    docs.write.parquet(src)
    hist = invoices(spark, SF_SMALL)
    prof = profile(hist)
    out_dir = os.path.join(scratch, "out")
    sink = parquet_batch_sink(out_dir, ["doc_id", "total", "valid", "total_anomalies", "success", "stages"])
    q = start_invoice_stream(spark, src, os.path.join(scratch, "ckpt"), sink, history_profile=prof,
                             as_of="2005-06-30", max_files_per_trigger=2)
    q.awaitTermination(300)
    streamed = spark.read.parquet(out_dir).drop("batch")
    batch = stream_chain(spark.read.parquet(src), prof, as_of="2005-06-30").select(
        "doc_id", "total", "valid", "total_anomalies", "success", "stages")
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_jvm(spark):
    inv = invoices(spark, SF_SMALL)
    det = detect_anomalies(inv, profile(inv))
    plan = _plan(det)
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "BroadcastExchange" in plan or "BroadcastNestedLoopJoin" in plan


def test_one_scan_per_field_pattern(spark):
    df = spark.createDataFrame([(1, TEXT)], DOCS)
    plan = extract_fields(df)._jdf.queryExecution().optimizedPlan().toString()
    # every search pattern scans the text once and stops at its first match; the line items are one scan
    n_patterns = sum(len(v) for v in SEARCH_PATTERNS.values())
    assert plan.count("regexp_extract(text#") == n_patterns
    assert plan.count("regexp_extract_all(text#") == 1


def test_scan_prunes_columns(spark):
    df = invoices(spark, SF_SMALL).select("doc_id", "total")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int," in plan
    assert "l_shipdate" not in plan and "o_totalprice" not in plan


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 39
    reference = {k for k in q if not k.startswith("op") and k != "pipeline"}
    assert len(reference) >= 49 and reference <= set(o)


def test_text_documents(spark, scratch):
    from quire.sources.files import read_text_documents
    for i, body in enumerate(["INVOICE # X-1\nTotal: 5.00", "nothing"]):
        open(os.path.join(scratch, f"doc{i}.txt"), "w").write(body)
    docs = read_text_documents(spark, scratch)
    inv = {os.path.basename(r.path): r for r in extract_fields(docs).collect()}
    assert inv["doc0.txt"].invoice_number == "X-1" and inv["doc1.txt"].total is None
    assert len({r.doc_id for r in inv.values()}) == 2
