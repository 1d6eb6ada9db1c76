"""Files that are no text, folders that fill up, and tables laid out by document."""

import os

from pyspark.sql import functions as F

from quire.operators.extract import extract_fields, merge_entities
from quire.plans.catalog_files import by_document
from quire.plans.run import run_invoices, summarize
from quire.sinks.layout import lay_out
from quire.sources.binary import checked_texts, read_checked_documents
from quire.sources.files import assemble_pages
from quire.streaming.folder import PAGE_SCHEMA, newest, start_folder_stream, start_page_stream
from quire.streaming.stream import parquet_batch_sink

TEXT = "INVOICE # A-{}\nFrom: Shop & Co.\nDate: 05/03/2024\nwidget  2  $5.00  $10.00\nTotal: 12.00\nVAT: 2.00\nSubtotal: 10.00"


def _put(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, content in files.items():
        with open(os.path.join(folder, name.replace("_", ".")), "wb") as f:
            f.write(content)


def test_checked_files(spark, scratch):
    good = TEXT.format(1).encode()
    _put(scratch, a_txt=good, b_txt=b"Total: \xff\xfe", c_txt=b"", d_txt=good + b" " * 400, e_pdf=good, f_txt="Total: 1.00 é".encode(), g_txt="é".encode()[:1])
    docs = read_checked_documents(spark, scratch, max_bytes=300)
    got = {os.path.basename(r.path): r for r in docs.collect()}
    assert sorted(got) == ["a.txt", "b.txt", "d.txt", "f.txt", "g.txt"]  # a scan leaves out files of no bytes
    assert {n for n, r in got.items() if r.ocr_success} == {"a.txt", "f.txt"}
    assert got["a.txt"].text == good.decode() and got["f.txt"].text.endswith("é")
    assert got["b.txt"].text is None and got["b.txt"].ocr_error == got["g.txt"].ocr_error == "not valid UTF-8"
    assert got["d.txt"].ocr_error == f"larger than 300 bytes: {len(good) + 400}" and got["d.txt"].text is None
    assert all(r.doc_id == r.path for r in got.values())
    run = run_invoices(docs)
    assert tuple(summarize(run).first()) == (5, 2, 3)
    row = {os.path.basename(r.path): r for r in run.collect()}
    assert row["a.txt"].invoice_number == "A-1" and row["b.txt"].error == "OCR extraction failed" and row["b.txt"].invoice_number is None
    assert row["b.txt"].stages.ocr.text_length == 0 and row["b.txt"].stages.validation is None


def test_large_files_are_not_read(spark, scratch):
    """The limit reaches both scans, and the one of the large files does not read their content."""
    _put(scratch, a_txt=b"x" * 50, b_txt=b"x" * 500)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")  # reading a longer content fails
    try:
        got = sorted((r.text, r.ocr_success) if r.ocr_success else ("", False) for r in read_checked_documents(spark, scratch, max_bytes=100).collect())
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == [("", False), ("x" * 50, True)]


def test_bytes_of_any_table(spark):
    rows = [(1, b"abc", 3), (2, None, 3), (3, b"abc", None), (4, None, None), (5, b"\xed\xa0\x80", 3), (6, b"", 0), (7, b"abcdef", 6)]
    got = {r.k: (r.text, r.ocr_success, r.ocr_error) for r in checked_texts(spark.createDataFrame(rows, "k int, content binary, length long"), 5).collect()}
    assert got[1] == got[3] == ("abc", True, None) and got[6] == ("", True, None)
    assert got[2] == got[4] == (None, False, "no content") and got[5] == (None, False, "not valid UTF-8") and got[7] == (None, False, "larger than 5 bytes: 6")
    assert checked_texts(spark.createDataFrame([], "k int, content binary, length long")).count() == 0


def test_folder_stream_takes_new_files_once(spark, scratch):
    folder, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    _put(folder, a_txt=TEXT.format(1).encode(), b_txt=b"\xff", c_pdf=b"%PDF")

    def run():
        start_folder_stream(spark, folder, os.path.join(scratch, "checkpoint"), parquet_batch_sink(out, ["doc_id", "invoice_number", "success", "error"]),
                            max_bytes=1000, max_files_per_trigger=1).awaitTermination()
        return sorted((os.path.basename(r.doc_id), r.invoice_number, r.success, r.error) for r in spark.read.parquet(out).collect())

    failed = "OCR extraction failed"
    assert run() == [("a.txt", "A-1", True, None), ("b.txt", None, False, failed)]
    _put(folder, d_txt=TEXT.format(2).encode(), e_txt=b"x" * 2000)
    want = [("a.txt", "A-1", True, None), ("b.txt", None, False, failed), ("d.txt", "A-2", True, None), ("e.txt", None, False, failed)]
    assert run() == want
    assert run() == want  # nothing new


def test_pages_that_arrive_late(spark, scratch):
    rows = [(d, p, f"text {d} {p}", (d + p) % 5 != 0) for d in range(12) for p in range(1, 2 + d % 4)]
    pages = os.path.join(scratch, "pages")
    for part in (rows[::3], rows[1::3], [r for r in rows[2::3] if r[0] != 11]):
        spark.createDataFrame(part, PAGE_SCHEMA).write.mode("append").parquet(pages)
        start_page_stream(spark, pages, os.path.join(scratch, "checkpoint"), os.path.join(scratch, "out")).awaitTermination()
    got = sorted(tuple(r) for r in newest(spark, os.path.join(scratch, "out")).collect())
    assert got == sorted(tuple(r) for r in assemble_pages(spark.read.schema(PAGE_SCHEMA).parquet(pages)).collect())
    last = spark.read.parquet(os.path.join(scratch, "out")).agg(F.max("batch")).first()[0]
    touched = {r.doc_id for r in spark.read.parquet(os.path.join(scratch, f"out/batch={last}")).collect()}
    assert touched == {r[0] for r in rows[2::3] if r[0] != 11}  # a batch writes the documents it has touched


def test_joins_of_laid_out_tables_move_nothing(spark, scratch):
    docs = spark.createDataFrame([(i, TEXT.format(i) if i % 3 else "Total: 5.00") for i in range(40)], "doc_id bigint, text string")
    ents = spark.createDataFrame([(i, o, "ORG", f"Org {i} {o}") for i in range(0, 40, 2) for o in (1, 0)], "doc_id bigint, ord int, label string, text string")
    inv = extract_fields(docs)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        t = lay_out(inv, os.path.join(scratch, "tables"), 4, ents)
        joined = by_document(t)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        got = {r.doc_id: r for r in joined.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {r.doc_id: r for r in merge_entities(inv, ents, with_lists=True).collect()}
    assert len(got) == 40 and all(got[i].supplier == want[i].supplier and got[i].organizations == "|".join(want[i].organizations) for i in want)
    assert got[0].supplier == "Org 0 0" and got[1].n_items == 1 and got[1].quantity == "2" and got[1].cents == 1000 and got[3].n_items == 0
