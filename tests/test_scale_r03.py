"""Round 3: joins and descents that do not grow with what they need not, and searches of ASCII texts."""

import datetime
import os
import random

from pyspark.sql import functions as F

from quire.functions import dates
from quire.functions import patterns as P
from quire.functions import stage
from quire.operators import history
from quire.operators import validate as validate_module
from quire.operators.extract import extract_fields, merge_entities
from quire.operators.history import profile_as_of
from quire.plans import catalog, catalog_files, catalog_records
from quire.sinks import writers


def _orders(spark, scratch, n=300):
    rows = [(k, 10 + k % 7) for k in range(1, n)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(os.path.join(scratch, "orders.parquet"))
    return scratch


def test_record_defaults_send_no_table_through_the_driver(spark, scratch):
    df = catalog_records.i_record_defaults(spark, _orders(spark, scratch))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert df.count() == 299


def test_small_keys_skip_the_levels_of_large_ones(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("hot", day, float(rng.randrange(1, 1000))) for day in range(40) for _ in range(60)]
    rows += [(f"c{k}", day, float(rng.randrange(1, 1000))) for k in range(400) for day in range(3)]
    h = spark.createDataFrame(rows, "k string, n int, total double").select("k", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("day"), "total", F.lit(1.0).alias("vat"))
    written = []
    real = stage.materialize

    def counted(df, name="table"):
        out = real(df, name)
        if name == "descent":
            written.append(out.count())
        return out

    monkeypatch.setattr(history, "materialize", counted)
    got = {(r["k"], r["day"].toordinal()): (r["q1_total"], r["q3_total"]) for r in profile_as_of(h, h, ["k"], "day").collect()}
    import numpy as np
    first = min(d for _, d in got)
    for (k, d), (q1, q3) in got.items():
        before = [t for kk, n, t in rows if kk == k and first + n < d]
        assert (q1, q3) == ((None, None) if not before else tuple(float(np.percentile(before, p)) for p in (25, 75)))
    # 39 days of one large key at every level; 800 days of small keys (4 ranks each) at the last level or two, and not at all of them
    assert len(written) > 2 and sum(written) < len(written) * 39 * 4 + 1.5 * 800 * 4


def test_ascii_and_other_texts_are_searched_alike(spark):
    words = ["invoice", "INV", "Date", "from", "Vendor:", "total", "VAT", "tax", "Subtotal", "sub-total", "amount due", "3/4/2024", "5 May 2024", "widget", "1,2.5", "$7", "9", ",", "#A-1", ":", "& Co."]
    gaps = ["", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x1f ", "\x0b", " \n", "$"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 12))) for _ in range(30_000)]
    # the mark at the end keeps a text from being ASCII and is in no pattern; it is set apart by a letter, which no group's end can take
    both = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    marked = both.withColumn("text", F.concat("text", F.lit("\n%"), F.lit("§")))
    plain = both.withColumn("text", F.concat("text", F.lit("\n%"), F.lit("!")))
    cols = ["doc_id", "invoice_number", "invoice_date", "supplier", "total_raw", "vat_raw", "subtotal_raw", "total", F.to_json("line_items").alias("items")]
    a, b = extract_fields(plain).select(*cols), extract_fields(marked).select(*cols)
    assert a.exceptAll(b).count() == 0 and a.where("total_raw IS NOT NULL").count() > 1000
    plan = extract_fields(plain)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(_plain#") == sum(map(len, P.SEARCH_PATTERNS.values())) and plan.count("regexp_extract_all(_plain#") == 1


def test_each_search_of_a_whole_group_is_one_match(spark):
    docs = spark.createDataFrame([(1, "INVOICE # A-1\nTotal: $5.00")], "doc_id long, text string")
    plan = extract_fields(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(_hit0_total_raw" not in plan


def test_items_of_ascii_texts_look_for_no_other_digits_or_spaces(spark):
    plan = extract_fields(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan
    text = "Qty\n\x1c widget one \x1f 2  $1,000.50  $2,001\nbolt\x0b 3 , 4.\n 7 8 9\nend  99999999999999999999999999999999999999  1  2\n"
    docs = spark.createDataFrame([(1, text), (2, text + "§")], "doc_id long, text string")
    a, b = (r["x"] for r in extract_fields(docs).withColumn("x", F.to_json("line_items")).select("x", "items_ok").collect())
    assert a == b
    kept = extract_fields(docs.withColumn("text", F.replace("text", F.lit(" , "), F.lit(" 5 ")))).select("line_items").collect()
    got = [[tuple(x) for x in r["line_items"]] for r in kept]
    assert got[0] == got[1] and [(x[1], int(x[2]), x[3], x[4]) for x in got[0]] == [
        ("Qty\n\x1c widget one", 2, 1000.5, 2001.0), ("bolt", 3, 5.0, 4.0), ("", 7, 8.0, 9.0), ("end", 99999999999999999999999999999999999999, 1.0, 2.0)]


def test_items_without_findings_are_not_spread_out(spark):
    rows = [(1, [("a", 2, 1.5, 3.0)]), (2, [("a", 2, 1.5, 3.5), ("b", 1, 1.0, 1.0)]), (3, [("a", 1, 1.0, 1.0), (None, None, 2.0, 3.0)]), (4, []), (5, None), (6, [None]),
            (7, [("a", 2, float("nan"), 3.0)])]
    docs = spark.createDataFrame(rows, "doc_id long, line_items array<struct<description:string,quantity:long,unit_price:double,total:double>>")
    found = validate_module.item_findings("line_items")
    got = {r["doc_id"]: [(f["code"], f["item_no"], f["field"]) for f in r["f"]] for r in docs.select("doc_id", found.alias("f")).collect()}
    missing = [("item_field_missing", 1, k) for k in ("description", "quantity", "unit_price", "total")]
    assert got == {1: [], 2: [("item_total_mismatch", 1, "total")], 3: [("item_field_missing", 2, "description"), ("item_field_missing", 2, "quantity")], 4: [], 5: [], 6: missing, 7: []}
    assert "exists" in docs.select(found)._jdf.queryExecution().optimizedPlan().toString()


def test_a_day_is_not_tried_as_a_month(spark):
    texts = [f"{a}{sep}{b}{sep}2004" for sep in "/-" for a in ("0", "00", "1", "01", "9", "12", "13", "29", "30", "31", "32", "99") for b in ("0", "2", "02", "11", "12", "13", "31", "40")]
    texts += ["1 /2/2004", "1 Feb 2004", "31  Feb\t2004", "3 March 2004", "0000-1-1", "1/1/0000", "10000-1-1", "2004-13-1", "2004-2-29"]
    docs = spark.createDataFrame([(t,) for t in texts], "invoice_date string")
    def read(t):
        for fmt in ("%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d", "%d-%m-%Y", "%m-%d-%Y", "%d %b %Y", "%d %B %Y"):
            try:
                return datetime.datetime.strptime(t, fmt).date()
            except ValueError:
                pass

    df = dates.with_parsed_date(docs)
    got = {r[0]: r[1] for r in df.select("invoice_date", "invoice_date_parsed").collect()}
    assert got == {t: read(t) for t in texts}
    assert "^(?:0?[1-9]|1[0-2])/" in df._jdf.queryExecution().optimizedPlan().toString()


def test_published_invoices_are_written_once_before_their_formats(spark, scratch, monkeypatch):
    tables = {"orders": [(k, 5, datetime.datetime(2001, 2, 3)) for k in range(1, 20)], "part": [(1, "blue bolt")],
              "lineitem": [(k, 1, 1, n, 2.0, 10.0 * n) for k in range(1, 20) for n in range(1, 3)]}
    for name, schema in (("orders", "o_orderkey long, o_custkey long, o_orderdate timestamp"), ("part", "p_partkey long, p_name string"),
                         ("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double")):
        spark.createDataFrame(tables[name], schema).write.parquet(os.path.join(scratch, f"{name}.parquet"))
    written, real = [], stage.materialize

    def counted(df, name="table"):
        written.append(name)
        return real(df, name)

    for module in (writers, catalog):
        monkeypatch.setattr(module, "materialize", counted)
    got = {r["what"]: (r["outcome"], r["n"]) for r in catalog_files.x_formats(spark, scratch).collect()}
    assert written == ["records"] and got["json"] == got["csv"] == ("written", 19) and got["csv items"] == ("written", 38) and got["csv again"] == ("has been published", None)


def test_entities_in_order_of_nulls_and_ties(spark):
    ents = spark.createDataFrame([(1, 2, "ORG", "b"), (1, None, "ORG", "z"), (1, 2, "ORG", "a"), (1, 2, "ORG", None), (1, 0, "DATE", "d"), (2, 1, "MONEY", "m")], "doc_id long, ord int, label string, text string")
    inv = spark.createDataFrame([(1, None), (2, "s"), (3, None)], "doc_id long, supplier string")
    merged = merge_entities(inv, ents, with_lists=True)
    assert "lambdafunction" not in merged._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: (r["organizations"], r["dates"], r["money"]) for r in merged.collect()}
    assert got == {1: (["z", None, "a", "b"], ["d"], []), 2: ([], [], ["m"]), 3: ([], [], [])}
