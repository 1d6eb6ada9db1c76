"""Mixing: targets against plain water-filling, copies against their targets, and odd rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import mixing

SF = "/root/testdata/sf0.01"


def filled(size, weight, share, most):
    """Clamp and reshare until nothing is above its stop."""
    left, full = share * sum(size.values()), {}
    while True:
        open_ = {k: w for k, w in weight.items() if k not in full}
        if not open_:
            return full
        got = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        over = {k: most * size[k] for k in got if got[k] >= most * size[k]}
        if not over:
            return full | got
        full |= over
        left -= sum(over.values())


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.tuples(st.integers(0, 1000), st.integers(1, 9)), min_size=1))
def test_targets(spark, sources):
    rows = spark.createDataFrame([(k, s, float(w)) for k, (s, w) in sources.items()], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.targets(rows, 1.5, 2.0).collect()}
    want = filled({k: s for k, (s, _) in sources.items()}, {k: w for k, (_, w) in sources.items()}, 1.5, 2.0)
    assert got == pytest.approx(want, abs=1e-6)


def test_copies_come_near_their_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs)
    rows = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max("copies").alias("copies")).collect()
    assert all(abs(r.taken - r.target) <= r.most and r.copies <= 2 for r in rows)
    again = mixing.mix(docs.repartition(7)).select("doc_id", "copies")
    assert sorted(again.collect()) == sorted(got.select("doc_id", "copies").collect())
    assert mixing.repeated(got).count() == got.agg(F.sum("copies")).first()[0]


def test_weights_follow_code_points_null_last(spark):
    names = ["b", "a", "ä", "Z", None, "\U0001f600", "ﬁ"]
    got = mixing.cycled_weights(spark.createDataFrame([(n,) for n in names], "source string"), (5, 2, 1)).collect()
    order = sorted((n for n in names if n), key=lambda n: [ord(c) for c in n]) + [None]
    assert {r.source: r.weight for r in got} == {n: (5, 2, 1)[k % 3] for k, n in enumerate(order)}


def test_odd_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (None, None, None), (3, "", "t"), (4, "x " * 50000, None), (5, "y", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sum(r.source_size == 0 and r.taken == 0 for r in got) == 1
    assert len({r.copies for r in got if r.doc_id == 1}) == 1
    assert mixing.mix(docs.limit(0)).count() == 0
    given_weights = spark.createDataFrame([("s", 1.0), ("t", 1.0), (None, 1.0), ("u", 3.0)], "source string, weight double")
    assert mixing.mix(docs, given_weights).count() == len(rows)
    clash = mixing.mix(docs.withColumn("target", F.lit("old")).withColumn("weight", F.lit("kept")).withColumn("Size", F.lit(0)))
    assert clash.columns.count("target") == 1 and clash.filter("doc_id = 5").first().size == 1 and clash.first().weight == "kept"


def test_columns_named_like_internal_ones(spark):
    names = ["part", "in", "whole", "extra", "before", "_c", "_k", "_s", "_d", "_draw", "_slice", "reach", "tie_size", "slice_size", "stop", "weight", "_others", "_"]
    docs = spark.createDataFrame([(k, "x y " * k, "st"[k % 2]) for k in range(9)], "doc_id long, text string, source string")
    got = mixing.mix(docs.withColumns({n: F.lit(n) for n in names}))
    plain = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    rows = got.collect()
    assert {r.doc_id: r.copies for r in rows} == plain
    assert all(r[n] == n for r in rows for n in names)
