"""Quality rules: counts against plain Python, sketches against exact quartiles, labels, and odd rows."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import quality_rules as qr

SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = collections.Counter(wins)
    hit = {p for k, x in enumerate(wins) if n[x] > 1 for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)


def test_counts(spark):
    rng = random.Random(3)
    texts = [None, "", "\n\n", "a\n\na\n a\na ", "ab cd " * 30, "Ä#ö * |\x0b\x0cx", " ".join("abcdefgh") * 2, "w " * 40000]
    texts += ["".join(rng.choice(["a", "b", "c", " ", "\n", "é", "#"]) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, extra string")
    for r in qr.measure(docs).collect():
        assert tuple(r[c] for c in qr.COUNTS) == counts(texts[r.doc_id]), texts[r.doc_id]


def test_sketch_quartiles(spark):
    measured = qr.measure(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source"))
    got = {(r.lang, r.measure): r for r in qr.quartiles(qr.merge(qr.sketches(measured), ["lang"]), ["lang"]).collect()}
    for lang, in measured.select("lang").distinct().collect():
        values = sorted(r[0] for r in measured.filter(F.col("lang") == lang).select(F.col("word_chars") / F.col("n_words")).collect())
        for name, q in (("q1", 0.25), ("q3", 0.75)):
            assert got[lang, "word_length"][name] == pytest.approx(values[int(q * (len(values) - 1))], rel=0.0101)


def test_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = qr.op2(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.99
    assert sum(not r.kept for r in bad) / len(bad) > 0.9


def test_odd_rows(spark):
    rows = [(k, "some plain words of a text " * 5 + str(k), "en", None) for k in range(9)] + [(20, None, None, "s"), (20, None, None, "s"), (None, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = qr.apply_rules(docs).collect()
    assert len(got) == 12 and sum(r.base_failed for r in got) == 12
    assert qr.apply_rules(docs.limit(0)).count() == 0
    clash = qr.apply_rules(docs.withColumn("Kept", F.lit("old")).withColumn("n_words", F.lit("old")).withColumn("high_word_length", F.lit("x")))
    assert sorted(r.kept for r in clash.collect()) == sorted(r.kept for r in got) and "high_word_length" in clash.columns
