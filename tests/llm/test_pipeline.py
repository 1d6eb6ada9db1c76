"""The pipeline stage by stage on the given documents: each stage against what it must keep, drop or change."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quire.llm.shared import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:5])
    assert steps[5].columns[: len(steps[0].columns)] == steps[0].columns


def test_language_id_keeps_clean_documents(steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert set(after) <= set(before) and len(after) > 0.97 * len(before)
    assert all(re.search(r"[^\W\d_]", r.text) for r in after.values())


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def test_one_of_each_group_stays(steps):
    before, after = rows(steps[1]), rows(steps[2])
    sets = {i: shingles(r.text) for i, r in before.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) and 100 * len(s & t) >= 80 * len(s | t):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert set(after) == {i for i in ids if find(i) == i}


def test_contaminated_documents_go(spark, steps):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(t):
        return word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        wins |= {tuple(w[j : j + 10]) for j in range(len(w) - 9)}
    before, after = rows(steps[2]), rows(steps[3])
    hit = {i for i, r in before.items() for w in [words(r.text)] if any(tuple(w[j : j + 10]) in wins for j in range(len(w) - 9))}
    assert hit and set(after) == set(before) - hit


def test_personal_data_is_replaced(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(after) == set(before)
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert not any(mail.search(r.text) for r in after.values())
    assert all(r.text == before[i].text or "[" in r.text for i, r in after.items())
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_mix(steps):
    before, after = rows(steps[4]), steps[5].groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("c"), F.first("copies").alias("copies")).collect()
    assert {r.doc_id for r in after} <= set(before) and all(r.n == r.c == r.copies <= 2 for r in after)
    for r in steps[5].groupBy("source").agg(F.sum("size").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most


def test_run_is_the_stages(spark, steps):
    got = cp.run(spark, SF).select("doc_id", "copy", "text").collect()
    assert sorted(got) == sorted(steps[5].select("doc_id", "copy", "text").collect())


def test_odd_rows(spark, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    text = "le chat est sur la table et la maison avec le chien " * 4
    rows = [(1, text, "fr", "s", 5, "x"), (1, text, "fr", "s", 5, "x"), (2, None, None, None, None, None), (None, text + "un autre", "fr", None, 3, "y"), (4, "", "en", "s", 0, "z"), (5, "mail a@b.co " + text, "fr", "t", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").withColumn("score", F.lit(1)).withColumn("found", F.lit(2)).withColumn("size", F.lit(7))
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in cp.STAGES:
            now = written(stage(spark, now, str(tmp_path)), f"odd-{name}")
            if name != "mix":
                assert now.columns == docs.columns
        texts = {r.text for r in now.collect()}
        assert all("a@b.co" not in t for t in texts)


def test_near_dedup_keeps_one_row_of_repeats_and_links_rows_without_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a, "x"), (5, a, "x"), (5, a, "y"), (None, a, "z"), (7, a + " more", "x"), (None, b, "x"), (None, b, "x"), (None, b + " tail", "q"), (9, c, None), (10, "", None), (10, "", None), (11, "", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({n: F.lit(n) for n in ("key", "hash", "row", "none", "at0", "n", "_")})
    got = cp.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text, r.lang) for r in got.collect()]
    b_rows = [r for r in kept if r[1] and r[1].startswith("b0")]
    assert [r for r in kept if r not in b_rows and r[1]] in ([(5, a, "x"), (9, c, None)], [(9, c, None), (5, a, "x")])
    assert len(b_rows) == 1 and b_rows[0][0] is None
    assert sorted(str(r[0]) for r in kept if not r[1]) == ["10", "11", "None"]
    assert all(r.key == "key" and r.at0 == "at0" for r in got.collect())
