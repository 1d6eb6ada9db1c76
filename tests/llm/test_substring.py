"""Substring dedup against a plain window search, over several blocks and buckets, and on odd rows."""

import random
import re

import numpy as np
import pytest

from quire.llm import substring


def brute(rows, k):
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for j in range(len(w) - k + 1):
            if i is not None:
                x = tuple(w[j : j + k])
                first[x] = min(i, first.get(x, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for j in range(len(w) - k + 1) if i is not None and first[tuple(w[j : j + k])] < i for p in range(j, j + k)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    passages = [" ".join(f"p{rng.randrange(60)}" for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages).split()
            a = rng.randrange(0, 6)
            parts += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 15))] + p[a : len(p) - rng.randrange(0, 6)]
        rows.append((i, " ".join(parts)))
    rows += [(200 + k, rows[k][1]) for k in range(10)] + [(300, "a b " * 60), (301, "b a " * 50), (302, "z " * 100)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,bucket,k,m", [(10**9, 10**9, 13, 5), (3000, 5000, 13, 5), (3000, 2000, 7, 3)])
def test_matches_window_search(spark, monkeypatch, block, bucket, k, m):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring, "BUCKET_BYTES", bucket)
    rows = corpus(block + k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in substring.without_repeats(docs, k, m).collect()), key=str)
    assert got == brute(rows, k)


def test_spans_point_at_equal_words(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 3000)
    rows = corpus(9)
    text = {i: t.split() for i, t in rows}
    spans = substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert spans
    for r in spans:
        n = r.end - r.start
        assert n >= 13 and r.source_doc < r.doc_id
        assert text[r.doc_id][r.start : r.end] == text[r.source_doc][r.source_start : r.source_start + n]


def test_odd_rows(spark):
    p = " ".join(f"w{k}" for k in range(20))
    rows = [(1, p), (2, "x " + p), (2, p + " y"), (2, p + " y"), (None, p), (None, None), (4, None), (5, ""), (6, p + " " + p), (7, (p + " z ") * 3000), (8, "few words")]
    docs = spark.createDataFrame([(*r, "block", 1) for r in rows], "doc_id long, text string, block string, kept int")
    got = sorted((tuple(r) for r in substring.without_repeats(docs).collect()), key=str)
    assert got == brute(rows, 13)
    assert substring.without_repeats(docs.limit(0)).count() == 0


def test_hashes_do_not_depend_on_the_stretch(monkeypatch):
    from quire.llm import textkit

    data = np.frombuffer(("ab c " * 500 + "x" * 900 + " ab c").encode(), np.uint8)
    off = np.array([0, len(data)])
    want = textkit.Words(data, off).hashes()
    monkeypatch.setattr(textkit, "_STRETCH", 64)
    got = textkit.Words(data, off).hashes()
    assert (want == got).all() and len(set(want.tolist())) == 3
