"""LM scoring: the lattice against all segmentations, counts and sums against plain Python, and odd rows."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import lm_score
from quire.llm.lattice import Lattice, Pieces, batches

SF = "/root/testdata/sf0.001"


def segmentations(word, names):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in names:
            for rest in segmentations(word[n:], names):
                yield (word[:n], *rest)


def test_lattice_sums_all_segmentations():
    rng = random.Random(1)
    names = {bytes([b]) for b in b" abc"} | {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 5))) for _ in range(25)} | {b" a", b" ab"}
    pieces = Pieces({x: rng.uniform(-5, 0) for x in names})
    weight = dict(zip(pieces.names, pieces.start, strict=True))
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 8))) for _ in range(60)]
    count = np.array([rng.randrange(1, 5) for _ in words], float)
    got, use = np.empty(len(words)), np.zeros(len(names))
    for own, data, off in batches(pa.array(words), 40):
        lattice = Lattice(data, off, pieces)
        got[own] = lattice.probability(pieces.start)
        use += lattice.expected(pieces.start, count[own])
    want = collections.Counter()
    for w, c, g in zip(words, count, got, strict=True):
        each = {s: math.exp(sum(weight[x] for x in s)) for s in segmentations(b" " + w.encode(), names)}
        assert g == pytest.approx(math.log(sum(each.values())))
        for s, v in each.items():
            for x in s:
                want[x] += c * v / sum(each.values())
    assert use == pytest.approx([want[x] for x in pieces.names])


def test_scores_against_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 50_000)
    docs = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    low = {i: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split() for i, t in docs.items()}
    train = collections.Counter()
    for i, w in low.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*w, b""])
    n, v = sum(train.values()), len(train)
    rows = lm_score.op7(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        tokens = [*low[r.doc_id], b""]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
        assert r.score < 0
    # the lattice knows the corpus: held-out texts are likelier than the same letters shuffled
    rng = random.Random(0)
    held = [(r.doc_id, docs[r.doc_id]) for r in rows if r.held_out and len(docs[r.doc_id]) > 200][:10]
    both = [(2 * i, t) for i, t in held] + [(2 * i + 1, " ".join("".join(rng.sample(w, len(w))) for w in t.split())) for i, t in held]
    frame = spark.createDataFrame([(-i - 1, t, False) for i, t in both] + [(i, t, True) for i, t in docs.items()], "doc_id long, text string, train boolean")
    by = {r.doc_id: r.score for r in lm_score.score(frame, F.col("train")).filter("doc_id < 0").collect()}
    assert all(by[-2 * i - 1] > by[-2 * i - 2] for i, _ in held)


def test_odd_rows(spark):
    rows = [(1, "a b A"), (1, "a b A"), (2, None), (3, ""), (None, "é \U0001f600 b"), (5, "x" * 3000 + " b"), (6, "a " * 70000)]
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")
    got = lm_score.score(docs, F.col("doc_id") != 6).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 4, 4, 4, 70001]
    by = {r.doc_id: r for r in got}
    assert by[2].score == by[3].score and by[6].held_out and not by[None].held_out and by[6].n_known == 70001
    assert by[2].train_tokens == 4 + 4 + 1 + 1 + 4 + 3
    assert all(np.isfinite(r.score) for r in got)
    assert lm_score.score(docs.limit(0), F.lit(True)).count() == 0
    assert {r.train_tokens for r in lm_score.score(docs, F.lit(False)).collect()} == {0}
