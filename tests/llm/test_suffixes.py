"""Suffix-array dedup against a plain window search, over several blocks, buckets and range partitions."""

import random

import pytest
from test_substring import brute

from quire.llm import substring, suffixes


def corpus(seed, k, n=150):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(500)}" for _ in range(rng.randrange(k, 4 * k))] for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            p = list(rng.choice(passages[: 2 if rng.random() < 0.6 else 8]))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edited"
            parts += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 25))] + p
        rows.append((i, " ".join(parts)))
    rows += [(n + x, rows[x][1]) for x in range(8)] + [(n + 20, "a b " * 3 * k), (n + 21, "b a " * 3 * k), (n + 22, "z " * 4 * k), (n + 23, "z " * 2 * k)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,bucket,k,m", [(10**9, 10**9, 50, 8), (9000, 9000, 50, 8), (4000, 2000, 20, 5)])
def test_matches_window_search(spark, monkeypatch, block, bucket, k, m):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(suffixes, "PART_BYTES", bucket)
    rows = corpus(k + bucket % 97, k)
    got = sorted((tuple(r) for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), k, m).collect()), key=str)
    want = brute(rows, k)
    assert got == want and sum(w[2] for w in want) > 1000


def test_odd_rows(spark):
    p = " ".join(f"w{x}" for x in range(70))
    rows = [(1, p), (2, "x " + p), (2, p + " y"), (2, p + " y"), (None, p), (None, None), (4, None), (5, ""), (6, p + " " + p), (7, (p + " z ") * 900), (8, "few words")]
    docs = spark.createDataFrame([(*r, "seed", 1) for r in rows], "doc_id long, text string, seed string, left int")
    got = sorted((tuple(r) for r in suffixes.without_repeats(docs).collect()), key=str)
    assert got == brute(rows, 50)
    assert suffixes.without_repeats(docs.limit(0)).count() == 0
