"""Near-duplicates and components against brute force, with groups of edited copies around the threshold."""

import random
import re

import numpy as np
import pytest

from quire.llm.components import components
from quire.llm import neardup
from quire.llm.neardup import near_duplicates, sketch


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    ids = sorted(x for x in sets if x is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("k,percent,tile", [(3, 85, 48), (5, 80, 48), (3, 85, 5)])
def test_matches_brute_force(spark, monkeypatch, k, percent, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = random.Random(k)
    rows = []
    for g in range(4):
        base = [f"w{rng.randrange(200)}" for _ in range(120)]
        rows += [edited(rng, base, rng.randrange(0, 9)) for _ in range(40)]
    rows += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    rows += ["Same Words", "same words", "same", "same", "SAME", "same words here", "x y z", "x  Y\tz"]
    rng.shuffle(rows)
    data = list(enumerate(rows))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), k, percent).collect()}
    assert got == brute(data, k, percent)


def test_odd_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(60000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a"), (5, "A"), (None, "a"), (None, "a"), (7, long), (8, long + " end"), (9, "p q r s t u"), (9, "other words stand here now"), (10, "other words stand here now"), (11, "p q r s t u"), (11, "p q r s t u")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, kept int")
    got = near_duplicates(docs, 3, 85).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {i: by[i].component_id for i in by if i} == brute(rows, 3, 85)
    assert by[10].component_id == by[11].component_id == 9
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[None].kept and by[None].component_id is None
    assert near_duplicates(docs.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(4)
    t = 120
    for size in (1, 2, 7, 400):
        x = rng.integers(0, 2**63, size, dtype=np.uint64)
        assert (sketch(x, np.array([0, size]), t) != 2**64 - 1).all()
    gaps = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 300, dtype=np.uint64)
        s = sketch(np.concatenate([x[:270], x[30:]]), np.array([0, 270, 540]), t)
        gaps.append((s[0] == s[1]).mean() - 240 / 300)
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.06


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(600, 900)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(3, 3), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in root}
