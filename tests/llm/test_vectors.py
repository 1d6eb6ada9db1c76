"""op11 and op12 against brute force: rows that repeat, tie, lie in clusters, and rows that take no part."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hard_negatives, inner_products
from quire.llm.vectors import Best, products, quantised

SCHEMA = "vec_id long, embedding array<float>, label int, v int, score string, data string"


def rows_of(seed: int, n: int, dim: int = 6) -> list[tuple]:
    """Clusters, copies, zero and short vectors, ids that repeat, and rows with nulls and values that are not finite."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = []
    for i in range(n):
        x = centres[i % 4] * rng.choice([0.2, 1, 3]) + rng.normal(size=dim) * rng.choice([0.01, 0.5]) if i % 3 else rng.normal(size=dim)
        rows.append((i, [float(np.float32(t)) for t in x], int(rng.integers(0, 3))))
    rows += [(n, rows[1][1], 1), (n + 1, rows[1][1], 1), (n + 2, [0.0] * dim, 0), (n + 3, rows[2][1][:2], 2), (n + 4, [], 1)]
    rows += [rows[5], rows[20], (20, rows[7][1], 2), (40, [9.0] * dim, 0)]
    rows += [(None, [1.0] * dim, 1), (1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")], 1), (1003, [float("inf")], 0), (1100, [float("-inf")], None), (1200, [1.0] * dim, None)]
    return [(*r, 1, "x", "y") for r in rows]


def whole(rows: list[tuple], factor: int) -> list[tuple[int, list[int], int]]:
    fine = [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], [math.floor(factor * x) for x in r[1]], r[2]) for r in fine]


def dot(a: list[int], b: list[int]) -> int:
    return sum(x * y for x, y in zip(a, b, strict=False))


def queries_of(rows: list[tuple], every: int, least) -> dict:
    out: dict = {}
    for r in rows:
        if r[0] % every == 0:
            out[r[0]] = min(out.get(r[0], least(r)), least(r))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_is_exact(spark, seed):
    rows = rows_of(seed, 300)
    data = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = inner_products.top_k(quantised(data.select("vec_id", "embedding"), 64), F.col("vec_id") % 20 == 0, 7).collect()
    all_rows = whole(rows, 64)
    expected = []
    for q, v in queries_of(all_rows, 20, lambda r: r[1]).items():
        best = sorted((-dot(v, c), i) for i, c, _ in all_rows if i != q)[:7]
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_top_k_with_few_candidates_and_none(spark):
    data = spark.createDataFrame([(20, [1.0, 2.0]), (21, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = inner_products.top_k(quantised(data, 64), F.col("vec_id") % 20 == 0, 20).collect()
    assert [tuple(r) for r in got] == [(20, 1, 21, 64 * 32 + 128 * 32)]
    for none in (data.filter("vec_id = 20"), data.filter("false")):
        assert inner_products.top_k(quantised(none, 64), F.col("vec_id") % 20 == 0, 20).collect() == []


@pytest.mark.parametrize("seed", [3, 4])
def test_hard_negatives_are_exact(spark, seed):
    rows = rows_of(seed, 300)
    data = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives.mine(quantised(data.select("vec_id", "embedding", "label"), 256), F.col("vec_id") % 20 == 0).collect()
    all_rows = [r for r in whole(rows, 256) if r[2] is not None]
    expected = []
    for a, (label, v) in queries_of(all_rows, 20, lambda r: (r[2], r[1])).items():
        scored = sorted((-dot(v, c), i, other) for i, c, other in all_rows if i != a)
        for s, positive, _ in [x for x in scored if x[2] == label][:5]:
            window = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            expected += [(a, positive, rank, i, -s, -n) for rank, (n, i, _) in enumerate(window, 1)]
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert len(expected) > 50


def test_hard_negatives_of_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(quantised(none, 256), F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_touch(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = hard_negatives.hilbert(grid, bits)
    assert sorted(place) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_zone_bounds_hold_every_score_and_skip_far_blocks():
    rng = np.random.default_rng(0)
    anchors = rng.integers(-300, 300, (40, 8))
    block = rng.integers(-50, 50, (100, 8)) + 200
    least, greatest = hard_negatives.bounds(anchors, block.min(0)[None], block.max(0)[None])
    scores = products(anchors, block)
    assert (least[:, 0] <= scores.min(1)).all() and (scores.max(1) <= greatest[:, 0]).all()
    assert (greatest[:, 0] < 0).any() and (least[:, 0] > 0).any()


def test_bounds_of_partial_sums_drop_only_what_cannot_reach():
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(50, 8)) * [8, 4, 2, 1, 1, 1, 1, 1], rng.normal(size=(200, 8)) * [8, 4, 2, 1, 1, 1, 1, 1]
    cuts = [0, 2, 4, 6]
    floor = np.full(50, 120.0)
    kept_q, kept_c = inner_products.survivors(q, c, inner_products._suffix(q, cuts), inner_products._suffix(c, cuts), cuts, floor)
    i, j = np.nonzero(q @ c.T >= 120)
    assert set(i) <= set(kept_q) and set(j) <= set(kept_c)
    assert len(kept_q) < 50 and len(kept_c) < 200


def test_large_components_are_exact_or_an_error():
    a = np.array([[2**40, 3, -(2**20)]])
    assert products(a, np.array([[2**20, 5, 7]]))[0, 0] == 2**60 + 15 - 7 * 2**20
    with pytest.raises(OverflowError):
        products(a, np.array([[2**40, 0, 0]]))


def test_short_lists_keep_the_best_and_smaller_ids():
    best = Best(2, 2)
    best.add_rows(np.array([0, 1]), np.array([[5, 7, 7, 1], [1, 1, 1, 1]]), np.array([4, 9, 3, 1]))
    best.add_rows(np.array([1]), np.array([[1, 2]]), np.array([0, 8]))
    assert list(zip(best.key, best.score, best.id, strict=True)) == [(0, 7, 3), (0, 7, 9), (1, 2, 8), (1, 1, 0)]
