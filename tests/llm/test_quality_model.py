"""Quality classifier: held-out accuracy, the isotonic fit against brute force, and odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import quality_model as qm

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = qm.op3(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = got.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    bad = [r for r in held if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.8
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.filter((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull()).count() == 0


def test_isotonic_is_the_nearest_rising_fit():
    rng = np.random.default_rng(1)
    grid = np.linspace(0, 1, 6)
    for _ in range(20):
        n, p = rng.integers(1, 6, 5).astype(float), rng.choice(grid, 5)
        fit = qm.isotonic(n, n * p)
        assert (np.diff(fit) >= -1e-12).all()
        cost = (n * (fit - p) ** 2).sum()
        best = min((n * (np.array(v) - p) ** 2).sum() for v in itertools.combinations_with_replacement(np.linspace(0, 1, 21), 5))
        assert cost <= best + 1e-9


def test_statistics_of_one_text():
    text = "Ab ab ab!\nx | y\nx | y".encode()
    row = dict(zip(qm.NAMES, qm.measures(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0], strict=True))
    assert row["log_words"] == pytest.approx(np.log1p(9))
    assert row["distinct_words"] == pytest.approx(6 / 9) and row["repeated_lines"] == pytest.approx(1 / 3)
    assert row["bars"] == pytest.approx(2 / len(text)) and row["upper"] == pytest.approx(1 / 10)


def test_odd_rows(spark):
    good, bad = "plain words follow one another here", "*** $$$ *** $$$"
    docs = spark.createDataFrame([(k, (good if k % 2 else bad) + f" {k}", k) for k in range(40)] + [(50, None, 1), (51, "", 1), (None, good, 1), (52, "w " * 60000, 1), (52, "w " * 60000, 1)], "doc_id long, text string, score int")
    stats = qm.statistics(docs)
    labels = spark.createDataFrame([(k, k % 2, k % 4 > 1) for k in range(40)], "doc_id long, label int, calibrate boolean")
    model = qm.fit(stats.join(labels, "doc_id"))
    got = qm.score(stats, model).collect()
    assert len(got) == 45 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] > 0.9 > 0.1 > by[2]
    assert qm.score(stats.limit(0), model).count() == 0
    assert qm.fit(stats.join(labels.limit(0), "doc_id")) is None
    assert {r.score for r in qm.score(stats, None).collect()} == {0.5}


def test_cosines_are_a_gaussian_kernel_and_the_fit_is_ridge(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, len(qm.NAMES))) * rng.uniform(0.1, 3, len(qm.NAMES)) + 1
    label, held = (x[:, 0] + x[:, 3] > 2).astype(int), np.arange(60) % 4 == 0
    rows = [([float(v) for v in r], int(y), bool(h)) for r, y, h in zip(x, label, held, strict=True)]
    labelled = spark.createDataFrame(rows, "stats array<double>, label int, calibrate boolean").repartition(5)
    model = qm.fit(labelled, features=24, width=4.0, ridge=0.01, bins=64)
    train = x[~held]
    mean, scale = train.mean(axis=0), train.std(axis=0)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    # ridge as least squares over rows of its own, not as normal equations
    z = model.cosines(train)
    grown = np.vstack([z, np.sqrt(0.01 * len(train)) * np.eye(25)[:24]])
    weight = np.linalg.lstsq(grown, np.append(label[~held].astype(float), np.zeros(24)), rcond=None)[0]
    assert np.allclose(model.cosines(x) @ model.weight, model.cosines(x) @ weight, atol=1e-5)
    # products of many cosines are the kernel
    many = qm.Model(mean, scale, rng.standard_normal((len(qm.NAMES), 40000)) / 4.0, rng.uniform(0, 2 * np.pi, 40000), np.zeros(40001), np.empty(0), np.empty(0))
    z, c = np.clip((x - mean) / scale, -6, 6), many.cosines(x)[:, :-1]
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2) / (2 * 4.0**2))
    assert np.abs(c @ c.T - kernel).max() < 0.04
    # calibration: scores of the rows held back, counted in bins, under the rising fit
    at = np.minimum((model.raw(x[held]) - qm.LOW) / (qm.HIGH - qm.LOW) * 64, 63).astype(int)
    bins = sorted(set(at))
    want = qm.isotonic(np.array([(at == b).sum() for b in bins], float), np.array([label[held][at == b].sum() for b in bins], float))
    assert np.allclose(model.value, want) and np.allclose(model.at, qm.LOW + (np.array(bins) + 0.5) * 2 / 64)
