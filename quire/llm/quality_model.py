"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration.

``statistics`` turns each whole text into ``len(NAMES)`` numbers in one pass. ``fit`` standardises them, maps them to
``features`` random cosines (an approximation of a Gaussian kernel of the given ``width``), lets every partition sum its
part of the normal equations, adds those parts by matrix row in Spark and solves one bounded system. Raw scores of the
rows kept for calibration are counted in ``bins`` score bins, to which the pool-adjacent-violators fit applies. Models
are made of all labelled rows; only sums of bounded size reach the driver.

Defined results: null and empty texts have all statistics 0 and are scored like any other; labels that are null or of
unknown documents are ignored; several labels of one document count as one row each; without any labelled row every
score is 0.5; null ids and repeated rows are scored row by row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.shared import long_rows, written
from quire.llm.textkit import LETTERED, SPACED, Words, buffers, gathered, mix, window_hashes

LIMIT = 2_000_000


def _class(text: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text)] = True
    return out


_UPPER, _LOWER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789")
_SYMBOL, _BANG, _BAR, _POINT = _class(b"#*$%&|<>"), _class(b"!"), _class(b"|"), _class(b".,;:?")
_WIDE, _LINE = np.arange(256) >= 128, np.arange(256) != 10

NAMES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "bars", "points", "wide", "spaces",
    "distinct_words", "same_as_before", "distinct_triples", "repeated_lines", "words_a_line", "letter_words",
)


def _distinct(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each of n texts."""
    if not len(h):
        return np.zeros(n)
    key = mix(h, 3) ^ mix(text.astype(np.uint64), 7)
    order = np.argsort(key)
    key, owner = key[order], text[order]
    return np.bincount(owner[np.append(True, key[1:] != key[:-1])], minlength=n).astype(float)


def measures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The statistics of some texts, one row each."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1)
        np.cumsum(table[data], out=total[1:])
        return total[off[1:]] - total[off[:-1]]

    w = Words(data, off, SPACED)
    h = w.hashes()
    words = np.maximum(w.n, 1).astype(float)
    lines = Words(data, off, _LINE)
    upper, lower = share(_UPPER), share(_LOWER)
    same = np.zeros(0) if len(h) < 2 else ((h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])).astype(float)
    triples = window_hashes(h, 3)
    inside = w.text[: len(triples)] == w.text[2:] if len(triples) else np.zeros(0, bool)
    n_lines = np.maximum(lines.n, 1).astype(float)
    columns = [
        np.log1p(w.n), share(SPACED) / words / 10, upper / np.maximum(upper + lower, 1), share(_DIGIT) / size,
        share(_SYMBOL) / size, share(_BANG) / size, share(_BAR) / size, share(_POINT) / size, share(_WIDE) / size, share(~SPACED) / size,
        _distinct(h, w.text, n) / words, np.bincount(w.text[1:], same, n) / words if len(same) else np.zeros(n),
        _distinct(triples[inside], w.text[: len(triples)][inside], n) / np.maximum(w.n - 2, 1),
        (lines.n - _distinct(lines.hashes(), lines.text, n)) / n_lines, np.log1p(words / n_lines),
        Words(data, off, LETTERED, lower=True).n / words,
    ]
    out = np.stack(columns, axis=1)
    out[w.n == 0] = 0.0
    return out


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``stats`` (array of double, in the order of NAMES) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "_text", LIMIT):
            x = measures(*buffers(table.column("_text")))
            stats = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield from pa.Table.from_arrays([*(table.column(c) for c in keep), stats], names=[*keep, "stats"]).to_batches()

    used = long_rows(docs).select(*keep, F.col("text").alias("_text"))
    return used.mapInArrow(run, T.StructType([*used.schema.fields[:-1], T.StructField("stats", T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    at: np.ndarray  # calibration: raw scores, rising
    value: np.ndarray  # and what they mean

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.turn + self.shift) * np.sqrt(2 / len(self.shift)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.cosines(x) @ self.weight, LOW, HIGH)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.value) if len(self.at) else np.full(len(x), 0.5)


#: Raw scores are kept in this range, in which calibration counts its bins.
LOW, HIGH = -0.5, 1.5


def _matrix(table: pa.Table, column: str = "stats") -> np.ndarray:
    col = table.column(column).combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten()).reshape(len(col), len(NAMES))


def fit(labelled: DataFrame, features: int = 128, width: float = 4.0, ridge: float = 1e-3, bins: int = 512, seed: int = 5) -> Model | None:
    """A model from rows of stats, label (0 or 1) and calibrate (boolean: held back for the calibration)."""
    rng = np.random.default_rng(seed)
    train, held = labelled.filter(~F.col("calibrate")), labelled.filter("calibrate")
    moments = [f(F.col("stats")[k]) for k in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]
    got = train.agg(F.count(F.lit(1)), *moments).first()
    if not got[0]:
        return None
    mean, scale = np.array(got[1::2], float), np.array(got[2::2], float)
    turn = rng.standard_normal((len(NAMES), features)) / width
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), turn, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.empty(0), np.empty(0))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z = model.cosines(_matrix(pa.Table.from_batches([batch])))
            total += z.T @ np.hstack([z, np.asarray(batch.column("label"), float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(features + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["k", "part"])

    def add(table: pa.Table) -> pa.Table:
        parts = sorted(table.column("part").to_pylist())
        return pa.Table.from_arrays([table.column("k").slice(0, 1), pa.array([np.sum([np.frombuffer(p) for p in parts], axis=0).tobytes()], pa.binary())], names=["k", "part"])

    parts = train.select("stats", "label").mapInArrow(partial, "k int, part binary").groupBy("k").applyInArrow(add, "k int, part binary")
    system = np.array([np.frombuffer(bytes(r.part)) for r in sorted(parts.collect(), key=lambda r: r.k)])
    normal = system[:, :-1] + ridge * got[0] * np.diag(np.append(np.ones(features), 0.0)) + 1e-9 * np.eye(features + 1)
    model = Model(**{**vars(model), "weight": np.linalg.solve(normal, system[:, -1])})

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(bins), np.zeros(bins)
        for batch in batches:
            k = np.minimum((model.raw(_matrix(pa.Table.from_batches([batch]))) - LOW) / (HIGH - LOW) * bins, bins - 1).astype(int)
            n += np.bincount(k, minlength=bins)
            ones += np.bincount(k, np.asarray(batch.column("label"), float), minlength=bins)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(ones[some])], names=["bin", "n", "ones"])

    counts = held.select("stats", "label").mapInArrow(binned, "bin int, n double, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    rows = sorted(counts.collect())
    if not rows:
        return Model(**{**vars(model), "at": np.array([0.0, 1.0]), "value": np.array([0.0, 1.0])})
    at = LOW + (np.array([r.bin for r in rows]) + 0.5) * (HIGH - LOW) / bins
    return Model(**{**vars(model), "at": at, "value": isotonic(np.array([r.n for r in rows]), np.array([r.ones for r in rows]))})


def isotonic(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The non-decreasing step function nearest to ones / n by weighted squares (pool adjacent violators)."""
    pools: list[list[float]] = []
    for count, hits in zip(n, ones, strict=True):
        pools.append([count, hits, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), hits / count) for count, hits, k in pools])


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """``stats`` with its statistics replaced by ``score``."""
    sent = stats.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in stats.columns if c != "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(pa.Table.from_batches([batch]))
            s = np.full(len(x), 0.5) if sent.value is None else sent.value.score(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s)], names=[*keep, "score"])

    schema = T.StructType([*(f for f in stats.schema.fields if f.name != "stats"), T.StructField("score", T.DoubleType())])
    return stats.select(*keep, "stats").mapInArrow(run, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels outside fold 0 of 5 are learned, those of fold 4 by the calibration."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    stats = written(statistics(docs), "statistics")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    learned = labels.filter(F.col("label").isNotNull() & (fold != 0)).withColumn("calibrate", fold == 4)
    model = fit(stats.join(learned, "doc_id").select("stats", "label", "calibrate"))
    held_out = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    return score(stats, model).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
