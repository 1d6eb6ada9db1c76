"""Integer vectors for the searches: quantising, packed blocks, exact products and short lists of the best.

Defined results: rows whose id or vector is null, or whose vector holds a null or a component that is not finite, take no
part. A shorter vector is filled up with zeros; an empty one is the zero vector. Components that leave 64 bits stop at
its limits, and a score that leaves 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import written

#: Scores below every score.
NONE = np.iinfo(np.int64).min


def quantised(rows: DataFrame, factor: int, vector: str = "embedding") -> DataFrame:
    """``rows`` that take part, with ``v`` (long[]): the floor of ``factor`` times each component, in place of the vector."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(factor)) * c.cast("double")))
    rows = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != vector], whole.alias("v"))


def dimension(vectors: DataFrame) -> int:
    """The longest vector's number of components, 1 at least."""
    return max(1, int(vectors.agg(F.max(F.size("v"))).first()[0] or 0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as int64 rows of ``dim`` components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()]
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.int64, copy=False)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``: by floats while every partial sum stays below 2^53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min()))) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if max(map(abs, exact.ravel())) >= 2**63:
        raise OverflowError("a score leaves 64 bits")
    return exact.astype(np.int64)


def packed(vectors: DataFrame, order: list[Column], extra: Callable[[np.ndarray], dict[str, list]], fields: str, dim: int, partitions: int,
           rows: int, name: str) -> DataFrame:
    """``vectors`` (vec_id, v, label?) in ``order`` over range partitions, ``rows`` to a Parquet row: ids, labels, data and ``extra``.

    ``order`` must end in vec_id, so that equal keys are dealt over several partitions too.
    """
    labelled = "label" in vectors.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in _last(batches):
            if batch is not None and batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
            while held and sum(map(len, held)) >= (rows if batch is not None else 1):
                table = pa.concat_tables(held)
                now, rest = table.slice(0, rows), table.slice(rows)
                held = [rest] if len(rest) else []
                v = matrix(now["v"], dim)
                out = {"ids": [now["vec_id"].to_numpy().astype(np.int64).tobytes()], "data": [v.tobytes()], **extra(v)}
                if labelled:
                    out["labels"] = [now["label"].to_numpy().astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_pydict(out)

    sort = vectors.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    keep = sort.select("vec_id", "v", *(["label"] if labelled else []))
    return written(keep.mapInArrow(pack, f"ids binary, data binary, {fields}" + (", labels binary" if labelled else "")), name)


def _last(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


class Best:
    """The best ``k`` (score, smaller id first) of each of ``n`` keys, and the score a newcomer must reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(n, NONE) if floor is None else floor.copy()
        self.key = self.score = self.id = np.zeros(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.floor[key]
        key, score, ids = (np.concatenate([a, b[good]]) for a, b in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, key))  # ~x falls as x rises, without overflow
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        keep = place < self.k
        self.key, self.score, self.id, place = key[keep], score[keep], ids[keep], place[keep]
        full = place == self.k - 1
        self.floor[self.key[full]] = np.maximum(self.floor[self.key[full]], self.score[full])

    def add_rows(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """Scores of ``keys`` (rows) against ``ids`` (columns); of crowded rows only what can be among the best is sorted."""
        low = self.floor[keys][:, None]
        hit = scores >= low if allowed is None else (scores >= low) & allowed
        if scores.shape[1] > 2 * self.k and hit.sum() > 4 * self.k * len(keys):
            seen = np.where(hit, scores, NONE)
            kth = np.partition(seen, -self.k, axis=1)[:, -self.k]
            hit &= scores >= kth[:, None]
        i, j = np.nonzero(hit)
        self.add(keys[i], scores[i, j], ids[j])


def in_blocks(rows: DataFrame, size: int) -> list[DataFrame]:
    """``rows`` (vec_id, ...) dealt into frames of about ``size`` rows each, by a hash of the id."""
    n = max(1, -(-rows.count() // size))
    if n == 1:
        return [rows]
    return [rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i) for i in range(n)]


def scanned(blocks: DataFrame, queries: list[DataFrame], prepare: Callable[[list], object], scan: Callable, schema: str, name: str) -> DataFrame:
    """What ``scan(broadcast value, batches)`` finds in ``blocks`` for each frame of queries, one pass over the blocks a frame.

    A frame of queries is of bounded size and is the only thing that passes through the driver.
    """
    context, found = blocks.sparkSession.sparkContext, []
    for block in queries:
        asked = block.collect()
        if not asked:
            continue
        held = context.broadcast(prepare(asked))
        found.append(written(blocks.mapInArrow(lambda batches, held=held: scan(held.value, batches), schema), name))
        held.destroy()
    if not found:
        return blocks.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group by score, then smaller vec_id, with ``rank`` from 1; a task sends k rows of a group at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
