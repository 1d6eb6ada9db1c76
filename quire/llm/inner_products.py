"""Exact top-k by inner product: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

1. The second moments of all vectors, summed in the map tasks, give the rotation: its first coordinates hold most of the
   length. A rotation changes no inner product.
2. Candidates are sorted by descending length over range partitions and packed into blocks.
3. The two longest blocks give every query a first score that the wanted ones reach.
4. One pass over the blocks for each 8192 queries (broadcast, bounded): a block is skipped for the queries whose length times
   its greatest length misses their score so far; what is left is summed coordinate group by coordinate group, and
   candidates and queries go whose partial sum plus the product of the residual lengths misses it. The scores of
   what stays are integers, computed exactly, so pruning loses nothing: float bounds are widened by their error.
5. The best of every task meet by query, k rows of a task at most.

Defined results: see ``vectors``. Rows with the query's own id are no candidates of it; rows that share another id are candidates
each; a query id on several rows asks with its smallest vector. Equal scores go by smaller id. A query without candidates and
an empty table give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import long_rows, written
from quire.llm.vectors import Best, NONE, dimension, in_blocks, longs, matrix, packed, products, quantised, ranked, scanned

ROWS, QUERIES, CHUNK, SEED_BLOCKS = 2048, 8192, 512, 2
#: Shares of the coordinates after which partial sums are held against the bounds.
STEPS = (0.25, 0.5, 0.75)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, by descending singular value, from the d x d matrix of second moments."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            v = matrix(batch.column("v"), dim).astype(np.float64)
            total += v.T @ v
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "x": total[i, j]})

    sums = long_rows(vectors).select("v").mapInArrow(moments, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    m = np.zeros((dim, dim))
    for i, j, x in sums.collect():  # d (d + 1) / 2 rows
        m[i, j] = m[j, i] = x
    return np.linalg.eigh(m)[1][:, ::-1]


def _suffix(w: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Lengths of the coordinates from each cut on."""
    return np.stack([np.sqrt((w[:, c:] ** 2).sum(1)) for c in cuts], 1)


def survivors(wq: np.ndarray, wc: np.ndarray, rq: np.ndarray, rc: np.ndarray, cuts: list[int], floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the queries and of the candidates that still have a pair whose bound reaches the query's floor."""
    q, c = np.arange(len(wq)), np.arange(len(wc))
    part, start = np.zeros((len(q), len(c))), 0
    for s, cut in enumerate(cuts[1:], 1):
        part += wq[q, start:cut] @ wc[c, start:cut].T
        alive = part + np.outer(rq[q, s], rc[c, s]) >= floor[q][:, None]
        keep_q, keep_c = alive.any(1), alive.any(0)
        part, q, c, start = part[np.ix_(keep_q, keep_c)], q[keep_q], c[keep_c], cut
        if not len(q) or not len(c):
            break
    return q, c


def _search(asked: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, v, turn, k = asked["ids"], asked["v"], asked["turn"], asked["k"]
    dim = v.shape[1]
    cuts = sorted({0, *(max(1, round(dim * s)) for s in STEPS)})
    wq = v @ turn
    rq = _suffix(wq, cuts)
    best = Best(len(ids), k, asked["floor"])
    for batch in batches:
        for row in batch.to_pylist():
            cid, c = longs(row["ids"]), longs(row["data"]).reshape(-1, dim)
            wc = c @ turn
            rc = _suffix(wc, cuts)
            for at in range(0, len(ids), CHUNK):
                some = np.arange(at, min(at + CHUNK, len(ids)))
                # a float sum of d terms is off by less than this
                slack = 1e-9 * (1.0 + rq[some, 0] * rc[:, 0].max())
                reach = best.floor[some].astype(np.float64) - slack
                some, reach = (x[rq[some, 0] * rc[:, 0].max() >= reach] for x in (some, reach))
                if not len(some):
                    continue
                q, j = survivors(wq[some], wc, rq[some], rc, cuts, reach)
                if len(q) and len(j):
                    best.add_rows(some[q], products(v[some[q]], c[j]), cid[j], ids[some[q]][:, None] != cid[j])
    yield pa.RecordBatch.from_pydict({"query_id": ids[best.key], "score": best.score, "vec_id": best.id})


def top_k(vectors: DataFrame, is_query: Column, k: int, partitions: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of ``vectors`` (vec_id, v) for each of its rows that ``is_query`` names."""
    dim = dimension(vectors)
    turn = rotation(vectors, dim)
    n = partitions or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    by_length = vectors.select("vec_id", "v", F.sqrt(length).alias("length"))
    top = lambda v: {"top": [float(np.sqrt((v.astype(np.float64) ** 2).sum(1)).max())]}
    blocks = packed(by_length, [F.desc("length"), F.col("vec_id")], top, "top double", dim, n, ROWS, "by-length")
    # the lengths first, so that only the wanted blocks' vectors travel
    tops = [r["top"] for r in blocks.select("top").orderBy(F.desc("top")).limit(SEED_BLOCKS).collect()]
    longest = blocks.filter(F.col("top") >= min(tops, default=0.0)).limit(SEED_BLOCKS).collect()
    seed_ids = np.concatenate([longs(r["ids"]) for r in longest] or [longs(b"")])
    seeds = np.concatenate([longs(r["data"]).reshape(-1, dim) for r in longest] or [longs(b"").reshape(0, dim)])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column("vec_id").to_numpy().astype(np.int64), matrix(batch.column("v"), dim)
            floor = np.full(len(ids), NONE)
            for at in range(0, len(ids), CHUNK):
                some = slice(at, at + CHUNK)
                s = np.where(ids[some][:, None] == seed_ids, NONE, products(v[some], seeds))
                if s.shape[1] > k:  # one more than the query itself may take
                    floor[some] = np.partition(s, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "v": [x.tobytes() for x in v], "floor": floor})

    queries = vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = written(long_rows(queries).mapInArrow(first, "vec_id long, v binary, floor long"), "queries")

    def prepare(rows: list) -> dict:
        return {"ids": np.array([r["vec_id"] for r in rows]), "v": np.stack([longs(r["v"]) for r in rows]), "floor": np.array([r["floor"] for r in rows]),
                "turn": turn, "k": k}

    found = scanned(blocks.select("ids", "data"), in_blocks(queries, QUERIES), prepare, _search, "query_id long, score long, vec_id long", "found")
    return ranked(found, ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every vector whose id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(quantised(rows, 64), F.col("vec_id") % 20 == 0, 20)


OP12_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, min(v) AS w FROM e WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(v, w), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
      FROM q JOIN e ON query_id <> vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
