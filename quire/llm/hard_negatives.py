"""Hard negatives: Hilbert-ordered blocks with zone maps, read by the anchors whose windows their bounds can meet.

1. The 8 dimensions that vary most are cut into 16 steps between their least and greatest value; the place on the Hilbert curve
   through those cells orders all rows over range partitions, so that a block holds rows that lie near each other.
2. A block is one Parquet row: 512 rows packed, beside the least and greatest value of every dimension (the zone map).
3. For an anchor, interval arithmetic over the zone map bounds every score in the block from both sides. The block's
   vectors are unpacked only if some anchor's window reaches between those bounds, and only for such anchors; the
   blocks of a batch come by descending bound, so that windows narrow early.
4. First pass: the window is from the fifth best score so far upwards, among rows of the anchor's label: its positives.
   Second pass: for each positive, scores from ``low`` to ``high`` percent of its own, among other labels. Each pass
   runs once for 4096 anchors (broadcast, bounded) and reads what Spark has partitioned; the best of every task meet by anchor.

Scores are integers and computed exactly; the bounds are integers too (floats are widened by their error), so no row is lost.

Defined results: see ``vectors``; rows with a null label take no part. Rows with the anchor's id are neither positives nor negatives
of it; rows that share another id count each, so that one may be a positive twice. An anchor id on several rows is the
smallest of them (label, then vector). Equal scores go by smaller id. A positive without negatives, an anchor without
positives and an empty table give no rows; a negative positive score has an empty window. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import long_rows, written
from quire.llm.vectors import Best, NONE, dimension, in_blocks, longs, matrix, packed, products, quantised, ranked, scanned

ROWS, ANCHORS, CHUNK = 512, 4096, 512
CURVE_DIMS, CURVE_BITS = 8, 4


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n x d, below 2^bits; d * bits below 64).

    From the highest bit down, the cell is reflected and its axes exchanged until it stands as in the curve's first
    corner; the Gray code of what is left, bit by bit over all axes, is the place.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        below = (1 << b) - 1
        for i in range(d):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turned = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turned ^= np.where((x[d - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turned
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def spreads(vectors: DataFrame, dim: int) -> list[tuple[int, int, int]]:
    """(dimension, least, greatest) of the dimensions that vary most, widest first; one row a dimension and partition."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), dim)
                f = v.astype(np.float64)
                yield pa.RecordBatch.from_pydict({"i": np.arange(dim), "n": np.full(dim, len(v)), "s": f.sum(0), "q": (f * f).sum(0), "low": v.min(0), "high": v.max(0)})

    parts = vectors.select("v").mapInArrow(sums, "i long, n long, s double, q double, low long, high long")
    variance = F.sum("q") / F.sum("n") - (F.sum("s") / F.sum("n")) ** 2
    found = parts.groupBy("i").agg(variance.alias("var"), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # dim rows
    return [(r["i"], r["low"], r["high"]) for r in sorted(found, key=lambda r: (-r["var"], r["i"]))[:CURVE_DIMS]]


def hilbert_blocks(vectors: DataFrame, dim: int, partitions: int) -> DataFrame:
    """Blocks (ids, labels, data, low, high) of ``vectors`` (vec_id, label, v) in the order of the curve."""
    axes = spreads(vectors, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), dim)
            cells = np.zeros((len(v), len(axes)), np.int64)
            for at, (i, low, high) in enumerate(axes):
                share = (v[:, i].astype(np.float64) - low) / max(1.0, float(high) - float(low) + 1)
                cells[:, at] = np.clip(share * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, CURVE_BITS))], names=[*batch.schema.names, "place"])

    placed = long_rows(vectors).mapInArrow(place, "vec_id long, label long, v array<long>, place long")
    zone = lambda v: {"low": [v.min(0)], "high": [v.max(0)]}
    return packed(placed, [F.col("place"), F.col("vec_id")], zone, "low array<long>, high array<long>", dim, partitions, ROWS, "hilbert-blocks")


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score (anchors x blocks) that interval arithmetic allows, widened by the error of the floats."""
    a, low, high = (x.astype(np.float64) for x in (anchors, low, high))
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = 1.0 + 1e-9 * np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def _blocks(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return matrix(batch.column("low"), dim), matrix(batch.column("high"), dim)


def _unpacked(batch: pa.RecordBatch, b: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return longs(batch.column("ids")[b].as_py()), longs(batch.column("labels")[b].as_py()), longs(batch.column("data")[b].as_py()).reshape(-1, dim)


def _chunks(which: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(which), CHUNK):
        yield which[at:at + CHUNK]


def _positives(asked: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, labels, v, dim = asked["ids"], asked["labels"], asked["v"], asked["v"].shape[1]
    best = Best(len(ids), asked["k"])
    for batch in batches:
        _, greatest = bounds(v, *_blocks(batch, dim))
        for b in np.argsort(-greatest.max(0)):
            near = np.flatnonzero(greatest[:, b] >= best.floor)
            if len(near):
                cid, clabel, c = _unpacked(batch, b, dim)
                for some in _chunks(near):
                    fits = (labels[some][:, None] == clabel) & (ids[some][:, None] != cid)
                    best.add_rows(some, products(v[some], c), cid, fits)
    yield pa.RecordBatch.from_pydict({"anchor_id": ids[best.key], "score": best.score, "vec_id": best.id})


def _negatives(asked: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys are (anchor, place of the positive); unused places have an empty window."""
    ids, labels, v, dim, low, high = asked["ids"], asked["labels"], asked["v"], asked["v"].shape[1], asked["low"], asked["high"]
    width = low.shape[1]
    best = Best(low.size, asked["k"], low.ravel())
    for batch in batches:
        least, greatest = bounds(v, *_blocks(batch, dim))
        for b in np.argsort(-greatest.max(0)):
            open_ = best.floor.reshape(-1, width)
            wanted = (open_ <= high) & (greatest[:, b][:, None] >= open_) & (least[:, b][:, None] <= high)
            near = np.flatnonzero(wanted.any(1))
            if len(near):
                cid, clabel, c = _unpacked(batch, b, dim)
                for some in _chunks(near):
                    s = products(v[some], c)
                    other = (labels[some][:, None] != clabel) & (ids[some][:, None] != cid)
                    for p in range(width):
                        best.add_rows(some * width + p, s, cid, other & (s <= high[some, p][:, None]))
    anchor, place = np.divmod(best.key, width)
    yield pa.RecordBatch.from_pydict({"anchor_id": ids[anchor], "place": place, "score": best.score, "vec_id": best.id})


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, partitions: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``vectors`` (vec_id, label, v).

    A negative's score is at least ``low`` and at most ``high`` percent of its positive's.
    """
    vectors = vectors.filter("label IS NOT NULL").select("vec_id", F.col("label").cast("long").alias("label"), "v")
    dim = dimension(vectors)
    n = partitions or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = hilbert_blocks(vectors, dim, n)
    anchors = written(vectors.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.*"), "anchors")

    def prepare(rows: list) -> dict:
        v = np.zeros((len(rows), dim), np.int64)
        for at, r in enumerate(rows):
            v[at, :len(r["v"])] = r["v"]
        return {"ids": np.array([r["vec_id"] for r in rows]), "labels": np.array([r["label"] for r in rows]), "v": v}

    found = scanned(blocks, in_blocks(anchors, ANCHORS), lambda rows: prepare(rows) | {"k": positives}, _positives, "anchor_id long, score long, vec_id long", "positives")
    best = written(ranked(found, ["anchor_id"], positives).select("anchor_id", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "first-positives")
    windows = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("place", "positive_score")).alias("positives"))
    asked = written(anchors.join(windows, "vec_id"), "windows")

    def windowed(rows: list) -> dict:
        least, most = np.full((len(rows), positives), np.iinfo(np.int64).max), np.full((len(rows), positives), NONE)
        for at, r in enumerate(rows):
            for p in r["positives"]:
                score = p["positive_score"]  # low * score <= 100 * negative <= high * score, in whole numbers
                least[at, p["place"]], most[at, p["place"]] = -(-low * score // 100), high * score // 100
        return prepare(rows) | {"k": negatives, "low": least, "high": most}

    found = scanned(blocks, in_blocks(asked, ANCHORS), windowed, _negatives, "anchor_id long, place long, score long, vec_id long", "negatives")
    chosen = ranked(found, ["anchor_id", "place"], negatives).join(best, ["anchor_id", "place"])
    return chosen.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100; labels of ids divisible by 7 are turned first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    turned = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(quantised(rows.withColumn("label", turned), 256), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id AS anchor_id, min(struct_pack(l := label, w := v)) AS m FROM e WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT anchor_id, vec_id, label = m.l AS same, list_sum(list_transform(list_zip(v, m.w), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
      FROM a JOIN e ON anchor_id <> vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
      FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY s.score DESC, s.vec_id) AS r
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 5
"""
