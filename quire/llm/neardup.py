"""MinHash near-duplicates: fast similarity sketches, banding and exact verification.

``sketch`` fills t bins in rounds. In round i < t every element falls into a hashed bin with a value in [i, i + 1); in
round t + k every element falls into bin k. A bin keeps its least value and a set stops as soon as all its bins are
filled, which takes 2t rounds at most and one or two for a set of many elements. Equal bins of two sketches are then an
unbiased, concentrated estimate of the Jaccard similarity. With 30 bands of 4 bins a pair at similarity 0.85 shares no
band with probability 2e-10 (1e-7 at 0.8).

``near_duplicates`` works on one representative for each distinct set:

1. Representatives that share a band are candidates. Only their sets are read again.
2. A shingle that no other candidate has cannot be shared, so m, a set's other shingles, bounds every similarity by
   min(m) / (n + n' - min(m)). Sets that cannot reach the threshold with anything leave.
3. In every band the set with the largest share of m is the pivot; all others are compared with it exactly.
4. What this has linked is one component. Where a band still holds several, all sets that such bands connect (a
   cluster) are compared with one another in tiles of TILE x TILE sets, each tile one small matrix product in a task
   that returns only the links that join components. So no link is lost, no pair is a row, and a group of n close
   copies costs about n comparisons rather than n^2.

Defined results: a text of fewer words than a shingle has its whole word sequence as its one shingle; null texts and
texts without words have no set and are linked with nothing. Rows with a null id are not linked either (component null, kept).
Rows that share an id are one document. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.shared import long_rows, written
from quire.llm.textkit import SPACED, U64, Words, buffers, gathered, lists, mix, window_hashes

LIMIT = 2_000_000
BANDS, ROWS = 30, 4
#: Sets on one side of a tile.
TILE = 48
_EMPTY = U64(2**64 - 1)


def sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed k-word shingles of each text behind one another, sorted within a text, and their offsets."""
    w = Words(data, off, SPACED, lower=True)
    h = w.hashes()
    s = window_hashes(h, k, seed=k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(s[a : b - k + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(window_hashes(h[a:b], b - a, seed=b - a) if b > a else s[:0])
    first = np.zeros(len(out) + 1, np.int64)
    np.cumsum([len(x) for x in out], out=first[1:])
    return (np.concatenate(out) if out else s[:0]), first


def sketch(elements: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """One row of t bins for each set; the rows of empty sets keep the empty mark."""
    n = len(first) - 1
    bins = np.full(n * t, _EMPTY)
    owner = np.repeat(np.arange(n), np.diff(first))
    for i in range(2 * t):
        if not len(elements):
            break
        v = mix(elements, i + 1)
        to = ((v & U64(0xFFFF)) * U64(t) >> U64(16)).astype(np.int64) if i < t else i - t
        np.minimum.at(bins, owner * t + to, (U64(i) << U64(48)) | (v >> U64(16)))
        open_ = (bins.reshape(n, t) == _EMPTY).any(axis=1)
        if not open_.all():
            stay = open_[owner]
            elements, owner = elements[stay], owner[stay]
    return bins.reshape(n, t)


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text", LIMIT):
            for at in range(0, len(table), 4096):
                part = table.slice(at, 4096)
                x, first = sets(*buffers(part.column("text")), k)
                bins = sketch(x, first, BANDS * ROWS).reshape(len(part), BANDS, ROWS)
                bands = np.zeros((len(part), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands ^ bins[:, :, r], r)
                bands = mix(bands ^ np.arange(BANDS, dtype=np.uint64)[None, :], 99)
                total = np.zeros((2, len(x) + 1), np.uint64)
                for j in range(2):  # the sum of an independent hash of all elements stands for the set
                    np.cumsum(mix(x, 1000 + j), out=total[j, 1:])
                marks = total[:, first[1:]] - total[:, first[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").combine_chunks(), pa.array(np.diff(first)), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)),
                     lists(bands.ravel().view(np.int64), np.arange(len(part) + 1) * BANDS, pa.int64())],
                    names=["doc_id", "n", "f1", "f2", "bands"],
                )

    return run


def _shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text", LIMIT):
            x, first = sets(*buffers(table.column("text")), k)
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(mix(x, 1000), out=total[1:])
            mark = (total[first[1:]] - total[first[:-1]]).view(np.int64)
            yield from pa.Table.from_arrays([table.column("doc_id"), pa.array(mark), pa.array(np.diff(first)), lists(x.view(np.int64), first, pa.int64())], names=["doc_id", "f1", "n", "x"]).to_batches()

    return run


def _within(a: str, b: str, percent: int) -> Column:
    """Can two sets, by their sizes and shared parts, reach the threshold?"""
    most = F.least(F.col(f"{a}.m"), F.col(f"{b}.m"))
    return 100 * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)


def _verified(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    one = pairs.join(shingles.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("x").alias("xa")), "a")
    two = one.join(shingles.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("x").alias("xb")), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return two.filter(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _tile(percent: int):
    """Links between the components of a tile, as few as join them."""

    def run(table: pa.Table) -> pa.Table:
        sets_, n = table.column("x").combine_chunks(), np.asarray(table.column("n")).astype(np.int64)
        ids, component, side = (np.asarray(table.column(c)).astype(np.int64) for c in ("doc_id", "component", "side"))
        owner = np.repeat(np.arange(len(n)), n)
        _, place, count = np.unique(np.asarray(sets_.flatten()), return_inverse=True, return_counts=True)
        both = count[place] > 1
        column, owner = (np.cumsum(count > 1) - 1)[place[both]], owner[both]
        common = np.zeros((len(n), len(n)))
        for at in range(0, int((count > 1).sum()), 16384):
            here = (column >= at) & (column < at + 16384)
            part = np.zeros((len(n), 16384), np.float32)
            part[owner[here], column[here] - at] = 1
            common += part @ part.T
        link = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        link &= component[:, None] != component[None, :]
        if table.column("i")[0] != table.column("j")[0]:
            link &= side[:, None] != side[None, :]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        found = []
        for a, b in np.argwhere(np.triu(link, 1)).tolist():
            x, y = find(int(component[a])), find(int(component[b]))
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((int(ids[a]), int(ids[b])))
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return run


def _tiled(rest: DataFrame, clusters: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of one cluster."""
    rows = rest.join(clusters.withColumnRenamed("component", "cluster"), rest["doc_id"] == clusters["node"]).select("doc_id", rest["component"], "cluster")
    tiles = rows.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("long").alias("tiles"))
    rows = rows.join(tiles, "cluster").withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("doc_id", "component", "cluster", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    full = rows.join(shingles.select("doc_id", "n", "x"), "doc_id")
    return full.groupBy("cluster", "i", "j").applyInArrow(_tile(percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """For every row of ``docs`` (doc_id long, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 x intersection >= ``percent`` x union of their shingle sets.
    """
    docs = long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(docs.mapInArrow(_features(shingle), "doc_id long, n long, f1 long, f2 long, bands array<long>"), "sketches")
    linkable = rows.filter("n > 0 and doc_id is not null")
    classes = written(linkable.groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("n", "f1", "f2", F.col("r.doc_id").alias("rep"), "r.bands"), "classes")
    banded = classes.select("rep", F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("h")
    members = written(banded.join(shared, "h"), "members")
    # sets of the candidates, and how much of each another candidate has as well
    shingles = written(docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").mapInArrow(_shingles(shingle), "doc_id long, f1 long, n long, x array<long>"), "shingles")
    alone = shingles.select("doc_id", "f1", F.explode("x").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "f1")).alias("d")).filter("c = 1")
    alone = alone.groupBy(F.col("d.doc_id").alias("_d"), F.col("d.f1").alias("_f")).agg(F.count(F.lit(1)).alias("alone"))
    sizes = shingles.select("doc_id", "f1", "n").distinct().join(alone, (F.col("doc_id") == F.col("_d")) & (F.col("f1") == F.col("_f")), "left").select("doc_id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"))
    sizes = sizes.filter(100 * F.col("m") >= percent * F.col("n"))
    members = written(members.join(sizes, members["rep"] == sizes["doc_id"]).select("h", "doc_id", "n", "m"), "members")
    # links with the pivot of each band
    pivots = members.groupBy("h").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("share"), (-F.col("doc_id")).alias("minus"), "n", "m")).alias("p"))
    pivots = pivots.select("h", (-F.col("p.minus")).alias("doc_id"), F.col("p.n").alias("n"), F.col("p.m").alias("m"))
    pairs = members.alias("s").join(pivots.alias("p"), (F.col("s.h") == F.col("p.h")) & (F.col("s.doc_id") != F.col("p.doc_id")) & _within("s", "p", percent))
    pairs = pairs.select(F.col("s.doc_id").alias("a"), F.col("p.doc_id").alias("b")).distinct()
    found = written(_verified(pairs, shingles, percent), "links")
    labels = written(components(found), "components")
    # bands whose members are still apart: all pairs of their clusters, tile by tile
    labelled = members.join(labels, members["doc_id"] == labels["node"], "left").select("h", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    apart = labelled.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc_id").alias("first")).filter("lo < hi").select("h", "first")
    rest = written(labelled.join(apart, "h").select("doc_id", "component", "first").distinct(), "apart")
    clusters = components(rest.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    more = _tiled(rest.select("doc_id", "component").distinct(), clusters, shingles, percent)
    # rows that share an id link the sets they belong to
    belongs = linkable.select("doc_id", "n", "f1", "f2").join(classes.drop("bands"), ["n", "f1", "f2"]).select("doc_id", "rep")
    belongs = written(belongs.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"), F.collect_set("rep").alias("all")), "belongs")
    same = belongs.filter("rep < other").select(F.col("rep").alias("a"), F.explode("all").alias("b"))
    labels = components(found.union(more).union(same))
    where = belongs.join(labels, belongs["rep"] == labels["node"], "left").select(F.col("doc_id").alias("_d"), F.coalesce("component", "rep").alias("_c"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(where, F.col("doc_id") == F.col("_d"), "left")
    out = out.withColumn("component_id", F.coalesce("_c", "doc_id")).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=3, percent=85)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + least(3, len(w)) - 1], ' ') AS x
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, both_.b FROM r JOIN both_ ON r.x = both_.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(x) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
