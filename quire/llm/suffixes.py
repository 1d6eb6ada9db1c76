"""Substring dedup with a sparse suffix array of the corpus.

1. Every window of ``k`` words holds a minimiser of ``m`` words, which depends on the window's words alone. Suffixes are
   kept at minimisers only, and only at those that several documents hold (packed hashes in buckets, as in
   ``substring``). A suffix row has the hashes of the k words from its position on and of the words before it; equal rows of
   a block of documents are one row with several coordinates.
2. The rows are sorted over the whole cluster by (minimiser, following words): range partitions, so that a
   passage found in a third of all documents is spread over tasks.
3. Neighbours in that order are compared word by word, and so are neighbours in the order of the words before. The
   lengths they share split a minimiser's suffixes into classes for every split of k words into words before and
   words from the minimiser on: suffixes of one class hold the same k words around it. The smallest document of a
   class is the source; in all others these windows are repeated, and windows in a row make one span, extended to
   the left and to the right.
4. Minimisers whose suffixes a partition border has cut take part once more: each partition sends the windows of which it
   holds no smaller document, as packed arrays of two hashes of all their words and the smallest coordinate. A bucket
   answers each partition with the coordinates of smaller documents elsewhere, and windows in a row make one span. No row
   stands for a window.

A word goes if such a span covers it, so the smallest document that holds a passage keeps it. Words are compared by 32
bits each beside a common 64-bit minimiser, so that a false match of k words has a chance of 2^-32 a word; across
partitions by 128 bits of these.

Defined results: null texts have no words; rows with a null id are neither changed nor a source; rows that share an id
are one document each, and none is above the other; texts of fewer than k words have no suffix; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import substring
from quire.llm.shared import written
from quire.llm.substring import Block, KEPT, SEEDS, blocks, bucket_of, ddl, kept_words, packed, seed_bucket, seeds_of, table_of
from quire.llm.textkit import U64, mix, sliding_min, window_hashes

#: Text bytes whose suffixes one partition of the sorted array holds.
PART_BYTES = 8_000_000

_SUFFIX = {"seed": pa.int64(), "right": pa.binary(), "left": pa.binary(), "block": pa.int64(), "doc": pa.list_(pa.int64()), "row": pa.list_(pa.int32()), "at": pa.list_(pa.int32())}
_SPAN = {"block": pa.int64(), "doc": pa.list_(pa.int64()), "row": pa.list_(pa.int32()), "start": pa.list_(pa.int32()), "words": pa.int32(), "source_doc": pa.int64(), "source_start": pa.int32()}
_FOUND = {**_SPAN, "seed": pa.int64(), "right": pa.binary(), "left": pa.binary(), "open": pa.int64(), "part": pa.int32()}


def _selected(b: Block, k: int, m: int) -> np.ndarray:
    """Words at which the minimiser of some k-word window starts."""
    w = k - m + 1
    raw = window_hashes(b.h, m, seed=2)
    least = np.zeros(len(raw) + w - 1, np.uint64)
    least[b.at + w - 1] = sliding_min(raw, w)[b.at]
    return np.flatnonzero(~sliding_min(~least, w) == raw)


def _suffixes(k: int, m: int, buckets: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs) or not len(back):
            return table_of(_SUFFIX, [])
        b = Block(docs, k, m)
        if not len(b.at):
            return table_of(_SUFFIX, [])
        at = _selected(b, k, m)
        seed = mix(window_hashes(b.h, m, seed=2)[at])
        known = np.sort(np.concatenate([U64(n << 32) | np.frombuffer(x, np.uint32).astype(np.uint64) for n, x in zip(back.column("bucket").to_pylist(), back.column("keys").to_pylist(), strict=True)]))
        mine = (bucket_of(seed, buckets).astype(np.uint64) << U64(32)) | (mix(seed, 5) >> U64(32))
        hit = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
        at, seed = at[hit], seed[hit]
        if not len(at):
            return table_of(_SUFFIX, [])
        word = (b.h >> U64(32)).astype(">u4") | 1
        doc = b.words.text[at]
        ahead, behind = at[:, None] + np.arange(k), at[:, None] - 1 - np.arange(k)
        right = np.where(ahead < b.words.first[doc + 1][:, None], word[np.minimum(ahead, len(word) - 1)], 0).astype(">u4")
        left = np.where(behind >= b.words.first[doc][:, None], word[np.maximum(behind, 0)], 0).astype(">u4")
        both = np.ascontiguousarray(np.hstack([seed.astype(">u8").view(">u4").reshape(-1, 2), right, left]).astype(">u4"))
        _, first, group = np.unique(both.view(f"V{both.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        cut = np.append(np.searchsorted(group[order], np.arange(len(first))), len(order))
        place = at - b.words.first[doc]
        off = pa.array(cut.astype(np.int32))
        columns = [
            pa.array(seed[first].view(np.int64)), pa.array([r.tobytes() for r in right[first]], pa.binary()), pa.array([x.tobytes() for x in left[first]], pa.binary()),
            pa.array(np.full(len(first), docs.column("block")[0].as_py())), pa.ListArray.from_arrays(off, pa.array(b.ids[doc[order]])),
            pa.ListArray.from_arrays(off, pa.array(doc[order].astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(place[order].astype(np.int32))),
        ]
        return pa.Table.from_arrays(columns, names=list(_SUFFIX))

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal words of two rows of hashes before the first that differs or is missing."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint32).reshape(len(rows), -1)


def _sources(seed: np.ndarray, right: np.ndarray, left: np.ndarray, doc: np.ndarray, k: int, m: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words before the minimiser: (it, suffixes, a suffix of the smallest document of each one's class)."""
    n = len(seed)
    same = seed[1:] == seed[:-1]
    to_right = np.where(same, _shared(right[:-1], right[1:]), -1)
    group = np.cumsum(np.append(True, ~same))
    by_left = np.argsort(np.ascontiguousarray(left).view(f"V{left.shape[1] * 4}").ravel(), kind="stable")
    by_left = by_left[np.argsort(group[by_left], kind="stable")]
    to_left = np.where(group[by_left[1:]] == group[by_left[:-1]], _shared(left[by_left[:-1]], left[by_left[1:]]), -1)
    has_left, has_right = (left != 0).sum(axis=1), (right != 0).sum(axis=1)
    left_class = np.empty(n, np.int64)
    for before in range(k - m + 1):
        left_class[by_left] = np.cumsum(np.append(True, to_left < before))
        key = np.cumsum(np.append(True, to_right < k - before)) * (n + 1) + left_class
        some = np.flatnonzero((has_left >= before) & (has_right >= k - before))
        order = some[np.lexsort((doc[some], key[some]))]
        begin = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else order
        yield before, order, np.repeat(order[begin], np.diff(np.append(begin, len(order))))


def _neighbours(k: int, m: int):
    """Spans of a sorted partition, and the suffixes of its first and last minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        seed, right, left = np.asarray(t.column("seed").combine_chunks()), _matrix(t.column("right")), _matrix(t.column("left"))
        docs, rows, places, block = (t.column(c).to_pylist() for c in ("doc", "row", "at", "block"))
        doc, place = np.array([x[0] for x in docs]), np.array([x[0] for x in places])
        source = np.full((len(doc), k - m + 3), -1)  # with a free column on either side
        for before, order, first in _sources(seed, right, left, doc, k, m):
            source[order, before + 1] = np.where(doc[first] < doc[order], first, -1)
        edge = np.diff((source >= 0).astype(np.int8), axis=1)
        lows, highs = np.argwhere(edge == 1), np.argwhere(edge == -1)
        out = []
        for (a, low), (_, high) in zip(lows.tolist(), highs.tolist(), strict=True):
            # windows with low to high - 1 words before the minimiser repeat; the row's first document holds them here
            mine = [x for x in range(len(docs[a])) if docs[a][x] == docs[a][0]]
            b = int(source[a, high])
            out.append((block[a], [docs[a][0]] * len(mine), [rows[a][x] for x in mine], [places[a][x] - high + 1 for x in mine], k + high - 1 - low, int(doc[b]), int(place[b]) - high + 1, *[None] * 5))
        before, after = (left != 0).sum(axis=1).tolist(), (right != 0).sum(axis=1).tolist()
        for a, own in enumerate(docs):
            if own[-1] > own[0] and before[a] + after[a] >= k:  # the row's other documents share all of it with the first
                mine = [x for x in range(len(own)) if own[x] > own[0]]
                out.append((block[a], [own[x] for x in mine], [rows[a][x] for x in mine], [places[a][x] - before[a] for x in mine], before[a] + after[a], own[0], places[a][0] - before[a], *[None] * 5))
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        # of a minimiser that may go on in another partition: windows whose smallest document here is the row's first
        places_left = np.arange(k - m + 1)
        has_left, has_right = (left != 0).sum(axis=1), (right != 0).sum(axis=1)
        for a in np.flatnonzero((seed == seed[0]) | (seed == seed[-1])).tolist():
            free = (source[a, 1:-1] < 0) & (has_left[a] >= places_left) & (has_right[a] >= k - places_left)
            if free.any():
                mine = [x for x in range(len(docs[a])) if docs[a][x] == docs[a][0]]
                out.append((block[a], [docs[a][0]] * len(mine), [rows[a][x] for x in mine], [places[a][x] for x in mine], None, None, None, int(seed[a]), right[a].tobytes(), left[a].tobytes(), int(sum(1 << b for b in np.flatnonzero(free).tolist())), part))
        yield from table_of(_FOUND, out).to_batches()

    return run


def _open_windows(t: pa.Table, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window around a partition's cut suffixes, by all its words and its minimiser, and whether it is open.

    Both have a row for each suffix and a column for each number of words before the minimiser.
    """
    width, n = k - m + 1, len(t)
    words = np.hstack([_matrix(t.column("left"))[:, ::-1], _matrix(t.column("right"))]).astype(np.uint64)  # the minimiser starts at column k
    seed, free = (np.asarray(t.column(c).combine_chunks()).astype(np.int64) for c in ("seed", "open"))
    names = np.empty((n, width, 2), np.uint64)
    begin = k - np.arange(width)
    for at in range(0, n, 4096):
        part = words[at : at + 4096]
        own = seed[at : at + 4096].view(np.uint64)[:, None]
        for j in range(2):  # a window never leaves its own 2k words
            every = window_hashes(mix(part.ravel(), 11 + j), k, seed=21 + j)
            names[at : at + 4096, :, j] = mix(every[np.arange(len(part))[:, None] * 2 * k + begin] ^ mix(own, 31 + j))
    return names, (free[:, None] >> np.arange(width) & 1).astype(bool)


_KEYS = {"bucket": pa.int32(), "part": pa.int32(), "keys": pa.binary(), "doc": pa.binary(), "start": pa.binary()}


def _window_keys(k: int, m: int, buckets: int):
    """The open windows of a partition: two hashes and the smallest coordinate of each, packed by bucket."""

    def run(table: pa.Table) -> pa.Table:
        names, free = _open_windows(table, k, m)
        a, before = np.nonzero(free)
        key = names[a, before]
        doc = np.array([x[0] for x in table.column("doc").to_pylist()], np.int64)[a]
        start = np.array([min(y for d, y in zip(*x, strict=True) if d == x[0][0]) for x in zip(table.column("doc").to_pylist(), table.column("start").to_pylist(), strict=True)], np.int64)[a] - before
        order = np.lexsort((start, doc, key[:, 1], key[:, 0]))
        key, doc, start = key[order], doc[order], start[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(key) else order
        columns = [np.ascontiguousarray(key[first]), doc[first], start[first].astype(np.int32)]
        part = table.column("part")[0].as_py()
        return table_of(_KEYS, [(n, part, *c) for n, c in packed(bucket_of(columns[0][:, 0], buckets), buckets, columns)])

    return run


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, doc, start = (b"".join(table.column(c).to_pylist()) for c in ("keys", "doc", "start"))
    return np.frombuffer(key, np.uint64).reshape(-1, 2), np.frombuffer(doc, np.int64), np.frombuffer(start, np.int32)


def _first_elsewhere(table: pa.Table) -> pa.Table:
    """Of a bucket's windows those of which another partition holds a smaller document, with that coordinate, for each partition."""
    key, doc, start = _unpacked(table)
    size = [len(x) // 16 for x in table.column("keys").to_pylist()]
    order = np.lexsort((start, doc, key[:, 1], key[:, 0]))
    first = np.flatnonzero(np.append(True, (key[order][1:] != key[order][:-1]).any(axis=1)))
    source = np.empty(len(order), np.int64)
    source[order] = np.repeat(order[first], np.diff(np.append(first, len(order))))
    rows, begin = [], 0
    for part, n in zip(table.column("part").to_pylist(), size, strict=True):
        own = np.arange(begin, begin + n)
        begin += n
        hit = own[doc[source[own]] < doc[own]]
        if len(hit):
            rows.append((table.column("bucket")[0].as_py(), part, key[hit].tobytes(), doc[source[hit]].tobytes(), start[source[hit]].tobytes()))
    return table_of(_KEYS, rows)


def _across(k: int, m: int):
    """Spans of a partition's cut suffixes whose windows smaller documents in other partitions hold."""

    def run(t: pa.Table, back: pa.Table) -> pa.Table:
        if not len(t) or not len(back):
            return table_of(_SPAN, [])
        key, doc, start = _unpacked(back)
        order = np.argsort(key[:, 0], kind="stable")
        key, doc, start = key[order], doc[order], start[order]
        names, free = _open_windows(t, k, m)
        place = np.minimum(np.searchsorted(key[:, 0], names[:, :, 0]), len(key) - 1)
        source = np.full((len(t), k - m + 3), -1)  # with a free column on either side
        source[:, 1:-1] = np.where(free & (key[place] == names).all(axis=2), place, -1)
        edge = np.diff((source >= 0).astype(np.int8), axis=1)
        lows, highs = np.argwhere(edge == 1), np.argwhere(edge == -1)
        docs, rows, places, block = (t.column(c).to_pylist() for c in ("doc", "row", "start", "block"))
        out = []
        for (a, low), (_, high) in zip(lows.tolist(), highs.tolist(), strict=True):
            b = int(source[a, high])
            out.append((block[a], docs[a], rows[a], [p - high + 1 for p in places[a]], k + high - 1 - low, int(doc[b]), int(start[b])))
        return table_of(_SPAN, out)

    return run


def spans(dealt: DataFrame, total: int, k: int, m: int) -> DataFrame:
    """Repeated spans: block, doc, row, start (lists), words, source_doc, source_start.

    A window's place around its minimiser is one bit of a long, so k may exceed m by 61 at most.
    """
    if not 0 < m <= k <= m + 61:
        raise ValueError("k must lie between m and m + 61")
    buckets = max(1, math.ceil(total / substring.BUCKET_BYTES))
    seeds = dealt.groupBy("block").applyInArrow(seeds_of(k, m, buckets), ddl(SEEDS)).groupBy("bucket").applyInArrow(seed_bucket, ddl(SEEDS))
    rows = dealt.groupBy("block").cogroup(seeds.groupBy("block")).applyInArrow(_suffixes(k, m, buckets), ddl(_SUFFIX))
    ordered = rows.repartitionByRange(max(1, math.ceil(total / PART_BYTES)), "seed", "right", "left").sortWithinPartitions("seed", "right")
    found = written(ordered.mapInArrow(_neighbours(k, m), ddl(_FOUND)), "suffix-spans")
    # minimisers that a border has cut
    cut = found.filter("seed is not null").select("seed", "right", "left", "block", "doc", "row", "start", "open", "part")
    across = cut.groupBy("seed").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("seed")
    cut = cut.join(across, "seed")
    back = cut.groupBy("part").applyInArrow(_window_keys(k, m, buckets), ddl(_KEYS)).groupBy("bucket").applyInArrow(_first_elsewhere, ddl(_KEYS))
    again = cut.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(_across(k, m), ddl(_SPAN))
    return found.filter("seed is null").select(*_SPAN).union(again.select(*_SPAN))


def without_repeats(docs: DataFrame, k: int = 50, m: int = 8, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``: the words left over, by single spaces (or the SHA-256 of that)."""
    dealt, total = blocks(docs, substring.BLOCK_BYTES)
    found = spans(dealt, total, k, m).select("block", "doc", "row", "start", "words", "source_doc")
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(kept_words(digest), ddl(KEPT))


def op9(spark, sf_dir: str) -> DataFrame:
    """Words of every document that are left without passages of 50 words or more that smaller documents hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM w WHERE len(w) >= 50)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY x) AS d FROM win) WHERE doc_id > d),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM rep)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w WHERE len(w) > 0),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
