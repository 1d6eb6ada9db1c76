"""Substring dedup on a compacted de Bruijn graph of word k-mers.

A k-mer (``k`` consecutive words of one document) is an edge; edges that occur again and follow one another without a
branch form a path, and a path is one fact: its first edge decides the whole. Documents stay in blocks by a hash of
their ids, and what travels is packed arrays and path rows:

1. ``seeds_of``: every k-mer holds m-word minimisers; a k-mer that occurs twice shares its minimiser with its copy. Each
   block sends its distinct minimisers (32 bits within a bucket); buckets return those seen in several documents.
2. ``_edges``: k-mers with a returned minimiser are sent to buckets with the hashes of their neighbours. Buckets return
   the edges that occur in several documents, and whether the edge before and the edge after are the same wherever
   it occurs (by 32 bits of their hashes, which decides where paths are cut, not what is a copy).
3. ``_paths``: runs of returned edges are cut at branches into paths. One row for each path and block: first edge,
   length, a digest of all its words, the coordinates (document, first word). Equal rows are verified copies, and a
   Spark join with the smallest coordinate of each path finds the source.
4. ``repeated_spans``: coordinates whose document is above the source's are repeated spans.

Every row that a bucket or a path gathers stands for a whole block, so that a passage found in a third of all documents
is one row per block. Nothing is sampled; minimisers only keep k-mers out that cannot repeat.

Defined results: null texts have no words; rows with a null id are neither changed nor a source; rows that share an id
are one document each, and none is above the other; texts shorter than k words have no k-mer; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import text_bytes
from quire.llm.textkit import SPACED, U64, Words, buffers, mix, sliding_min, whole, window_hashes

#: Text bytes of a block of documents, and of the documents whose hashes one bucket compares.
BLOCK_BYTES, BUCKET_BYTES = 4_000_000, 24_000_000
_NONE = U64(0)


def in_order(table: pa.Table) -> pa.Table:
    """A block's rows in an order that every step finds again, whatever order they arrive in."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


class Block:
    """Words and k-mers of a block's documents."""

    def __init__(self, table: pa.Table, k: int, m: int):
        table = in_order(table)
        self.words = Words(*buffers(table.column("text")), kind=SPACED)
        self.h = self.words.hashes()
        ids = table.column("doc_id").combine_chunks()
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.known = ~np.asarray(ids.is_null())
        inside = whole(self.words.first, k) if len(self.h) >= k else np.zeros(0, bool)
        inside &= self.known[self.words.text[: len(inside)]]
        self.at = np.flatnonzero(inside)  # first words of the k-mers
        self.doc = self.words.text[self.at]
        self.edge = window_hashes(self.h, k, seed=1)[self.at] | U64(1) if len(self.at) else np.empty(0, np.uint64)
        self.seed = mix(sliding_min(window_hashes(self.h, m, seed=2), k - m + 1))[self.at] if len(self.at) else self.edge

    def next_to(self) -> tuple[np.ndarray, np.ndarray]:
        """The edges before and after each edge in its document, 0 at the document's ends."""
        near = (self.at[1:] == self.at[:-1] + 1) & (self.doc[1:] == self.doc[:-1]) if len(self.at) else np.zeros(0, bool)
        before, after = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.uint64)
        before[1:] = np.where(near, self.edge[:-1], _NONE)
        after[:-1] = np.where(near, self.edge[1:], _NONE)
        return before, after


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, np.int64)


def packed(bucket: np.ndarray, buckets: int, columns: list[np.ndarray]) -> list[tuple[int, list[bytes]]]:
    """Rows dealt to buckets (``bucket`` rises), each column as bytes."""
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(b, [c[edges[b] : edges[b + 1]].tobytes() for c in columns]) for b in np.flatnonzero(np.diff(edges)).tolist()]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the key: the bucket is the place of its upper 32 bits."""
    return ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def table_of(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.values(), strict=True)], names=list(schema))


SEEDS = {"bucket": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "ids": pa.binary()}
_BACK = {"block": pa.int64(), "keys": pa.binary(), "flags": pa.binary()}


def seeds_of(k: int, m: int, buckets: int):
    """Distinct minimisers of a block, each with whether several of its documents hold it."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        b = Block(table, k, m)
        seed, several = _distinct(b.seed, b.doc)
        bucket = bucket_of(seed, buckets)
        low = (mix(seed, 5) >> U64(32)).astype(np.uint32)
        return table_of(SEEDS, [(n, block, c[0], c[1]) for n, c in packed(bucket, buckets, [low, several.astype(np.uint8)])])

    return run


def _distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and whether each is in several documents."""
    order = np.argsort(key, kind="stable")  # rows come by document, so the documents of a key rise
    key, doc = key[order], doc[order]
    at = _groups(key)
    last = np.append(at[1:], len(key)) - 1
    return key[at], doc[at] != doc[last]


def seed_bucket(table: pa.Table) -> pa.Table:
    """The minimisers of a bucket that several documents hold, for each block that holds them."""
    keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    several = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("ids").to_pylist()]).astype(bool)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    at = _groups(every[order])
    size = np.diff(np.append(at, len(every)))
    again = np.zeros(len(every), bool)
    again[order] = np.repeat((size > 1) | np.logical_or.reduceat(several[order], at), size) if len(at) else again
    rows, begin = [], 0
    for block, own in zip(table.column("block").to_pylist(), keys, strict=True):
        hit = own[again[begin : begin + len(own)]]
        begin += len(own)
        if len(hit):
            rows.append((table.column("bucket")[0].as_py(), block, hit.tobytes(), b""))
    return table_of(SEEDS, rows)


_EDGES = {"bucket": pa.int32(), "block": pa.int64(), "edge": pa.binary(), "flags": pa.binary(), "before": pa.binary(), "after": pa.binary()}
#: Flags of an edge: several documents of the block; not always the same edge before; not always the same after.
SEVERAL, SPLIT, JOIN = 1, 2, 4


def _edges(k: int, m: int, seed_buckets: int, buckets: int):
    """Distinct candidate edges of a block, with their neighbours as far as these agree within the block."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs) or not len(back):
            return table_of(_EDGES, [])
        b = Block(docs, k, m)
        bucket, low = bucket_of(b.seed, seed_buckets), (mix(b.seed, 5) >> U64(32)).astype(np.uint32)
        known = np.sort(np.concatenate([U64(n << 32) | np.frombuffer(x, np.uint32).astype(np.uint64) for n, x in zip(back.column("bucket").to_pylist(), back.column("keys").to_pylist(), strict=True)]))
        mine = (bucket.astype(np.uint64) << U64(32)) | low.astype(np.uint64)
        take = np.flatnonzero(known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine)
        before, after = b.next_to()
        order = take[np.argsort(b.edge[take], kind="stable")]
        edge, doc, before, after = b.edge[order], b.doc[order], before[order], after[order]
        at = _groups(edge)
        last = np.append(at[1:], len(edge)) - 1
        flags = (doc[at] != doc[last]) * SEVERAL
        if len(at):
            flags |= (np.minimum.reduceat(before, at) != np.maximum.reduceat(before, at)) * SPLIT
            flags |= (np.minimum.reduceat(after, at) != np.maximum.reduceat(after, at)) * JOIN
        short = [(x[at] >> U64(32)).astype(np.uint32) for x in (before, after)]  # 0 stays 0
        rows = packed(bucket_of(edge[at], buckets), buckets, [edge[at], flags.astype(np.uint8), *short])
        return table_of(_EDGES, [(n, docs.column("block")[0].as_py(), *c) for n, c in rows])

    return run


def _edge_bucket(table: pa.Table) -> pa.Table:
    """Edges of a bucket that several documents hold, with flags over all blocks, for each block that holds them."""
    edges = [np.frombuffer(x, np.uint64) for x in table.column("edge").to_pylist()]
    every = np.concatenate(edges)
    flags = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("flags").to_pylist()])
    near = [np.concatenate([np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()]) for c in ("before", "after")]
    order = np.argsort(every, kind="stable")
    at = _groups(every[order])
    size = np.diff(np.append(at, len(every)))
    both = np.bitwise_or.reduceat(flags[order], at)
    both |= ((size > 1) * SEVERAL).astype(np.uint8)
    for x, flag in zip(near, (SPLIT, JOIN), strict=True):
        both |= ((np.minimum.reduceat(x[order], at) != np.maximum.reduceat(x[order], at)) * flag).astype(np.uint8)
    out = np.zeros(len(every), np.uint8)
    out[order] = np.repeat(both, size)
    rows, begin = [], 0
    for block, own in zip(table.column("block").to_pylist(), edges, strict=True):
        f = out[begin : begin + len(own)]
        begin += len(own)
        hit = (f & SEVERAL) > 0
        if hit.any():
            rows.append((block, own[hit].tobytes(), f[hit].tobytes()))
    return table_of(_BACK, rows)


_PATHS = {"path": pa.binary(), "block": pa.int64(), "words": pa.int32(), "doc": pa.list_(pa.int64()), "row": pa.list_(pa.int32()), "start": pa.list_(pa.int32())}


def _paths(k: int, m: int):
    """Paths of a block: repeated edges in a row, cut at branches. One row for each, with all its coordinates."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs) or not len(back):
            return table_of(_PATHS, [])
        b = Block(docs, k, m)
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in back.column("keys").to_pylist()])
        flags = np.concatenate([np.frombuffer(x, np.uint8) for x in back.column("flags").to_pylist()])
        order = np.argsort(keys)
        keys, flags = keys[order], flags[order]
        place = np.minimum(np.searchsorted(keys, b.edge), len(keys) - 1)
        take = np.flatnonzero(keys[place] == b.edge)
        if not len(take):
            return table_of(_PATHS, [])
        f, at, doc = flags[place[take]], b.at[take], b.doc[take]
        goes_on = (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1]) & ((f[1:] & SPLIT) == 0) & ((f[:-1] & JOIN) == 0)
        begin = np.flatnonzero(np.append(True, ~goes_on))
        size = np.diff(np.append(begin, len(take))) + k - 1
        found: dict[bytes, tuple[int, list, list, list]] = {}
        data, w = b.words.data, b.words
        for s, n, d in zip(at[begin].tolist(), size.tolist(), doc[begin].tolist(), strict=True):
            path = hashlib.blake2b(b" ".join(data[w.start[s] : w.end[s + n - 1]].tobytes().split()), digest_size=16).digest()
            row = found.setdefault(path, (n, [], [], []))
            row[1].append(int(b.ids[d]))
            row[2].append(d)
            row[3].append(s - int(w.first[d]))
        return table_of(_PATHS, [(p, docs.column("block")[0].as_py(), *x) for p, x in found.items()])

    return run


def blocks(docs: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(doc_id, text, block), and the text bytes: documents dealt by a hash of their ids, about ``size`` bytes a block."""
    total = text_bytes(docs)
    n = max(1, math.ceil(total / size))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(n)).cast("long").alias("block")), total


def ddl(schema: dict[str, pa.DataType]) -> str:
    names = {"int32": "int", "int64": "long", "binary": "binary", "string": "string", "bool": "boolean"}
    return ", ".join(f"{c} {names.get(str(t)) or ('array<long>' if t.value_type == pa.int64() else 'array<int>')}" for c, t in schema.items())


def paths(dealt: DataFrame, total: int, k: int, m: int) -> DataFrame:
    """Verified copies: path, block, words, doc, start, and the source (smallest coordinate of the path)."""
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    seeds = dealt.groupBy("block").applyInArrow(seeds_of(k, m, buckets), ddl(SEEDS))
    seeds = seeds.groupBy("bucket").applyInArrow(seed_bucket, ddl(SEEDS))
    edges = dealt.groupBy("block").cogroup(seeds.groupBy("block")).applyInArrow(_edges(k, m, buckets, buckets), ddl(_EDGES))
    edges = edges.groupBy("bucket").applyInArrow(_edge_bucket, ddl(_BACK))
    found = dealt.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(_paths(k, m), ddl(_PATHS))
    # a path has one row a block, so the rows of one path are at most as many as the blocks
    first = F.struct(F.col("doc")[0].alias("doc"), F.col("start")[0].alias("start"))
    return found.withColumn("source", F.min(first).over(Window.partitionBy("path")))


def repeated_spans(docs: DataFrame, k: int = 13, m: int = 5) -> DataFrame:
    """(doc_id, start, end, source_doc, source_start) in words: spans that also start in a document with a smaller id."""
    dealt, total = blocks(docs, BLOCK_BYTES)
    rows = paths(dealt, total, k, m).select("words", "source", F.inline(F.arrays_zip("doc", "start")))
    return rows.filter(F.col("doc") > F.col("source.doc")).select(F.col("doc").alias("doc_id"), "start", (F.col("start") + F.col("words")).alias("end"), F.col("source.doc").alias("source_doc"), F.col("source.start").alias("source_start"))


KEPT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}


def kept_words(digest: bool):
    """Each document of a block without its repeated spans."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        docs, cut = in_order(docs), {}
        for own, places, starts, words, source in zip(*(spans.column(c).to_pylist() for c in ("doc", "row", "start", "words", "source_doc")), strict=True):
            for d, row, s in zip(own, places, starts, strict=True):
                if d > source:
                    cut.setdefault(row, []).append((s, s + words))
        ids, texts, n_words, n_removed, kept = docs.column("doc_id").to_pylist(), docs.column("text"), [], [], []
        for i, text in enumerate(texts):
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            left = words
            if i in cut:
                stay = np.ones(len(words), bool)
                for s, e in cut[i]:
                    stay[s:e] = False
                left = [words[j] for j in np.flatnonzero(stay).tolist()]
            n_removed.append(len(words) - len(left))
            joined = b" ".join(left)
            kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip((ids, n_words, n_removed, kept), KEPT.values(), strict=True)], names=list(KEPT))

    return run


def without_repeats(docs: DataFrame, k: int = 13, m: int = 5, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``: the words left over, by single spaces (or the SHA-256 of that).

    A word goes if a window of ``k`` words around it also starts in a document with a smaller id, judged on the input.
    The blocks of documents are dealt once; every step reads the same shuffle.
    """
    dealt, total = blocks(docs, BLOCK_BYTES)
    found = paths(dealt, total, k, m).select("block", "doc", "row", "start", "words", F.col("source.doc").alias("source_doc"))
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(kept_words(digest), ddl(KEPT))


def op8(spark, sf_dir: str) -> DataFrame:
    """Words of every document that are left without 13-word windows that start in documents with smaller ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM w WHERE len(w) >= 13)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY x) AS d FROM win) WHERE doc_id > d),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM rep)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w WHERE len(w) > 0),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
