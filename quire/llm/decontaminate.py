"""Benchmark decontamination: a prefix-filtered join of documents with item-sized windows.

A window is ``window`` consecutive words of an item (an item of fewer words, but not none, is one window). A document
contains a window as a whole, so of each window's shingles the single rarest is a sufficient prefix: every document
that contains the window holds that shingle. Steps:

1. ``vocabulary``: the items' shingles (``shingle`` words; shorter items: all their words), with their corpus counts from
   one pass over all documents, ordered by rarity (count, then hash).
2. ``prefixes``: each distinct window with its rarest shingle, that shingle's place in the window, and its words.
3. ``spans``: document shingles that equal a prefix shingle give a candidate start; length and position bounds keep
   windows that fit into the text, then all words are compared. Hits are merged into word spans per document.

Benchmarks are joined in blocks of at most ``block_windows`` windows, each sent to the tasks as a few arrays of known
size, one block a pass; documents are never shuffled. A larger benchmark makes more passes, by the same path.

Words are compared by 64-bit hashes of all their bytes, every word of a window on its own. Defined results: null and
empty texts have no words; null item texts have no windows; items that share an id count once, a null item id counts
as an item with an empty name; null document ids and repeated rows are reported row by row; extra columns are ignored.
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
from quire.llm.textkit import LETTERED, Words, buffers, gathered, window_hashes

LIMIT = 2_000_000


@dataclass(frozen=True)
class Block:
    """Distinct windows of some items, ordered by the hash of their prefix shingle."""

    prefix: np.ndarray  # hash of the rarest shingle
    at: np.ndarray  # its first word's place in the window
    size: np.ndarray  # shingle words
    words: list[np.ndarray]  # word hashes of the window
    items: list[list[str]]


def _windows(table: pa.Table, window: int, shingle: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, int]]:
    """(item id, words, shingles, shingle words) of every window."""
    w = Words(*buffers(table.column("text")), kind=LETTERED, lower=True)
    h = w.hashes()
    for k, name in enumerate(table.column("item_id").to_pylist()):
        own = h[w.first[k] : w.first[k + 1]]
        size = min(window, len(own))
        for s in range(len(own) - size + 1) if size else ():
            part = own[s : s + size]
            n = min(shingle, size)
            yield name or "", part, window_hashes(part, n, seed=n), n


def _items(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """One row for each distinct window: its key, words, shingles and the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text", LIMIT):
            rows = [(i, w.tobytes(), s.tobytes(), n) for i, w, s, n in _windows(table, window, shingle)]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int32())], names=["item", "words", "shingles", "n"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item string, words binary, shingles binary, n int")
    return rows.groupBy("words", "shingles", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _counts(docs: DataFrame, vocabulary: dict[int, np.ndarray]) -> DataFrame:
    """Corpus occurrences of the given shingles, by (n, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(len(v), np.int64) for n, v in vocabulary.items()}
        for table in gathered(batches, "text", LIMIT):
            w = Words(*buffers(table.column("text")), kind=LETTERED, lower=True)
            h = w.hashes()
            for n, known in vocabulary.items():
                total[n] += np.bincount(_found(known, h, n, w.text)[1], minlength=len(known))
        for n, known in vocabulary.items():
            some = np.flatnonzero(total[n])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(known[some].view(np.int64)), pa.array(total[n][some])], names=["n", "hash", "count"])

    return docs.select("text").mapInArrow(run, "n int, hash long, count long").groupBy("n", "hash").agg(F.sum("count").alias("count"))


def _found(known: np.ndarray, h: np.ndarray, n: int, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a shingle of ``known`` (sorted) starts inside one text, and its place in ``known``."""
    s = window_hashes(h, n, seed=n)
    if not len(s) or not len(known):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(known, s), len(known) - 1)
    hit = np.flatnonzero((known[place] == s) & (text[: len(s)] == text[n - 1 :]))
    return hit, place[hit]


def blocks(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, block_windows: int = 200_000) -> Iterator[Block]:
    """The benchmark's windows with their prefix shingles; rarity is counted over all of ``docs``."""
    items = _items(benchmark, window, shingle)
    held: list = []
    for row in items.toLocalIterator(prefetchPartitions=False):
        held.append(row)
        if len(held) == block_windows:
            yield _block(docs, held)
            held = []
    if held:
        yield _block(docs, held)


def _block(docs: DataFrame, rows: list) -> Block:
    shingles = [np.frombuffer(r.shingles, np.uint64) for r in rows]
    vocabulary = {n: np.unique(np.concatenate([s for s, r in zip(shingles, rows, strict=True) if r.n == n])) for n in sorted({r.n for r in rows})}
    count = {(r.n, r.hash): r["count"] for r in _counts(docs, vocabulary).toLocalIterator()}
    at = [min(range(len(s)), key=lambda k: (count.get((r.n, int(s.view(np.int64)[k])), 0), int(s[k]))) for s, r in zip(shingles, rows, strict=True)]
    prefix = np.array([s[k] for s, k in zip(shingles, at, strict=True)], np.uint64)
    order = np.argsort(prefix, kind="stable")
    words = [np.frombuffer(r.words, np.uint64) for r in rows]
    return Block(prefix[order], np.array(at)[order], np.array([r.n for r in rows])[order], [words[k] for k in order], [list(rows[k]["items"]) for k in order])


def _hits(block: Block, w: Words, h: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, end word, window) of every occurrence."""
    out = []
    for n in np.unique(block.size):
        mine = np.flatnonzero(block.size == n)
        known, begin = np.unique(block.prefix[mine], return_index=True)
        end = np.append(begin[1:], len(mine))
        at, place = _found(known, h, int(n), w.text)
        for p, k in zip(at.tolist(), place.tolist(), strict=True):
            lo, hi = w.first[w.text[p]], w.first[w.text[p] + 1]
            for x in mine[begin[k] : end[k]].tolist():
                s = p - int(block.at[x])
                e = s + len(block.words[x])
                if s >= lo and e <= hi and np.array_equal(h[s:e], block.words[x]):
                    out.append((s, e, x))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",), block_windows: int = 200_000) -> DataFrame:
    """For every row of ``docs``: ``keep`` columns, n_words, spans (merged word ranges that are hit) and items (ids).

    Each block of windows is one pass over the documents that adds its spans and items; between passes the rows are
    written, so that no task and no driver holds more than one block.
    """
    others = [c for c in keep if c != "text"]
    rows = long_rows(docs).select(*others, F.col("text").alias("_text"), F.array().cast(SPAN).alias("spans"), F.array().cast("array<string>").alias("items"))
    waiting = None
    for block in blocks(docs, benchmark, window, shingle, block_windows):
        if waiting is not None:
            rows = written(_pass(rows, waiting, others), "decontaminate").drop("n_words")
        waiting = block
    rows = _pass(rows, waiting, others)
    return rows.withColumnRenamed("_text", "text").select(*keep, "spans", "items", "n_words")


def _pass(rows: DataFrame, block: Block | None, keep: list[str]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)
    names = [*keep, "_text", "spans", "items", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "_text", LIMIT):
            w = Words(*buffers(table.column("_text")), kind=LETTERED, lower=True)
            spans = [[(x["start"], x["end"]) for x in own] for own in table.column("spans").to_pylist()]
            items = [set(own) for own in table.column("items").to_pylist()]
            if sent.value is not None:
                for s, e, x in _hits(sent.value, w, w.hashes()):
                    k = int(w.text[s])
                    spans[k].append((s - int(w.first[k]), e - int(w.first[k])))
                    items[k].update(sent.value.items[x])
            out = [table.column(c) for c in names[:-3]]
            out += [pa.array([_merged(x) for x in spans], _SPAN), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(w.n)]
            yield from pa.Table.from_arrays(out, names=names).to_batches()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType())]))


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def op5(spark, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document: 10-word windows of all items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return contaminated(docs, benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bwin),
dwin AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, k, s, item_id FROM dwin JOIN bwin USING (k, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
        FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
