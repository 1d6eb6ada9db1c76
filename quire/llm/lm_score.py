"""LM scoring: the log probability of a text under a subword lattice whose weights follow the corpus.

1. ``word_rows``: each chunk of documents becomes one row for each distinct word: its count in training texts, and which
   of the chunk's documents it stands in, once for each time. So everything below handles a word once a chunk.
2. ``vocabulary``: counts of all distinct words of the corpus, by a grouped sum.
3. ``fit``: the vocabulary's own scores weight all segmentations of each training word (forward and backward recursion);
   the expected uses of the pieces, times the word's count, are summed by piece and become the weights.
4. ``score``: the forward recursion gives each distinct word its marginal probability; a join takes it to the words'
   chunks, where it is summed by document.

A text's probability is the product over its words, as no piece crosses a space, and over one end.

Defined results: null and empty texts have one token, the end; rows with a null id belong to the training texts and are
scored; repeated rows count as often as they occur; without training rows counts are 0 and weights are the
vocabulary's own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.lattice import BATCH_BYTES, Lattice, batches, read_pieces
from quire.llm.shared import long_rows, written
from quire.llm.textkit import SPACED, Words, as_binary, buffers, gathered

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES, CHUNK_ROWS = 14_000_000, 60_000
#: The end of a text, as a word that no text can hold.
END = ""
_ROW = {"chunk": "long", "word": "string", "c": "long", "places": "binary", "docs": "binary"}
#: What a chunk's own row says of each of its documents.
_DOC = np.dtype([("id", "<i8"), ("has_id", "?"), ("train", "?"), ("tokens", "<i8")])


def _chunk(table: pa.Table, name: int) -> Iterator[pa.RecordBatch]:
    w = Words(*buffers(table.column("text")), kind=SPACED, lower=True)
    train = np.asarray(table.column("train").combine_chunks()).astype(np.int64)
    h = w.hashes()
    order = np.argsort(h, kind="stable")
    sorted_h, text = h[order], w.text[order]
    at = np.flatnonzero(np.append(True, sorted_h[1:] != sorted_h[:-1])) if len(h) else np.empty(0, np.int64)
    size = np.diff(np.append(at, len(h)))
    words = as_binary(*w.bytes_of(order[at]), kind=pa.string())
    count = np.add.reduceat(train[text], at) if len(at) else np.empty(0, np.int64)
    every = np.arange(len(table))
    words = pa.concat_arrays([words, pa.array([END], pa.string())])
    count = np.append(count, train.sum())
    places = np.concatenate([text, every]).astype(np.uint16)
    off = np.append(0, np.cumsum(np.append(size, len(table)))) * 2
    n = len(words)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), words, pa.array(count), as_binary(places.view(np.uint8), off), pa.nulls(n, pa.binary())], names=list(_ROW))
    ids = table.column("doc_id").combine_chunks()
    own = np.zeros(len(table), _DOC)
    own["id"], own["has_id"], own["train"], own["tokens"] = np.asarray(ids.fill_null(0)), ~np.asarray(ids.is_null()), train, w.n + 1
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([own.tobytes()], pa.binary())], names=list(_ROW))


def word_rows(docs: DataFrame, train: Column) -> DataFrame:
    """The rows of all chunks, written once: (chunk, word, c, places), and one row a chunk with its documents."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for table in gathered(parts, "text", CHUNK_BYTES):
            for at in range(0, len(table), CHUNK_ROWS):
                yield from _chunk(table.slice(at, CHUNK_ROWS), name)
                name += 1

    rows = long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(True)).alias("train"))
    return written(rows.mapInArrow(run, ", ".join(map(" ".join, _ROW.items()))), "words")


def vocabulary(rows: DataFrame) -> DataFrame:
    """(word, c): every distinct word with its count in training texts."""
    return written(rows.filter("word is not null").groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")


@dataclass(frozen=True)
class Model:
    pieces: str
    weight: np.ndarray  # log probability of each piece
    end: float  # log probability of the end
    tokens: int
    distinct: int


def fit(counts: DataFrame, pieces: str = PIECES, smooth: float = 0.5) -> Model:
    """Weights from one expectation step over all training words; what is collected has the vocabulary's size."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = read_pieces(pieces)
        total = np.zeros(len(p.names))
        for part in gathered(parts, "word", 4 * BATCH_BYTES):
            c = np.asarray(part.column("c").combine_chunks(), float)
            for own, data, off in batches(part.column("word").combine_chunks()):
                total += Lattice(data, off, p).expected(p.start, c[own])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

    tokens, distinct, ends = counts.filter("c > 0").agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == END, F.col("c")))).first()
    p = read_pieces(pieces)
    n = np.zeros(len(p.names))
    used = counts.filter((F.col("c") > 0) & (F.col("word") != END)).mapInArrow(run, "piece long, n double")
    for row in used.groupBy("piece").agg(F.sum("n").alias("n")).toLocalIterator():
        n[row.piece] = row.n
    if not tokens:
        return Model(pieces, p.start + np.log(0.5), float(np.log(0.5)), 0, 0)
    total = n.sum() + (ends or 0) + smooth * (len(n) + 1)
    return Model(pieces, np.log((n + smooth) / total), float(np.log(((ends or 0) + smooth) / total)), int(tokens), int(distinct))


def word_scores(counts: DataFrame, model: Model) -> DataFrame:
    """``counts`` with ``lattice``: log10 of each token's marginal probability."""
    sent = counts.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        p = read_pieces(m.pieces)
        for part in gathered(parts, "word", 4 * BATCH_BYTES):
            words = part.column("word").combine_chunks()
            lattice = np.empty(len(words))
            for own, data, off in batches(words):
                lattice[own] = Lattice(data, off, p).probability(m.weight)
            lattice[np.asarray(pa.compute.equal(words, END))] = m.end
            yield pa.RecordBatch.from_arrays([words, part.column("c").combine_chunks(), pa.array(lattice / np.log(10))], names=["word", "c", "lattice"])

    return counts.select("word", "c").mapInArrow(run, "word string, c long, lattice double")


def _summed(tokens: int, distinct: int):
    """Scores of a chunk's documents from those of its words; a word's base score follows from its count."""

    def run(table: pa.Table) -> pa.Table:
        (mine,) = [x for x in table.column("docs").to_pylist() if x]
        docs = np.frombuffer(mine, _DOC)
        data, off = buffers(table.column("places"))
        place, size = data.view(np.uint16).astype(np.int64), np.diff(off) // 2
        c, lattice = (np.asarray(table.column(x).combine_chunks(), float) for x in ("c", "lattice"))
        base = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
        known, base, lattice = (np.bincount(place, np.repeat(x, size), minlength=len(docs)) for x in ((c > 0).astype(float), base, lattice))
        ids = pa.array(docs["id"], mask=~docs["has_id"])
        return pa.Table.from_arrays([ids, pa.array(docs["train"]), pa.array(docs["tokens"]), pa.array(known.astype(np.int64)), pa.array(base), pa.array(lattice)], names=["doc_id", "trained", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, train: Column, pieces: str = PIECES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text)."""
    rows = word_rows(docs, train)
    counts = vocabulary(rows)
    model = fit(counts, pieces)
    known = word_scores(counts, model).select(F.col("word").alias("_w"), "c", "lattice")
    words = rows.filter("word is not null").select("chunk", "word", "places").join(known, F.col("word") == F.col("_w"))
    nothing = F.lit(b"")
    words = words.select("chunk", "places", "c", "lattice", nothing.alias("docs"))
    own = rows.filter("word is null").select("chunk", nothing.alias("places"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("lattice"), "docs")
    out = words.union(own).groupBy("chunk").applyInArrow(_summed(model.tokens, model.distinct), "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those outside fold 1 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
