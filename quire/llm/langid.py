"""Language ID by compression: the language whose zstandard dictionary encodes a text in the fewest bytes.

``fit`` takes a bounded sample of labelled documents per language (the ``per_language`` distinct texts with the smallest
seeded hash, an equal share of ``dictionary_bytes`` of letters from a hashed position of each) as a raw-content dictionary. ``classify`` reduces each whole text to
its lower-cased runs of letters, cuts it into pieces of ``piece_bytes``, encodes each piece with each dictionary and
sums the sizes, so long texts cost and count evenly: no prefix, no cap. Each piece stands behind a constant carrier,
as an encoder leaves very short inputs as they are, which would make every size equal.

Defined results: a text that is null or has no letter is ``und`` with score 0 and is rejected. Equal sizes go to the
language with more labelled rows, then to the first in code-point order. A margin (gap between the two smallest sizes,
relative to the smallest) under ``min_margin`` is rejected; a single learned language always wins with score 1.
Without any labelled row every text is ``und``. Null ids and repeated rows are treated as any others; columns besides
``keep`` are ignored, and a ``keep`` column named like a result is replaced by it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import long_rows, written

UNKNOWN = "und"
CARRIER = bytes(128)
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased runs of letters between single spaces."""
    return f" {_NOT_LETTERS.sub(' ', text.lower())} ".encode("utf-8", "surrogatepass")


def shares(lengths: list[int], size: int) -> list[int]:
    """Equal shares of ``size``; what shorter ones leave goes to the others."""
    out = [0] * len(lengths)
    for done, k in enumerate(sorted(range(len(lengths)), key=lengths.__getitem__)):
        out[k] = min(lengths[k], size // (len(lengths) - done))
        size -= out[k]
    return out


def fit(labelled: DataFrame, per_language: int = 96, dictionary_bytes: int = 32_768, seed: str = "langid") -> dict[str, bytes]:
    """Dictionaries by language from ``labelled`` (text, lang), most frequent language first.

    The model has languages x dictionary_bytes at most and is learned from languages x per_language distinct texts. They
    are ranked by their hashes alone, and only the parts of those picked leave the map tasks.
    """
    usable = labelled.select("lang", "text", F.xxhash64(F.lit(seed), F.col("text")).alias("draw"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    drawn = written(usable.groupBy("lang", "draw").agg(F.count(F.lit(1)).alias("n")), "drawn")
    counts = {lang: n for lang, n in drawn.groupBy("lang").agg(F.sum("n")).collect()}
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    picked = drawn.withColumn("nth", nth).filter(F.col("nth") <= per_language).select("lang", "draw", "nth")
    begin = F.pmod(F.xxhash64("draw"), F.greatest(F.length("text") - dictionary_bytes, F.lit(0)) + 1)
    part = F.substring(F.col("text"), (begin + 1).cast("int"), F.lit(dictionary_bytes))
    found: dict[str, list[tuple[int, bytes]]] = {}
    for lang, nth, text in usable.join(F.broadcast(picked), ["lang", "draw"]).groupBy("lang", "nth").agg(F.min(part)).collect():
        found.setdefault(lang, []).append((nth, letters(text)))
    model = {}
    for lang in sorted(found, key=lambda x: (-counts[x], x.encode())):
        parts = [text for _, text in sorted(found[lang], reverse=True)]
        cut = [(x, n, zlib.crc32(x) % (len(x) - n + 1)) for x, n in zip(parts, shares([len(x) for x in parts], dictionary_bytes), strict=True)]
        model[lang] = b"".join(x[at : at + n] for x, n, at in cut)
    return model


def _encoders(model: dict[str, bytes], level: int, piece_bytes: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in model.values():
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            level, dict_size=len(raw), source_size=piece_bytes, min_match=3,
            write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        held.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(compression_params=how, dict_data=held))
    return out


def sizes(text: str, encoders: list, piece_bytes: int) -> np.ndarray:
    """Encoded bytes of the whole text by language."""
    raw = letters(text)
    total = np.zeros(len(encoders))
    for at in range(0, len(raw), piece_bytes):
        part = CARRIER + raw[at : at + piece_bytes]
        total += [len(e.compress(part)) for e in encoders]
    return total


def classify(docs: DataFrame, model: dict[str, bytes], min_margin: float = 0.02, level: int = 7, piece_bytes: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred, score (0 to 1), margin and rejected for every row of ``docs``."""
    names = list(model)
    keep = tuple(c for c in keep if c.lower() not in ("lang_pred", "score", "margin", "rejected"))

    others = [c for c in keep if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(model, level, piece_bytes)
        for batch in batches:
            pred, score, margin = [], [], []
            for text, letters in zip(batch.column("_text"), batch.column("_letters").to_pylist(), strict=True):
                if not letters or not names:
                    pred.append(UNKNOWN), score.append(0.0), margin.append(0.0)
                    continue
                s = sizes(text.as_py(), encoders, piece_bytes)
                best = int(np.argmin(s))
                rest = np.delete(s, best)
                gap = float((rest.min() - s[best]) / max(1.0, s[best])) if len(rest) else 1.0
                pred.append(names[best]), margin.append(gap)
                score.append(1.0 - 0.5 * math.exp(-gap / min_margin) if len(rest) else 1.0)
            out = [batch.column("_text" if c == "text" else c) for c in keep]
            out += [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "lang_pred", "score", "margin"])
        pa.default_memory_pool().release_unused()

    # the text travels once, whether it is kept or not
    used = long_rows(docs).select(*others, F.col("text").alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = docs.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "margin": F.lit(0.0)}).schema
    found = used.mapInArrow(run, schema)
    return found.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < min_margin))


def training_fold(docs: DataFrame, buckets: int, left_out: int) -> Column:
    """True where crc32 of the id as text, modulo ``buckets``, is not ``left_out`` (null ids: true)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % buckets != left_out, F.lit(True))


def op10(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside fold 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(training_fold(docs, 4, 2)).select("text", "lang"))
    found = classify(docs, model)
    return found.select("doc_id", (~training_fold(found, 4, 2)).alias("held_out"), "lang_pred", "score", "margin", "rejected")
