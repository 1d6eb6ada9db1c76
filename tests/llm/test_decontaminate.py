"""Decontamination against a plain window search, on odd rows and in several blocks."""

import re

import pytest
from pyspark.sql import functions as F

from quire.llm.decontaminate import contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for name, t in items:
            b = words(t)
            n = min(window, len(b))
            wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found.add(name or "")
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


DOCS = [
    (1, "Start the quick Brown fox, jumps over the lazy dog again and again end"), (2, None), (3, ""), (4, "... !!"),
    (5, "über straße x"), (6, "a b a b a b a b a b a b a b a b"), (6, "a b a b a b a b a b a b a b a b"), (None, "one two three four five"),
    (8, "filler " * 30000 + "quick brown fox jumps over the lazy dog again and"), (9, "quick brown fox"), (10, "the"), (11, "lone ÜBER STRASSE"),
]
ITEMS = [("i1", "The quick brown fox jumps over the lazy dog again, and again"), ("i2", "Straße X"), ("i3", "a b a b a b a b a b a"), (None, "two-three"), ("i5", None), ("i6", "--"), ("i7", "lone"), ("i1", "three four")]


@pytest.mark.parametrize("block", [200_000, 2])
def test_matches_window_search(spark, block):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, items int")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = contaminated(docs, items, block_windows=block).collect()
    seen = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in got), key=str)
    assert seen == brute(DOCS, ITEMS, 10)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert contaminated(docs.limit(0), items).count() == 0
    assert contaminated(docs, items.limit(0)).filter(F.size("spans") > 0).count() == 0
