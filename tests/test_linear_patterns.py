"""The search patterns find what the fixed patterns find, and stay linear on long runs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.operators.extract import extract_fields

WORDS = ["invoice", "inv", "Invoice", "number", "date", "from", "vendor", "supplier", "total", "amount", "due", "grand",
         "vat", "tax", "sales", "subtotal", "sub-total", "Jan", "5 May 2024", "12/3/24", "1-2-2024", "widget", "a",
         "&", ".", ",", "x9", "-", "#", ":", "$", "7", "1,2.5", "٣"]
GAPS = ["", " ", "  ", "   ", "\n", " \n", "\n ", "\t", "\r\n", "\x1c", " ", ":", " : ", "$", "\n\n "]


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            parts += [rng.choice(WORDS) if rng.random() < 0.6 else rng.choice("aA 9,.\n:") * rng.randrange(1, 4), rng.choice(GAPS)]
        out.append("".join(parts))
    return out


def plain(text, patterns):
    """Group 1 of the first pattern of the list that matches: verbatim patterns, all matches, first one."""
    found = [F.get(F.regexp_extract_all(text, F.lit(P.FIELD_FLAGS + P.to_java(p)), 1), 0) for p in patterns]
    return F.nullif(F.trim(F.coalesce(*found), F.lit(P.PY_WHITESPACE)), F.lit(""))


def test_same_fields_and_items_as_the_fixed_patterns(spark):
    rows = spark.createDataFrame([(t,) for t in texts(200_000, 11)], "text string").repartition(4)
    want = {f: plain("text", ps) for f, ps in P.FIELD_PATTERNS.items()}
    plain_items = P.java_item_pattern(guarded=False, pattern=P.LINE_ITEM_PATTERN)
    items = [F.regexp_extract_all("text", F.lit(plain_items), F.lit(g)) for g in range(5)]
    mine = [F.regexp_extract_all("text", F.lit(P.java_item_pattern()), F.lit(g)) for g in range(5)]
    strip = lambda a: F.transform(a, lambda x: F.trim(x, F.lit(P.PY_WHITESPACE)))
    same_items = (items[0] == mine[0]) & (strip(items[1]) == strip(mine[1]))
    for k in (2, 3, 4):
        same_items = same_items & (items[k] == mine[k])
    got = extract_fields(rows, keep_text=True)
    raw = lambda f: F.col(f + "_raw") if f in P.AMOUNT_FIELDS else F.col(f)
    differ = got.select("text", *[(~raw(f).eqNullSafe(w)).cast("int").alias(f) for f, w in want.items()],
                        (~same_items).cast("int").alias("items"))
    sums = differ.agg(*[F.sum(f).alias(f) for f in [*want, "items"]]).first().asDict()
    assert set(sums.values()) == {0}, (sums, differ.filter(" + ".join(sums) + " > 0").take(3))
    hits = got.agg(*[F.count(raw(f)).alias(f) for f in want]).first()
    assert min(hits) > 2000


@pytest.mark.parametrize("start", ["Total", "VAT", "Invoice", "Date", "From", "Amount", "Subtotal", "widget 3", "12", "From:", "a"])
@pytest.mark.parametrize("run,end", [(" ", "x"), (" ", "9"), ("\n", "%"), ("9", "x"), ("9", " %")])
def test_long_runs_are_linear(spark, start, run, end):
    rows = spark.createDataFrame([(1, start + run * 100_000 + end)], "doc_id long, text string")
    t0 = time.perf_counter()
    extract_fields(rows).collect()
    assert time.perf_counter() - t0 < 8  # the job itself; 1,600 spaces took two minutes by the plain patterns
