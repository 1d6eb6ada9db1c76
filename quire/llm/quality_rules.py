"""Quality rules whose limits follow the corpus: quantile sketches per language and source instead of fixed cutoffs.

1. ``measure``: counts of every whole text as one projection of array functions (no UDF, no explode). Word windows are
   compared by 64-bit hashes inside one text; only texts in which a window occurs twice sort their windows.
2. ``sketches``: each measure falls into a logarithmic bin (relative error ``ACCURACY``), and the sketch of a group is its
   bins with their counts. Sketches are merged by adding counts, so map tasks, sources and languages add up alike,
   and a group has a bounded number of rows however many documents it has.
3. ``limits``: quartiles from the merged sketches; a value is an outlier beyond ``reach`` quartile distances from the
   quartiles, where a distance counts as ``least`` at least. A (language, source) with under ``least_rows`` documents takes
   the merged sketch of its language, a language with fewer that of all documents. Shares that are 0 in three quarters of
   a group have the quartiles 0, so that their limit is the constant ``reach`` times ``least`` (README, ``op2``).
4. ``judge`` joins the limits to the documents.

Defined results: null texts count as empty; nulls in lang or source are groups of their own; repeated rows are judged
row by row and count as often as they occur; an empty table gives no rows; extra columns pass through, but for those
named like a result, which are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Relative error of a value read from a sketch, and the least value that has a bin of its own.
ACCURACY, LEAST = 0.01, 1e-6
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Measures with their least quartile distance; and those for which low values are outliers too.
SPREAD = {"symbol_share": 0.01, "repeat_share": 0.05, "dup_line_share": 0.08, "word_length": 0.4}
BOTH_SIDES = ("word_length",)
#: Names used on the way.
_OWN = ("_w", "_l", "_h", "_x", "_s", "_lang", "_source")


def measure(docs: DataFrame, window: int = 8) -> DataFrame:
    """``docs`` without text, with the COUNTS of each row."""
    kept = [c for c in docs.columns if c.lower() not in ("text", *COUNTS, "base_failed", "kept", *_OWN)]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    one = docs.select(*kept, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("_l"))
    two = one.select(
        *kept, "n_symbols", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    last = F.greatest(F.size("_h") - window + 1, F.lit(0))
    hashed = F.transform("_h", lambda h, i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(window)]))
    three = two.withColumn("_x", F.slice(hashed, 1, last)).drop("_h")
    several = F.size(F.array_distinct("_x")) < F.size("_x")
    placed = F.array_sort(F.transform("_x", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    four = three.withColumn("_s", F.when(several, placed)).drop("_x")
    twice = F.filter("_s", lambda s, k: F.coalesce(s["x"] == F.get(F.col("_s"), k - 1)["x"], F.lit(False)) | F.coalesce(s["x"] == F.get(F.col("_s"), k + 1)["x"], F.lit(False)))
    starts = F.array_sort(F.transform(twice, lambda s: s["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-window).alias("at"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(window), i - a["at"])).alias("n")), lambda a: a["n"],
    )
    return four.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(*kept, *COUNTS)


def _shares() -> dict[str, Column]:
    def over(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return {"symbol_share": over("n_symbols", "word_chars"), "repeat_share": over("n_repeat_words", "n_words"), "dup_line_share": over("n_dup_lines", "n_lines"), "word_length": over("word_chars", "n_words")}


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): values under LEAST have the bin null."""
    each = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in _shares().items()])
    rows = measured.select("lang", "source", F.inline(each))
    bin_ = F.when(F.col("value") >= LEAST, F.ceil(F.log("value") / F.lit(math.log(_GAMMA))).cast("int"))
    return rows.groupBy("lang", "source", "measure", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of larger groups."""
    return sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, rows, q1, q3): the value of the bin that holds the quartile's rank."""
    order = Window.partitionBy(*by, "measure").orderBy(F.col("bin").asc_nulls_first())
    upto = sketch.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rows", F.sum("n").over(Window.partitionBy(*by, "measure")))
    value = F.coalesce(F.lit(2 / (_GAMMA + 1)) * F.pow(F.lit(_GAMMA), F.col("bin")), F.lit(0.0))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("rows") - 1)), value))

    return upto.groupBy(*by, "measure").agg(F.max("rows").alias("rows"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def limits(sketch: DataFrame, reach: float = 6.0, least_rows: int = 100) -> DataFrame:
    """(lang, source) with columns low_ and high_ of every measure."""
    held = written(sketch, "sketch")
    levels = [quartiles(merge(held, by), by) for by in (["lang", "source"], ["lang"], [])]
    small, middle, large = (x.select(*x.columns[:-4], "measure", F.struct("rows", "q1", "q3").alias(f"_{k}")) for k, x in enumerate(levels))
    both = small.alias("a").join(middle.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.measure") == F.col("b.measure"))).select("a.lang", "a.source", "a.measure", "_0", "_1")
    every = both.join(large, "measure")
    used = F.when(F.col("_0.rows") >= least_rows, F.col("_0")).when(F.col("_1.rows") >= least_rows, F.col("_1")).otherwise(F.col("_2"))
    spread = F.create_map(*[F.lit(x) for kv in SPREAD.items() for x in kv])
    far = F.lit(float(reach)) * F.greatest(F.col("q.q3") - F.col("q.q1"), spread[F.col("measure")])
    rows = every.select("lang", "source", "measure", used.alias("q")).select("lang", "source", "measure", (F.col("q.q1") - far).alias("low"), (F.col("q.q3") + far).alias("high"))
    wide = [F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}") for m in SPREAD for c in ("low", "high")]
    return rows.groupBy("lang", "source").agg(*wide)


def judge(measured: DataFrame, bounds: DataFrame, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """``measured`` with base_failed and kept."""
    names = measured.columns
    bounds = bounds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*[c for c in bounds.columns if c not in ("lang", "source")]).alias("_x"))
    rows = measured.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fine = F.lit(True)
    for m, v in _shares().items():
        fine = fine & F.coalesce(v <= F.col(f"_x.high_{m}"), F.lit(True))
        if m in BOTH_SIDES:
            fine = fine & F.coalesce(v >= F.col(f"_x.low_{m}"), F.lit(True))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine).select(*names, "base_failed", "kept")


def apply_rules(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang, source, ...) without text, with COUNTS, base_failed and kept."""
    measured = written(measure(docs), "measured")
    return judge(measured, limits(sketches(measured)))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM w WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_rep
        FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
             coalesce(n_rep, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT doc_id, lang, source, unnest(['symbol_share', 'repeat_share', 'dup_line_share', 'word_length']) AS measure,
             unnest([CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END,
                     CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END]::DOUBLE[]) AS value FROM m),
b AS (SELECT *, CASE WHEN value >= 1e-6 THEN ceil(ln(value) / ln(1.01::DOUBLE / 0.99)) END AS bin FROM v),
g AS (SELECT measure, lang, source, 0 AS lvl, bin, count(*) AS n FROM b GROUP BY ALL
      UNION ALL SELECT measure, lang, NULL, 1, bin, count(*) FROM b GROUP BY measure, lang, bin
      UNION ALL SELECT measure, NULL, NULL, 2, bin, count(*) FROM b GROUP BY measure, bin),
c AS (SELECT *, sum(n) OVER (PARTITION BY measure, lang, source, lvl ORDER BY bin NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY measure, lang, source, lvl) AS nrows,
             coalesce(2 / (1.01::DOUBLE / 0.99 + 1) * pow(1.01::DOUBLE / 0.99, bin), 0) AS val FROM g),
q AS (SELECT measure, lang, source, lvl, max(nrows) AS nrows, min(CASE WHEN upto > floor(0.25 * (nrows - 1)) THEN val END) AS q1,
             min(CASE WHEN upto > floor(0.75 * (nrows - 1)) THEN val END) AS q3 FROM c GROUP BY ALL),
u AS (SELECT a.measure, a.lang, a.source, CASE WHEN a.nrows >= 100 THEN a.q1 WHEN b.nrows >= 100 THEN b.q1 ELSE z.q1 END AS q1,
             CASE WHEN a.nrows >= 100 THEN a.q3 WHEN b.nrows >= 100 THEN b.q3 ELSE z.q3 END AS q3
      FROM q a JOIN q b ON b.lvl = 1 AND a.measure = b.measure AND a.lang IS NOT DISTINCT FROM b.lang JOIN q z ON z.lvl = 2 AND a.measure = z.measure WHERE a.lvl = 0),
l AS (SELECT measure, lang, source, q1 - 6 * greatest(q3 - q1, least_) AS low, q3 + 6 * greatest(q3 - q1, least_) AS high
      FROM u JOIN (VALUES ('symbol_share', 0.01::DOUBLE), ('repeat_share', 0.05::DOUBLE), ('dup_line_share', 0.08::DOUBLE), ('word_length', 0.4::DOUBLE)) s(measure, least_) USING (measure)),
j AS (SELECT doc_id, bool_and(value <= high AND (v.measure <> 'word_length' OR value >= low)) AS fine
      FROM v JOIN l ON v.measure = l.measure AND v.lang IS NOT DISTINCT FROM l.lang AND v.source IS NOT DISTINCT FROM l.source GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m) JOIN j USING (doc_id)
"""
