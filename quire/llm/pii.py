"""PII: personal data by pattern, and terms that give it away by co-occurrence in the corpus. DataFrame functions only.

1. ``find`` locates e-mail and IP addresses, card and phone numbers. Matches and the text between them come from one
   scan each, and their lengths add up to positions, so cost follows the text. The patterns are possessive forms of
   the plain ones (stated at PLAIN): they find the same matches, without backtracking over long runs.
2. ``disclosing`` takes the values found as protected entities. A term t next to an entity e discloses the share
   PMI(e; t) / IC(e) of the information in e, with PMI = log(N n(e,t) / (n(e) n(t))) and IC = log(N / n(e)) over all N
   documents; all counts are of whole documents. Terms are letter runs that stand next to e at least once. A term counts
   if it meets e in ``least_contexts`` different contexts, or in fewer when so many are unlikely by chance: the first
   meeting is how the pair was found, and the others have the probability L^k / k! at most (k = contexts - 1, L = contexts
   of e times n(t) / N), which has to be under ``chance``. So rare entities have terms too, copies of one passage are one
   context, and one context alone is no evidence. It has to disclose at least ``generalise_at``; from ``remove_at`` on it
   is to be removed.
3. ``spans`` adds those terms wherever they stand in a document that holds the entity.
4. ``sanitise`` replaces spans by their kind and drops those to be removed.

Defined results: null texts are empty; positions count code points; rows that are equal share their spans; null ids are treated
like any other; empty tables give no rows; a text may hold any number of entities, at a cost in proportion to them; in ``sanitise`` nulls stay null, and all columns but text are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import written

#: FIXED VALUES: the patterns that define the base spans.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PLAIN)
#: The same matches found in one go. A run of an address's first part is tried at its start only (or where the last
#: match ended), as all its later starts meet the same "@"; card runs of under 12 digits fail the check on length.
FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_TERM = r"\p{L}{2,}"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
#: Prefix sums are made in stretches of this many entries.
_STRETCH = 256
#: Texts are cut in pieces of so many code points.
_PIECE = 4096


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        digits = F.translate(x, " -", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(x, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _value(kind: str, x: Column) -> Column:
    """What makes two finds the same entity."""
    return F.lower(x) if kind == "email" else x if kind == "ip" else F.regexp_replace(x, "[^0-9]", "")


def _sums(numbers: Column) -> Column:
    """Inclusive prefix sums."""
    none = F.array().cast("array<int>")
    return F.aggregate(numbers, none, lambda a, x: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x))


def _positions(rows: DataFrame, text: str, gate: Column, pattern: Column, name: str) -> DataFrame:
    """``rows`` with matches ``name`` and their end positions ``name``_end, two columns of equal length."""
    m, parts, size, local, base = (f"{name}{x}" for x in ("", "_parts", "_size", "_local", "_base"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn(m, F.when(gate, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none))
    rows = rows.withColumn(parts, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none))
    # arrays are walked side by side: one that a lambda names once is computed anew for every element
    rows = rows.withColumn(size, F.zip_with(m, F.slice(parts, F.lit(1), F.size(m)), lambda x, p: F.length(p) + F.length(x))).drop(parts)
    count = F.ceil(F.size(size) / _STRETCH).cast("int")
    stretches = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: _sums(F.slice(F.col(size), b * _STRETCH + 1, _STRETCH)))).otherwise(F.array().cast("array<array<int>>"))
    rows = rows.withColumn(local, stretches).drop(size)
    rows = rows.withColumn(base, _sums(F.transform(local, lambda s: F.get(s, F.size(s) - 1))))
    ends = F.flatten(F.transform(local, lambda s, b: F.transform(s, lambda x: x + F.coalesce(F.get(F.col(base), b - 1), F.lit(0)))))
    return rows.withColumn(f"{name}_end", ends).drop(local, base)


def _maxima(numbers: Column) -> Column:
    """Inclusive running maxima."""
    none = F.array().cast("array<int>")
    return F.aggregate(numbers, none, lambda a, x: F.array_append(a, F.greatest(F.coalesce(F.get(a, F.size(a) - 1), x), x)))


def _running(rows: DataFrame, numbers: Column, name: str) -> DataFrame:
    """``rows`` with the inclusive running maxima of ``numbers``, made in stretches."""
    rows = rows.withColumn("_numbers", numbers)
    count = F.ceil(F.size("_numbers") / _STRETCH).cast("int")
    stretches = F.transform(F.sequence(F.lit(0), count - 1), lambda b: _maxima(F.slice("_numbers", b * _STRETCH + 1, _STRETCH)))
    rows = rows.withColumn("_local", F.when(count > 0, stretches).otherwise(F.array().cast("array<array<int>>"))).drop("_numbers")
    rows = rows.withColumn("_base", _maxima(F.transform("_local", lambda s: F.get(s, F.size(s) - 1))))
    whole = F.flatten(F.transform("_local", lambda s, b: F.transform(s, lambda x: F.greatest(x, F.coalesce(F.get(F.col("_base"), b - 1), F.lit(0))))))
    return rows.withColumn(name, whole).drop("_local", "_base")


def _gate(kind: str) -> Column:
    if kind == "email":
        return F.contains(F.col("_t"), F.lit("@"))
    return F.contains(F.col("_t"), F.lit("+")) if kind == "phone" else F.col("_t").rlike("[0-9]")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``found``: base spans as (start, rank, end, kind, value) by start, then kind as listed."""
    rows = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    found = []
    for rank, kind in enumerate(KINDS):
        rows = _positions(rows, "_t", _gate(kind), F.lit(FAST[kind]), f"_{kind}")
        found.append(_checked(kind, rank))
    return rows.withColumn("found", F.array_sort(F.concat(*found)).cast(_SPAN)).drop("_t", *[f"_{k}{x}" for k in KINDS for x in ("", "_end")])


def _checked(kind: str, rank: int) -> Column:
    """The matches of a kind that pass its check, as spans."""

    def span(x: Column, i: Column) -> Column:
        e = F.get(F.col(f"_{kind}_end"), i)
        return F.when(_valid(kind, x), F.struct((e - F.length(x)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(kind).alias("kind"), _value(kind, x).alias("value")))

    return F.filter(F.transform(f"_{kind}", span), lambda s: s.isNotNull())


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _terms(text: Column) -> Column:
    """Distinct terms of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)))


def _stretched(text: str) -> Column:
    """A text in pieces of ``_PIECE`` code points, so that cutting something out of it does not count from its beginning."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / _PIECE)), lambda i: F.substring(F.col(text), (i * _PIECE + 1).cast("int"), F.lit(_PIECE)))


def _between(text: str, pieces: str, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text: from two of its pieces unless they are many."""
    at = F.floor(start / _PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(F.col(pieces), at), F.lit("")), F.coalesce(F.get(F.col(pieces), at + 1), F.lit("")))
    return F.when(end - start <= _PIECE, F.substring(two, start - at * _PIECE + 1, end - start)).otherwise(F.substring(F.col(text), start + 1, end - start))


def contexts(found: DataFrame, reach: int = 96) -> DataFrame:
    """(doc, kind, value, context, terms): a hash of the ``reach`` code points around an entity, and the terms in them."""
    rows = found.filter(F.size("found") > 0).select(_key().alias("doc"), "text", "found", _stretched("text").alias("pieces"), F.length("text").alias("length"))

    def around(s: Column) -> Column:
        left = _between("text", "pieces", F.greatest(s["start"] - reach, F.lit(0)), s["start"])
        right = _between("text", "pieces", s["end"], F.least(s["end"] + reach, F.col("length")))
        return F.struct(s["kind"].alias("kind"), s["value"].alias("value"), (s["start"] > reach).alias("cut"), left.alias("left"), right.alias("right"))

    rows = rows.select("doc", F.explode(F.transform("found", around)).alias("s")).select("doc", "s.*")
    left = F.when(F.col("cut"), F.regexp_replace("left", r"^[^\x20\x09-\x0D]++", "")).otherwise(F.col("left"))
    right = F.regexp_replace("right", r"[^\x20\x09-\x0D]+$", "")
    rows = rows.select("doc", "kind", "value", F.lower(F.concat(left, F.lit(" \n "), right)).alias("near"))
    return rows.select("doc", "kind", "value", F.xxhash64("near").alias("context"), _terms(F.col("near")).alias("terms"))


def _pairs(found: DataFrame, near: DataFrame) -> DataFrame:
    """(kind, value, term, contexts, both): documents with entity and term, and different contexts of the entity in them.

    Where the term stands next to the entity, those contexts count; where it stands elsewhere in the document, one does.
    Each document brings its text once, whatever its entities, and pairs are added up in the map tasks first.
    """
    places = near.groupBy("doc", F.struct("kind", "value").alias("e")).agg(F.collect_list(F.struct("context", "terms")).alias("places"))
    texts = found.filter(F.size("found") > 0).select(_key().alias("doc"), "text").dropDuplicates(["doc"]).select("doc", _terms(F.lower("text")).alias("all"))
    rows = texts.join(places, "doc").select("e", "places", F.explode("all").alias("term"))
    beside = F.array_distinct(F.transform(F.filter("places", lambda p: F.array_contains(p["terms"], F.col("term"))), lambda p: p["context"]))
    rows = rows.select("e", "term", beside.alias("beside"), F.array_min("places.context").alias("any"))
    rows = rows.select("e", "term", (F.size("beside") > 0).alias("near"), F.posexplode(F.when(F.size("beside") > 0, F.col("beside")).otherwise(F.array("any"))).alias("nth", "context"))
    once = rows.groupBy("e", "term", "context").agg(F.count_if(F.col("nth") == 0).alias("both"), F.max("near").alias("near"))
    pairs = once.groupBy("e", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("both").alias("both"), F.max("near").alias("near"))
    return pairs.filter("near").select("e.kind", "e.value", "term", "contexts", "both")


def disclosing(docs: DataFrame, found: DataFrame, least_contexts: int = 3, generalise_at: float = 0.8, remove_at: float = 0.95, chance: float = 0.05) -> DataFrame:
    """(kind, value, term, share, remove): terms that disclose an entity, counted over all documents."""
    near = written(contexts(found), "contexts")
    entities = near.groupBy("kind", "value").agg(F.count_distinct("doc").alias("n_entity"), F.count_distinct("context").alias("n_contexts"))
    # an entity of one context has no second meeting with any term
    several = entities.filter(F.col("n_contexts") >= min(2, least_contexts))
    pairs = _pairs(found, near.join(several.select("kind", "value"), ["kind", "value"])).filter(F.col("contexts") >= min(2, least_contexts))
    total = docs.count()
    # document frequency of every term of the corpus, added up in the map tasks first
    terms = docs.select(F.explode(_terms(F.lower("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    rows = pairs.join(several, ["kind", "value"]).join(terms, "term")
    n = F.lit(float(max(total, 1)))
    again = F.least(F.col("contexts") - 1, F.lit(20)).cast("int")
    by_chance = F.pow(F.col("n_contexts") * F.col("n_term") / n, again) / F.factorial(again)
    rows = rows.filter((F.col("contexts") >= least_contexts) | (by_chance <= chance))
    both = F.least("both", "n_term", "n_entity")
    pmi, ic = F.log2(n * both / (F.col("n_entity") * F.col("n_term"))), F.log2(n / F.col("n_entity"))
    share = F.when(ic > 0, pmi / ic).otherwise(0.0)
    return rows.withColumn("share", share).filter(F.col("share") >= generalise_at).select("kind", "value", "term", "share", (F.col("share") >= remove_at).alias("remove"))


def spans(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with ``found`` (base spans) and ``spans`` (all spans; terms have the kind "term" or "removed")."""
    # written before any filter: a filter on what was found would be pushed below the search and repeat it for every use
    found = written(find(docs), "found")
    personal = found.filter(F.size("found") > 0).select("doc_id", "text", "found")
    terms = disclosing(docs, personal, **thresholds)
    held = personal.select(_key().alias("doc"), F.explode("found").alias("s")).select("doc", "s.kind", "s.value").distinct()
    named = held.join(terms, ["kind", "value"]).groupBy("doc", "term").agg(F.max("remove").alias("remove")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "remove"))).alias("_terms"))
    named = written(named.withColumnRenamed("doc", "_doc"), "terms")
    rows = found.withColumn("_key", _key()).join(named, F.col("_key") == F.col("_doc"), "left").drop("_key", "_doc")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("_terms"), "|"), F.lit(r")(?!\p{L})"))
    rows = rows.withColumn("_p", F.coalesce(pattern, F.lit("(?!)"))).withColumn("_t", F.coalesce("text", F.lit("")))
    rows = _positions(rows, "_t", F.col("_terms").isNotNull(), F.col("_p"), "_x")

    def span(x: Column, i: Column) -> Column:
        e = F.get(F.col("_x_end"), i)
        kind = F.when(F.coalesce(F.try_element_at(F.col("_terms"), F.lower(x)), F.lit(False)), F.lit("removed")).otherwise(F.lit("term"))
        return F.struct((e - F.length(x)).alias("start"), F.lit(len(KINDS)).alias("rank"), e.alias("end"), kind.alias("kind"), F.lower(x).alias("value"))

    rows = rows.withColumn("_more", F.transform("_x", span).cast(_SPAN))
    apart = F.filter("_more", lambda m: ~F.exists(F.col("found"), lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    return rows.withColumn("spans", F.array_sort(F.concat("found", apart))).drop("_terms", "_p", "_t", "_x", "_x_end", "_more")


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with the spans of each text replaced by their kind in brackets; overlapping spans become one."""
    # all other columns travel as one, out of the way of the search's own names
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = spans(docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"at{i}") for i, c in enumerate(others)]).alias("_others")), **thresholds)
    rows = _running(rows.withColumn("_pieces", _stretched("text")), F.transform("spans", lambda s: s["end"]), "_upto")

    def step(s: Column, at: Column) -> Column:
        label = F.when(s["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.when(s["start"] >= at, F.concat(_between("text", "_pieces", at, s["start"]), label)).otherwise(F.lit(""))

    rest = F.substring(F.col("text"), F.element_at("_upto", -1) + 1, F.length("text"))
    before = F.slice(F.concat(F.array(F.lit(0)), F.col("_upto")), F.lit(1), F.size("spans"))
    text = F.concat(F.array_join(F.zip_with("spans", before, step), ""), rest)
    return rows.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))).select(*[F.col(f"_others.at{others.index(c)}").alias(c) if c in others else F.col(c) for c in docs.columns])


def _listed(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.when(s["kind"] == "removed", F.lit("term")).otherwise(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that disclose it."""
    rows = spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(F.array_remove(F.col("found.rank"), F.lit(k))) for k in range(len(KINDS))]
    counts = [(F.size("found") - n).cast("long").alias(f"n_{kind}") for n, kind in zip(counts, KINDS, strict=True)]
    return rows.select("doc_id", *counts, F.sha2(_listed("found"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
