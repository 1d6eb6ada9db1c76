"""Field and line-item extraction from document text, as native column expressions.

``extract_fields(docs)`` turns ``(doc_id, text, …)`` into one typed invoice row per document (columns in its docstring). It is a narrow, shuffle-free projection; every regex is evaluated once per
row. Filtering on an extracted column right after this projection makes Catalyst push the filter below it and
evaluate the regex twice, so materialise (write or ``persist``) extracted tables before filtering them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import (
    AMOUNT_FIELDS,
    CONFIDENCE_SCORE,
    FIELD_ORDER,
    PLAIN_WHITESPACE,
    SEARCH_PATTERNS,
    WHOLE_GROUPS,
    java_field_pattern,
    java_item_pattern,
)
from ..functions.text import col_of, first_of, is_ascii, parse_amount, parse_double, parse_whole, ustrip

ITEM_STRUCT = "struct<item_no:int,description:string,quantity:decimal(38,0),unit_price:double,total:double>"


def with_fields(docs: DataFrame, text_col: str = "text", patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs`` with one column per field (amounts as captured, ``<field>_raw``), each by the E0 cascade."""
    name = lambda f: f if f not in AMOUNT_FIELDS else f + "_raw"
    forms = lambda plain: {name(f): [java_field_pattern(p, plain) for p in ps] for f, ps in (patterns or SEARCH_PATTERNS).items()}
    if patterns:
        return first_of(docs, text_col, forms(False))
    rows = docs if PLAIN in docs.columns else _with_plain(docs, text_col)
    return first_of(rows, text_col, forms(False), PLAIN, forms(True), {name(f) for f in WHOLE_GROUPS}).drop(PLAIN)


PLAIN = "_plain"


def _with_plain(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the text where it is ASCII alone, which the forms of the patterns for such texts search."""
    return docs.withColumn(PLAIN, F.when(is_ascii(F.col(text_col)), F.col(text_col)))


def line_item_matches(text: Column | str, guarded: bool = True, plain: bool = False) -> Column:
    """E8 scan: every non-overlapping match (group 0) of the line-item pattern, left to right."""
    return F.regexp_extract_all(col_of(text), F.lit(java_item_pattern(guarded, plain=plain)), 0)


ITEM_SEP, GROUP_SEP = "\u0002", "\u0000"  # never inside a match: not letters, whitespace, digits, ',', '.', '$'


def line_items_column(text: Column | str, guarded: bool = True, plain: Column | str | None = None) -> Column:
    """``array<struct<item_no, description, quantity, unit_price, total>>`` before the conversion check.

    The guarded scan finds the matches; they are joined with a separator that no match can contain and the
    (unguarded) pattern is applied once more to that short string, rewriting every match to its four groups —
    one extra pass over the matched text instead of four regex calls per item. Re-matching a match on its own
    yields the same groups, and the separator keeps matches from running into each other. ``plain`` holds the text
    where it is ASCII alone and is NULL elsewhere; it is scanned with the form for such texts, and its groups need
    neither other scripts' digits nor other whitespace looked for, item by item.
    """
    groups = "$1" + GROUP_SEP + "$2" + GROUP_SEP + "$3" + GROUP_SEP + "$4"

    def found(source: Column | str, is_plain: bool) -> Column:
        joined = F.array_join(line_item_matches(source, guarded, is_plain), ITEM_SEP)
        return F.regexp_replace(joined, F.lit(java_item_pattern(guarded=False, plain=is_plain)), F.lit(groups))

    every = _items(found(text, False), ustrip, parse_whole, parse_amount)
    if plain is None:
        return every
    # only amounts hold commas
    own = _items(F.replace(found(plain, True), F.lit(","), F.lit("")), lambda s: F.trim(s, F.lit(PLAIN_WHITESPACE)),
                 lambda s: s.try_cast("decimal(38,0)"), lambda s: s.try_cast("double"))
    return F.when(col_of(plain).isNull(), every).otherwise(own)


def _items(joined: Column, strip: Callable[[Column], Column], whole: Callable[[Column], Column], amount: Callable[[Column], Column]) -> Column:
    """The item structs of the joined matches, each rewritten to its four groups."""

    def item(g: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).cast("int").alias("item_no"),
            strip(g[0]).alias("description"),
            whole(g[1]).alias("quantity"),
            amount(g[2]).alias("unit_price"),
            amount(g[3]).alias("total"),
        )

    groups_of = F.transform(F.filter(F.split(joined, ITEM_SEP), lambda r: r != ""), lambda r: F.split(r, GROUP_SEP))
    return F.transform(groups_of, item)


def confidence_column(fields: dict[str, Column | str]) -> Column:
    """``{field: 0.8}`` for every field that was stored, in field order."""
    kv = []
    for f in fields:
        kv += [F.lit(f), F.when(col_of(fields[f]).isNotNull(), F.lit(CONFIDENCE_SCORE))]
    return F.map_filter(F.create_map(*kv), lambda k, v: v.isNotNull())


def extract_fields(
    docs: DataFrame,
    text_col: str = "text",
    patterns: dict[str, list[str]] | None = None,
    keep_text: bool = False,
    guarded: bool = True,
) -> DataFrame:
    """The full invoice record for every document.

    Output: the input columns (minus the text unless ``keep_text``) plus ``invoice_number, invoice_date,
    supplier, total_raw, vat_raw, subtotal_raw, total, vat, subtotal, line_items, items_ok, parse_ok,
    converted, confidence`` (``converted.<amount>``: the amount was turned into a number at extraction).

    E7/E10/G5 failure cascade, expressed without exceptions: line-item conversion runs first; if any item's price
    or total does not convert, ``line_items`` is empty and no amount is converted. Otherwise total, vat, subtotal
    convert in that order and the first failure stops the rest. An amount left unconverted is read later as a
    plain number (``float(raw)`` without removing commas), which is what ``total``/``vat``/``subtotal`` hold.
    """
    fields = list(patterns or SEARCH_PATTERNS)
    keep = [c for c in docs.columns if keep_text or c != text_col]
    found = with_fields(_with_plain(docs, text_col).withColumn("_items", line_items_column(text_col, guarded, PLAIN)), text_col, patterns)
    stage1 = found.select(*keep, *[f if f not in AMOUNT_FIELDS else f + "_raw" for f in fields], "_items")
    items_ok = F.forall("_items", lambda x: x["unit_price"].isNotNull() & x["total"].isNotNull())
    # each amount is read once: the columns below refer to it several times
    number = {f: F.col("_n_" + f) for f in AMOUNT_FIELDS}
    stage2 = stage1.withColumns({"items_ok": items_ok, **{"_n_" + f: parse_amount(F.col(f + "_raw")) for f in AMOUNT_FIELDS}})

    attempt = F.col("items_ok")
    amounts: dict[str, Column] = {}
    converted: dict[str, Column] = {}
    for f in AMOUNT_FIELDS:
        raw = F.col(f + "_raw")
        amounts[f] = F.when(attempt, number[f]).otherwise(parse_double(raw))
        converted[f] = attempt & number[f].isNotNull()
        attempt = attempt & (raw.isNull() | number[f].isNotNull())
    parse_ok = attempt

    stored = {f: (F.col(f) if f not in AMOUNT_FIELDS else F.col(f + "_raw")) for f in FIELD_ORDER if f in fields}
    out_cols = [c for c in stage1.columns if c != "_items"]
    return stage2.select(
        *out_cols,
        *[amounts[f].alias(f) for f in AMOUNT_FIELDS],
        F.when(F.col("items_ok"), F.col("_items"))
        .otherwise(F.array().cast(f"array<{ITEM_STRUCT}>"))
        .alias("line_items"),
        F.col("items_ok"),
        parse_ok.alias("parse_ok"),
        F.struct(*[converted[f].alias(f) for f in AMOUNT_FIELDS]).alias("converted"),
        confidence_column(stored).alias("confidence"),
    )


def extract_line_items(invoices: DataFrame, key: str = "doc_id") -> DataFrame:
    """The line-item child table ``(doc_id, item_no, description, quantity, unit_price, total)``.

    ``inline_outer`` + a filter on the generated column, not ``inline``: an inner generator makes Catalyst infer
    ``size(line_items) > 0`` and push it below the extraction, which would evaluate the item scan again.
    """
    return explode_items(invoices.select(key, "line_items"), "line_items")


def explode_items(df: DataFrame, col: str) -> DataFrame:
    """``inline`` of an array of structs without the inferred (and pushed-down) non-empty filter."""
    keep = [c for c in df.columns if c != col]
    first = df.schema[col].dataType.elementType.fieldNames()[0]
    return df.select(*keep, F.inline_outer(col)).where(F.col(first).isNotNull())


def merge_entities(invoices: DataFrame, entities: DataFrame, key: str = "doc_id", with_lists: bool = False) -> DataFrame:
    """NER entities merged into the pattern result.

    ``entities(doc_id, ord, label, text)``; the supplier falls back to the first ORG (lowest ``ord``) when the
    pattern found none. The fallback needs only ``min_by`` per document (constant state, map-side partial
    aggregation); ``with_lists`` also attaches the ORG/DATE/MONEY lists in document order.
    """
    aggs = [F.min_by(F.when(F.col("label") == "ORG", F.col("text")),
                     F.when(F.col("label") == "ORG", F.col("ord"))).alias("_first_org")]
    if with_lists:
        for label, name in (("ORG", "organizations"), ("DATE", "dates"), ("MONEY", "money")):
            aggs.append(
                F.sort_array(F.collect_list(F.when(F.col("label") == label, F.struct("ord", "text"))))["text"].alias(name)
            )
    ents = entities.groupBy(key).agg(*aggs)
    merged = invoices.join(ents, key, "left")
    out = merged.withColumn("supplier", F.coalesce(F.col("supplier"), F.col("_first_org"))).drop("_first_org")
    if with_lists:
        for name in ("organizations", "dates", "money"):
            out = out.withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")))
    return out
