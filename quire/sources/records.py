"""Invoice records given as JSON, in which any key may be absent, null or of another type in any record.

Each record is parsed once into a VARIANT, from which typed columns are taken. ``present`` lists the keys that a record has, and
each item has a list of its own, so that a default applies to an absent key and not to a null one, row by row:
:func:`quire.operators.targets.to_target` (I1–I3) and :func:`quire.operators.validate.validate` (V1, V9) read them.

Amounts follow the record's own type: a number is a converted amount; text stays text in ``<amount>_raw`` and is read as
``float`` reads it; anything else (an object, a list) is no number. ``true`` and ``false`` are 1 and 0. Records that are
no JSON object, and JSON that does not parse, give a row without keys whose ``record_ok`` is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import AMOUNT_FIELDS, FIELD_ORDER, PY_WHITESPACE
from ..functions.text import parse_double

ITEM_KEYS = ("description", "quantity", "unit_price", "total")
OTHER_KEYS = ("line_items", "confidence_scores", "validation_status", "anomaly_flags")


def _at(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _kind(x: Column) -> Column:
    """``STRING``, ``BIGINT``, ``OBJECT<…`` … of a VARIANT; NULL where the key is absent."""
    return F.schema_of_variant(x)


def _text(x: Column) -> Column:
    """Text as it is; a number or flag as it is written; NULL for null and absent."""
    return F.try_variant_get(x, "$", "string")


def _number(x: Column, kind: Column) -> Column:
    text = F.trim(_text(x), F.lit(PY_WHITESPACE))
    flag = F.try_variant_get(x, "$", "boolean").cast("int").cast("double")
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(kind == "STRING", parse_double(text)).when(kind == "BOOLEAN", flag).when(~nested, F.try_variant_get(x, "$", "double"))


def _present(v: Column, keys: tuple[str, ...]) -> Column:
    """Those of ``keys`` that the object has, null ones included."""
    return F.filter(F.array(*[F.when(_at(v, k).isNotNull(), F.lit(k)) for k in keys]), lambda k: k.isNotNull())


def _item(x: Column, i: Column) -> Column:
    number = lambda k: _number(_at(x, k), _kind(_at(x, k)))
    return F.struct(
        (i + 1).cast("int").alias("item_no"), _text(_at(x, "description")).alias("description"), number("quantity").alias("quantity"),
        number("unit_price").alias("unit_price"), number("total").alias("total"), _present(x, ITEM_KEYS).alias("present"))


def read_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` (JSON text in ``column``) as invoices: the columns of an extraction, ``present`` and ``record_ok``."""
    kept = [c for c in lines.columns if c != column]
    v = F.col("_v")
    parsed = lines.select(*[F.col(f"`{c}`") for c in kept], F.try_parse_json(F.col(f"`{column}`")).alias("_v"))
    parsed = parsed.withColumn("record_ok", F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)))
    amounts = []
    for f in AMOUNT_FIELDS:
        x, kind = _at(v, f), _kind(_at(v, f))
        amounts += [_text(x).alias(f + "_raw"), _number(x, kind).alias(f)]
    texts = [_text(_at(v, f)).alias(f) for f in FIELD_ORDER if f not in AMOUNT_FIELDS]
    # an amount given as text counts as captured, not as converted
    converted = F.create_map(*[p for f in AMOUNT_FIELDS for p in (F.lit(f), F.coalesce(_kind(_at(v, f)) != "STRING", F.lit(False)))])
    items = F.transform(_at(v, "line_items", "array<variant>"), _item)
    return parsed.select(
        *[F.col(f"`{c}`") for c in kept], *texts, *amounts, converted.alias("converted"), items.alias("line_items"),
        _at(v, "confidence_scores", "map<string,double>").alias("confidence"), _text(_at(v, "validation_status")).alias("validation_status"),
        _at(v, "anomaly_flags", "array<string>").alias("anomaly_flags"), _present(v, (*FIELD_ORDER, *OTHER_KEYS)).alias("present"), "record_ok")
