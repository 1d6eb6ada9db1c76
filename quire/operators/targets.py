"""Target-system layouts (generic, SAP, Oracle) and their outbox, as projections.

A target gives the columns of one layout for an invoice frame; several targets fan out from one written frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import ORACLE_CONSTANTS, SAP_CONSTANTS, TARGET_LABELS, VALIDATION_STATUS_DEFAULT

Layout = Callable[[DataFrame], list[Column]]


def _of(df: DataFrame, name: str, default, column: str | None = None) -> Column:
    """A field of the record: the default applies where the key is absent; NULLs pass through.

    Absent means no such column; in a frame with ``present`` (the keys of each record) also a key not listed there.
    """
    column = column or name
    given = default if isinstance(default, Column) else F.lit(default)
    if column not in df.columns:
        return given
    if "present" not in df.columns:
        return F.col(column)
    return F.when(F.array_contains("present", name), F.col(column)).otherwise(given)


def _items(df: DataFrame) -> Column:
    """The line items without their lists of keys; an absent key is an empty list."""
    if "line_items" not in df.columns:
        return F.array().cast("array<string>")
    kind = df.schema["line_items"].dataType.elementType
    fields = [f for f in kind.fieldNames() if f != "present"]
    items = F.col("line_items") if len(fields) == len(kind.fieldNames()) else F.transform("line_items", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return F.when(F.array_contains("present", "line_items"), items).otherwise(F.array()) if "present" in df.columns else items


def generic(df: DataFrame) -> list[Column]:
    """I1."""
    conf = _of(df, "confidence_scores", F.create_map().cast("map<string,double>"), "confidence")
    flags = _of(df, "anomaly_flags", F.array().cast("array<string>"))
    return [
        _of(df, "supplier", "").alias("vendor"),
        _of(df, "invoice_number", "").alias("invoice_number"),
        _of(df, "invoice_date", "").alias("invoice_date"),
        _of(df, "subtotal", 0.0).alias("subtotal"),
        _of(df, "vat", 0.0).alias("tax_amount"),
        _of(df, "total", 0.0).alias("total_amount"),
        _items(df).alias("line_items"),
        F.struct(conf.alias("extraction_confidence"),
                 _of(df, "validation_status", VALIDATION_STATUS_DEFAULT).alias("validation_status"),
                 flags.alias("anomaly_flags")).alias("metadata"),
    ]


def sap(df: DataFrame) -> list[Column]:
    """Tax and subtotal are not part of the layout."""
    return [
        F.lit(SAP_CONSTANTS["BUKRS"]).alias("BUKRS"), _of(df, "supplier", "").alias("LIFNR"),
        _of(df, "invoice_date", "").alias("BLDAT"), _of(df, "total", 0.0).alias("WRBTR"),
        F.lit(SAP_CONSTANTS["WAERS"]).alias("WAERS"), _of(df, "invoice_number", "").alias("XBLNR"),
        F.lit(SAP_CONSTANTS["BSART"]).alias("BSART"), _items(df).alias("ITEMS"),
    ]


def oracle(df: DataFrame) -> list[Column]:
    """``description`` is ``Invoice <number>`` (NULL when the number is NULL)."""
    number = _of(df, "invoice_number", "")
    return [
        _of(df, "supplier", "").alias("vendor_id"), number.alias("invoice_num"),
        _of(df, "invoice_date", "").alias("invoice_date"), _of(df, "total", 0.0).alias("invoice_amount"),
        _of(df, "vat", 0.0).alias("tax_amount"), F.lit(ORACLE_CONSTANTS["currency_code"]).alias("currency_code"),
        F.lit(ORACLE_CONSTANTS["invoice_type_lookup_code"]).alias("invoice_type_lookup_code"),
        F.concat(F.lit(ORACLE_CONSTANTS["description_prefix"]), number).alias("description"),
        _items(df).alias("lines"),
    ]


LAYOUTS: dict[str, Layout] = {"generic": generic, "sap": sap, "oracle": oracle}


class TargetRegistry:
    """Several named targets."""

    def __init__(self) -> None:
        self._targets: dict[str, Layout] = {}

    def register(self, name: str, layout: Layout) -> None:
        self._targets[name] = layout

    def get(self, name: str) -> Layout | None:
        return self._targets.get(name)

    def names(self) -> list[str]:
        return list(self._targets)

    def fan_out(self, df: DataFrame) -> dict[str, DataFrame]:
        return {n: _project(df, t) for n, t in self._targets.items()}


def target(name: str) -> Layout:
    """Case-insensitive lookup; unknown names raise ``ValueError``."""
    hit = LAYOUTS.get(name.lower())
    if hit is None:
        raise ValueError(f"Unknown ERP type: {name}")
    return hit


def _project(df: DataFrame, layout: Layout) -> DataFrame:
    return df.select(*(["doc_id"] if "doc_id" in df.columns else []), *layout(df))


def to_target(df: DataFrame, name: str) -> DataFrame:
    return _project(df, target(name))


def target_record(df: DataFrame, name: str) -> Column:
    """The target's layout of each row as one struct column."""
    return F.struct(*target(name)(df))


def outbox(df: DataFrame, name: str) -> DataFrame:
    """I4: what is to be sent to a target, one row per invoice: ``target, label, document_id, payload`` (JSON).

    The id is the invoice number for every target. Nothing is sent; whoever sends the rows records the outcome.
    """
    return df.select(
        *(["doc_id"] if "doc_id" in df.columns else []), F.lit(name.lower()).alias("target"),
        F.lit(TARGET_LABELS[name.lower()]).alias("label"), _of(df, "invoice_number", "").alias("document_id"),
        F.to_json(target_record(df, name), {"ignoreNullFields": "false"}).alias("payload"))
