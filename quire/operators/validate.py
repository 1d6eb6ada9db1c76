"""Data-quality validation of invoice rows, as one projection of native expressions.

``validate(invoices)`` appends ``errors``, ``warnings`` (arrays of finding structs), ``valid`` and
``invoice_date_parsed``. Order of findings: required fields, numeric checks, total consistency, line items;
warnings: VAT rate, then date. No shuffle, no UDF.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_of_col, with_parsed_date
from ..functions.text import parse_double, template
from .rules import RULE_FAILED, Rule, applied
from ..functions.patterns import (
    MSG_DATE_FUTURE,
    MSG_DATE_OLD,
    MSG_DATE_UNPARSEABLE,
    MSG_ITEM_MISMATCH,
    MSG_ITEM_MISSING,
    MSG_NEGATIVE,
    MSG_NOT_A_NUMBER,
    MSG_REQUIRED_MISSING,
    MSG_TOTAL_MISMATCH,
    MSG_UNUSUAL_VAT_RATE,
    AMOUNT_FIELDS,
    CALCULATION_TOLERANCE,
    DEFAULT_REQUIRED_FIELDS,
    DEFAULT_VAT_RATES,
    OLD_DATE_DAYS,
    PY_WHITESPACE,
    VAT_RATE_TOLERANCE,
)

FINDING = "struct<code:string,field:string,item_no:int,observed:double,expected:double,message:string>"
FINDINGS = f"array<{FINDING}>"

# Codes (stable identifiers; messages are display text only)
REQUIRED_MISSING = "required_missing"
NOT_A_NUMBER = "not_a_number"
NEGATIVE = "negative"
TOTAL_MISMATCH = "total_mismatch"
ITEM_FIELD_MISSING = "item_field_missing"
ITEM_TOTAL_MISMATCH = "item_total_mismatch"
UNUSUAL_VAT_RATE = "unusual_vat_rate"
UNPARSEABLE_DATE = "unparseable_date"
FUTURE_DATE = "future_date"
VERY_OLD_DATE = "very_old_date"
VALIDATION_ERROR = "validation_error"  # reserved: typed columns cannot raise
CODES = (REQUIRED_MISSING, NOT_A_NUMBER, NEGATIVE, TOTAL_MISMATCH, ITEM_FIELD_MISSING, ITEM_TOTAL_MISMATCH, UNUSUAL_VAT_RATE, UNPARSEABLE_DATE, FUTURE_DATE,
         VERY_OLD_DATE, RULE_FAILED)


def gt(a: Column, b: Column | float) -> Column:
    """Python's ``a > b`` for doubles: false when either side is NaN (Spark orders NaN above everything)."""
    b = b if isinstance(b, Column) else F.lit(b)
    return (a > b) & ~F.isnan(a) & ~F.isnan(b)


def finding(code: str, field: str | Column | None, message: Column | str, item_no: Column | None = None,
            observed: Column | None = None, expected: Column | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(code).alias("code"),
        lit(field).cast("string").alias("field"),
        (item_no if item_no is not None else F.lit(None)).cast("int").alias("item_no"),
        (observed if observed is not None else F.lit(None)).cast("double").alias("observed"),
        (expected if expected is not None else F.lit(None)).cast("double").alias("expected"),
        lit(message).cast("string").alias("message"),
    )


def _present(df: DataFrame, f: str) -> Column:
    """``f in data and data[f] is not None``: captured text counts as present even when it is not a number."""
    if f in AMOUNT_FIELDS and f + "_raw" in df.columns:
        return F.col(f + "_raw").isNotNull()
    if f == "confidence_scores" and "confidence" in df.columns:
        return F.col("confidence").isNotNull()
    if f in df.columns:
        return F.col(f).isNotNull()
    return F.lit(False)


def required_findings(df: DataFrame, required_fields: list[str]) -> list[Column]:
    """V1."""
    return [
        F.when(~_present(df, f), finding(REQUIRED_MISSING, f, MSG_REQUIRED_MISSING.format(field=f)))
        for f in required_fields
    ]


def numeric_findings(df: DataFrame) -> list[Column]:
    """V2, V3, V4."""
    out = []
    for f in AMOUNT_FIELDS:
        v = F.col(f)
        out.append(
            F.when(_present(df, f) & v.isNull(), finding(NOT_A_NUMBER, f, MSG_NOT_A_NUMBER.format(field=f)))
            .when(v < 0, finding(NEGATIVE, f, MSG_NEGATIVE.format(field=f), observed=v))
        )
    sub, vat, tot = F.col("subtotal"), F.col("vat"), F.col("total")
    expected = sub + vat
    msg = template(MSG_TOTAL_MISMATCH, subtotal=sub, vat=vat, expected=expected, total=tot)
    out.append(
        F.when(gt(F.abs(expected - tot), CALCULATION_TOLERANCE),
               finding(TOTAL_MISMATCH, "total", msg, observed=tot, expected=expected))
    )
    return out


def item_findings(items: Column | str = "line_items", with_keys: bool = False) -> Column:
    """Per item (1-based position), missing keys then arithmetic; flattened into one array.

    A typed item has no key where it has NULL; ``with_keys`` takes the keys from the item's own list ``present``.
    """
    items = F.col(items) if isinstance(items, str) else items
    lacks = lambda x, k: ~F.array_contains(x["present"], k) if with_keys else x[k].isNull()

    def per_item(x: Column, i: Column) -> Column:
        n = i + 1
        checks = [
            F.when(lacks(x, k), finding(ITEM_FIELD_MISSING, k, template(MSG_ITEM_MISSING, n=n, key=k), item_no=n))
            for k in ("description", "quantity", "unit_price", "total")
        ]
        q, u, t = x["quantity"].cast("double"), x["unit_price"], x["total"]
        exp = q * u
        msg = template(MSG_ITEM_MISMATCH, n=n, quantity=x["quantity"], unit_price=u, expected=exp, total=t)
        checks.append(F.when(gt(F.abs(exp - t), CALCULATION_TOLERANCE),
                             finding(ITEM_TOTAL_MISMATCH, "total", msg, item_no=n, observed=t, expected=exp)))
        return F.array(*checks)

    def suspect(x: Column) -> Column:
        wrong = gt(F.abs(x["quantity"].cast("double") * x["unit_price"] - x["total"]), CALCULATION_TOLERANCE)
        lacking = [lacks(x, k) for k in ("description", "quantity", "unit_price", "total")]
        return F.coalesce(reduce(or_, [*lacking, wrong]), F.lit(True))

    # the findings of an item are put together only where some item of the document has one
    found = F.filter(F.flatten(F.coalesce(F.transform(items, per_item), F.array().cast(f"array<{FINDINGS}>"))),
                     lambda f: f.isNotNull())
    return F.when(F.exists(items, suspect), found).otherwise(F.array().cast(FINDINGS))


def vat_rate(vat: Column | None = None, subtotal: Column | None = None) -> Column:
    """``vat / subtotal * 100`` when ``subtotal > 0``; NULL otherwise (no division by zero under ANSI)."""
    vat = F.col("vat") if vat is None else vat
    subtotal = F.col("subtotal") if subtotal is None else subtotal
    return F.when(gt(subtotal, 0.0) & vat.isNotNull(), (vat / subtotal) * 100)


def vat_rate_findings(rates: list[float]) -> list[Column]:
    """V5 (warning)."""
    rate = vat_rate()
    allowed = F.array(*[F.lit(float(r)) for r in rates])
    expected_txt = ", ".join(f"{r}%" for r in rates)
    msg = template(MSG_UNUSUAL_VAT_RATE, rate=F.format_string("%.2f", rate), rates=expected_txt)
    return [
        F.when(rate.isNotNull() & ~F.exists(allowed, lambda r: F.abs(rate - r) < VAT_RATE_TOLERANCE),
               finding(UNUSUAL_VAT_RATE, "vat", msg, observed=rate))
    ]


def date_findings(parsed: Column, raw: Column, as_of: Column) -> list[Column]:
    """V6–V8 (warnings): unparseable, else future and/or very old."""
    present = raw.isNotNull() & (raw != "")
    return [
        F.when(present & parsed.isNull(),
               finding(UNPARSEABLE_DATE, "invoice_date", template(MSG_DATE_UNPARSEABLE, date=raw))),
        F.when(present & (parsed > as_of),
               finding(FUTURE_DATE, "invoice_date", template(MSG_DATE_FUTURE, date=raw))),
        F.when(present & (F.datediff(as_of, parsed) > OLD_DATE_DAYS),
               finding(VERY_OLD_DATE, "invoice_date", template(MSG_DATE_OLD, date=raw))),
    ]


def compact(cols: list[Column], kind: str = FINDINGS) -> Column:
    """Those of ``cols`` that are not NULL, in their order, as one array of this type."""
    none = F.array().cast(kind)
    if not cols:
        return none
    # a filter of the array would do, but higher-order functions are not compiled, nor is what stands in them
    return F.concat(*[F.when(c.isNotNull(), F.array(c)).otherwise(none) for c in cols])


def _typed(df: DataFrame) -> DataFrame:
    """Structured input may carry amounts as text: those that are no numbers become NULL next to their text.

    ``<amount>_raw`` keeps what was given, so that V2 reports them; text is read as ``float`` reads it (no commas).
    """
    kinds = dict(df.dtypes)
    for f in AMOUNT_FIELDS:
        if kinds.get(f) == "string":
            if f + "_raw" not in kinds:
                df = df.withColumn(f + "_raw", F.col(f))
            df = df.withColumn(f, parse_double(F.trim(F.col(f), F.lit(PY_WHITESPACE))))
    return df


def validate(
    invoices: DataFrame,
    required_fields: list[str] | None = None,
    vat_rates: list[float] | None = None,
    strict: bool = False,
    as_of: _dt.date | str | None = None,
    rules: Sequence[Rule] = (),
) -> DataFrame:
    """``errors``, ``warnings``, ``valid``; V11 strict mode moves warnings into errors.

    Own ``rules`` follow the built-in checks of their severity (error or warning), in the order given.
    """
    req = DEFAULT_REQUIRED_FIELDS if required_fields is None else required_fields
    rates = DEFAULT_VAT_RATES if vat_rates is None else vat_rates
    df = with_parsed_date(_typed(invoices))
    errors = F.concat(
        compact(required_findings(df, req) + numeric_findings(df)),
        item_findings("line_items", "present" in df.schema["line_items"].dataType.elementType.fieldNames()) if "line_items" in df.columns else F.array().cast(FINDINGS),
    )
    warnings = compact(
        vat_rate_findings(rates)
        + date_findings(F.col("invoice_date_parsed"), F.col("invoice_date"), as_of_col(as_of))
    )
    own = [(r.severity, F.when(when, finding(r.code, r.field, r.message, observed=seen))) for r, when, seen in applied(df, rules, ("error", "warning"))]
    if own:
        errors = F.concat(errors, compact([c for kind, c in own if kind == "error"]))
        warnings = F.concat(warnings, compact([c for kind, c in own if kind == "warning"]))
    if strict:
        errors, warnings = F.concat(errors, warnings), F.array().cast(FINDINGS)
    out = df.withColumn("errors", errors).withColumn("warnings", warnings)
    return out.withColumn("valid", F.size("errors") == 0)


def findings_as_rows(validated: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per finding, ``kind`` = error | warning."""
    tag = lambda arr, kind: F.transform(arr, lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("f")))  # noqa
    both = F.concat(tag(F.col("errors"), "error"), tag(F.col("warnings"), "warning"))
    # explode_outer + filter: an inner explode would push an inferred size() filter below the validation
    rows = validated.select(key, F.explode_outer(both).alias("x")).where(F.col("x").isNotNull())
    return rows.select(key, "x.kind", "x.f.*")
