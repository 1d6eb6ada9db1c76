"""The whole document → invoice → validation → anomalies → export → target chain, and its summary.

``run_invoices(docs)`` takes ``(doc_id, text[, ocr_success, ocr_error, path])`` and returns one row per document
with the extracted record, ``errors/warnings/valid``, anomaly columns, per-stage status and ``success``. A row whose
OCR failed is kept with its status alone: no record, finding, anomaly or export. Validation never gates later
stages. Nothing is collected and, but for the history profile, nothing runs when the plan is made; ``summarize`` is
a one-row aggregate.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.patterns import FIELD_ORDER, MSG_OCR_FAILED
from ..functions.stage import materialize
from ..operators.anomaly import detect_anomalies, profile
from ..operators.extract import extract_fields, merge_entities
from ..operators.targets import target_record
from ..operators.validate import CODES, validate
from ..options import Options
from ..sinks.writers import write_invoices

RECORD_KEYS = FIELD_ORDER + ["line_items", "confidence_scores"]
NER_KEYS = ["organizations", "dates", "money"]


def run_invoices(
    docs: DataFrame,
    history: DataFrame | None = None,
    options: Options | None = None,
    as_of: _dt.date | str | None = None,
    by: list[str] | tuple[str, ...] = (),
    entities: DataFrame | None = None,
    materialize_extracted: bool = False,
    min_partitions: int | None = None,
    history_profile: DataFrame | None = None,
) -> DataFrame:
    """Every stage for every document; ``history`` (invoice-shaped, ``total``/``vat``) feeds the profile, or
    ``history_profile`` is one made before (streams).

    ``materialize_extracted`` writes the extracted invoices once (parquet under ``spark.checkpoint.dir``) and
    runs validation and detection from that table: the stage boundary for large runs — later filters cannot
    re-run the regex scans, and a lost executor re-reads the table instead of the text. ``min_partitions`` deals
    the documents out first, for inputs of fewer partitions than the cluster has cores.
    """
    opts = options or Options()
    given = [c for c in docs.columns if c != "text"]
    d = docs.repartition(min_partitions) if min_partitions else docs
    ocr_ok = F.col("ocr_success") if "ocr_success" in d.columns else F.lit(True)
    d = d.withColumn("_ocr_ok", F.coalesce(ocr_ok, F.lit(False))).withColumn(
        "_text_length", F.coalesce(F.length("text"), F.lit(0)))
    # a failed OCR yields no record: nothing is extracted from its text (its length is still reported)
    d = d.withColumn("text", F.when(F.col("_ocr_ok"), F.col("text")))
    inv = extract_fields(d)
    if materialize_extracted:
        inv = materialize(inv, "extracted")
    ner = opts.use_entities and entities is not None
    if ner:
        inv = merge_entities(inv, entities, with_lists=True)
    inv = validate(inv, required_fields=list(opts.required_fields), vat_rates=list(opts.vat_rates), strict=opts.strict, as_of=as_of,
                   rules=opts.rules)
    mode = opts.anomaly_mode
    prof = history_profile
    if prof is None and history is not None and mode == "statistical":
        prof = profile(history, by=by)
    out = detect_anomalies(inv, prof, by=by, mode=mode, own_rules=opts.anomaly_rules)

    ok = F.col("_ocr_ok")
    own = [*given, "_ocr_ok", "_text_length"]
    out = out.select(*own, *[F.when(ok, F.col(c)).alias(c) for c in out.columns if c not in own])
    keys = RECORD_KEYS + (NER_KEYS if ner else [])
    stages = [
        F.struct(ok.alias("success"), F.col("_text_length").alias("text_length")).alias("ocr"),
        F.when(ok, F.struct(F.lit(True).alias("success"), F.array(*[F.lit(k) for k in keys])
                            .alias("fields_extracted"))).alias("extraction"),
        F.when(ok, F.struct("valid", "errors", "warnings")).alias("validation"),
    ]
    failed_anomaly = F.lit(False)
    if mode is not None:
        if mode == "rule_based":  # a raised rule ends the run before this stage reports
            failed_anomaly = F.col("anomaly_error").isNotNull()
        stages.append(F.when(ok & ~failed_anomaly, F.struct("has_anomalies", "total_anomalies")).alias("anomaly_detection"))
    success = ok & ~failed_anomaly
    stages.append(F.when(success, F.struct(F.lit(True).alias("success"))).alias("export"))
    if opts.target is not None:
        stages.append(F.when(success, target_record(out, opts.target)).alias("erp_integration"))
    error = F.when(~ok, F.lit(MSG_OCR_FAILED)).when(failed_anomaly, F.col("anomaly_error"))
    return out.withColumn("stages", F.struct(*stages)).withColumn("success", success).withColumn(
        "error", error).drop("_ocr_ok", "_text_length")


def export_run(results: DataFrame, base: str, formats: list[str] | tuple[str, ...] = ("json", "csv"), pretty_json: bool = False) -> bool:
    """Stage 5: the records of the documents that succeeded, written in every format; failed ones write nothing."""
    return write_invoices(results.filter("success"), base, formats, pretty_json)


def summarize(results: DataFrame) -> DataFrame:
    """``total, successful, failed`` — one row, counted without collecting the results."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )


_SEVERAL = ("errors", "warnings", "anomalies")


def observed(results: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """``results`` and what is counted while they are written: no second run for the summary.

    Use the frame once, in whatever writes the results; then :func:`summary_of` the observation. It holds total, successful,
    failed, the numbers of errors, warnings and anomalies, and of findings by code. A task that is repeated counts once.
    """
    seen = Observation(name)
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(f"n_{c}")
    some = [c for c in _SEVERAL if c in results.columns]
    having = lambda kind, code: F.size(F.filter(kind, lambda f: f["code"] == code))
    by_code = [F.coalesce(F.sum(having(kind, code)), F.lit(0)).alias(f"{kind}.{code}")
               for kind in ("errors", "warnings") if kind in results.columns for code in CODES]
    return results.observe(seen, F.count("*").alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), *[n(c) for c in some], *by_code), seen


def summary_of(seen: Observation) -> dict[str, int]:
    """The counts of a frame of :func:`observed` that has been written; codes that did not occur are left out."""
    return {k: int(v) for k, v in seen.get.items() if "." not in k or v}


def export_observed(results: DataFrame, base: str, formats: list[str] | tuple[str, ...] = ("json", "csv"), pretty_json: bool = False) -> tuple[bool, dict[str, int]]:
    """:func:`export_run` and the summary of the run, from the one job that evaluates it."""
    frame, seen = observed(results)
    return export_run(frame, base, formats, pretty_json), summary_of(seen)


def report(results: DataFrame, name_col: str = "doc_id") -> DataFrame:
    """P5: the per-invoice report line; stages that did not run report NULL validity and no anomalies."""
    stages = F.col("stages")
    has_anom = "anomaly_detection" in results.schema["stages"].dataType.fieldNames()
    n_anom = stages["anomaly_detection"]["total_anomalies"] if has_anom else F.lit(0)
    return results.select(
        F.col(name_col).alias("name"),
        F.when(F.col("success"), F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        "supplier", "total", F.coalesce(F.size("line_items"), F.lit(0)).cast("bigint").alias("n_line_items"),
        F.coalesce(n_anom, F.lit(0)).cast("bigint").alias("n_anomalies"),
        stages["validation"]["valid"].alias("valid"),
    )
