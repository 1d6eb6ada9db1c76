"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` per operator, plus its DuckDB oracle.

Every query reads the supplied tables (or the invoices Spark renders from them) in full. Results are flat,
scalar columns with the same names on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.anomaly import PROFILE_COLUMNS, detect_anomalies, iqr_outlier, profile, z_score
from ..operators.extract import (extract_fields, extract_line_items, line_items_column, merge_entities,
                                 with_fields)
from ..operators.targets import outbox, to_target
from ..functions.patterns import AMOUNT_FIELDS
from ..functions.stage import materialize, scratch_path
from ..operators.validate import findings_as_rows, validate, vat_rate
from ..options import Options
from ..sinks.writers import (CSV_READ_OPTIONS, flatten_for_csv, line_item_rows, output_names, to_record, union_item_tables,
                            write_csv, write_json)
from ..sources.files import assemble_pages, extension, is_supported_file
from ..sources.fixtures import entity_table, rendered_invoices
from ..sources.tables import read_table, spread
from .run import report, run_invoices, summarize
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_fields(rendered_invoices(spark, sf_dir))


def invoices_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted invoices written once (checkpoint) — for queries that use them twice (history and input)."""
    return materialize(invoices(spark, sf_dir), dictionaries=False)


# ---- extraction -------------------------------------------------------------------------------------------------

@register("e_fields", O.with_base(
    "SELECT doc_id, invoice_number, invoice_date, supplier, total_raw, vat_raw, subtotal_raw, total, vat, subtotal, "
    "CAST(n_items AS BIGINT) AS n_items, items_ok, parse_ok FROM inv"))
def e_fields(spark, d):
    return invoices(spark, d).select(
        "doc_id", "invoice_number", "invoice_date", "supplier", "total_raw", "vat_raw", "subtotal_raw",
        "total", "vat", "subtotal", F.size("line_items").cast("bigint").alias("n_items"), "items_ok", "parse_ok")


@register("e_line_items", O.with_base(
    "SELECT doc_id, item_no, description, quantity, unit_price, total FROM items"))
def e_line_items(spark, d):
    return extract_line_items(invoices(spark, d)).select(
        "doc_id", F.col("item_no").cast("bigint").alias("item_no"), "description", F.col("quantity").cast("bigint").alias("quantity"),
        "unit_price", "total")


# ---- validation -------------------------------------------------------------------------------------------------

AS_OF = "2005-06-30"  # fixed reference date so results do not depend on the day of the run
AS_OF_FUTURE = "2000-06-30"


def validated(spark, d, strict: bool = False, as_of: str = AS_OF) -> DataFrame:
    return validate(invoices(spark, d), strict=strict, as_of=as_of)


def _codes(col: str, code: str):
    return F.filter(col, lambda f: f["code"] == code)


def _fields_of(col: str, code: str):
    return F.array_join(F.transform(_codes(col, code), lambda f: f["field"]), ",")


def _n(col: str, code: str):
    return F.size(_codes(col, code)).cast("bigint")


@register("v_required", O.with_base(
    "SELECT doc_id, concat_ws(',', CASE WHEN supplier IS NULL THEN 'supplier' END, "
    "CASE WHEN total_raw IS NULL THEN 'total' END, CASE WHEN invoice_date IS NULL THEN 'invoice_date' END) "
    "AS missing FROM inv"))
def v_required(spark, d):
    return validated(spark, d).select("doc_id", _fields_of("errors", "required_missing").alias("missing"))


@register("v_numeric", O.with_base(
    "SELECT doc_id, concat_ws(',', CASE WHEN nan_total THEN 'total' END, CASE WHEN nan_vat THEN 'vat' END, "
    "CASE WHEN nan_subtotal THEN 'subtotal' END) AS not_a_number, "
    "concat_ws(',', CASE WHEN total < 0 THEN 'total' END, CASE WHEN vat < 0 THEN 'vat' END, "
    "CASE WHEN subtotal < 0 THEN 'subtotal' END) AS negative FROM val", O.val_ctes(AS_OF)))
def v_numeric(spark, d):
    v = validated(spark, d)
    return v.select("doc_id", _fields_of("errors", "not_a_number").alias("not_a_number"),
                    _fields_of("errors", "negative").alias("negative"))


@register("v_total_consistency", O.with_base(
    "SELECT doc_id, mismatch, CASE WHEN mismatch THEN total END AS observed, "
    "CASE WHEN mismatch THEN subtotal + vat END AS expected FROM val", O.val_ctes(AS_OF)))
def v_total_consistency(spark, d):
    v = validated(spark, d)
    m = F.get(_codes("errors", "total_mismatch"), 0)
    return v.select("doc_id", m.isNotNull().alias("mismatch"), m["observed"].alias("observed"),
                    m["expected"].alias("expected"))


@register("v_vat_rate", O.with_base(
    "SELECT doc_id, rate, unusual_rate FROM val", O.val_ctes(AS_OF)))
def v_vat_rate(spark, d):
    v = validated(spark, d)
    return v.select("doc_id", vat_rate().alias("rate"), (_n("warnings", "unusual_vat_rate") > 0).alias("unusual_rate"))


@register("v_date_parse", O.with_base(
    "SELECT doc_id, invoice_date, strftime(parsed, '%Y-%m-%d') AS parsed, "
    "(invoice_date IS NOT NULL AND parsed IS NULL) AS unparseable FROM val", O.val_ctes(AS_OF)))
def v_date_parse(spark, d):
    v = validated(spark, d)
    return v.select("doc_id", "invoice_date", F.date_format("invoice_date_parsed", "yyyy-MM-dd").alias("parsed"),
                    (_n("warnings", "unparseable_date") > 0).alias("unparseable"))


@register("v_date_range", O.with_base(
    "SELECT doc_id, coalesce(parsed > as_of, false) AS future, "
    "coalesce(date_diff('day', parsed, as_of) > 3650, false) AS very_old FROM val", O.val_ctes(AS_OF_FUTURE)))
def v_date_range(spark, d):
    v = validated(spark, d, as_of=AS_OF_FUTURE)
    return v.select("doc_id", (_n("warnings", "future_date") > 0).alias("future"),
                    (_n("warnings", "very_old_date") > 0).alias("very_old"))


@register("v_date_old", O.with_base(
    "SELECT doc_id, coalesce(parsed > as_of, false) AS future, "
    "coalesce(date_diff('day', parsed, as_of) > 3650, false) AS very_old FROM val", O.val_ctes(AS_OF)))
def v_date_old(spark, d):
    v = validated(spark, d, as_of=AS_OF)
    return v.select("doc_id", (_n("warnings", "future_date") > 0).alias("future"),
                    (_n("warnings", "very_old_date") > 0).alias("very_old"))


@register("v_item_arithmetic", O.with_base(
    "SELECT doc_id, CAST(item_no AS BIGINT) AS item_no, observed, expected FROM item_err", O.val_ctes(AS_OF)))
def v_item_arithmetic(spark, d):
    v = validated(spark, d)
    return v.select("doc_id", F.explode_outer(_codes("errors", "item_total_mismatch")).alias("f")).where(
        F.col("f").isNotNull()).select(
        "doc_id", F.col("f.item_no").cast("bigint").alias("item_no"), F.col("f.observed").alias("observed"),
        F.col("f.expected").alias("expected"))


@register("v_verdict", O.with_base(
    "SELECT doc_id, n_err AS n_errors, n_warn AS n_warnings, n_err = 0 AS valid FROM verdict", O.val_ctes(AS_OF)))
def v_verdict(spark, d):
    v = validated(spark, d)
    return v.select("doc_id", F.size("errors").cast("bigint").alias("n_errors"),
                    F.size("warnings").cast("bigint").alias("n_warnings"), "valid")


@register("v_verdict_strict", O.with_base(
    "SELECT doc_id, n_err + n_warn AS n_errors, CAST(0 AS BIGINT) AS n_warnings, n_err + n_warn = 0 AS valid "
    "FROM verdict", O.val_ctes(AS_OF)))
def v_verdict_strict(spark, d):
    v = validated(spark, d, strict=True)
    return v.select("doc_id", F.size("errors").cast("bigint").alias("n_errors"),
                    F.size("warnings").cast("bigint").alias("n_warnings"), "valid")


_FINDING_ROWS_SQL = """
SELECT kind, code, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'error' AS kind, 'required_missing' AS code FROM inv WHERE supplier IS NULL
  UNION ALL SELECT 'error', 'required_missing' FROM inv WHERE total_raw IS NULL
  UNION ALL SELECT 'error', 'required_missing' FROM inv WHERE invoice_date IS NULL
  UNION ALL SELECT 'error', 'not_a_number' FROM val WHERE nan_total
  UNION ALL SELECT 'error', 'not_a_number' FROM val WHERE nan_vat
  UNION ALL SELECT 'error', 'not_a_number' FROM val WHERE nan_subtotal
  UNION ALL SELECT 'error', 'total_mismatch' FROM val WHERE mismatch
  UNION ALL SELECT 'error', 'item_total_mismatch' FROM item_err
  UNION ALL SELECT 'warning', 'unusual_vat_rate' FROM val WHERE unusual_rate
  UNION ALL SELECT 'warning', 'unparseable_date' FROM val WHERE invoice_date IS NOT NULL AND parsed IS NULL
  UNION ALL SELECT 'warning', 'future_date' FROM val WHERE parsed > as_of
  UNION ALL SELECT 'warning', 'very_old_date' FROM val WHERE date_diff('day', parsed, as_of) > 3650
) GROUP BY kind, code"""


@register("v_finding_counts", O.with_base(_FINDING_ROWS_SQL, O.val_ctes(AS_OF)))
def v_finding_counts(spark, d):
    rows = findings_as_rows(validated(spark, d))
    return rows.groupBy("kind", "code").agg(F.count("*").alias("n"))


# ---- anomalies --------------------------------------------------------------------------------------------------

def _r6(c):
    return F.round(c, 6)


_PROFILE_SQL_COLS = ("n_rows, n_total, round(mean_total, 6) AS mean_total, round(std_total, 6) AS std_total, "
                     "round(q1_total, 6) AS q1_total, round(q3_total, 6) AS q3_total, n_vat, "
                     "round(mean_vat, 6) AS mean_vat, round(std_vat, 6) AS std_vat")


def _profile_out(p: DataFrame, by=()) -> DataFrame:
    return p.select(*by, "n_rows", "n_total", *[_r6(F.col(c)).alias(c) for c in
                                               ("mean_total", "std_total", "q1_total", "q3_total")],
                    "n_vat", _r6(F.col("mean_vat")).alias("mean_vat"), _r6(F.col("std_vat")).alias("std_vat"))


@register("a_profile", O.with_base(f"SELECT {_PROFILE_SQL_COLS} FROM prof",
                                   O.profile_ctes("prof", "inv", "total", "vat")))
def a_profile(spark, d):
    return _profile_out(profile(invoices_once(spark, d)))


_NATION_SRC = """
nation_hist AS (
  SELECT n.n_name, l.l_extendedprice AS total, l.l_extendedprice * l.l_tax AS vat
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""


@register("a_profile_by_nation",
          "WITH " + ",\n".join([_NATION_SRC] + O.profile_ctes("prof", "nation_hist", "total", "vat", ["n_name"]))
          + f"\nSELECT n_name, {_PROFILE_SQL_COLS} FROM prof")
def a_profile_by_nation(spark, d):
    li = read_table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_tax")
    sup = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nat = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    hist = (li.join(sup, li.l_suppkey == sup.s_suppkey).join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("n_name", F.col("l_extendedprice").alias("total"),
                    (F.col("l_extendedprice") * F.col("l_tax")).alias("vat")))
    return _profile_out(profile(hist, by=["n_name"]), ["n_name"])


_EVENTS_SQL = ("WITH " + ",\n".join(O.profile_ctes("prof", "events", "value", "NULL")) + """
SELECT e.event_id,
  CASE WHEN e.value IS NOT NULL AND e.value <> 0 AND p.n_rows >= 2 AND p.n_total > 0 THEN round(
    CASE WHEN p.n_total < 2 OR p.std_total = 0 THEN 0.0 ELSE abs((e.value - p.mean_total) / p.std_total) END, 6)
  END AS z_score,
  coalesce(e.value IS NOT NULL AND e.value <> 0 AND p.n_rows >= 2 AND p.n_total >= 4 AND
    (e.value < p.q1_total - 1.5 * (p.q3_total - p.q1_total) OR e.value > p.q3_total + 1.5 * (p.q3_total - p.q1_total)),
    false) AS iqr_outlier
FROM events e CROSS JOIN prof p""")


@register("a_zscore_iqr", _EVENTS_SQL)
def a_zscore_iqr(spark, d):
    ev = read_table(spark, d, "events").select("event_id", F.col("value").alias("total"),
                                               F.lit(None).cast("double").alias("vat"))
    p = profile(ev).select(*[F.col(c).alias("p_" + c) for c in PROFILE_COLUMNS])
    j = ev.crossJoin(F.broadcast(p))
    run = (F.col("total").isNotNull() & (F.col("total") != 0) & (F.col("p_n_rows") >= 2))
    z = z_score(F.col("total"), F.col("p_n_total"), F.col("p_mean_total"), F.col("p_std_total"))
    out = iqr_outlier(F.col("total"), F.col("p_n_total"), F.col("p_q1_total"), F.col("p_q3_total"))
    return j.select("event_id", F.when(run & (F.col("p_n_total") > 0), _r6(z)).alias("z_score"),
                    F.coalesce(run & out, F.lit(False)).alias("iqr_outlier"))


def detected(spark, d, by=(), mode="statistical") -> DataFrame:
    inv = invoices_once(spark, d) if mode == "statistical" else invoices(spark, d)
    prof = profile(inv, by=by) if mode == "statistical" else None
    return detect_anomalies(inv, prof, by=by, mode=mode)


def _anom(typ: str, field: str):
    return F.get(F.filter("anomalies", lambda a: (a["type"] == typ) & (a["field"] == field)), 0)


_STAT_SQL = O.profile_ctes("prof", "inv", "total", "vat") + [f"""
stat AS (
  SELECT i.*, {O.stat_select('p')},
    {O.TRUTHY_TOTAL} AS t_truthy, {O.TRUTHY_VAT} AS v_truthy
  FROM inv i CROSS JOIN prof p
),
stat2 AS (
  SELECT *, gate AND t_truthy AND p_n_total > 0 AS run_t, gate AND v_truthy AND p_n_vat > 0 AS run_v,
    (t_truthy AND total IS NULL) OR (gate AND v_truthy AND p_n_vat > 0 AND vat IS NULL) AS failed
  FROM stat
)"""]


@register("a_total_outlier", O.with_base(
    "SELECT doc_id, CASE WHEN run_t AND NOT failed THEN round(zt, 6) END AS z_total, "
    "coalesce(run_t AND NOT failed AND (zt > 3 OR iqr), false) AS outlier, "
    "CASE WHEN run_t AND NOT failed AND (zt > 3 OR iqr) THEN (CASE WHEN zt > 4 THEN 'high' ELSE 'medium' END) END "
    "AS severity FROM stat2", _STAT_SQL))
def a_total_outlier(spark, d):
    a = _anom("statistical_outlier", "total")
    return detected(spark, d).select("doc_id", _r6(F.col("scores")["total_z_score"]).alias("z_total"),
                                     a.isNotNull().alias("outlier"), a["severity"].alias("severity"))


@register("a_vat_outlier", O.with_base(
    "SELECT doc_id, CASE WHEN run_v AND NOT failed THEN round(zv, 6) END AS z_vat, "
    "coalesce(run_v AND NOT failed AND zv > 3, false) AS outlier FROM stat2", _STAT_SQL))
def a_vat_outlier(spark, d):
    a = _anom("statistical_outlier", "vat")
    return detected(spark, d).select("doc_id", _r6(F.col("scores")["vat_z_score"]).alias("z_vat"),
                                     a.isNotNull().alias("outlier"))


@register("a_error_path", O.with_base(
    "SELECT doc_id, CASE WHEN t_truthy AND total IS NULL THEN 'total:' || total_raw "
    "WHEN gate AND v_truthy AND p_n_vat > 0 AND vat IS NULL THEN 'vat:' || vat_raw END AS failed_on FROM stat2",
    _STAT_SQL))
def a_error_path(spark, d):
    e = F.regexp_extract("anomaly_error", "'(.*)'$", 1)
    which = F.when(F.col("anomaly_error").isNull(), F.lit(None)).when(
        F.col("total_raw").isNotNull() & F.col("total").isNull() & (F.col("total_raw") == e), F.lit("total:")
    ).otherwise(F.lit("vat:"))
    return detected(spark, d).select("doc_id", F.concat(which, e).alias("failed_on"))


_RULES_SQL = [f"""
dups AS (
  SELECT doc_id FROM items GROUP BY doc_id HAVING count(*) <> count(DISTINCT lower(coalesce(description, '')))
),
rules AS (
  SELECT i.doc_id,
    coalesce({O.TRUTHY_TOTAL} AND total > 0 AND total % 1000 = 0 AND total > 1000, false) AS round_total,
    d.doc_id IS NOT NULL AS duplicate_items,
    coalesce(supplier, '') = '' AS missing_supplier,
    CASE WHEN subtotal > 0 AND vat IS NOT NULL AND (vat / subtotal) * 100 > 30 THEN (vat / subtotal) * 100 END
      AS high_vat_rate,
    {O.TRUTHY_TOTAL} AND total IS NULL AS failed
  FROM inv i LEFT JOIN dups d ON i.doc_id = d.doc_id
)"""]


def _rules(spark, d):
    return detected(spark, d, mode="rule_based")


@register("a_round", O.with_base("SELECT doc_id, round_total AND NOT failed AS flagged FROM rules", _RULES_SQL))
def a_round(spark, d):
    return _rules(spark, d).select("doc_id", _anom("suspicious_pattern", "total").isNotNull().alias("flagged"))


@register("a_duplicate_items", O.with_base(
    "SELECT doc_id, duplicate_items AND NOT failed AS flagged FROM rules", _RULES_SQL))
def a_duplicate_items(spark, d):
    return _rules(spark, d).select("doc_id", _anom("duplicate_items", "line_items").isNotNull().alias("flagged"))


@register("a_missing_supplier", O.with_base(
    "SELECT doc_id, missing_supplier AND NOT failed AS flagged FROM rules", _RULES_SQL))
def a_missing_supplier(spark, d):
    return _rules(spark, d).select("doc_id",
                                   _anom("missing_critical_field", "supplier").isNotNull().alias("flagged"))


@register("a_high_vat", O.with_base(
    "SELECT doc_id, CASE WHEN NOT failed THEN high_vat_rate END AS rate FROM rules", _RULES_SQL))
def a_high_vat(spark, d):
    return _rules(spark, d).select("doc_id", _anom("unusual_rate", "vat")["value"].alias("rate"))


@register("a_rules_all", O.with_base(
    "SELECT doc_id, failed, CAST(CASE WHEN failed THEN 0 ELSE (CASE WHEN round_total THEN 1 ELSE 0 END) + "
    "(CASE WHEN duplicate_items THEN 1 ELSE 0 END) + (CASE WHEN missing_supplier THEN 1 ELSE 0 END) + "
    "(CASE WHEN high_vat_rate IS NOT NULL THEN 1 ELSE 0 END) END AS BIGINT) AS n_anomalies FROM rules", _RULES_SQL))
def a_rules_all(spark, d):
    r = _rules(spark, d)
    return r.select("doc_id", F.col("anomaly_error").isNotNull().alias("failed"),
                    F.col("total_anomalies").cast("bigint").alias("n_anomalies"))


_GATE_SQL = O.profile_ctes("sprof", "inv", "total", "vat", ["supplier"]) + [f"""
gstat AS (
  SELECT i.*, {O.stat_select('p')}, p.n_rows AS p_n_rows,
    {O.TRUTHY_TOTAL} AS t_truthy, {O.TRUTHY_VAT} AS v_truthy
  FROM inv i LEFT JOIN sprof p ON i.supplier = p.supplier
)"""]


@register("a_history_gate", O.with_base(
    "SELECT doc_id, p_n_rows AS n_rows, gate, "
    "CASE WHEN gate AND t_truthy AND p_n_total > 0 AND NOT (t_truthy AND total IS NULL) "
    "AND NOT (v_truthy AND p_n_vat > 0 AND vat IS NULL) THEN round(zt, 6) END AS z_total, "
    "coalesce(gate AND t_truthy AND p_n_total > 0 AND NOT (t_truthy AND total IS NULL) "
    "AND NOT (v_truthy AND p_n_vat > 0 AND vat IS NULL) AND (zt > 3 OR iqr), false) AS total_outlier FROM gstat",
    _GATE_SQL))
def a_history_gate(spark, d):
    inv = invoices_once(spark, d)
    det = detect_anomalies(inv, profile(inv, by=["supplier"]), by=["supplier"])
    a = _anom("statistical_outlier", "total")
    return det.select("doc_id", F.col("history_rows").alias("n_rows"), (F.coalesce("history_rows", F.lit(0)) >= 2).alias("gate"),
                      _r6(F.col("scores")["total_z_score"]).alias("z_total"), a.isNotNull().alias("total_outlier"))


# ---- extraction extras: confidence, documents table, entity merge -----------------------------------------------

@register("e_confidence_count", O.with_base(
    "SELECT doc_id, CAST((CASE WHEN invoice_number IS NOT NULL THEN 1 ELSE 0 END) + "
    "(CASE WHEN invoice_date IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN supplier IS NOT NULL THEN 1 ELSE 0 END) + "
    "(CASE WHEN total_raw IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN vat_raw IS NOT NULL THEN 1 ELSE 0 END) + "
    "(CASE WHEN subtotal_raw IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_confidence, "
    "concat_ws(',', CASE WHEN invoice_number IS NOT NULL THEN 'invoice_number' END, "
    "CASE WHEN invoice_date IS NOT NULL THEN 'invoice_date' END, CASE WHEN supplier IS NOT NULL THEN 'supplier' END, "
    "CASE WHEN total_raw IS NOT NULL THEN 'total' END, CASE WHEN vat_raw IS NOT NULL THEN 'vat' END, "
    "CASE WHEN subtotal_raw IS NOT NULL THEN 'subtotal' END) AS fields, "
    "round(0.8 * ((invoice_number IS NOT NULL)::INT + (invoice_date IS NOT NULL)::INT + (supplier IS NOT NULL)::INT + "
    "(total_raw IS NOT NULL)::INT + (vat_raw IS NOT NULL)::INT + (subtotal_raw IS NOT NULL)::INT), 3)::DOUBLE AS sum_scores FROM inv"))
def e_confidence_count(spark, d):
    c = F.col("confidence")
    return invoices(spark, d).select(
        "doc_id", F.size(c).cast("bigint").alias("n_confidence"), F.array_join(F.map_keys(c), ",").alias("fields"),
        F.round(F.aggregate(F.map_values(c), F.lit(0.0), lambda x, v: x + v), 3).alias("sum_scores"))


_DOC_FIELDS_SQL = ("WITH " + ",\n".join([
    "rendered AS (SELECT doc_id, text FROM documents)", O.FIELDS_CTE]) + "\n"
    "SELECT doc_id, invoice_number, invoice_date, supplier, total_raw, vat_raw, subtotal_raw FROM fields")


@register("e_documents_fields", _DOC_FIELDS_SQL)
def e_documents_fields(spark, d):
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"))
    return with_fields(docs).drop("text")


# each text, followed by one line with a quantity and two amounts made of its own numbers
@register("e_documents_line_items", "WITH " + ",\n".join(
    ["rendered AS (SELECT doc_id, coalesce(text, '') || chr(10) || 'Closing line  ' || n_chars || '  $' || doc_id || '.50  $1,' || n_chars "
     "AS text FROM documents)", O.ITEM_ROWS_CTE.strip()])
    + "\nSELECT m.doc_id, CAST(len(m1) AS BIGINT) AS n_matches, CAST(m2[-1] AS BIGINT) AS last_quantity, "
      "CAST(replace(m3[-1], ',', '') AS DOUBLE) AS last_price, CAST(replace(m4[-1], ',', '') AS DOUBLE) AS last_total FROM item_matches m")
def e_documents_line_items(spark, d):
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text", "n_chars"))
    line = F.concat(F.lit("\nClosing line  "), F.col("n_chars").cast("string"), F.lit("  $"), F.col("doc_id").cast("string"),
                    F.lit(".50  $1,"), F.col("n_chars").cast("string"))
    found = docs.select("doc_id", line_items_column(F.concat(F.coalesce("text", F.lit("")), line)).alias("items"))
    last = F.get(F.col("items"), F.size("items") - 1)
    return found.select("doc_id", F.size("items").cast("bigint").alias("n_matches"), last["quantity"].cast("bigint").alias("last_quantity"),
                        last["unit_price"].alias("last_price"), last["total"].alias("last_total"))


@register("e_entity_fallback", O.with_base(
    "SELECT i.doc_id, coalesce(i.supplier, f.org) AS supplier, i.supplier IS NULL AND f.org IS NOT NULL AS from_ner "
    "FROM inv i LEFT JOIN (SELECT doc_id, arg_min(text, ord) AS org FROM entities WHERE label = 'ORG' "
    "GROUP BY doc_id) f ON i.doc_id = f.doc_id", [O.ENTITIES_SQL]))
def e_entity_fallback(spark, d):
    inv = invoices(spark, d)
    ents = entity_table(read_table(spark, d, "orders"), read_table(spark, d, "customer"))
    merged = merge_entities(inv.withColumnRenamed("supplier", "_pattern_supplier")
                            .withColumn("supplier", F.col("_pattern_supplier")), ents)
    return merged.select("doc_id", "supplier",
                         (F.col("_pattern_supplier").isNull() & F.col("supplier").isNotNull()).alias("from_ner"))


# ---- sources ------------------------------------------------------------------------------------------------------

@register("s_page_assembly",
          "SELECT conv_id AS doc_id, CAST(count(*) AS BIGINT) AS pages, coalesce(string_agg(CASE WHEN role <> 'system' "
          "THEN '--- Page ' || CAST(turn + 1 AS VARCHAR) || ' ---' || chr(10) || coalesce(text, '') END, "
          "chr(10) || chr(10) ORDER BY turn), '') AS text FROM conversations GROUP BY conv_id")
def s_page_assembly(spark, d):
    conv = read_table(spark, d, "conversations")
    pages = conv.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text",
                        (F.col("role") != "system").alias("success"))
    return assemble_pages(pages)


# file paths made of the page addresses: eight endings (one of them not supported) in lower, upper and mixed case
_ENDINGS = [".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".txt"]
_CASED = _ENDINGS + [e.upper() for e in _ENDINGS] + [e[:2].upper() + e[2:] for e in _ENDINGS]


@register("s_extension_predicate",
          "WITH p AS (SELECT page_id, rtrim(url, '/') || [" + ", ".join(f"'{e}'" for e in _CASED) + "][CAST(page_id % 24 AS INT) + 1] AS path FROM pages) "
          "SELECT page_id, lower('.' || split_part(path, '.', -1)) AS extension, split_part(lower(path), '.', -1) IN "
          "('pdf', 'png', 'jpg', 'jpeg', 'tiff', 'tif', 'bmp') AS supported FROM p")
def s_extension_predicate(spark, d):
    pages = read_table(spark, d, "pages").select("page_id", "url")
    cased = F.array(*[F.lit(e) for e in _CASED])
    paths = pages.select("page_id", F.concat(F.rtrim("url", F.lit("/")), F.element_at(cased, (F.col("page_id") % 24 + 1).cast("int"))).alias("path"))
    return paths.select("page_id", extension("path").alias("extension"), is_supported_file("path").alias("supported"))


# ---- sinks (layouts) ----------------------------------------------------------------------------------------------

_CONF = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN CAST(0.8 AS DOUBLE) END AS confidence_{f}"
    for f, c in (("invoice_number", "invoice_number"), ("invoice_date", "invoice_date"), ("supplier", "supplier"),
                 ("total", "total_raw"), ("vat", "vat_raw"), ("subtotal", "subtotal_raw")))


@register("x_flat_header", O.with_base(
    "SELECT doc_id, invoice_number, invoice_date, supplier, CASE WHEN conv_total THEN total END AS total, "
    "CASE WHEN NOT conv_total THEN total_raw END AS total_text, CASE WHEN conv_vat THEN vat END AS vat, "
    "CASE WHEN NOT conv_vat THEN vat_raw END AS vat_text, CASE WHEN conv_subtotal THEN subtotal END AS subtotal, "
    "CASE WHEN NOT conv_subtotal THEN subtotal_raw END AS subtotal_text, CAST(n_items AS INTEGER) AS "
    f"line_items_count, {_CONF} FROM inv"))
def x_flat_header(spark, d):
    rec = to_record(invoices(spark, d)).where(F.col("doc_id").isNotNull())
    kinds = F.struct(*[F.col(f)["text"].isNotNull().alias(f"_{f}_text") for f in AMOUNT_FIELDS])
    # a row meets the kinds of every record of its document, as in a join by doc_id; the documents lie together already
    flat = flatten_for_csv(rec, [kinds.alias("_kinds")]).withColumn("_kinds", F.collect_list("_kinds").over(Window.partitionBy("doc_id")))
    flat = flat.select("*", F.inline("_kinds"))
    return flat.select("doc_id", "invoice_number", "invoice_date", "supplier", *[c for f in AMOUNT_FIELDS for c in (
        F.when(~F.col(f"_{f}_text"), F.col(f)).cast("double").alias(f), F.when(F.col(f"_{f}_text"), F.col(f)).alias(f"{f}_text"))],
        "line_items_count", *[c for c in flat.columns if c.startswith("confidence_")])


@register("x_line_items", O.with_base(
    "SELECT doc_id, CAST(item_no AS INTEGER) AS item_no, description, quantity, total, unit_price FROM items"))
def x_line_items(spark, d):
    return line_item_rows(to_record(invoices(spark, d))).withColumn("quantity", F.col("quantity").cast("bigint"))


_RECORD_SQL = ("SELECT i.invoice_number, invoice_date, supplier, CASE WHEN conv_total THEN i.total END AS total, "
               "CASE WHEN NOT conv_total THEN total_raw END AS total_text, CASE WHEN conv_vat THEN vat END AS vat, "
               "CASE WHEN NOT conv_vat THEN vat_raw END AS vat_text, CASE WHEN conv_subtotal THEN subtotal END AS subtotal, "
               "CASE WHEN NOT conv_subtotal THEN subtotal_raw END AS subtotal_text, CAST(n_items AS INTEGER) AS n_items, ")


@register("x_json_roundtrip", O.with_base(
    _RECORD_SQL + "f.description AS first_description, CAST(f.quantity AS BIGINT) AS first_quantity, f.unit_price AS first_unit_price, f.total AS first_total, "
    "l.description AS last_description, CAST(l.quantity AS BIGINT) AS last_quantity, l.unit_price AS last_unit_price, l.total AS last_total, "
    "CASE WHEN total_raw IS NOT NULL THEN CAST(0.8 AS DOUBLE) END AS total_score, "
    "CAST((i.invoice_number IS NOT NULL)::INT + (invoice_date IS NOT NULL)::INT + (supplier IS NOT NULL)::INT + (total_raw IS NOT NULL)::INT "
    "+ (vat_raw IS NOT NULL)::INT + (subtotal_raw IS NOT NULL)::INT AS INTEGER) AS n_scores "
    "FROM inv i LEFT JOIN items f ON i.doc_id = f.doc_id AND f.item_no = 1 LEFT JOIN items l ON i.doc_id = l.doc_id AND l.item_no = i.n_items"))
def x_json_roundtrip(spark, d):
    """Records written as JSON in the shared folder and read back as any reader would: amounts are numbers or text."""
    path = scratch_path(spark, "json-records")
    write_json(to_record(invoices(spark, d)), path)
    item = "struct<description:string,quantity:bigint,unit_price:double,total:double>"
    schema = ("invoice_number string, invoice_date string, supplier string, total string, vat string, subtotal string, "
              f"line_items array<{item}>, confidence_scores map<string,double>")
    # record and kind of each amount come from the same line, so that no row is looked up by a value that may be NULL or repeated
    quoted = [F.contains("value", F.lit(f'"{f}": "')).alias(f"_{f}_text") for f in AMOUNT_FIELDS]
    both = spark.read.text(path).select(F.from_json("value", schema).alias("r"), *quoted).select("r.*", *[f"_{f}_text" for f in AMOUNT_FIELDS])
    first, last = F.get("line_items", 0), F.get("line_items", F.size("line_items") - 1)
    ends = [x[k].alias(f"{name}_{k}") for name, x in (("first", first), ("last", last)) for k in ("description", "quantity", "unit_price", "total")]
    return both.select(
        "invoice_number", "invoice_date", "supplier", *[c for f in AMOUNT_FIELDS for c in (
            F.when(~F.col(f"_{f}_text"), F.col(f)).try_cast("double").alias(f), F.when(F.col(f"_{f}_text"), F.col(f)).alias(f"{f}_text"))],
        F.size("line_items").alias("n_items"), *ends, F.try_element_at("confidence_scores", F.lit("total")).alias("total_score"), F.size("confidence_scores").alias("n_scores"))


@register("x_csv_roundtrip", O.with_base(
    "SELECT i.doc_id, i.invoice_number, invoice_date, supplier, total_raw IS NOT NULL AS has_total, "
    + "".join(f"CASE WHEN conv_{f} THEN i.{f} ELSE try_cast({f}_raw AS DOUBLE) END AS {f}, " for f in ("total", "vat", "subtotal"))
    + _CONF + ", CAST(n_items AS INTEGER) AS line_items_count, "
    "CAST(f.item_no AS INTEGER) AS item_no, f.description, f.quantity, f.total AS item_total, f.unit_price "
    "FROM inv i LEFT JOIN items f ON i.doc_id = f.doc_id"))
def x_csv_roundtrip(spark, d):
    """Both CSV tables written in the shared folder and read back; first descriptions hold a line break."""
    path = scratch_path(spark, "csv-records")
    write_csv(materialize(to_record(invoices(spark, d)), "records"), path)
    read = lambda name, schema: spark.read.options(**CSV_READ_OPTIONS).schema(schema).csv(f"{path}/{name}")
    scores = ", ".join(f"confidence_{f} double" for f in ("invoice_number", "invoice_date", "supplier", "total", "vat", "subtotal"))
    head = read("invoices", "doc_id long, invoice_number string, invoice_date string, supplier string, total string, vat string, "
                            f"subtotal string, line_items_count int, {scores}")
    items = read("line_items", "doc_id long, item_no int, description string, quantity long, total double, unit_price double")
    amounts = [F.col(f).try_cast("double").alias(f) for f in AMOUNT_FIELDS]
    scores = [c for c in head.columns if c.startswith("confidence_")]
    return head.select("doc_id", "invoice_number", "invoice_date", "supplier", F.col("total").isNotNull().alias("has_total"), *amounts, *scores, "line_items_count").join(
        items.withColumnRenamed("total", "item_total"), "doc_id", "left")


@register("x_item_union", O.with_base(
    "SELECT doc_id, CAST(item_no AS INTEGER) AS item_no, description, CASE WHEN doc_id % 2 = 0 THEN CAST(quantity AS BIGINT) END AS quantity, "
    "CASE WHEN doc_id % 2 = 1 THEN unit_price END AS unit_price FROM items"))
def x_item_union(spark, d):
    items = line_item_rows(to_record(invoices(spark, d))).withColumn("quantity", F.col("quantity").cast("bigint")).drop("total")
    return union_item_tables(items.filter("doc_id % 2 = 0").drop("unit_price"), items.filter("doc_id % 2 = 1").drop("quantity"))


@register("x_output_names", "SELECT url AS path, 'invoice_' || row_number() OVER (ORDER BY url) AS output_name FROM pages")
def x_output_names(spark, d):
    return output_names(read_table(spark, d, "pages").select(F.col("url").alias("path")))


# ---- targets ------------------------------------------------------------------------------------------------------

@register("i_generic", O.with_base(
    "SELECT doc_id, supplier AS vendor, invoice_number, invoice_date, subtotal, vat AS tax_amount, "
    "total AS total_amount, CAST(n_items AS BIGINT) AS n_line_items, 'unknown' AS validation_status, "
    "CAST(0 AS BIGINT) AS n_anomaly_flags FROM inv"))
def i_generic(spark, d):
    g = to_target(invoices(spark, d), "generic")
    return g.select("doc_id", "vendor", "invoice_number", "invoice_date", "subtotal", "tax_amount", "total_amount",
                    F.size("line_items").cast("bigint").alias("n_line_items"),
                    F.col("metadata.validation_status").alias("validation_status"),
                    F.size("metadata.anomaly_flags").cast("bigint").alias("n_anomaly_flags"))


@register("i_sap", O.with_base(
    "SELECT doc_id, 'CompanyCode' AS BUKRS, supplier AS LIFNR, invoice_date AS BLDAT, total AS WRBTR, 'USD' AS WAERS, "
    "invoice_number AS XBLNR, 'ZINV' AS BSART, CAST(n_items AS BIGINT) AS n_items FROM inv"))
def i_sap(spark, d):
    s = to_target(invoices(spark, d), "SAP")
    return s.select("doc_id", "BUKRS", "LIFNR", "BLDAT", "WRBTR", "WAERS", "XBLNR", "BSART",
                    F.size("ITEMS").cast("bigint").alias("n_items"))


@register("i_oracle", O.with_base(
    "SELECT doc_id, supplier AS vendor_id, invoice_number AS invoice_num, invoice_date, total AS invoice_amount, "
    "vat AS tax_amount, 'USD' AS currency_code, 'STANDARD' AS invoice_type_lookup_code, "
    "'Invoice ' || invoice_number AS description, CAST(n_items AS BIGINT) AS n_lines FROM inv"))
def i_oracle(spark, d):
    o = to_target(invoices(spark, d), "Oracle")
    return o.select("doc_id", "vendor_id", "invoice_num", "invoice_date", "invoice_amount", "tax_amount",
                    "currency_code", "invoice_type_lookup_code", "description",
                    F.size("lines").cast("bigint").alias("n_lines"))


_LINES = "array<struct<item_no:int,description:string,quantity:decimal(38,0),unit_price:double,total:double>>"
_PAYLOADS = {
    "generic": (f"vendor string, invoice_number string, invoice_date string, subtotal double, tax_amount double, total_amount double, line_items {_LINES}, "
                "metadata struct<extraction_confidence:map<string,double>,validation_status:string,anomaly_flags:array<string>>",
                {"vendor": "vendor", "number": "invoice_number", "issued": "invoice_date", "amount": "total_amount", "tax": "tax_amount", "subtotal": "subtotal", "items": "line_items"}),
    "sap": (f"BUKRS string, LIFNR string, BLDAT string, WRBTR double, WAERS string, XBLNR string, BSART string, ITEMS {_LINES}",
            {"vendor": "LIFNR", "number": "XBLNR", "issued": "BLDAT", "amount": "WRBTR", "items": "ITEMS"}),
    "oracle": (f"vendor_id string, invoice_num string, invoice_date string, invoice_amount double, tax_amount double, currency_code string, invoice_type_lookup_code string, "
               f"description string, lines {_LINES}",
               {"vendor": "vendor_id", "number": "invoice_num", "issued": "invoice_date", "amount": "invoice_amount", "tax": "tax_amount", "items": "lines"}),
}


@register("i_outbox", O.with_base(
    "SELECT i.doc_id, t.target, invoice_number AS document_id, t.label, supplier AS vendor, invoice_number AS number, i.total AS amount, invoice_date AS issued, "
    "CASE WHEN t.target <> 'sap' THEN i.vat END AS tax, CASE WHEN t.target = 'generic' THEN i.subtotal END AS subtotal, CAST(n_items AS INTEGER) AS n_items, "
    "coalesce(f.descriptions, '') AS descriptions, coalesce(f.quantity, 0)::BIGINT AS quantity, coalesce(f.unit_cents, 0)::BIGINT AS unit_cents, coalesce(f.cents, 0)::BIGINT AS cents, "
    "CASE t.target WHEN 'sap' THEN 'CompanyCode USD ZINV' WHEN 'oracle' THEN 'USD STANDARD' || coalesce(' Invoice ' || invoice_number, '') ELSE concat_ws(' ', 'unknown', 0, "
    "CASE WHEN invoice_date IS NOT NULL THEN 'invoice_date' END, CASE WHEN invoice_number IS NOT NULL THEN 'invoice_number' END, CASE WHEN subtotal_raw IS NOT NULL THEN 'subtotal' END, "
    "CASE WHEN supplier IS NOT NULL THEN 'supplier' END, CASE WHEN total_raw IS NOT NULL THEN 'total' END, CASE WHEN vat_raw IS NOT NULL THEN 'vat' END) END AS others "
    "FROM inv i CROSS JOIN (VALUES ('generic', 'Generic'), ('sap', 'SAP'), ('oracle', 'Oracle')) t(target, label) "
    "LEFT JOIN (SELECT doc_id, string_agg(description, '|' ORDER BY item_no) AS descriptions, sum(quantity) AS quantity, sum(CAST(round(unit_price * 100) AS BIGINT)) AS unit_cents, "
    "sum(CAST(round(total * 100) AS BIGINT)) AS cents FROM items GROUP BY doc_id) f ON i.doc_id = f.doc_id"))
def i_outbox(spark, d):
    """Payloads as they would be sent: each is read back from its JSON once, and every field and item of it is compared."""
    inv = invoices_once(spark, d)  # I5 fan-out: one written frame, one projection per target
    out = None
    for t, (schema, names) in _PAYLOADS.items():
        sent = outbox(inv, t).select("doc_id", "target", "document_id", "label", F.from_json("payload", schema).alias("p"))
        p = lambda name: F.col(f"p.{names[name]}") if name in names else F.lit(None).cast("double")
        summed = lambda v: F.aggregate(p("items"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(v(x).cast("long"), F.lit(0)))
        others = {"sap": ["p.BUKRS", "p.WAERS", "p.BSART"], "oracle": ["p.currency_code", "p.invoice_type_lookup_code", "p.description"],
                  "generic": ["p.metadata.validation_status", F.size("p.metadata.anomaly_flags").cast("string"),
                              F.array_join(F.array_sort(F.map_keys("p.metadata.extraction_confidence")), " ")]}
        one = sent.select("doc_id", "target", "document_id", "label", *[p(n).alias(n) for n in ("vendor", "number", "amount", "issued", "tax", "subtotal")],
                          F.size(p("items")).alias("n_items"), F.array_join(F.transform(p("items"), lambda x: x["description"]), "|").alias("descriptions"),
                          summed(lambda x: x["quantity"]).alias("quantity"), summed(lambda x: F.round(x["unit_price"] * 100)).alias("unit_cents"),
                          summed(lambda x: F.round(x["total"] * 100)).alias("cents"), F.concat_ws(" ", *others[t]).alias("others"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- end-to-end runs ----------------------------------------------------------------------------------------------

def batch_docs(spark, d) -> DataFrame:
    """Rendered invoices plus an OCR status: orders still pending ('P') count as failed scans."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus")
    return rendered_invoices(spark, d).join(o, "doc_id", "left").select(
        "doc_id", "text", (F.coalesce(F.col("o_orderstatus"), F.lit("")) != "P").alias("ocr_success"))


_BATCH_SQL = [
    "ocr AS (SELECT o_orderkey AS doc_id, coalesce(o_orderstatus, '') <> 'P' AS ocr_ok FROM orders)"]


@register("p_batch_summary", O.with_base(
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE coalesce(o.ocr_ok, true)) AS BIGINT) "
    "AS successful, CAST(count(*) FILTER (WHERE NOT coalesce(o.ocr_ok, true)) AS BIGINT) AS failed "
    "FROM inv i LEFT JOIN ocr o ON i.doc_id = o.doc_id", _BATCH_SQL))
def p_batch_summary(spark, d):
    return summarize(run_invoices(batch_docs(spark, d), as_of=AS_OF))


@register("p_batch_summary_rules", O.with_base(
    "SELECT CAST(count(*) AS BIGINT) AS total, "
    "CAST(count(*) FILTER (WHERE coalesce(o.ocr_ok, true) AND NOT r.failed) AS BIGINT) AS successful, "
    "CAST(count(*) FILTER (WHERE NOT (coalesce(o.ocr_ok, true) AND NOT r.failed)) AS BIGINT) AS failed "
    "FROM inv i LEFT JOIN ocr o ON i.doc_id = o.doc_id JOIN rules r ON i.doc_id = r.doc_id",
    _BATCH_SQL + _RULES_SQL))
def p_batch_summary_rules(spark, d):
    return summarize(run_invoices(batch_docs(spark, d), options=Options(anomaly_mode="rule_based"), as_of=AS_OF))


@register("p_stage_status", O.with_base(
    "SELECT i.doc_id, coalesce(o.ocr_ok, true) AS ocr_success, CAST(length(r0.text) AS BIGINT) AS text_length, "
    "CASE WHEN coalesce(o.ocr_ok, true) THEN CAST(8 AS BIGINT) END AS n_fields_extracted, "
    "CASE WHEN coalesce(o.ocr_ok, true) THEN v.n_err = 0 END AS valid, "
    "CASE WHEN coalesce(o.ocr_ok, true) THEN v.n_err END AS n_errors, "
    "CASE WHEN coalesce(o.ocr_ok, true) THEN v.n_warn END AS n_warnings, "
    "CASE WHEN coalesce(o.ocr_ok, true) THEN CAST(CASE WHEN r.failed THEN 0 ELSE "
    "(CASE WHEN r.round_total THEN 1 ELSE 0 END) + (CASE WHEN r.duplicate_items THEN 1 ELSE 0 END) + "
    "(CASE WHEN r.missing_supplier THEN 1 ELSE 0 END) + (CASE WHEN r.high_vat_rate IS NOT NULL THEN 1 ELSE 0 END) "
    "END AS BIGINT) END AS total_anomalies, coalesce(o.ocr_ok, true) AS success, "
    "CASE WHEN NOT coalesce(o.ocr_ok, true) THEN 'OCR extraction failed' END AS error "
    "FROM inv i JOIN rendered r0 ON i.doc_id = r0.doc_id LEFT JOIN ocr o ON i.doc_id = o.doc_id "
    "JOIN verdict v ON i.doc_id = v.doc_id JOIN rules r ON i.doc_id = r.doc_id",
    _BATCH_SQL + O.val_ctes(AS_OF) + _RULES_SQL))
def p_stage_status(spark, d):
    r = run_invoices(batch_docs(spark, d), as_of=AS_OF)
    s = F.col("stages")
    return r.select(
        "doc_id", s["ocr"]["success"].alias("ocr_success"), s["ocr"]["text_length"].cast("bigint").alias("text_length"),
        F.size(s["extraction"]["fields_extracted"]).cast("bigint").alias("n_fields_extracted"),
        s["validation"]["valid"].alias("valid"),
        F.size(s["validation"]["errors"]).cast("bigint").alias("n_errors"),
        F.size(s["validation"]["warnings"]).cast("bigint").alias("n_warnings"),
        s["anomaly_detection"]["total_anomalies"].cast("bigint").alias("total_anomalies"),
        "success", "error")


@register("p_report", O.with_base(
    "SELECT i.doc_id AS name, CASE WHEN coalesce(o.ocr_ok, true) THEN 'success' ELSE 'failed' END AS status, "
    "CASE WHEN coalesce(o.ocr_ok, true) THEN i.supplier END AS supplier, "
    "CASE WHEN coalesce(o.ocr_ok, true) THEN i.total END AS total, "
    "CAST(CASE WHEN coalesce(o.ocr_ok, true) THEN i.n_items ELSE 0 END AS BIGINT) AS n_line_items, "
    "CAST(CASE WHEN NOT coalesce(o.ocr_ok, true) OR r.failed THEN 0 ELSE "
    "(CASE WHEN r.round_total THEN 1 ELSE 0 END) + (CASE WHEN r.duplicate_items THEN 1 ELSE 0 END) + "
    "(CASE WHEN r.missing_supplier THEN 1 ELSE 0 END) + (CASE WHEN r.high_vat_rate IS NOT NULL THEN 1 ELSE 0 END) "
    "END AS BIGINT) AS n_anomalies, CASE WHEN coalesce(o.ocr_ok, true) THEN v.n_err = 0 END AS valid "
    "FROM inv i LEFT JOIN ocr o ON i.doc_id = o.doc_id JOIN verdict v ON i.doc_id = v.doc_id "
    "JOIN rules r ON i.doc_id = r.doc_id", _BATCH_SQL + O.val_ctes(AS_OF) + _RULES_SQL))
def p_report(spark, d):
    return report(run_invoices(batch_docs(spark, d), as_of=AS_OF))


@register("p_failed_rows", O.with_base(
    "SELECT coalesce(o.ocr_ok, true) AS ocr_ok, CAST(count(*) AS BIGINT) AS n, "
    "CAST(sum(CASE WHEN coalesce(o.ocr_ok, true) THEN v.n_err + v.n_warn ELSE 0 END) AS BIGINT) AS n_findings, "
    "CAST(sum(CASE WHEN coalesce(o.ocr_ok, true) AND coalesce(i.supplier, f.org) IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_suppliers, "
    "CAST(sum(CASE WHEN coalesce(o.ocr_ok, true) THEN 1 ELSE 0 END) AS BIGINT) AS n_exported "
    "FROM inv i LEFT JOIN ocr o ON i.doc_id = o.doc_id JOIN verdict2 v ON i.doc_id = v.doc_id "
    "LEFT JOIN (SELECT doc_id, arg_min(text, ord) AS org FROM entities WHERE label = 'ORG' GROUP BY doc_id) f ON i.doc_id = f.doc_id GROUP BY 1",
    _BATCH_SQL + [O.ENTITIES_SQL] + O.val_ctes(AS_OF) + ["""
verdict2 AS (
  SELECT v.doc_id, v.n_err - CASE WHEN i.supplier IS NULL AND f.org IS NOT NULL THEN 1 ELSE 0 END AS n_err, v.n_warn
  FROM verdict v JOIN inv i ON v.doc_id = i.doc_id
  LEFT JOIN (SELECT doc_id, arg_min(text, ord) AS org FROM entities WHERE label = 'ORG' GROUP BY doc_id) f ON v.doc_id = f.doc_id)"""]))
def p_failed_rows(spark, d):
    """A failed scan yields no record: no finding, no supplier from its entities, no export."""
    ents = entity_table(read_table(spark, d, "orders"), read_table(spark, d, "customer"))
    r = run_invoices(batch_docs(spark, d), options=Options(use_entities=True), as_of=AS_OF, entities=ents)
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return r.groupBy(F.col("stages.ocr.success").alias("ocr_ok")).agg(
        F.count("*").alias("n"), F.sum(n("errors") + n("warnings")).alias("n_findings"), F.count("supplier").alias("n_suppliers"),
        F.count_if(F.coalesce(F.col("stages.export.success"), F.lit(False))).alias("n_exported"))


@register("p_run_history", O.with_base(
    "SELECT i.doc_id, i.supplier, p.n_rows AS history_rows, CAST(coalesce(o.n, 0) AS BIGINT) AS n_organizations, "
    "i.invoice_number AS sent_number FROM inv2_ i LEFT JOIN sprof p ON i.supplier = p.supplier "
    "LEFT JOIN (SELECT doc_id, count(*) AS n FROM entities WHERE label = 'ORG' GROUP BY doc_id) o ON i.doc_id = o.doc_id",
    [O.ENTITIES_SQL] + O.profile_ctes("sprof", "inv", "total", "vat", ["supplier"]) + ["""
inv2_ AS (
  SELECT i.* EXCLUDE (supplier), coalesce(i.supplier, f.org) AS supplier
  FROM inv i LEFT JOIN (SELECT doc_id, arg_min(text, ord) AS org FROM entities WHERE label = 'ORG' GROUP BY doc_id) f ON i.doc_id = f.doc_id)"""]))
def p_run_history(spark, d):
    """A run with a history by supplier, entities and a target."""
    ents = entity_table(read_table(spark, d, "orders"), read_table(spark, d, "customer"))
    r = run_invoices(rendered_invoices(spark, d), history=invoices_once(spark, d), by=["supplier"], entities=ents, as_of=AS_OF,
                     options=Options(use_entities=True, target="sap"), materialize_extracted=True)
    return r.select("doc_id", "supplier", "history_rows", F.size("organizations").cast("bigint").alias("n_organizations"),
                    F.col("stages.erp_integration.XBLNR").alias("sent_number"))


# ---- structured input: amounts as text, items with absent keys ----------------------------------------------------

@register("v_structured_amounts", """
WITH s AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'abc' WHEN 1 THEN '1,234.00' WHEN 2 THEN '-' || o_custkey ELSE ' ' || o_custkey || '.5 ' END AS total,
                  CASE WHEN o_orderkey % 3 = 0 THEN -1.0 * o_custkey WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_custkey END AS vat FROM orders)
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'total' ELSE '' END AS not_a_number,
       concat_ws(',', CASE WHEN doc_id % 4 = 2 AND try_cast(total AS DOUBLE) < 0 THEN 'total' END, CASE WHEN vat < 0 THEN 'vat' END) AS negative,
       CASE WHEN doc_id % 4 >= 2 THEN CAST(trim(total) AS DOUBLE) END AS total FROM s""")
def v_structured_amounts(spark, d):
    k = F.col("o_orderkey")
    cust = F.col("o_custkey").cast("string")
    rows = read_table(spark, d, "orders").select(
        k.alias("doc_id"), F.lit("Supplier").alias("supplier"), F.lit(None).cast("string").alias("invoice_date"), F.lit(None).cast("double").alias("subtotal"),
        F.when(k % 4 == 0, F.lit("abc")).when(k % 4 == 1, F.lit("1,234.00")).when(k % 4 == 2, F.concat(F.lit("-"), cust)).otherwise(
            F.concat(F.lit(" "), cust, F.lit(".5 "))).alias("total"),
        F.when(k % 3 == 0, -F.col("o_custkey")).when(k % 3 == 2, F.col("o_custkey")).cast("double").alias("vat"))
    v = validate(rows, required_fields=[], as_of=AS_OF)
    return v.select("doc_id", _fields_of("errors", "not_a_number").alias("not_a_number"), _fields_of("errors", "negative").alias("negative"), "total")


@register("v_item_missing", """
WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber, l_quantity, l_extendedprice,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS item_no FROM lineitem)
SELECT doc_id, item_no, 'description' AS field FROM l WHERE l_linenumber = 2
UNION ALL SELECT doc_id, item_no, 'quantity' FROM l WHERE l_quantity >= 40
UNION ALL SELECT doc_id, item_no, 'unit_price' FROM l WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, item_no, 'total' FROM l WHERE l_extendedprice < 5000""")
def v_item_missing(spark, d):
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.struct(
        F.when(F.col("l_linenumber") != 2, F.lit("part")).alias("description"), F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_orderkey") % 7 != 0, F.lit(1.0)).alias("unit_price"), F.when(F.col("l_extendedprice") >= 5000, F.col("l_extendedprice")).alias("total")).alias("item"))
    rows = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("line_items"))
    none = {c: F.lit(None).cast(t) for c, t in (("supplier", "string"), ("invoice_date", "string"), ("total", "double"), ("vat", "double"), ("subtotal", "double"))}
    v = validate(rows.withColumns(none), required_fields=[], as_of=AS_OF)
    return v.select("doc_id", F.explode_outer(_codes("errors", "item_field_missing")).alias("f")).where(F.col("f").isNotNull()).select(
        "doc_id", F.col("f.item_no").cast("bigint").alias("item_no"), F.col("f.field").alias("field"))


def flagship(spark, d) -> DataFrame:
    """Invoices whose stated total disagrees with subtotal + VAT, with their error/warning/anomaly counts."""
    # written once before filtering: a filter on derived columns would otherwise inline every regex it depends on
    r = materialize(run_invoices(rendered_invoices(spark, d), as_of=AS_OF))
    mism = F.exists("errors", lambda f: f["code"] == "total_mismatch")
    return r.select("doc_id", "invoice_number", "supplier", "subtotal", "vat", "total",
                    F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"),
                    F.col("total_anomalies").alias("n_anomalies"), mism.alias("_m")).where("_m").drop("_m")


# registers the queries over records, dated histories, own rules and observed runs, and those over files and laid out tables
from . import catalog_records as _catalog_records  # noqa: E402, F401
from . import catalog_files as _catalog_files  # noqa: E402, F401
