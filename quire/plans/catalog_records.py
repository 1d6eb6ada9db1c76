"""Registered queries over records with absent keys, histories by date, own rules, observed runs and ragged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stage import materialize, scratch_path
from ..operators.anomaly import detect_anomalies
from ..operators.growing import append_state, stored_profile
from ..operators.history import profile_as_of
from ..operators.rules import Rule
from ..operators.targets import to_target
from ..operators.validate import validate
from ..options import Options
from ..sinks.ragged import ragged_header, write_ragged_csv
from ..sinks.writers import CSV_READ_OPTIONS
from ..sources.records import read_records
from ..sources.tables import read_table
from . import oracle as O
from .catalog import _BATCH_SQL, _RULES_SQL, AS_OF, batch_docs, invoices, invoices_once, register
from .run import export_observed, run_invoices


# ---- records in which keys are absent, null or of another type -----------------------------------------------------

def json_orders(spark, d) -> DataFrame:
    """One JSON record for each order; which keys it has, and as what, follows from its number."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    k, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    quoted = lambda key, c: F.concat(F.lit(f'"{key}": "'), c, F.lit('"'))
    plain = lambda key, c: F.concat(F.lit(f'"{key}": '), c)
    items = ('"line_items": [{"description": "a", "quantity": 2, "unit_price": 1.5, "total": 3.0}, {"quantity": null, "total": "7"}, '
             '{"description": "b", "quantity": 2, "unit_price": "2.5", "total": 4}]')
    parts = F.concat_ws(
        ", ",
        F.when(k % 7 != 0, quoted("invoice_number", F.concat(F.lit("INV-"), k.cast("string")))),
        F.when(k % 4 == 1, F.lit('"supplier": null')).when(k % 4 == 2, F.lit('"supplier": ""')).when(k % 4 == 3, quoted("supplier", F.concat(F.lit("Supplier "), cust))),
        F.when(k % 5 == 1, F.lit('"total": null')).when(k % 5 == 2, quoted("total", F.concat(cust, F.lit(".5")))).when(k % 5 == 3, plain("total", F.concat(cust, F.lit(".25")))).when(
            k % 5 == 4, quoted("total", F.lit("n/a"))),
        F.when(k % 3 == 1, F.lit('"vat": null')).when(k % 3 == 2, plain("vat", cust)),
        F.when(k % 6 == 1, F.lit('"line_items": null')).when(k % 6 == 2, F.lit('"line_items": []')).when(k % 6 > 2, F.lit(items)),
        F.when(k % 9 == 0, F.lit('"validation_status": null')).when(k % 9 == 1, F.lit('"validation_status": "ok"')),
        F.when(k % 8 == 0, F.lit('"anomaly_flags": ["x", "y"]')))
    whole = F.concat(F.lit("{"), parts, F.lit("}"))
    return o.select(k.alias("doc_id"), F.when(k % 101 == 0, F.lit("{broken")).when(k % 103 == 0, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole).alias("value"))


_RECORDS = """
r AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 101 <> 0 AND o_orderkey % 103 <> 0 AS ok FROM orders),
f AS (SELECT k, ok, ok AND k % 7 <> 0 AS has_number, ok AND k % 4 <> 0 AS has_supplier, ok AND k % 5 <> 0 AS has_total, ok AND k % 3 <> 0 AS has_vat, ok AND k % 6 <> 0 AS has_items,
  CASE WHEN ok AND k % 7 <> 0 THEN 'INV-' || k END AS number,
  CASE WHEN ok AND k % 4 = 2 THEN '' WHEN ok AND k % 4 = 3 THEN 'Supplier ' || c END AS supplier,
  CASE WHEN ok AND k % 5 = 2 THEN c + 0.5 WHEN ok AND k % 5 = 3 THEN c + 0.25 END::DOUBLE AS total, CASE WHEN ok AND k % 3 = 2 THEN c END::DOUBLE AS vat,
  CASE WHEN ok AND k % 6 > 2 THEN 3 WHEN ok AND k % 6 = 1 THEN NULL ELSE 0 END::INTEGER AS n_items,
  CASE WHEN ok AND k % 9 = 0 THEN NULL WHEN ok AND k % 9 = 1 THEN 'ok' ELSE 'unknown' END AS status, CASE WHEN ok AND k % 8 = 0 THEN 2 ELSE 0 END::INTEGER AS n_flags FROM r)"""


@register("i_record_defaults", f"""
WITH {_RECORDS}
SELECT k AS doc_id, ok AS record_ok, CASE WHEN has_supplier THEN supplier ELSE '' END AS vendor, CASE WHEN has_number THEN number ELSE '' END AS invoice_number, '' AS invoice_date,
  0.0::DOUBLE AS subtotal, CASE WHEN has_total THEN total ELSE 0.0 END AS total_amount, CASE WHEN has_vat THEN vat ELSE 0.0 END AS tax_amount, n_items, status AS validation_status, n_flags,
  'Invoice ' || CASE WHEN has_number THEN number ELSE '' END AS oracle_description, CASE WHEN has_supplier THEN supplier ELSE '' END AS sap_vendor,
  CASE WHEN n_items > 0 THEN 7.0 END::DOUBLE AS second_total FROM f""")
def i_record_defaults(spark, d):
    """A default where this record lacks the key; null and text that is no number pass through as NULL."""
    r = materialize(read_records(json_orders(spark, d)), "records")
    extra = [to_target(r, "oracle").select("doc_id", F.col("description").alias("oracle_description")), to_target(r, "sap").select("doc_id", F.col("LIFNR").alias("sap_vendor")),
             r.select("doc_id", "record_ok")]
    out = to_target(r, "generic")
    for e in extra:  # one row a record on both sides: the compressed size of a few columns is no reason to send them through the driver
        out = out.join(e.hint("merge"), "doc_id")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return out.select("doc_id", "record_ok", "vendor", "invoice_number", "invoice_date", "subtotal", "total_amount", "tax_amount", size("line_items").alias("n_items"),
                      F.col("metadata.validation_status").alias("validation_status"), size("metadata.anomaly_flags").alias("n_flags"), "oracle_description", "sap_vendor",
                      F.get("line_items", 1)["total"].alias("second_total"))


def _listed(col: str, code: str, item: bool = False) -> Column:
    found = F.filter(col, lambda f: f["code"] == code)
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["item_no"].cast("string"), f["field"]) if item else f["field"]), ",")


@register("v_record_keys", f"""
WITH {_RECORDS}
SELECT k AS doc_id, concat_ws(',', CASE WHEN supplier IS NULL THEN 'supplier' END, CASE WHEN NOT has_total OR k % 5 = 1 THEN 'total' END, 'invoice_date') AS missing,
  CASE WHEN ok AND k % 5 = 4 THEN 'total' ELSE '' END AS not_a_number,
  CASE WHEN n_items > 0 THEN '2:description,2:unit_price' ELSE '' END AS item_missing, CASE WHEN n_items > 0 THEN '3:total' ELSE '' END AS item_mismatch,
  CASE WHEN ok AND k % 5 = 4 THEN 'failed' WHEN supplier IS NULL OR supplier = '' THEN 'missing_critical_field' ELSE '' END AS anomaly FROM f""")
def v_record_keys(spark, d):
    """V1, V2, V9, V10, A11, A16 on records: an item's null is not a missing key, and text that is no number fails detection."""
    v = detect_anomalies(validate(read_records(json_orders(spark, d)), as_of=AS_OF), mode="rule_based")
    v = materialize(v.select("doc_id", "errors", "anomalies", "anomaly_error"), "checked")
    first = F.get(F.filter("anomalies", lambda a: a["type"] == "missing_critical_field"), 0)["type"]
    return v.select("doc_id", _listed("errors", "required_missing").alias("missing"), _listed("errors", "not_a_number").alias("not_a_number"),
                    _listed("errors", "item_field_missing", True).alias("item_missing"), _listed("errors", "item_total_mismatch", True).alias("item_mismatch"),
                    F.when(F.col("anomaly_error").isNotNull(), F.lit("failed")).otherwise(F.coalesce(first, F.lit(""))).alias("anomaly"))


# ---- the history before each invoice --------------------------------------------------------------------------------

def _near(c: str, x: str | None = None) -> Column:
    """Hundredths, rounded where neither engine's last bits decide."""
    return F.floor(F.col(c) * 100 + 0.3721).cast("long").alias(x or c)


def _profiles_sql(history: str) -> str:
    """``p``: for each customer and day of ``h`` (customer, day, t, v) what lies before that day."""
    return f"""
h AS ({history}),
w AS (SELECT DISTINCT customer, day FROM h),
p AS (SELECT w.customer, w.day, count(h.customer) AS n_rows, count(t) AS n_total, avg(t) AS mean_total, stddev_pop(t) AS std_total, quantile_cont(t, 0.25) AS q1_total,
             quantile_cont(t, 0.75) AS q3_total, count(v) AS n_vat, avg(v) AS mean_vat, stddev_pop(v) AS std_vat
      FROM w LEFT JOIN h ON h.customer = w.customer AND h.day < w.day GROUP BY w.customer, w.day)"""


_ORDERS_SQL = _profiles_sql("SELECT CASE WHEN o_custkey % 3 = 0 THEN 'hot' ELSE o_custkey::VARCHAR END AS customer, o_orderdate::DATE AS day, nullif(o_totalprice, 0) AS t, "
                            "CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice * 0.1 END AS v FROM orders")
_EARLIER_SQL = _profiles_sql("SELECT doc_id % 7 AS customer, parsed AS day, nullif(total, 0) AS t, nullif(vat, 0) AS v FROM val WHERE parsed IS NOT NULL")
_FIGURES = ("mean_total", "std_total", "q1_total", "q3_total", "mean_vat", "std_vat")


def dated_history(spark, d) -> DataFrame:
    """Orders as a history: a third of all rows belong to one customer."""
    o = read_table(spark, d, "orders")
    customer = F.when(F.col("o_custkey") % 3 == 0, F.lit("hot")).otherwise(F.col("o_custkey").cast("string"))
    return o.select(customer.alias("customer"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("total"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice") * 0.1).alias("vat"))


@register("a_profile_as_of", f"WITH {_ORDERS_SQL} SELECT customer, strftime(day, '%Y-%m-%d') AS day, n_rows, n_total, n_vat, "
          + ", ".join(f"CAST(floor({c} * 100 + 0.3721) AS BIGINT) AS {c}" for c in _FIGURES) + " FROM p")
def a_profile_as_of(spark, d):
    """A1–A3 for every customer and day, from the orders before it."""
    h = dated_history(spark, d)
    p = profile_as_of(h, h, ["customer"], "day")
    return p.select("customer", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_rows", "n_total", "n_vat", *[_near(c) for c in _FIGURES])


@register("a_earlier_history", O.with_base(
    "SELECT v.doc_id, p.n_rows AS history_rows, CASE WHEN p.n_rows >= 2 AND p.n_total > 0 AND total <> 0 AND NOT coalesce(vat_raw IS NOT NULL AND vat IS NULL AND p.n_vat > 0, false) THEN "
    "CAST(floor(CASE WHEN p.n_total < 2 OR p.std_total = 0 THEN 0 ELSE abs((total - p.mean_total) / p.std_total) END * 1000 + 0.3721) AS BIGINT) END AS z "
    "FROM val v LEFT JOIN p ON v.doc_id % 7 = p.customer AND v.parsed = p.day", O.val_ctes(AS_OF) + [_EARLIER_SQL]))
def a_earlier_history(spark, d):
    """Every invoice against the invoices of its group dated before it."""
    inv = materialize(validate(invoices_once(spark, d), as_of=AS_OF).withColumn("customer", F.col("doc_id") % 7), "validated")
    prof = profile_as_of(inv, inv, ["customer"])
    out = detect_anomalies(inv, prof, by=["customer", "invoice_date_parsed"])
    return out.select("doc_id", "history_rows", F.floor(F.col("scores")["total_z_score"] * 1000 + 0.3721).cast("long").alias("z"))


# ---- a profile that grows ---------------------------------------------------------------------------------------------

@register("a_profile_grown", f"""
WITH {_ORDERS_SQL}
SELECT customer, count(*) AS n_rows, count(t) AS n_total, count(v) AS n_vat, {", ".join(f"CAST(floor({f}({x}) * 100 + 0.3721) AS BIGINT) AS {n}" for n, f, x in (
    ("mean_total", "avg", "t"), ("std_total", "stddev_pop", "t"), ("mean_vat", "avg", "v"), ("std_vat", "stddev_pop", "v")))},
  true AS q1_near, true AS q3_near FROM h GROUP BY customer""")
def a_profile_grown(spark, d):
    """Parts of the history summed up one after another, one of them twice; quartiles within 1 % of the ranks of all totals."""
    h = dated_history(spark, d)
    path = scratch_path(spark, "state")
    years = F.year("day")
    for name, part in (("early", years < 1995), ("middle", (years >= 1995) & (years < 1997)), ("late", years >= 1997), ("middle", (years >= 1995) & (years < 1997))):
        append_state(h.where(part), path, name, ["customer"])
    p = stored_profile(spark, path, ["customer"])
    ranks = h.join(p.select("customer", "q1_total", "q3_total", "n_total"), "customer").groupBy("customer").agg(
        *[(F.count_if(F.col("total") <= F.col(q)) >= F.lit(share - 0.01) * F.first("n_total")).alias(f"{x}_low") for x, q, share in (("q1", "q1_total", 0.25), ("q3", "q3_total", 0.75))],
        *[(F.count_if(F.col("total") < F.col(q)) <= F.lit(share + 0.01) * F.first("n_total")).alias(f"{x}_high") for x, q, share in (("q1", "q1_total", 0.25), ("q3", "q3_total", 0.75))])
    return p.join(ranks, "customer").select("customer", "n_rows", "n_total", "n_vat", *[_near(c) for c in ("mean_total", "std_total", "mean_vat", "std_vat")],
                                            *[(F.col(f"{x}_low") & F.col(f"{x}_high")).alias(f"{x}_near") for x in ("q1", "q3")])


# ---- own rules ----------------------------------------------------------------------------------------------------------

OWN_RULES = [
    Rule("large_vat", "vat > 50000", "VAT is large", "vat", "warning", "vat"),
    Rule("odd_number", "invoice_number rlike '[13579]$'", "odd number", "invoice_number"),
    Rule("no_such_column", "shipping > 0", "never", "shipping"),
    Rule("few_items", "size(line_items) < 2 and supplier is not null", "few items", "line_items"),
]
OWN_ANOMALIES = [Rule("heavy", "total > 1000000", "over a million", "total", "high", "total"), Rule("cheap", "total < 20000", "cheap", "total", "low")]


@register("v_own_rules", O.with_base(
    "SELECT i.doc_id, concat_ws(',', CASE WHEN regexp_matches(invoice_number, '[13579]$') THEN 'odd_number' END, 'rule_failed', "
    "CASE WHEN n_items < 2 AND supplier IS NOT NULL THEN 'few_items' END) AS own_errors, v.n_err AS n_built_in, "
    "CASE WHEN vat > 50000 THEN vat END AS large_vat, concat_ws(',', CASE WHEN total > 1000000 THEN 'heavy' END, CASE WHEN total < 20000 THEN 'cheap' END) AS own_anomalies, "
    "CAST((CASE WHEN r.round_total THEN 1 ELSE 0 END) + (CASE WHEN r.duplicate_items THEN 1 ELSE 0 END) + (CASE WHEN r.missing_supplier THEN 1 ELSE 0 END) "
    "+ (CASE WHEN r.high_vat_rate IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_rules "
    "FROM inv i JOIN verdict v ON i.doc_id = v.doc_id JOIN rules r ON i.doc_id = r.doc_id WHERE NOT r.failed", O.val_ctes(AS_OF) + _RULES_SQL))
def v_own_rules(spark, d):
    """Rules given as a list: after the built-in ones, in their order; the one that cannot be applied is reported and stops nothing."""
    own = [r.code for r in OWN_RULES] + ["rule_failed"]
    v = validate(invoices(spark, d), as_of=AS_OF, rules=OWN_RULES)
    out = materialize(detect_anomalies(v, mode="rule_based", own_rules=OWN_ANOMALIES).select("doc_id", "errors", "warnings", "anomalies", "anomaly_error"), "own-rules")
    mine = lambda col, key, names: F.filter(col, lambda f: f[key].isin(names))
    joined = lambda col, key, names: F.array_join(F.transform(mine(col, key, names), lambda f: f[key]), ",")
    kinds = [r.code for r in OWN_ANOMALIES]
    return out.where("anomaly_error IS NULL").select(
        "doc_id", joined("errors", "code", own).alias("own_errors"), (F.size("errors") - F.size(mine("errors", "code", own))).cast("long").alias("n_built_in"),
        F.get(mine("warnings", "code", ["large_vat"]), 0)["observed"].alias("large_vat"), joined("anomalies", "type", kinds).alias("own_anomalies"),
        (F.size("anomalies") - F.size(mine("anomalies", "type", kinds))).cast("long").alias("n_rules"))


# ---- a run that counts itself ---------------------------------------------------------------------------------------------

_COUNTED = ("total", "successful", "failed", "errors.required_missing", "errors.not_a_number", "errors.total_mismatch", "errors.item_total_mismatch", "warnings.unusual_vat_rate",
            "warnings.unparseable_date", "n_errors", "n_warnings")


_COUNTED_SQL = """
SELECT what, n FROM (UNPIVOT (
  SELECT count(*)::BIGINT AS total, (count(*) FILTER (WHERE ok))::BIGINT AS successful, (count(*) FILTER (WHERE NOT ok))::BIGINT AS failed,
    sum(CASE WHEN ok THEN (supplier IS NULL)::INT + (total_raw IS NULL)::INT + (invoice_date IS NULL)::INT END)::BIGINT AS "errors.required_missing",
    sum(CASE WHEN ok THEN nan_total::INT + nan_vat::INT + nan_subtotal::INT END)::BIGINT AS "errors.not_a_number",
    sum(CASE WHEN ok THEN mismatch::INT END)::BIGINT AS "errors.total_mismatch", sum(CASE WHEN ok THEN coalesce(e.n, 0) END)::BIGINT AS "errors.item_total_mismatch",
    sum(CASE WHEN ok THEN unusual_rate::INT END)::BIGINT AS "warnings.unusual_vat_rate",
    sum(CASE WHEN ok THEN (invoice_date IS NOT NULL AND parsed IS NULL)::INT END)::BIGINT AS "warnings.unparseable_date",
    sum(CASE WHEN ok THEN n_err END)::BIGINT AS n_errors, sum(CASE WHEN ok THEN n_warn END)::BIGINT AS n_warnings
  FROM (SELECT val.*, coalesce(o.ocr_ok, true) AS ok FROM val LEFT JOIN ocr o ON val.doc_id = o.doc_id) x LEFT JOIN item_err_n e ON x.doc_id = e.doc_id
  JOIN verdict w ON x.doc_id = w.doc_id) ON COLUMNS(*) INTO NAME what VALUE n)"""


@register("p_observed_summary", O.with_base(_COUNTED_SQL, _BATCH_SQL + O.val_ctes(AS_OF)))
def p_observed_summary(spark, d):
    """Records exported as JSON and CSV; the summary and the findings by code come from the job that wrote them."""
    run = run_invoices(batch_docs(spark, d), options=Options(anomaly_mode="rule_based"), as_of=AS_OF)
    run = run.withColumn("success", F.col("stages.ocr.success"))
    _, counts = export_observed(run, scratch_path(spark, "observed"))
    return spark.createDataFrame([(k, counts.get(k, 0)) for k in _COUNTED], "what string, n long")


# ---- tables with the keys that occur -----------------------------------------------------------------------------------------

@register("x_ragged_header", f"""
WITH {_RECORDS}
SELECT k AS doc_id, number AS invoice_number, nullif(supplier, '') AS supplier, CASE WHEN k % 5 = 4 THEN 'n/a' WHEN k % 5 = 2 THEN c || '.5' WHEN k % 5 = 3 THEN c || '.25' END AS total,
  CASE WHEN k % 3 = 2 THEN c::VARCHAR END AS vat, nullif(status, 'unknown') AS validation_status, CASE WHEN k % 8 = 0 THEN '["x","y"]' END AS anomaly_flags,
  coalesce(n_items, 0) AS line_items_count FROM f JOIN (SELECT o_orderkey AS o, o_custkey AS c FROM orders) x ON f.k = x.o WHERE ok""")
def x_ragged_header(spark, d):
    """The header has the keys that occur in any record."""
    path = scratch_path(spark, "ragged")
    lines = materialize(json_orders(spark, d), "lines")
    write_ragged_csv(lines, path)
    names = ragged_header(lines).columns
    return spark.read.options(**CSV_READ_OPTIONS).schema(", ".join(f"{n} {'long' if n == 'doc_id' else 'int' if n == 'line_items_count' else 'string'}" for n in names)).csv(f"{path}/invoices")


@register("x_ragged_items", f"""
WITH {_RECORDS}
SELECT k AS doc_id, i AS item_no, CASE i WHEN 1 THEN 'a' WHEN 3 THEN 'b' END AS description, CASE WHEN i <> 2 THEN '2' END AS quantity, CASE i WHEN 1 THEN '3.0' WHEN 2 THEN '7' ELSE '4' END AS total,
  CASE i WHEN 1 THEN '1.5' WHEN 3 THEN '2.5' END AS unit_price FROM f, (VALUES (1), (2), (3)) t(i) WHERE n_items > 0""")
def x_ragged_items(spark, d):
    """Items with different keys, read back from their CSV."""
    path = scratch_path(spark, "ragged")
    write_ragged_csv(json_orders(spark, d), path)
    return spark.read.options(**CSV_READ_OPTIONS).schema("doc_id long, item_no int, description string, quantity string, total string, unit_price string").csv(f"{path}/line_items")
