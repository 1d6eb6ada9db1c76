"""Registered queries over files read as bytes, folders that fill up, tables laid out by document, exports, targets and options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import scratch_path
from ..operators.extract import merge_entities
from ..operators.targets import TargetRegistry, generic, target
from ..operators.validate import validate
from ..options import Options
from ..sinks.layout import lay_out
from ..sinks.writers import CSV_READ_OPTIONS, publish_invoices, write_invoices
from ..sources.binary import checked_texts
from ..sources.fixtures import entity_table, rendered_invoices
from ..sources.tables import read_table
from ..streaming.folder import newest, start_page_stream
from . import oracle as O
from .catalog import _RULES_SQL, AS_OF, ORACLE, invoices, invoices_once, register
from .run import run_invoices

# ---- files as bytes -------------------------------------------------------------------------------------------------

LIMIT = 330


def scanned_bytes(spark, d) -> DataFrame:
    """Every rendered invoice as a file: one in 13 ends in a byte that UTF-8 does not have, one in 17 has no content."""
    raw = F.col("text").cast("binary")
    content = F.when(F.col("doc_id") % 13 == 5, F.concat(raw, F.lit(b"\xff"))).when(F.col("doc_id") % 17 != 3, raw)
    return rendered_invoices(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("length"), content.alias("content"))


@register("p_unreadable_files", O.with_base(
    "SELECT i.doc_id, s.ok AND NOT r.failed AS success, CASE WHEN NOT s.ok THEN 'OCR extraction failed' WHEN r.failed THEN "
    "'could not convert string to float: ''' || CASE WHEN i.total_raw IS NOT NULL AND i.total IS NULL THEN i.total_raw ELSE i.vat_raw END || '''' END AS error, s.why, "
    "CASE WHEN s.ok THEN s.n_chars ELSE 0 END AS text_length, CASE WHEN s.ok THEN i.supplier END AS supplier, CASE WHEN s.ok THEN i.total END AS total, "
    "CASE WHEN s.ok THEN v.n_err END AS n_errors FROM inv i JOIN scanned s ON i.doc_id = s.doc_id JOIN verdict v ON i.doc_id = v.doc_id JOIN rules r ON i.doc_id = r.doc_id",
    [f"""scanned AS (
  SELECT doc_id, why, why IS NULL AS ok, length(text)::BIGINT AS n_chars FROM (SELECT doc_id, text,
    CASE WHEN strlen(text) > {LIMIT} THEN 'larger than {LIMIT} bytes: ' || strlen(text) WHEN doc_id % 13 = 5 THEN 'not valid UTF-8'
      WHEN doc_id % 17 = 3 THEN 'no content' END AS why FROM rendered))"""] + O.val_ctes(AS_OF) + _RULES_SQL))
def p_unreadable_files(spark, d):
    """Files that are too large, no text or empty of content are failed rows of the run, each with its reason."""
    docs = checked_texts(scanned_bytes(spark, d), max_bytes=LIMIT)
    r = run_invoices(docs, options=Options(anomaly_mode="rule_based"), as_of=AS_OF)
    return r.select("doc_id", "success", "error", F.col("ocr_error").alias("why"), F.col("stages.ocr.text_length").cast("long").alias("text_length"), "supplier", "total",
                    F.size("stages.validation.errors").cast("long").alias("n_errors"))


# ---- a folder that fills up -----------------------------------------------------------------------------------------

@register("s_page_stream", ORACLE["s_page_assembly"])
def s_page_stream(spark, d):
    """S4 as a stream: odd pages arrive before even ones; a document is written again when more of its pages have come."""
    base = scratch_path(spark, "page-stream")
    pages = read_table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text", (F.col("role") != "system").alias("success"))
    odd = F.coalesce(F.col("page_no") % 2 == 1, F.lit(False))
    for part in (odd, ~odd):
        pages.filter(part).write.mode("append").parquet(f"{base}/pages")
        start_page_stream(spark, f"{base}/pages", f"{base}/checkpoint", f"{base}/documents").awaitTermination()
    return newest(spark, f"{base}/documents")


# ---- tables laid out by document --------------------------------------------------------------------------------------

@register("j_by_document", O.with_base(
    "SELECT i.doc_id, coalesce(i.supplier, e.org) AS supplier, coalesce(e.organizations, '') AS organizations, coalesce(e.dates, '') AS dates, "
    "coalesce(e.money, '') AS money, coalesce(t.n, 0)::BIGINT AS n_items, t.quantity, t.cents FROM inv i "
    "LEFT JOIN (SELECT doc_id, arg_min(text, ord) FILTER (WHERE label = 'ORG') AS org, string_agg(text, '|' ORDER BY ord) FILTER (WHERE label = 'ORG') AS organizations, "
    "string_agg(text, '|' ORDER BY ord) FILTER (WHERE label = 'DATE') AS dates, string_agg(text, '|' ORDER BY ord) FILTER (WHERE label = 'MONEY') AS money "
    "FROM entities GROUP BY doc_id) e ON i.doc_id = e.doc_id "
    "LEFT JOIN (SELECT doc_id, count(*) AS n, sum(quantity)::VARCHAR AS quantity, sum(CAST(round(total * 100) AS BIGINT))::BIGINT AS cents FROM items GROUP BY doc_id) t ON i.doc_id = t.doc_id",
    [O.ENTITIES_SQL]))
def j_by_document(spark, d):
    """J2, J3, E12 on bucketed tables: the joins and the grouping by document shuffle nothing."""
    ents = entity_table(read_table(spark, d, "orders"), read_table(spark, d, "customer"))
    t = lay_out(invoices(spark, d), scratch_path(spark, "by-document"), int(spark.conf.get("spark.sql.shuffle.partitions")), ents)
    return by_document(t)


def by_document(t) -> DataFrame:
    items = t.items.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sum("quantity").cast("string").alias("quantity"),
                                          F.sum(F.round(F.col("total") * 100).cast("long")).alias("cents"))
    merged = merge_entities(t.invoices, t.entities, with_lists=True).join(items, "doc_id", "left")
    return merged.select("doc_id", "supplier", *[F.array_join(c, "|").alias(c) for c in ("organizations", "dates", "money")],
                         F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "quantity", "cents")


# ---- exports, targets, options ----------------------------------------------------------------------------------------

@register("x_formats", O.with_base(
    "SELECT 'json' AS what, 'written' AS outcome, count(*)::BIGINT AS n FROM inv UNION ALL SELECT 'csv', 'written', count(*)::BIGINT FROM inv "
    "UNION ALL SELECT 'csv items', 'written', count(*)::BIGINT FROM items UNION ALL SELECT 'xml', 'unknown', NULL "
    "UNION ALL SELECT 'csv again', 'has been published', NULL UNION ALL SELECT 'xml alone', 'Unknown format: xml', NULL"))
def x_formats(spark, d):
    """Unknown formats beside known ones are skipped, alone they are an error; what is published stays."""
    base, inv = scratch_path(spark, "formats"), invoices(spark, d)  # evaluated once, in the publication that succeeds
    outcome = publish_invoices(inv, base, ["json", "xml", "csv"])
    rows = [("xml", outcome["xml"], None)]
    try:
        publish_invoices(inv, base, ["csv"])
    except FileExistsError as e:
        rows.append(("csv again", str(e).replace(f"{base} ", ""), None))
    try:
        write_invoices(inv, f"{base}-alone", ["xml"])
    except ValueError as e:
        rows.append(("xml alone", str(e), None))
    counted = lambda what, fmt, df: df.agg(F.lit(what).alias("what"), F.lit(outcome[fmt]).alias("outcome"), F.count("*").alias("n"))
    csv = lambda path: spark.read.options(**CSV_READ_OPTIONS).csv(f"{base}/format=csv/{path}")
    return (counted("json", "json", spark.read.text(f"{base}/format=json")).union(counted("csv", "csv", csv("invoices")))
            .union(counted("csv items", "csv", csv("line_items"))).union(spark.createDataFrame(rows, "what string, outcome string, n long")))


@register("i_registry", O.with_base(
    "SELECT doc_id, t.name, invoice_number AS number, supplier AS vendor, total AS amount, CASE WHEN t.name <> 'ledger' THEN CAST(n_items AS INTEGER) END AS n_items "
    "FROM inv CROSS JOIN (VALUES ('books'), ('warehouse'), ('ledger')) t(name)"))
def i_registry(spark, d):
    """Targets registered under own names, one of them a layout of its own; a name registered again is replaced."""
    reg = TargetRegistry()
    reg.register("books", target("Oracle"))
    reg.register("warehouse", target("SAP"))
    reg.register("books", generic)
    reg.register("ledger", lambda df: [F.col("invoice_number").alias("number"), F.col("supplier").alias("vendor"), F.col("total").alias("amount"), F.lit(None).cast("int").alias("n_items")])
    frames = reg.fan_out(invoices_once(spark, d))
    seen = {"books": ("invoice_number", "vendor", "total_amount", "line_items"), "warehouse": ("XBLNR", "LIFNR", "WRBTR", "ITEMS"), "ledger": ("number", "vendor", "amount", None)}
    out = None
    for name in reg.names():
        number, vendor, amount, items = seen[name]
        one = frames[name].select("doc_id", F.lit(name).alias("name"), F.col(number).alias("number"), F.col(vendor).alias("vendor"), F.col(amount).alias("amount"),
                                  (F.size(items) if items else F.col("n_items")).alias("n_items"))
        out = one if out is None else out.union(one)
    return out


@register("p_options", O.with_base(
    "SELECT doc_id, (invoice_number IS NULL)::INT + (vat_raw IS NULL)::INT = 0 AND NOT odd AS valid, ((invoice_number IS NULL)::INT + (vat_raw IS NULL)::INT)::BIGINT AS n_missing, "
    "CASE WHEN odd THEN rate END AS odd_rate FROM (SELECT *, coalesce(rate IS NOT NULL AND NOT (abs(rate - 7) < 0.5 OR abs(rate - 10) < 0.5), false) AS odd FROM val)",
    O.val_ctes(AS_OF)))
def p_options(spark, d):
    """Own required fields and rates; an unusual rate counts against an invoice as in a strict run."""
    opts = Options(required_fields=("invoice_number", "vat"), vat_rates=(7.0, 10.0), strict=True)
    v = validate(invoices(spark, d), required_fields=list(opts.required_fields), vat_rates=list(opts.vat_rates), strict=opts.strict, as_of=AS_OF)
    every = F.concat("errors", "warnings")
    having = lambda code: F.filter(every, lambda f: f["code"] == code)
    missing, odd = having("required_missing"), having("unusual_vat_rate")
    return v.select("doc_id", ((F.size(missing) == 0) & (F.size(odd) == 0)).alias("valid"), F.size(missing).cast("long").alias("n_missing"),
                    F.get(odd, 0)["observed"].alias("odd_rate"))
