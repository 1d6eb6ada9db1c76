"""Invoice documents rendered from the star schema (orders ⋈ lineitem ⋈ part), with planned defects.

One document per order key ``k``; every amount is integer cents, printed as ``<cents div 100>.<2 digits>`` (thousands
separators when ``k % 7 == 0``); nothing is formatted from a double. The rules (all keyed on ``k``):

* unit price ``floor(extendedprice*100/quantity + 0.5)``; item total ``quantity*unit`` (+1.00 on line 1 when
  ``k % 13 == 0``: broken arithmetic); when ``k % 37 == 0`` line 1 prints its unit price as a bare ``,``
* item lines ``<part name>  <qty>  $<unit>  $<total>`` ordered by (linenumber, partkey, suppkey)
* VAT rate by ``k % 6``: 0, 5, 10, 20, 7, 35 percent; VAT ``(subtotal*rate + 50) div 100``; printed as a bare ``,``
  when ``k % 31 == 0``
* total: ``k % 17 == 0`` the next multiple of 1000.00 above subtotal+VAT; else ``k % 11 == 0`` +5.00; else subtotal+VAT
* ``INVOICE # INV-<k>``; ``From: Supplier <custkey digits as letters a-j> & Co.`` except when ``k % 19 == 0``
* ``Date: `` as d/M/yy when ``k % 23 == 0``, ``d Mon yyyy`` when ``k % 29 == 0``, M/d/yyyy when ``k % 4 == 0``,
  else dd/MM/yyyy
* header ``Description  Qty  Price  Amount``; totals block Total, VAT, Subtotal for even ``k``, reversed for odd.

``RENDERED_SQL`` is the same rendering for DuckDB, used by the oracle queries.

Group size note: an order's items are concatenated into its one document, so the per-key group is one order's
lines (at most 17 at sf0.1). The item rows are narrow strings; the totals are a plain partial+final sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import few_tasks, read_table

HEADER_LINE = "Description  Qty  Price  Amount"


def _money(cents: Column, grouped: Column) -> Column:
    dollars = F.floor(cents / 100).cast("bigint")
    frac = F.lpad((cents % 100).cast("string"), 2, "0")
    whole = F.when(grouped, F.format_number(dollars, 0)).otherwise(dollars.cast("string"))
    return F.concat(whole, F.lit("."), frac)


def render_invoices(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """``(doc_id BIGINT, text STRING)``, one row per distinct ``l_orderkey``."""
    k = F.col("l_orderkey")
    grouped = k % 7 == 0
    qty = F.col("l_quantity").cast("bigint")
    unit = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5).cast("bigint")
    first_line = F.col("l_linenumber") == 1
    item_total = qty * unit + F.when((k % 13 == 0) & first_line, F.lit(100)).otherwise(F.lit(0))
    unit_txt = F.when((k % 37 == 0) & first_line, F.lit(",")).otherwise(_money(unit, grouped))
    line = F.concat_ws(
        "  ",
        F.coalesce(F.col("p_name"), F.lit("item")),
        qty.cast("string"),
        F.concat(F.lit("$"), unit_txt),
        F.concat(F.lit("$"), _money(item_total, grouped)),
    )
    # Hash-partition by order key once: the per-order aggregation reuses it (no second shuffle), and an explicit
    # partition count keeps AQE from folding the CPU-heavy text work downstream into one or two tasks. When the
    # scan arrives in fewer partitions than cores (one small file), partition before the part join so that the
    # join and the string formatting run in parallel; otherwise after it (the part join may itself shuffle).
    spark = lineitem.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    few = few_tasks(lineitem)
    if few:
        li = li.repartition(n_parts, "l_orderkey")
    joined = li.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if not few:
        joined = joined.repartition(n_parts, "l_orderkey")
    items = (
        joined
        .select(
            k,
            F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line")).alias("item"),
            item_total.alias("item_total"),
        )
    )
    per_order = items.groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_list("item"))["line"], "\n").alias("block"),
        F.sum("item_total").alias("sub"),
    )
    o = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("odate"))
    body = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")

    rate = F.element_at(F.array(*[F.lit(r) for r in (0, 5, 10, 20, 7, 35)]), (k % 6 + 1).cast("int"))
    vat = F.floor((F.col("sub") * rate + 50) / 100).cast("bigint")
    base = F.col("sub") + vat
    total = (
        F.when(k % 17 == 0, (F.floor(base / 100000) + 1) * 100000)
        .when(k % 11 == 0, base + 500)
        .otherwise(base)
        .cast("bigint")
    )
    vat_txt = F.when(k % 31 == 0, F.lit(",")).otherwise(_money(vat, grouped))
    sub_line = F.concat(F.lit("Subtotal: $"), _money(F.col("sub"), grouped))
    vat_line = F.concat(F.lit("VAT: $"), vat_txt)
    tot_line = F.concat(F.lit("Total: $"), _money(total, grouped))
    totals = F.when(k % 2 == 0, F.concat_ws("\n", tot_line, vat_line, sub_line)).otherwise(
        F.concat_ws("\n", sub_line, vat_line, tot_line)
    )
    supplier_line = F.when(
        k % 19 != 0,
        F.concat(
            F.lit("From: Supplier "),
            F.translate(F.col("o_custkey").cast("string"), "0123456789", "abcdefghij"),
            F.lit(" & Co."),
        ),
    )
    date_txt = (
        F.when(k % 23 == 0, F.date_format("odate", "d/M/yy"))
        .when(k % 29 == 0, F.date_format("odate", "d MMM yyyy"))
        .when(k % 4 == 0, F.date_format("odate", "M/d/yyyy"))
        .otherwise(F.date_format("odate", "dd/MM/yyyy"))
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("INVOICE # INV-"), k.cast("string")),
        supplier_line,
        F.concat(F.lit("Date: "), date_txt),
        F.lit(HEADER_LINE),
        F.col("block"),
        totals,
    )
    return body.select(k.alias("doc_id"), text.alias("text"))


def rendered_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_invoices(
        read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    )


def entity_table(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """NER-style entities per order document: ``(doc_id, ord, label, text)`` in document order.

    ord 0 DATE (order date), ord 1 ORG (customer name, absent for the AUTOMOBILE segment), ord 2 ORG (segment),
    ord 3 MONEY (order total from integer cents). Every order is read; where ``k % 5 == 0`` the scan is taken to have
    named no entity, so its flag leaves the entities out.
    """
    j = (
        orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        .withColumn("_named", F.col("o_orderkey") % 5 != 0)
        .join(customer.select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    )
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint")
    ent = F.explode(
        F.array(
            F.struct(F.lit(0).alias("ord"), F.lit("DATE").alias("label"),
                     F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd").alias("text")),
            F.when(F.col("c_mktsegment") != "AUTOMOBILE",
                   F.struct(F.lit(1).alias("ord"), F.lit("ORG").alias("label"), F.col("c_name").alias("text"))),
            F.struct(F.lit(2).alias("ord"), F.lit("ORG").alias("label"),
                     F.concat(F.lit("Segment "), F.col("c_mktsegment")).alias("text")),
            F.struct(F.lit(3).alias("ord"), F.lit("MONEY").alias("label"),
                     F.concat(F.lit("$"), _money(cents, F.lit(False))).alias("text")),
        )
    )
    return (
        j.select(F.col("o_orderkey").alias("doc_id"), "_named", ent.alias("e"))
        .where(F.col("_named") & F.col("e").isNotNull())
        .select("doc_id", F.col("e.ord").alias("ord"), F.col("e.label").alias("label"), F.col("e.text").alias("text"))
    )


# ---- the same rendering for DuckDB (oracle side) ------------------------------------------------------------------

def _money_sql(c: str, grouped: str) -> str:
    return (
        f"(CASE WHEN {grouped} THEN format('{{:,}}', ({c}) // 100) ELSE CAST(({c}) // 100 AS VARCHAR) END"
        f" || '.' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0'))"
    )


RENDERED_SQL = f"""
rendered_items AS (
  SELECT l.l_orderkey AS k, l.l_linenumber, l.l_partkey, l.l_suppkey,
         CAST(l.l_quantity AS BIGINT) AS qty,
         CAST(floor(l.l_extendedprice * 100 / l.l_quantity + 0.5) AS BIGINT) AS unit,
         coalesce(p.p_name, 'item') AS p_name
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
rendered_items2 AS (
  SELECT *, qty * unit + CASE WHEN k % 13 = 0 AND l_linenumber = 1 THEN 100 ELSE 0 END AS item_total
  FROM rendered_items
),
rendered_lines AS (
  SELECT k, l_linenumber, l_partkey, l_suppkey, item_total,
         p_name || '  ' || CAST(qty AS VARCHAR) || '  $' ||
         (CASE WHEN k % 37 = 0 AND l_linenumber = 1 THEN ',' ELSE {_money_sql('unit', 'k % 7 = 0')} END)
         || '  $' || {_money_sql('item_total', 'k % 7 = 0')} AS line
  FROM rendered_items2
),
rendered_orders AS (
  SELECT k, string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, line) AS block,
         CAST(sum(item_total) AS BIGINT) AS sub
  FROM rendered_lines GROUP BY k
),
rendered_amounts AS (
  SELECT r.*, o.o_custkey, CAST(o.o_orderdate AS DATE) AS odate,
         CAST((r.sub * (CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 20 WHEN 4 THEN 7 ELSE 35 END)
               + 50) // 100 AS BIGINT) AS vat
  FROM rendered_orders r LEFT JOIN orders o ON r.k = o.o_orderkey
),
rendered_totals AS (
  SELECT *, CAST(CASE WHEN k % 17 = 0 THEN ((sub + vat) // 100000 + 1) * 100000
                      WHEN k % 11 = 0 THEN sub + vat + 500 ELSE sub + vat END AS BIGINT) AS tot
  FROM rendered_amounts
),
rendered AS (
  SELECT k AS doc_id,
    concat_ws(chr(10),
      'INVOICE # INV-' || CAST(k AS VARCHAR),
      CASE WHEN k % 19 <> 0 THEN 'From: Supplier ' || translate(CAST(o_custkey AS VARCHAR), '0123456789', 'abcdefghij')
           || ' & Co.' END,
      'Date: ' || CASE WHEN k % 23 = 0 THEN strftime(odate, '%-d/%-m/%y')
                       WHEN k % 29 = 0 THEN strftime(odate, '%-d %b %Y')
                       WHEN k % 4 = 0 THEN strftime(odate, '%-m/%-d/%Y')
                       ELSE strftime(odate, '%d/%m/%Y') END,
      '{HEADER_LINE}',
      block,
      CASE WHEN k % 2 = 0 THEN
        concat_ws(chr(10), 'Total: $' || {_money_sql('tot', 'k % 7 = 0')},
                  'VAT: $' || CASE WHEN k % 31 = 0 THEN ',' ELSE {_money_sql('vat', 'k % 7 = 0')} END,
                  'Subtotal: $' || {_money_sql('sub', 'k % 7 = 0')})
      ELSE
        concat_ws(chr(10), 'Subtotal: $' || {_money_sql('sub', 'k % 7 = 0')},
                  'VAT: $' || CASE WHEN k % 31 = 0 THEN ',' ELSE {_money_sql('vat', 'k % 7 = 0')} END,
                  'Total: $' || {_money_sql('tot', 'k % 7 = 0')})
      END) AS text
  FROM rendered_totals
)"""

ENTITIES_SQL = f"""
entity_base AS (
  SELECT o.o_orderkey AS doc_id, o.o_orderdate, o.o_totalprice, c.c_name, c.c_mktsegment
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderkey % 5 <> 0
),
entities AS (
  SELECT doc_id, 0 AS ord, 'DATE' AS label, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS text FROM entity_base
  UNION ALL
  SELECT doc_id, 1, 'ORG', c_name FROM entity_base WHERE c_mktsegment <> 'AUTOMOBILE'
  UNION ALL
  SELECT doc_id, 2, 'ORG', 'Segment ' || c_mktsegment FROM entity_base
  UNION ALL
  SELECT doc_id, 3, 'MONEY',
         '$' || {_money_sql('CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)', 'false')} FROM entity_base
)"""
