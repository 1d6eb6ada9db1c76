"""DuckDB SQL text for the oracle side of the registered queries.

The SQL restates the same semantics independently on DuckDB (RE2 regexes, ``(?im)``; RE2 is linear, so the
line-item pattern is used unguarded). It is only query text handed to DuckDB by the checker — no parsing or
planning happens here.
"""

from __future__ import annotations

from ..sources.fixtures import ENTITIES_SQL, RENDERED_SQL

# ---- FIXED VALUES, written out again on this side so that a slip on the other one shows -------------------------
AMOUNT_FIELDS = ("total", "vat", "subtotal")
CALCULATION_TOLERANCE = 0.01
DEFAULT_VAT_RATES = (0.0, 5.0, 10.0, 20.0)
FIELD_PATTERNS = {
    "invoice_number": [r"invoice\s*#?\s*:?\s*([A-Z0-9-]+)", r"inv\s*#?\s*:?\s*([A-Z0-9-]+)",
                       r"invoice\s+number\s*:?\s*([A-Z0-9-]+)"],
    "invoice_date": [r"date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
                     r"invoice\s+date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
                     r"(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})"],
    "supplier": [r"from\s*:?\s*([A-Za-z\s&.,]+?)(?:\n|$)", r"vendor\s*:?\s*([A-Za-z\s&.,]+?)(?:\n|$)",
                 r"supplier\s*:?\s*([A-Za-z\s&.,]+?)(?:\n|$)"],
    "total": [r"total\s*:?\s*\$?\s*([\d,]+\.?\d*)", r"amount\s+due\s*:?\s*\$?\s*([\d,]+\.?\d*)",
              r"grand\s+total\s*:?\s*\$?\s*([\d,]+\.?\d*)"],
    "vat": [r"vat\s*:?\s*\$?\s*([\d,]+\.?\d*)", r"tax\s*:?\s*\$?\s*([\d,]+\.?\d*)",
            r"sales\s+tax\s*:?\s*\$?\s*([\d,]+\.?\d*)"],
    "subtotal": [r"subtotal\s*:?\s*\$?\s*([\d,]+\.?\d*)", r"sub-total\s*:?\s*\$?\s*([\d,]+\.?\d*)"],
}
LINE_ITEM_PATTERN = r"([A-Za-z\s]+)\s+(\d+)\s+\$?([\d,]+\.?\d*)\s+\$?([\d,]+\.?\d*)"
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
                 "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

WS = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS})"


def sql_first_match(text: str, patterns: list[str]) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({text}, '(?im){p}') THEN regexp_extract({text}, '(?im){p}', 1)" for p in patterns
    )
    return f"nullif({sql_strip(f'CASE {whens} END')}, '')"


def sql_amount(raw: str) -> str:
    return f"try_cast(replace({raw}, ',', '') AS DOUBLE)"


def sql_double(raw: str) -> str:
    return f"try_cast({raw} AS DOUBLE)"


FIELDS_CTE = (
    "fields AS (SELECT doc_id, "
    + ", ".join(
        f"{sql_first_match('text', FIELD_PATTERNS[f])} AS {f if f not in AMOUNT_FIELDS else f + '_raw'}"
        for f in FIELD_PATTERNS
    )
    + " FROM rendered)"
)

_P = LINE_ITEM_PATTERN
ITEM_ROWS_CTE = f"""
item_matches AS (
  SELECT doc_id, regexp_extract_all(text, '{_P}', 1) AS m1, regexp_extract_all(text, '{_P}', 2) AS m2,
         regexp_extract_all(text, '{_P}', 3) AS m3, regexp_extract_all(text, '{_P}', 4) AS m4
  FROM rendered
),
item_rows AS (
  SELECT doc_id, CAST(unnest(generate_series(1, len(m1))) AS BIGINT) AS item_no,
         unnest(m1) AS d_raw, unnest(m2) AS q_raw, unnest(m3) AS u_raw, unnest(m4) AS t_raw
  FROM item_matches
),
item_conv AS (
  SELECT doc_id, item_no, {sql_strip('d_raw')} AS description, try_cast(q_raw AS BIGINT) AS quantity,
         {sql_amount('u_raw')} AS unit_price, {sql_amount('t_raw')} AS total
  FROM item_rows
),
item_ok AS (
  SELECT doc_id, bool_and(unit_price IS NOT NULL AND total IS NOT NULL) AS items_ok, count(*) AS n_found
  FROM item_conv GROUP BY doc_id
)"""

INV_CTE = f"""
inv0 AS (
  SELECT f.*, coalesce(o.items_ok, true) AS items_ok, coalesce(o.n_found, 0) AS n_found
  FROM fields f LEFT JOIN item_ok o ON f.doc_id = o.doc_id
),
inv1 AS (
  SELECT *, items_ok AS att_total,
         items_ok AND (total_raw IS NULL OR {sql_amount('total_raw')} IS NOT NULL) AS att_vat
  FROM inv0
),
inv2 AS (
  SELECT *, att_vat AND (vat_raw IS NULL OR {sql_amount('vat_raw')} IS NOT NULL) AS att_subtotal FROM inv1
),
inv AS (
  SELECT doc_id, invoice_number, invoice_date, supplier, total_raw, vat_raw, subtotal_raw,
    CASE WHEN att_total THEN {sql_amount('total_raw')} ELSE {sql_double('total_raw')} END AS total,
    CASE WHEN att_vat THEN {sql_amount('vat_raw')} ELSE {sql_double('vat_raw')} END AS vat,
    CASE WHEN att_subtotal THEN {sql_amount('subtotal_raw')} ELSE {sql_double('subtotal_raw')} END AS subtotal,
    items_ok,
    att_subtotal AND (subtotal_raw IS NULL OR {sql_amount('subtotal_raw')} IS NOT NULL) AS parse_ok,
    att_total AND {sql_amount('total_raw')} IS NOT NULL AS conv_total,
    att_vat AND {sql_amount('vat_raw')} IS NOT NULL AS conv_vat,
    att_subtotal AND {sql_amount('subtotal_raw')} IS NOT NULL AS conv_subtotal,
    CASE WHEN items_ok THEN n_found ELSE 0 END AS n_items
  FROM inv2
),
items AS (
  SELECT c.* FROM item_conv c JOIN inv0 ON c.doc_id = inv0.doc_id WHERE inv0.items_ok
)"""

BASE = [RENDERED_SQL, FIELDS_CTE, ITEM_ROWS_CTE, INV_CTE]


def with_base(select: str, extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join(BASE + (extra or [])) + "\n" + select


__all__ = [
    "BASE", "CALCULATION_TOLERANCE", "DEFAULT_VAT_RATES", "ENTITIES_SQL", "WS", "sql_amount", "sql_double",
    "sql_first_match", "sql_strip", "with_base",
]


# ---- validation -------------------------------------------------------------------------------------------------

_DATE_TRIES = [
    (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y"),
    (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "%m-%d-%Y"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "%d %b %Y"),
    (r"\d{1,2} [A-Za-z]+ \d{4}", "%d %B %Y"),
]


def sql_parse_date(x: str) -> str:
    parts = [
        f"CASE WHEN regexp_full_match({x}, '{shape}') AND try_strptime({x}, '{fmt}') >= TIMESTAMP '0001-01-01' "
        f"THEN CAST(try_strptime({x}, '{fmt}') AS DATE) END"
        for shape, fmt in _DATE_TRIES
    ]
    return "coalesce(" + ", ".join(parts) + ")"


def _rates_ok(rate: str) -> str:
    return "(" + " OR ".join(f"abs({rate} - {float(r)}) < 0.5" for r in DEFAULT_VAT_RATES) + ")"


def val_ctes(as_of: str) -> list[str]:
    """``val``: per-invoice check flags; ``item_err``: V10 failures per item; ``verdict``: counts."""
    return [f"""
val0 AS (
  SELECT *, regexp_replace(invoice_date, '\\s+', ' ', 'g') AS dnorm,
         CASE WHEN subtotal > 0 AND vat IS NOT NULL THEN (vat / subtotal) * 100 END AS rate
  FROM inv
),
val AS (
  SELECT *, {sql_parse_date('dnorm')} AS parsed,
    (total_raw IS NOT NULL AND total IS NULL) AS nan_total,
    (vat_raw IS NOT NULL AND vat IS NULL) AS nan_vat,
    (subtotal_raw IS NOT NULL AND subtotal IS NULL) AS nan_subtotal,
    coalesce(abs((subtotal + vat) - total) > 0.01, false) AS mismatch,
    coalesce(rate IS NOT NULL AND NOT {_rates_ok('rate')}, false) AS unusual_rate,
    DATE '{as_of}' AS as_of
  FROM val0
),
item_err AS (
  SELECT doc_id, item_no, total AS observed, CAST(quantity AS DOUBLE) * unit_price AS expected
  FROM items WHERE abs(CAST(quantity AS DOUBLE) * unit_price - total) > 0.01
),
item_err_n AS (SELECT doc_id, count(*) AS n FROM item_err GROUP BY doc_id),
verdict AS (
  SELECT v.doc_id,
    CAST((CASE WHEN supplier IS NULL THEN 1 ELSE 0 END) + (CASE WHEN total_raw IS NULL THEN 1 ELSE 0 END)
      + (CASE WHEN invoice_date IS NULL THEN 1 ELSE 0 END)
      + (CASE WHEN nan_total OR total < 0 THEN 1 ELSE 0 END) + (CASE WHEN nan_vat OR vat < 0 THEN 1 ELSE 0 END)
      + (CASE WHEN nan_subtotal OR subtotal < 0 THEN 1 ELSE 0 END)
      + (CASE WHEN mismatch THEN 1 ELSE 0 END) + coalesce(e.n, 0) AS BIGINT) AS n_err,
    CAST((CASE WHEN unusual_rate THEN 1 ELSE 0 END)
      + (CASE WHEN invoice_date IS NOT NULL AND parsed IS NULL THEN 1 ELSE 0 END)
      + (CASE WHEN parsed > as_of THEN 1 ELSE 0 END)
      + (CASE WHEN date_diff('day', parsed, as_of) > 3650 THEN 1 ELSE 0 END) AS BIGINT) AS n_warn
  FROM val v LEFT JOIN item_err_n e ON v.doc_id = e.doc_id
)"""]


# ---- anomalies --------------------------------------------------------------------------------------------------

def _lerp_sql(a: str, b: str, f: str) -> str:
    return f"CASE WHEN {f} >= 0.5 THEN {b} - ({b} - {a}) * (1 - {f}) ELSE {a} + ({b} - {a}) * {f} END"


def profile_ctes(name: str, source: str, total: str, vat: str, by: list[str] | None = None) -> list[str]:
    """``{name}``: profile of ``source`` (truthy totals/vats), exact numpy-style quartiles, optionally by key."""
    by = by or []
    keys = ", ".join(by)
    kc = (keys + ", ") if by else ""
    part = f"PARTITION BY {keys} " if by else ""
    where_keys = (" WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in by)) if by else ""
    join_on = " AND ".join(f"p.{k} = r.{k}" for k in by)
    rj = lambda alias: (" AND " + " AND ".join(f"{alias}.{k} = p.{k}" for k in by)) if by else ""
    return [f"""
{name}_h AS (
  SELECT {kc}CASE WHEN {total} IS NOT NULL AND {total} <> 0 THEN CAST({total} AS DOUBLE) END AS t,
         CASE WHEN {vat} IS NOT NULL AND {vat} <> 0 THEN CAST({vat} AS DOUBLE) END AS v
  FROM {source}{where_keys}
),
{name}_a AS (
  SELECT {kc}count(*) AS n_rows, count(t) AS n_total, avg(t) AS mean_total, stddev_pop(t) AS std_total,
         count(v) AS n_vat, avg(v) AS mean_vat, stddev_pop(v) AS std_vat
  FROM {name}_h {"GROUP BY " + keys if by else ""}
),
{name}_r AS (
  SELECT {kc}t, row_number() OVER ({part}ORDER BY t) - 1 AS r FROM {name}_h WHERE t IS NOT NULL
),
{name}_pos AS (
  SELECT {kc}n_total, (n_total - 1) * 0.25 AS pos1, (n_total - 1) * 0.75 AS pos3 FROM {name}_a
),
{name}_q AS (
  SELECT {", ".join("p." + k for k in by) + ", " if by else ""}
    max(CASE WHEN r.r = floor(p.pos1) THEN r.t END) AS a1,
    max(CASE WHEN r.r = least(floor(p.pos1) + 1, p.n_total - 1) THEN r.t END) AS b1,
    max(CASE WHEN r.r = floor(p.pos3) THEN r.t END) AS a3,
    max(CASE WHEN r.r = least(floor(p.pos3) + 1, p.n_total - 1) THEN r.t END) AS b3,
    any_value(p.pos1 - floor(p.pos1)) AS f1, any_value(p.pos3 - floor(p.pos3)) AS f3
  FROM {name}_pos p JOIN {name}_r r ON {join_on if by else "true"}
  {"GROUP BY " + ", ".join("p." + k for k in by) if by else ""}
),
{name} AS (
  SELECT a.*, {_lerp_sql('q.a1', 'q.b1', 'q.f1')} AS q1_total, {_lerp_sql('q.a3', 'q.b3', 'q.f3')} AS q3_total
  FROM {name}_a a LEFT JOIN {name}_q q ON {(" AND ".join(f"a.{k} = q.{k}" for k in by)) if by else "true"}
)"""]


def stat_select(p: str, total: str = "total", vat: str = "vat", gate_ok: str | None = None) -> str:
    """Columns for z-scores, IQR flag and run conditions against profile alias ``p``."""
    return f"""
    coalesce({p}.n_rows, 0) >= 2 AS gate,
    CASE WHEN {p}.n_total < 2 OR {p}.std_total = 0 THEN 0.0
         ELSE abs(({total} - {p}.mean_total) / {p}.std_total) END AS zt,
    CASE WHEN {p}.n_vat < 2 OR {p}.std_vat = 0 THEN 0.0
         ELSE abs(({vat} - {p}.mean_vat) / {p}.std_vat) END AS zv,
    coalesce({p}.n_total >= 4 AND ({total} < {p}.q1_total - 1.5 * ({p}.q3_total - {p}.q1_total)
         OR {total} > {p}.q3_total + 1.5 * ({p}.q3_total - {p}.q1_total)), false) AS iqr,
    {p}.n_total AS p_n_total, {p}.n_vat AS p_n_vat"""


TRUTHY_TOTAL = "(total_raw IS NOT NULL AND (NOT coalesce(conv_total, false) OR total <> 0))"
TRUTHY_VAT = "(vat_raw IS NOT NULL AND (NOT coalesce(conv_vat, false) OR vat <> 0))"
