import random

import pytest

import duck
from quire.operators.extract import extract_fields, extract_line_items, merge_entities
from quire.operators.validate import validate

SCHEMA = "doc_id bigint, text string"


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r.doc_id: r for r in extract_fields(df).collect()}


def one(spark, text):
    return run(spark, [text])[0]


@pytest.mark.parametrize("text,field,expected", [
    ("Invoice Number: INV-1", "invoice_number", "Number"),          # G1: no word boundary
    ("Invoice Date: 01/02/2024", "invoice_number", "Date"),
    ("Invoice", "invoice_number", "oice"),                          # pattern 2 on bare 'Invoice'
    ("INVOICE # INV-77", "invoice_number", "INV-77"),
    ("Subtotal: 100.00\nTotal: 120.00", "total_raw", "100.00"),      # 'total' inside 'Subtotal'
    ("VAT (20%): 20", "vat_raw", None),
    ("VAT 20%: 4.00", "vat_raw", "20"),
    ("Total: €5", "total_raw", None),
    ("Amount due: $1,234.50", "total_raw", "1,234.50"),
    ("Date: 5/3/2024", "invoice_date", "5/3/2024"),
    ("Issued 15 January 2024", "invoice_date", "15 January 2024"),
    ("From: ACME & Co.\nDate: 1/1/2020", "supplier", "ACME & Co."),
    ("from:   \nVendor: Other", "supplier", None),                  # empty group does not fall through
    ("Vendor: Big Shop\r\nX", "supplier", "Big Shop"),              # \r is whitespace: captured, then stripped
    ("From: Nbsp Trading\nX", "supplier", "Nbsp Trading"),     # NBSP is whitespace
    ("From: Line\u2028Sep Ltd\nX", "supplier", "Line\u2028Sep Ltd"),  # U+2028 does not end a line
    ("From: Spaced Co \x1c\nX", "supplier", "Spaced Co"),           # \x1c is whitespace for strip
    ("", "invoice_number", None),
])
def test_field_cases(spark, text, field, expected):
    assert one(spark, text)[field] == expected


def test_null_text(spark):
    r = run(spark, [None])[0]
    assert r.invoice_number is None and r.total is None and r.line_items == []


def test_line_items_and_header_swallow(spark):
    text = "Description  Qty  Price  Amount\nred plate  5  $10.00  $50.00\nblue rod  2  $1,000.00  $2,000.00\n"
    r = one(spark, text)
    assert [(i.item_no, i.description, i.quantity, i.unit_price, i.total) for i in r.line_items] == [
        (1, "Description  Qty  Price  Amount\nred plate", 5, 10.0, 50.0), (2, "blue rod", 2, 1000.0, 2000.0)]
    assert r.items_ok and r.parse_ok


def test_failure_cascade_items(spark):
    # an item price that does not convert empties line_items and leaves every amount unconverted
    r = one(spark, "widget  5  $,  $50.00\nSubtotal: 1,000.00\nVAT: 200.00\nTotal: 1,200.00")
    assert r.line_items == [] and not r.items_ok and not r.parse_ok
    assert r.subtotal_raw == "1,000.00" and r.subtotal is None      # float('1,000.00') fails later
    assert r.vat == 200.0                                            # float('200.00') works later
    assert r.converted.total is False


def test_failure_cascade_amounts(spark):
    r = one(spark, "Total, due\nVAT: 1,000.00\nSubtotal: 5.00")
    assert r.total_raw == "," and r.total is None
    assert r.vat_raw == "1,000.00" and r.vat is None                 # conversion stopped at total
    assert r.subtotal == 5.0 and not r.parse_ok


def test_confidence(spark):
    r = one(spark, "INVOICE # A1\nTotal: 5.00")
    assert r.confidence == {"invoice_number": 0.8, "total": 0.8}


def test_quadratic_guard_long_prose(spark):
    prose = ("lorem ipsum dolor sit amet " * 2000)
    r = one(spark, prose + " widget  3  $1.00  $3.00")
    assert [(i.description, i.quantity) for i in r.line_items] == [((prose + " widget").strip(), 3)]


def test_child_table(spark):
    df = spark.createDataFrame([(7, "a  1  $1.00  $1.00\nb  2  $2.00  $4.00")], SCHEMA)
    rows = extract_line_items(extract_fields(df)).collect()
    assert [(r.doc_id, r.item_no, r.description) for r in rows] == [(7, 1, "a"), (7, 2, "b")]


def test_entity_merge(spark):
    inv = extract_fields(spark.createDataFrame([(1, "Total: 5"), (2, "From: Known\n"), (3, "x")], SCHEMA))
    ents = spark.createDataFrame([(1, 2, "ORG", "Second"), (1, 1, "ORG", "First"), (1, 0, "DATE", "today"),
                                  (2, 0, "ORG", "Ignored")], "doc_id bigint, ord int, label string, text string")
    out = {r.doc_id: r for r in merge_entities(inv, ents, with_lists=True).collect()}
    assert out[1].supplier == "First" and out[1].organizations == ["First", "Second"] and out[1].dates == ["today"]
    assert out[2].supplier == "Known"
    assert out[3].supplier is None and out[3].organizations == []


TOKENS = ["Invoice", "INVOICE", "inv", "#", ":", "Number", "Date", "date:", "From", "from:", "Vendor", "Supplier",
          "Total", "total:", "Amount", "due", "Grand", "VAT", "Tax", "Sales", "Subtotal", "Sub-total", "$", ",", ".",
          "12", "3", "1,234.56", "0.00", "99.9", "1.", "7/8/2024", "31/02/2024", "12-25-2024", "5 Jan 2024",
          "15 Sept 2024", "Acme", "Co.", "&", "widget", "blue rod", "x", "-", "A-1", "\n", "\n", " ", " ", "  ",
          "\t", " ", "\r\n", " ", "\x1c"]


# what RE2 calls whitespace; the other kinds are compared in test_linear_patterns
PLAIN = [t for t in TOKENS if t.isascii() and "\x1c" not in t]


def random_texts(n, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PLAIN) + rnd.choice(["", " ", "  ", "\n"]) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_random_texts_match_the_sql(spark):
    texts = random_texts(4000)
    got = run(spark, texts)
    fields = ("invoice_number", "invoice_date", "supplier", "total_raw", "vat_raw", "subtotal_raw", "total", "vat", "subtotal", "items_ok", "parse_ok")
    want = duck.rows(texts, f"SELECT doc_id, {', '.join(fields)} FROM inv")
    assert [{f: getattr(got[r["doc_id"]], f) for f in fields} for r in want] == [{f: r[f] for f in fields} for r in want]
    items = duck.rows(texts, "SELECT doc_id, list({'d': description, 'q': quantity, 'u': unit_price, 't': total} ORDER BY item_no) AS items FROM items GROUP BY doc_id")
    mine = {i: [(x.description, int(x.quantity), x.unit_price, x.total) for x in r.line_items] for i, r in got.items() if r.line_items}
    assert mine == {r["doc_id"]: [(x["d"], x["q"], x["u"], x["t"]) for x in r["items"]] for r in items}
    assert len(mine) > 100


def test_large_and_foreign_digits(spark):
    r = one(spark, "bolt  12345678901234567890  $1.00  $2.00\nnut  ٣  $٤.٥  $13.50\nTotal: ١٢.٥")
    assert [(i.description, int(i.quantity), i.unit_price, i.total) for i in r.line_items] == [
        ("bolt", 12345678901234567890, 1.0, 2.0), ("nut", 3, 4.5, 13.5)]
    assert r.items_ok and r.total_raw == "١٢.٥" and r.total == 12.5 and r.converted.total
    assert [f.code for f in validate(extract_fields(spark.createDataFrame([(1, "nut  ٣  $٤.٥  $13.50")], SCHEMA)), []).collect()[0].errors] == []
