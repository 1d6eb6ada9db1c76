"""Pattern sets and constants the results depend on.

FIXED VALUES — these must equal the behaviour being matched, so they are written out verbatim, in their natural
order. Each field's list is tried first to last; the first pattern that matches wins (group 1 is the value).
"""

from __future__ import annotations

import string

# ---- FIXED VALUES: field patterns (searched case-insensitively, multi-line) -----------------------------------
FIELD_PATTERNS: dict[str, list[str]] = {
    "invoice_number": [
        r"invoice\s*#?\s*:?\s*([A-Z0-9-]+)",
        r"inv\s*#?\s*:?\s*([A-Z0-9-]+)",
        r"invoice\s+number\s*:?\s*([A-Z0-9-]+)",
    ],
    "invoice_date": [
        r"date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
        r"invoice\s+date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
        r"(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})",
    ],
    "supplier": [
        r"from\s*:?\s*([A-Za-z\s&.,]+?)(?:\n|$)",
        r"vendor\s*:?\s*([A-Za-z\s&.,]+?)(?:\n|$)",
        r"supplier\s*:?\s*([A-Za-z\s&.,]+?)(?:\n|$)",
    ],
    "total": [
        r"total\s*:?\s*\$?\s*([\d,]+\.?\d*)",
        r"amount\s+due\s*:?\s*\$?\s*([\d,]+\.?\d*)",
        r"grand\s+total\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    ],
    "vat": [
        r"vat\s*:?\s*\$?\s*([\d,]+\.?\d*)",
        r"tax\s*:?\s*\$?\s*([\d,]+\.?\d*)",
        r"sales\s+tax\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    ],
    "subtotal": [
        r"subtotal\s*:?\s*\$?\s*([\d,]+\.?\d*)",
        r"sub-total\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    ],
}

# ---- FIXED VALUES: line-item pattern (case-sensitive): description, quantity, unit price, total ---------------
LINE_ITEM_PATTERN = r"([A-Za-z\s]+)\s+(\d+)\s+\$?([\d,]+\.?\d*)\s+\$?([\d,]+\.?\d*)"

# The same first matches without backtracking over runs of whitespace or digits. After ``\\s*`` the next character can
# never be whitespace, so possessive runs lose nothing; the amount, number and date groups stand last or before a
# character they cannot contain. Patterns that hold an earlier pattern of their list inside (``invoice number``,
# ``invoice date``, ``grand total``, ``sales tax``) can never be reached and are left out. The supplier group is
# either one line from its first non-space on, or nothing but space before a line end (an empty value); ``{c}`` is
# its class without the line feed. ``tests/test_linear_patterns.py`` compares all of them with the fixed values.
_GAP = r"\s*+(?::\s*+)?"
_AMOUNT = _GAP + r"(?:\$\s*+)?([\d,]++\.?+\d*+)"
_NUMBER = r"\s*+(?:#\s*+)?(?::\s*+)?([A-Z0-9-]++)"
_SUPPLIER = r"(?:" + _GAP + r"([A-Za-z&.,]{c}*+)(?:\n|$)|\s*+:\s\s*?(?:\n|$)|\s\s*?(?:\n|$))"
SEARCH_PATTERNS: dict[str, list[str]] = {
    "invoice_number": ["invoice" + _NUMBER, "inv" + _NUMBER],
    "invoice_date": [
        "date" + _GAP + r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
        r"(\d{1,2}\s++(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*+\s++\d{2,4})",
    ],
    "supplier": ["from" + _SUPPLIER, "vendor" + _SUPPLIER, "supplier" + _SUPPLIER],
    "total": ["total" + _AMOUNT, r"amount\s++due" + _AMOUNT],
    "vat": ["vat" + _AMOUNT, "tax" + _AMOUNT],
    "subtotal": ["subtotal" + _AMOUNT, "sub-total" + _AMOUNT],
}
# Fields whose group, when its pattern matches, is neither empty nor begins or ends with whitespace: one search gives the value.
WHOLE_GROUPS = {"invoice_number", "invoice_date", "total", "vat", "subtotal"}
# A description ends with its last whitespace (stripped later), so it needs no give-back.
SEARCH_ITEM = r"([A-Za-z\s]++)(?<=[A-Za-z\s]\s)(\d++)\s++\$?+([\d,]++\.?+\d*+)\s++\$?+([\d,]++\.?+\d*+)"

# ---- FIXED VALUES: scores and tolerances ------------------------------------------------------------------------
CONFIDENCE_SCORE = 0.8
CALCULATION_TOLERANCE = 0.01
VAT_RATE_TOLERANCE = 0.5
Z_SCORE_THRESHOLD = 3.0
Z_SCORE_HIGH = 4.0
IQR_FACTOR = 1.5
ROUND_TOTAL_UNIT = 1000.0
HIGH_VAT_PERCENT = 30.0
OLD_DATE_DAYS = 3650

# ---- FIXED VALUES: default options -------------------------------------------------------------------------------
DEFAULT_REQUIRED_FIELDS = ["supplier", "total", "invoice_date"]
DEFAULT_VAT_RATES = [0.0, 5.0, 10.0, 20.0]

# ---- FIXED VALUES: accepted date layouts, tried in this order (day-first before month-first) --------------------
# (strptime spelling: %d/%m/%Y, %m/%d/%Y, %Y-%m-%d, %d-%m-%Y, %m-%d-%Y, %d %b %Y, %d %B %Y)
DATE_FORMATS = ["d/M/yyyy", "M/d/yyyy", "yyyy-M-d", "d-M-yyyy", "M-d-yyyy", "d MMM yyyy", "d MMMM yyyy"]
# Shape each layout must have in full (4-digit year, 1-2 digit day/month) so that the parser is as strict as strptime.
DATE_SHAPES = [
    r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{4}-\d{1,2}-\d{1,2}$",
    r"^\d{1,2}-\d{1,2}-\d{4}$",
    r"^\d{1,2}-\d{1,2}-\d{4}$",
    r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    r"^\d{1,2} [A-Za-z]+ \d{4}$",
]

# ---- FIXED VALUES: finding / anomaly / status texts ({name} marks a value filled in per row) ----------------------
MSG_REQUIRED_MISSING = "Required field '{field}' is missing"
MSG_NOT_A_NUMBER = "Field '{field}' must be a number"
MSG_NEGATIVE = "Field '{field}' cannot be negative"
MSG_TOTAL_MISMATCH = "Total mismatch: subtotal ({subtotal}) + VAT ({vat}) = {expected}, but total is {total}"
MSG_ITEM_MISSING = "Line item {n}: missing {key}"
MSG_ITEM_MISMATCH = "Line item {n}: total mismatch ({quantity} × {unit_price} = {expected}, but total is {total})"
MSG_UNUSUAL_VAT_RATE = "Unusual VAT rate: {rate}%. Expected rates: {rates}"
MSG_DATE_UNPARSEABLE = "Could not parse invoice date: {date}"
MSG_DATE_FUTURE = "Invoice date is in the future: {date}"
MSG_DATE_OLD = "Invoice date is very old: {date}"
MSG_TOTAL_OUTLIER = "Total amount is unusual (z-score: {z})"
MSG_VAT_OUTLIER = "VAT amount is unusual (z-score: {z})"
MSG_ROUND_TOTAL = "Total is a very round number"
MSG_DUPLICATE_ITEMS = "Duplicate line items detected"
MSG_SUPPLIER_MISSING = "Supplier information is missing"
MSG_HIGH_VAT_RATE = "VAT rate is unusually high: {rate}%"
MSG_CONVERSION = "could not convert string to float: '{raw}'"
MSG_OCR_FAILED = "OCR extraction failed"
ANOMALY_TYPES = ["statistical_outlier", "suspicious_pattern", "duplicate_items", "missing_critical_field",
                 "unusual_rate"]
SEVERITIES = ["low", "medium", "high"]
VALIDATION_STATUS_DEFAULT = "unknown"
TARGET_LABELS = {"generic": "Generic", "sap": "SAP", "oracle": "Oracle"}
SAP_CONSTANTS = {"BUKRS": "CompanyCode", "WAERS": "USD", "BSART": "ZINV"}
ORACLE_CONSTANTS = {"currency_code": "USD", "invoice_type_lookup_code": "STANDARD", "description_prefix": "Invoice "}
PAGE_HEADER = "--- Page {n} ---"
PAGE_JOIN = "\n\n"

# ---- FIXED VALUES: supported document file extensions -----------------------------------------------------------
SUPPORTED_EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp"]

# ---- FIXED VALUES: what Python's str.strip() removes (every code point with str.isspace()) ----------------------
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

PLAIN_WHITESPACE = "".join(c for c in PY_WHITESPACE if c < "\x80")

# Java regex dialect. Python's str-pattern classes are spelled out so that Java matches exactly the same
# characters: \s is every code point with str.isspace() (Java's (?U)\s misses \x1c-\x1f), \d is category Nd.
# Flags: i = ignore case, u = Unicode case folding, m = multi-line, d = only \n ends a line.
JAVA_WS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
FIELD_FLAGS = "(?imdu)"
PLAIN_FIELD_FLAGS = "(?imd)"
ITEM_FLAGS = "(?d)"
# A line item never starts right after a letter or whitespace (the previous match ends in a digit, comma or dot,
# and a start after such a character would have matched one position earlier). Saying so up front keeps the
# search linear on long prose instead of quadratic.
ITEM_GUARD = r"(?<![A-Za-z\s])"


# The same sets and classes for texts of ASCII alone, character by character: Java tests such a class with one table look-up,
# ranges and characters beyond Latin-1 one after another. Case folding needs no ``u`` there.
ASCII_WS, ASCII_DIGITS, ASCII_LETTERS = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F ", string.digits, string.ascii_letters


def to_java(p: str, plain: bool = False) -> str:
    """Rewrite ``\\s`` and ``\\d`` (inside and outside character classes) to the explicit Python-equivalent sets.

    ``plain``: for texts of ASCII alone.
    """
    ws, digits = (ASCII_WS, ASCII_DIGITS) if plain else (JAVA_WS, r"\p{Nd}")
    if plain:
        p = p.replace("A-Za-z", ASCII_LETTERS)
    out, i, in_class = [], 0, False
    while i < len(p):
        c = p[i]
        if c == "\\" and i + 1 < len(p):
            n = p[i + 1]
            if n == "s":
                out.append(ws if in_class else "[" + ws + "]")
            elif n == "d":
                out.append("[" + digits + "]" if plain and not in_class else digits)
            else:
                out.append(p[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


def java_field_pattern(p: str, plain: bool = False) -> str:
    line = "[A-Za-z" + (ASCII_WS if plain else JAVA_WS).replace(r"\n", "", 1) + "&.,]"
    return (PLAIN_FIELD_FLAGS if plain else FIELD_FLAGS) + to_java(p.replace("{c}", "\0"), plain).replace("\0", line)


def java_item_pattern(guarded: bool = True, pattern: str = SEARCH_ITEM, plain: bool = False) -> str:
    return ITEM_FLAGS + to_java((ITEM_GUARD if guarded else "") + pattern, plain)


FIELD_ORDER = ["invoice_number", "invoice_date", "supplier", "total", "vat", "subtotal"]
AMOUNT_FIELDS = ["total", "vat", "subtotal"]
