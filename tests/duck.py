"""The oracle SQL on given texts: another engine, other regular expressions (RE2), patterns of its own."""

from __future__ import annotations

import duckdb
import pandas as pd

from quire.plans import oracle as O


def rows(texts: list[str], select: str, extra: list[str] | None = None) -> list[dict]:
    """``select`` over the extraction of ``texts`` (doc_id is their place), by doc_id."""
    con = duckdb.connect()
    con.register("texts", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    ctes = ["rendered AS (SELECT doc_id, text FROM texts)", O.FIELDS_CTE, O.ITEM_ROWS_CTE, O.INV_CTE, *(extra or [])]
    got = con.execute("WITH " + ",\n".join(ctes) + f"\nSELECT * FROM ({select}) ORDER BY doc_id")
    names = [c[0] for c in got.description]
    return [dict(zip(names, r, strict=True)) for r in got.fetchall()]
