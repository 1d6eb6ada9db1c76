"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.stage import clear_tables as clear
from quire.functions.stage import materialize as written

__all__ = ["clear", "long_rows", "text_bytes", "written"]

_BATCH, _DEFAULT, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def long_rows(docs: DataFrame) -> DataFrame:
    """``docs``, whose rows go to Python in batches of 1000 from now on, unless the session has set a size of its own.

    Spark's default of 10,000 rows is made for short rows; that many texts are tens of megabytes for each task, on both
    sides of the pipe.
    """
    conf = docs.sparkSession.conf
    if conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        conf.set(_BATCH, _ROWS)
    return docs


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one aggregate, from which partition and block counts follow."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
