"""Own rules as data: a list of conditions compiled into the projection that makes the built-in findings and anomalies.

A rule that cannot be applied to the frame (a column it does not have, a condition that is no condition) does not stop the others:
it is reported on every row as ``rule_failed``. A condition that is NULL for a row does not hold for it. Conditions are Spark
expressions and follow its rules for errors at run time: use ``try_cast``, ``try_divide`` and the like on doubtful values.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_FAILED = "rule_failed"


class Rule(NamedTuple):
    """``when`` (a Column or SQL text) makes a finding with this code; in the order of the list, after the built-in ones."""

    code: str
    when: Column | str
    message: str = ""
    field: str | None = None
    #: ``error`` or ``warning`` for validation; ``low``, ``medium`` or ``high`` for anomalies.
    severity: str = "error"
    #: What is reported as observed (validation) or as value (anomalies): a Column or SQL text of a number.
    observed: Column | str | None = None


def _column(c: Column | str | None) -> Column | None:
    return F.expr(c) if isinstance(c, str) else c


def _fits(df: DataFrame, rule: Rule) -> str | None:
    """Why a rule cannot be applied; None if it can. Nothing runs."""
    try:
        kinds = df.select(_column(rule.when).alias("when"), *([] if rule.observed is None else [_column(rule.observed).cast("double").alias("observed")])).dtypes
    except AnalysisException as e:
        return e.getCondition() or "ANALYSIS_ERROR"
    return None if kinds[0][1] == "boolean" else f"a condition of type {kinds[0][1]}"


def applied(df: DataFrame, rules: Sequence[Rule], severities: Sequence[str]) -> list[tuple[Rule, Column, Column | None]]:
    """(rule, condition, observed) of each of ``rules`` on ``df``; failed ones hold everywhere under :data:`RULE_FAILED`."""
    out = []
    for rule in rules:
        if rule.severity not in severities:
            raise ValueError(f"severity of rule {rule.code}: {rule.severity} is not one of {', '.join(severities)}")
        why = _fits(df, rule)
        if why:
            failed = rule._replace(code=RULE_FAILED, message=f"Rule '{rule.code}' could not be applied: {why}", observed=None)
            out.append((failed, F.lit(True), None))
        else:
            out.append((rule, F.coalesce(_column(rule.when), F.lit(False)), _column(rule.observed)))
    return out
