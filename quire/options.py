"""What a run can be told, as one frozen set of values with the fixed defaults of ``patterns``."""

from __future__ import annotations

from typing import TYPE_CHECKING, NamedTuple

from .functions.patterns import DEFAULT_REQUIRED_FIELDS, DEFAULT_VAT_RATES


if TYPE_CHECKING:
    from .operators.rules import Rule


class Options(NamedTuple):
    #: Attach organisations, dates and money amounts of an entity table, and take a missing supplier from it.
    use_entities: bool = False
    required_fields: tuple[str, ...] = tuple(DEFAULT_REQUIRED_FIELDS)
    vat_rates: tuple[float, ...] = tuple(DEFAULT_VAT_RATES)
    #: Warnings count as errors.
    strict: bool = False
    #: ``statistical``, ``rule_based``, or None for no anomaly stage.
    anomaly_mode: str | None = "statistical"
    #: Target system of each exported invoice, or None for no target stage.
    target: str | None = None
    #: Own rules of validation (severity error or warning) and of anomalies (low, medium or high), after the built-in ones.
    rules: tuple[Rule, ...] = ()
    anomaly_rules: tuple[Rule, ...] = ()


def anomaly_mode(enabled: bool = True, algorithms: list[str] | tuple[str, ...] = ("statistical", "rule_based")) -> str | None:
    """The first algorithm listed; an empty list means statistical; disabled means no stage."""
    if not enabled:
        return None
    return algorithms[0] if algorithms else "statistical"
