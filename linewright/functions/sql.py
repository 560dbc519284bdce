"""Building blocks of SQL expression text.

The expressions of this package are kept as SQL text and handed to Spark whole
(``F.expr``): the same Catalyst trees as from Column calls, without hundreds of
round trips to the JVM for the long CASE chains.
"""

from __future__ import annotations


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values) -> str:
    return ", ".join(text(v) for v in values)


def case(branches, other: str | None = None) -> str:
    """``CASE WHEN .. THEN .. [ELSE ..] END`` from (condition, result) pairs."""
    whens = " ".join(f"WHEN {test} THEN {result}" for test, result in branches)
    ending = "" if other is None else f" ELSE {other}"
    return f"CASE {whens}{ending} END"


def extract(value: str, pattern: str) -> str:
    """Group 1 of the first match, ``''`` where there is none."""
    return f"regexp_extract({value}, {text(pattern)}, 1)"


def matches(value: str, pattern: str) -> str:
    return f"regexp_like({value}, {text(pattern)})"


def none_if_empty(value: str) -> str:
    return f"nullif({value}, '')"


def as_number(digits: str) -> str:
    """Digits without leading zeros, null for ``''``.

    ``try_cast`` would raise and catch an error for every empty input, which
    costs far more than the parse itself.
    """
    return f"conv({digits}, 10, 10)"
