"""Search by regular expression and by trees of terms.

    Has("timeout") & ~Has("retry") | Matches(r"code=5[0-9]{2}")

A tree is one predicate over ``value``; the engine evaluates it per line, short-circuiting
as SQL does. Terms ignore case, as the plain search does; expressions don't unless asked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sql
from ..functions.text import contains_ignoring_case, let, match_spans, regex_spans
from .search import search_predicate


class Term:
    """What a line may be asked for; combine with ``&``, ``|`` and ``~``."""

    def test(self, value: str) -> str:
        raise NotImplementedError

    def spans(self, value: str) -> list[str]:
        """SQL for the places (start, length) of each thing the tree asks to be there."""
        raise NotImplementedError

    def __and__(self, other: Term) -> Term:
        return _Both(self, other, "AND")

    def __or__(self, other: Term) -> Term:
        return _Both(self, other, "OR")

    def __invert__(self) -> Term:
        return _Not(self)


@dataclass(frozen=True)
class Has(Term):
    """The line contains a text, in any case. The empty text is in every line."""

    text: str

    def test(self, value: str) -> str:
        return contains_ignoring_case(value, self.text)

    def spans(self, value: str) -> list[str]:
        length = f"char_length(lower({sql.text(self.text)}))"
        starts = match_spans(value, self.text)
        return [f"transform({starts}, s -> named_struct('start', s, 'length', {length}))"]


@dataclass(frozen=True)
class Matches(Term):
    """Some part of the line matches a (Java) regular expression."""

    pattern: str
    ignore_case: bool = False

    def test(self, value: str) -> str:
        return sql.matches(value, self._java())

    def spans(self, value: str) -> list[str]:
        return [regex_spans(value, self._java())]

    def _java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


@dataclass(frozen=True)
class _Both(Term):
    left: Term
    right: Term
    word: str

    def test(self, value: str) -> str:
        return f"({self.left.test(value)} {self.word} {self.right.test(value)})"

    def spans(self, value: str) -> list[str]:
        return [*self.left.spans(value), *self.right.spans(value)]


@dataclass(frozen=True)
class _Not(Term):
    inner: Term

    def test(self, value: str) -> str:
        return f"NOT ({self.inner.test(value)})"

    def spans(self, value: str) -> list[str]:
        return []  # what must not be there has no place


def term_predicate(term: Term, level: str | None = None) -> Column:
    """The tree as a predicate, after the cheap level test."""
    asked = F.expr(term.test("value"))
    return asked if level is None else search_predicate("", level) & asked


def search_terms(parsed: DataFrame, term: Term, level: str | None = None) -> DataFrame:
    """Lines for which the tree of terms holds. A null value is no match."""
    return parsed.filter(term_predicate(term, level))


def search_regex(
    parsed: DataFrame, pattern: str, level: str | None = None, ignore_case: bool = False
) -> DataFrame:
    """Lines some part of which matches the expression."""
    return search_terms(parsed, Matches(pattern, ignore_case), level)


def term_spans(parsed: DataFrame, term: Term) -> DataFrame:
    """``path, line_number, spans``: what to highlight in the lines for which a tree holds.

    Spans are (start, length) in characters, by start and without repeats; those of different
    terms may overlap. Lines for which the tree doesn't hold have none.
    """
    lists = term.spans("value")
    none = "CAST(array() AS array<struct<start:int,length:int>>)"
    found = lists[0] if len(lists) == 1 else none
    if len(lists) > 1:
        # In order, each that differs from the one before it.
        fresh = "filter(m, (x, i) -> i = 0 OR x <> m[i - 1])"
        found = let("m", f"array_sort(concat({', '.join(lists)}))", fresh)
    spans = sql.case([(term.test("value"), found)], none)
    return parsed.select("path", "line_number", F.expr(spans).alias("spans"))


def regex_matches(parsed: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """``path, line_number, spans``: (start, length) of every match of an expression."""
    return term_spans(parsed, Matches(pattern, ignore_case))
