"""Whole-line text expressions."""

from __future__ import annotations

from . import sql
from .patterns import LEADING_WS

_BLOCK = 256


def trim_left(value: str) -> str:
    """Drop leading Unicode white space."""
    return f"regexp_replace({value}, {sql.text(LEADING_WS)}, '')"


def clean_line(raw: str) -> str:
    """A scanned line as it is shown: one trailing CR removed, ``''`` if not UTF-8."""
    return sql.case(
        [
            (f"NOT is_valid_utf8({raw})", "''"),
            (f"endswith({raw}, '\\r')", f"left({raw}, char_length({raw}) - 1)"),
        ],
        raw,
    )


def contains_ignoring_case(value: str, needle: str) -> str:
    """Case-insensitive substring test. No wildcards; an empty needle matches all."""
    if needle == "":
        return "true"
    return f"contains(lower({value}), lower({sql.text(needle)}))"


def match_spans(value: str, needle: str) -> str:
    """1-based starts of every non-overlapping occurrence, left to right.

    Positions are characters of the lower-cased text. The text is cut at the
    needle; each start is the one before plus the needle and the piece between.
    Appending one start at a time copies the array each time, so a line with more
    than a block of matches is summed up block by block, then over block totals.
    """
    if needle == "":
        return "CAST(array() AS array<int>)"
    # Lower-cased by the engine, as the text is; nothing in it then ends the quotation.
    low = f"lower({sql.text(needle)})"
    step = f"char_length({low})"
    pattern = f"concat({sql.text(chr(92) + 'Q')}, {low}, {sql.text(chr(92) + 'E')})"
    pieces = f"split(lower({value}), {pattern}, -1)"
    # All pieces but the last are followed by a match.
    few = (
        "aggregate(slice(p, 1, size(p) - 1), CAST(array() AS array<int>), (acc, x) -> "
        "concat(acc, array(coalesce(try_element_at(acc, -1) + "
        f"{step}, 1) + char_length(x))))"
    )
    blocks = (
        f"transform(sequence(0, (size(p) - 2) div {_BLOCK}), b -> slice(p, "
        f"b * {_BLOCK} + 1, least({_BLOCK}, size(p) - 1 - b * {_BLOCK})))"
    )
    ends = f"transform({blocks}, k -> {_running('k', f'char_length(x) + {step}')})"
    totals = _running("e", "element_at(x, -1)")
    many = (
        f"zip_with(e, slice(concat(array(0), {totals}), 1, size(e)), (k, before) -> "
        f"transform(k, x -> x + before - {step} + 1))"
    )
    starts = sql.case(
        [(f"size(p) <= {_BLOCK} + 1", few)], f"flatten({let('e', ends, many)})"
    )
    return sql.case(
        [(contains_ignoring_case(value, needle), let("p", pieces, starts))],
        "CAST(array() AS array<int>)",
    )


# Two code points that stand for no character; around each match they part it from the rest.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def regex_spans(value: str, pattern: str) -> str:
    """``start, length`` of every match of a (Java) expression, left to right.

    Starts are 1-based characters. Matches of no character are left out. Every match is put
    between two marks and the text cut at the first of them: a start is the one before plus
    what lies between the two. Starts are summed up in blocks, as for :func:`match_spans`.
    The marks themselves, which no text should hold, count as unknown characters.
    """
    clean = f"translate({value}, '{_OPEN}{_CLOSE}', '\ufffd\ufffd')"
    marked = f"regexp_replace({clean}, {sql.text(pattern)}, '{_OPEN}$0{_CLOSE}')"
    pieces = f"split({marked}, '{_OPEN}', -1)"
    # From the start of the text to the first match, then from each match to the next.
    gaps = (
        "transform(slice(p, 1, size(p) - 1), (x, i) -> "
        "char_length(x) + CASE WHEN i = 0 THEN 1 ELSE -1 END)"
    )
    lengths = f"transform(slice(p, 2, size(p) - 1), x -> instr(x, '{_CLOSE}') - 1)"
    blocks = (
        f"transform(sequence(0, (size(g) - 1) div {_BLOCK}), "
        f"b -> slice(g, b * {_BLOCK} + 1, {_BLOCK}))"
    )
    ends = f"transform({blocks}, k -> {_running('k', 'x')})"
    totals = _running("e", "element_at(x, -1)")
    starts = (
        f"flatten(zip_with(e, slice(concat(array(0), {totals}), 1, size(e)), "
        f"(k, before) -> transform(k, x -> x + before)))"
    )
    paired = (
        f"filter(zip_with({starts}, {lengths}, (s, n) -> named_struct('start', s, "
        "'length', n)), m -> m.length > 0)"
    )
    found = let("g", gaps, let("e", ends, paired))
    none = "CAST(array() AS array<struct<start:int,length:int>>)"
    some = let("p", pieces, sql.case([("size(p) > 1", found)], none))
    return sql.case([(sql.matches(value, pattern), some)], none)


def _running(values: str, gap: str) -> str:
    """Running sum of an integer expression of ``x`` over an array."""
    last = "coalesce(try_element_at(acc, -1), 0)"
    return (
        f"aggregate({values}, CAST(array() AS array<int>), "
        f"(acc, x) -> concat(acc, array({last} + {gap})))"
    )


def let(name: str, value: str, body: str) -> str:
    """``body`` with a lambda variable bound to ``value``: it is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"
