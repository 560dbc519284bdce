"""Severity of a line, one expression per log format."""

from __future__ import annotations

from . import patterns as P
from . import sql
from .json_fields import LEVEL_KEYS
from .text import trim_left

# Level names by code.
LEVELS = ("error", "warn", "info", "debug", "trace", "unknown")

# Words that decide the level of free text; the first hit wins.
LINE_WORDS = (
    ("error", "error"),
    ("warn", "warn"),
    ("info", "info"),
    ("debug", "debug"),
    ("trace", "trace"),
)

# Words that decide the level of a JSON level value.
VALUE_WORDS = (
    ("error", "error"),
    ("fatal", "error"),
    ("crit", "error"),
    ("warn", "warn"),
    ("info", "info"),
    ("debug", "debug"),
    ("trace", "trace"),
    ("verbose", "trace"),
)

# The lowest number of each level in a JSON level value.
NUMBER_FLOORS = ((60, "error"), (50, "warn"), (40, "info"), (30, "debug"), (0, "trace"))

# Logcat priority letters.
LOGCAT_LETTERS = (
    ("V", "trace"),
    ("D", "debug"),
    ("I", "info"),
    ("W", "warn"),
    ("E", "error"),
    ("F", "error"),
)


def word_branches(lowered: str, words=LINE_WORDS) -> list[tuple[str, str]]:
    """CASE branches for the first listed word in lower-cased text."""
    return [
        (f"contains({lowered}, {sql.text(word)})", sql.text(name))
        for word, name in words
    ]


def number_branches(number: str) -> list[tuple[str, str]]:
    """CASE branches for a numeric level value; none holds for null."""
    return [(f"{number} >= {floor}", sql.text(name)) for floor, name in NUMBER_FLOORS]


def keyword_level(value: str) -> str:
    """Level by keyword anywhere in the text, ``information`` and ``terror`` included."""
    return sql.case(word_branches(f"lower({value})"), "'unknown'")


def logcat_letter(line: str) -> str:
    return sql.extract(line, P.LOGCAT_LETTER)


def letter_level(letter: str) -> str:
    branches = [
        (f"{letter} = {sql.text(mark)}", sql.text(name))
        for mark, name in LOGCAT_LETTERS
    ]
    return sql.case(branches, "'unknown'")


def logcat_level(line: str) -> str:
    return letter_level(logcat_letter(line))


def syslog_tail(line: str) -> str:
    """``': '`` and the message of a syslog line, ``''`` where there is none."""
    return sql.extract(line, P.SYSLOG_TAIL)


def syslog_message(line: str) -> str:
    tail = sql.none_if_empty(syslog_tail(line))
    return trim_left(f"substring({tail}, 3)")


def syslog_level(line: str) -> str:
    """Keyword of the message if it has one, else of the whole line."""
    by_message = word_branches(f"lower({syslog_tail(line)})")
    return sql.case(by_message + word_branches(f"lower({line})"), "'unknown'")


def json_level_value(line: str) -> str:
    """Value of the first level key found, ``''`` where the line has none.

    A string keeps its opening quote; the maps see past it.
    """
    return sql.extract(line, P.json_scalar(*LEVEL_KEYS, start=P.OBJECT_START))


def level_number(value: str) -> str:
    """A level value as an unsigned 32-bit number, null if it does not read as one."""
    return f"CAST({sql.as_number(sql.extract(value, P.JSON_UINT))} AS BIGINT)"


def level_code(level: str) -> str:
    """Level name to 0..5."""
    branches = [(f"{level} = {sql.text(n)}", str(i)) for i, n in enumerate(LEVELS[:-1])]
    return f"CAST({sql.case(branches, str(len(LEVELS) - 1))} AS TINYINT)"


def level_name(code: str) -> str:
    """0..5 to level name; any other code is unknown."""
    branches = [(f"{code} = {i}", sql.text(n)) for i, n in enumerate(LEVELS[:-1])]
    return sql.case(branches, sql.text(LEVELS[-1]))
