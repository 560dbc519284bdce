"""Field lookup in a JSON log line by scanning its text.

The scan takes the first quoted key that follows ``{`` or ``,`` at any depth and
keeps escapes as written, so it also works on malformed lines. ``get_json_object``
answers a different question (top-level key, decoded value, valid input only).
"""

from __future__ import annotations

from . import patterns as P
from . import sql

# Accepted key names, in the order they are tried.
TIMESTAMP_KEYS = ("timestamp", "time", "ts", "@timestamp")
LEVEL_KEYS = ("level", "severity", "lvl")


def string_field(line: str, key: str) -> str:
    """Raw text of the key's string value; null if its first hit has none."""
    quoted = sql.none_if_empty(sql.extract(line, P.json_quoted(key)))
    return f"substring({quoted}, 2)"


def number_field(line: str, key: str) -> str:
    """Leading digits of a bare number as DECIMAL(20,0), null beyond 64 bits."""
    digits = sql.extract(line, P.json_number(key))
    return f"CAST({sql.as_number(digits)} AS DECIMAL(20,0))"
