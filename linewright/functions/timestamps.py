"""Timestamp text of a line, one expression per log format.

No field is range-checked and nothing is converted to an instant: the result is
the stamp exactly as written. The ``*_stamp`` forms give ``''`` where there is
none, the ``*_timestamp`` forms null.
"""

from __future__ import annotations

from . import patterns as P
from . import sql
from .json_fields import TIMESTAMP_KEYS


def plain_stamp(line: str) -> str:
    return sql.extract(line, P.PLAIN_TS)


def logcat_stamp(line: str) -> str:
    return sql.extract(line, P.LOGCAT_TS)


def syslog_stamp(line: str) -> str:
    return sql.extract(line, P.SYSLOG_TS)


def json_stamp(line: str) -> str:
    """First of the known keys holding a string; an empty one ends the search."""
    return sql.extract(line, P.json_text(*TIMESTAMP_KEYS, start=P.OBJECT_START))


def plain_timestamp(line: str) -> str:
    return sql.none_if_empty(plain_stamp(line))


def logcat_timestamp(line: str) -> str:
    return sql.none_if_empty(logcat_stamp(line))


def syslog_timestamp(line: str) -> str:
    return sql.none_if_empty(syslog_stamp(line))


def json_timestamp(line: str) -> str:
    return sql.none_if_empty(json_stamp(line))
