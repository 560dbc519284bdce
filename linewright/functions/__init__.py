"""Column functions: text, timestamps, levels, JSON fields, formats.

Each takes column names (or SQL expressions) and returns a Column.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

from . import formats, json_fields, levels, text, timestamps
from .formats import FORMATS
from .levels import LEVELS


def _column(build):
    @functools.wraps(build)
    def function(*args: str) -> Column:
        return F.expr(build(*args))

    return function


clean_line = _column(text.clean_line)
contains_ignoring_case = _column(text.contains_ignoring_case)
match_spans = _column(text.match_spans)
trim_left = _column(text.trim_left)
plain_timestamp = _column(timestamps.plain_timestamp)
logcat_timestamp = _column(timestamps.logcat_timestamp)
syslog_timestamp = _column(timestamps.syslog_timestamp)
json_timestamp = _column(timestamps.json_timestamp)
string_field = _column(json_fields.string_field)
number_field = _column(json_fields.number_field)
keyword_level = _column(levels.keyword_level)
logcat_level = _column(levels.logcat_level)
syslog_level = _column(levels.syslog_level)
syslog_message = _column(levels.syslog_message)
level_code = _column(levels.level_code)
level_name = _column(levels.level_name)
detect_format = _column(formats.detect_format)

__all__ = [
    "FORMATS",
    "LEVELS",
    "clean_line",
    "contains_ignoring_case",
    "detect_format",
    "json_timestamp",
    "keyword_level",
    "level_code",
    "level_name",
    "logcat_level",
    "logcat_timestamp",
    "match_spans",
    "number_field",
    "plain_timestamp",
    "string_field",
    "syslog_level",
    "syslog_message",
    "syslog_timestamp",
    "trim_left",
]
