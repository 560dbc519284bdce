"""Log format of a file, from its name and its first line."""

from __future__ import annotations

from . import patterns as P
from . import sql

# Format names.
PLAIN, LOGCAT, SYSLOG, JSON = "Plain text", "Logcat", "Syslog", "JSON"
FORMATS = (PLAIN, LOGCAT, SYSLOG, JSON)

# File extensions that mean JSON whatever the content.
JSON_EXTENSIONS = ("json", "jsonl", "ndjson")


# Characters of a path that tell: the longest of these, its dot and the one before it.
_ENDING = max(map(len, JSON_EXTENSIONS)) + 2


def has_json_extension(path: str) -> str:
    """The expression sees the path's end only: it is tried at each character it is given."""
    extension = sql.extract(f"right({path}, {_ENDING})", r"[^/]\.([^./]*)\z")
    named = f"lower({extension}) IN ({sql.texts(JSON_EXTENSIONS)})"
    # Few paths get as far as the expression.
    last = {x for name in JSON_EXTENSIONS for x in (name[-1], name[-1].upper())}
    ends = " OR ".join(f"endswith({path}, {sql.text(x)})" for x in sorted(last))
    return f"({ends}) AND {named}"


def sniff_code(first_line: str) -> str:
    """Index into ``FORMATS`` for the first line of a file.

    A line that begins with a visible ASCII character has no white space to pass over, and one
    character more tells which expression, if any, is worth trying.
    """
    stamps = [(P.LOGCAT_TS, "1"), (P.SYSLOG_TS, "2")]
    branches = [
        (sql.matches(first_line, P.LEADING_WS + P.LOGCAT_BANNER), "1"),
        *((sql.matches(first_line, pattern), code) for pattern, code in stamps),
        (sql.matches(first_line, P.JSON_START), "3"),
    ]
    at = {n: f"substring({first_line}, {n}, 1)" for n in (1, 3, 4)}
    quick = [
        (f"startswith({first_line}, {sql.text(P.LOGCAT_BANNER)})", "1"),
        (f"{at[1]} IN ('{{', '[')", "3"),
        (f"{at[3]} = '-' AND {branches[1][0]}", "1"),
        (f"{at[4]} = ' ' AND {branches[2][0]}", "2"),
    ]
    visible = f"{at[1]} BETWEEN '!' AND '~'"
    code = sql.case([(visible, sql.case(quick, "0"))], sql.case(branches, "0"))
    return f"CAST({code} AS TINYINT)"


def format_name(path: str, code: str) -> str:
    """Format of a file; a null code (no first line) counts as plain text."""
    branches = [(has_json_extension(path), sql.text(JSON))]
    branches += [(f"{code} = {i}", sql.text(FORMATS[i])) for i in (1, 2, 3)]
    return sql.case(branches, sql.text(PLAIN))


def detect_format(path: str, first_line: str) -> str:
    return format_name(path, sniff_code(first_line))
