r"""Log formats described by Grok patterns: named sub-patterns that are made of each other.

    access = GrokFormat(
        "access",
        r"%{HOST:client} - %{NOTSPACE:user} \[%{HTTPDATE:when}\] %{QUOTED:request} %{INT:status}",
        stamp="when",
    )
    parse_grok(lines, [access])

``%{NAME:field}`` is the sub-pattern of that name and puts what it matches into a field, ``%{NAME}``
only matches. Patterns are expanded before anything runs; one that contains itself is refused. A
file is of the first format whose pattern its first line matches from its start; the lines
of all other files are parsed as ``parse_logs`` does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import levels as lv
from ..functions import sql
from .lookup import attach
from .parse import PARSED_COLUMNS, parse_logs

# Sub-patterns every format may use.
PATTERNS = {
    "INT": r"[+-]?[0-9]+",
    "NUMBER": r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)",
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": r".*?",
    "REST": r".*",
    "QUOTED": r'"(?:[^"\\]|\\.)*+"',
    "IPV4": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "HOSTNAME": r"[0-9A-Za-z][0-9A-Za-z_.-]*",
    "HOST": r"(?:%{IPV4}|%{HOSTNAME})",
    "PATH": r"(?:/[^\s?#]*)+",
    "LEVEL": r"(?i:trace|debug|info|notice|warn(?:ing)?|error|err|crit(?:ical)?|fatal|severe)",
    "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "TIME": r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?",
    "ZONE": r"(?:Z|[+-][0-9]{2}:?[0-9]{2})",
    "TIMESTAMP": r"%{DATE}[T ]%{TIME}%{ZONE}?",
    "MONTH": r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)",
    "SYSLOGTIME": r"%{MONTH} +[0-9]{1,2} %{TIME}",
    "HTTPDATE": r"[0-9]{2}/%{MONTH}/[0-9]{4}:%{TIME} %{ZONE}",
}
_USE = re.compile(r"%\{(\w+)(?::(\w+))?\}")


def expand_grok(pattern: str, own: dict[str, str] | None = None) -> tuple[str, list[str]]:
    """A Java expression and the names of its groups, in their order.

    ``own`` adds sub-patterns to the known ones, or puts others in their place.
    """
    known = PATTERNS | (own or {})
    fields: list[str] = []

    def expand(text: str, inside: tuple[str, ...]) -> str:
        def use(found: re.Match) -> str:
            name, field = found.groups()
            if name in inside:
                raise ValueError(f"%{{{name}}} contains itself: {' > '.join([*inside, name])}")
            if name not in known:
                raise ValueError(f"there is no pattern %{{{name}}}")
            if field is None:
                return f"(?:{expand(known[name], (*inside, name))})"
            if field in fields:
                raise ValueError(f"two fields are named {field}")
            fields.append(field)
            return f"({expand(known[name], (*inside, name))})"

        return _USE.sub(use, text)

    java = expand(pattern, ())
    if re.compile(java).groups != len(fields):
        raise ValueError("groups that are no fields must not capture: write (?:...)")
    return java, fields


@dataclass(frozen=True)
class GrokFormat:
    """A format: its name, its pattern, and which fields hold level and timestamp."""

    name: str
    pattern: str
    level: str | None = None
    stamp: str | None = None
    own: tuple[tuple[str, str], ...] = ()

    def expanded(self) -> tuple[str, list[str]]:
        java, fields = expand_grok(self.pattern, dict(self.own))
        missing = {self.level, self.stamp} - {None, *fields}
        if missing:
            raise ValueError(f"{self.name} has no field {sorted(missing)}")
        return f"^(?:{java})", fields


def grok_formats(lines: DataFrame, formats: list[GrokFormat]) -> DataFrame:
    """``path, grok``: the format of each file whose first line is in one of them."""
    tests = [(sql.matches("value", f.expanded()[0]), sql.text(f.name)) for f in formats]
    first = lines.filter("line_number = 1")
    return first.selectExpr("path", f"{sql.case(tests)} AS grok").filter("grok IS NOT NULL")


def parse_grok(lines: DataFrame, formats: list[GrokFormat]) -> DataFrame:
    """The columns of ``parse_logs``, and ``fields``, a map of the fields that took part.

    A line of a described format that does not match it has no fields, level ``unknown``
    and no timestamp. Levels are told from the level field's words, as elsewhere.
    """
    if len({f.name for f in formats}) < len(formats):
        raise ValueError("two formats have the same name")
    others = [c for c in lines.columns if c not in PARSED_COLUMNS]
    told = attach(lines, grok_formats(lines, formats), ["path"], how="left")
    plain = parse_logs(told.filter("grok IS NULL").drop("grok")).select(
        *PARSED_COLUMNS, *others, F.expr("CAST(NULL AS map<string,string>)").alias("fields")
    )
    found, level, stamp = [], [], []
    for one in formats:
        java, names = one.expanded()
        pairs = ", ".join(
            f"{sql.text(name)}, regexp_extract(value, {sql.text(java)}, {i})"
            for i, name in enumerate(names, 1)
        )
        held = f"map_filter(map({pairs}), (k, x) -> x <> '')" if pairs else "map()"
        mine = f"grok = {sql.text(one.name)}"
        found.append((f"{mine} AND {sql.matches('value', java)}", held))
        if one.level:
            level.append((mine, f"lower(try_element_at(fields, {sql.text(one.level)}))"))
        if one.stamp:
            stamp.append((mine, f"try_element_at(fields, {sql.text(one.stamp)})"))
    none = "CAST(NULL AS STRING)"
    word = sql.case(lv.word_branches("_word", lv.VALUE_WORDS), "'unknown'")
    grokked = (
        told.filter("grok IS NOT NULL")
        .selectExpr("*", f"{sql.case(found) if found else 'CAST(NULL AS map<string,string>)'} AS fields")
        .selectExpr(
            "*",
            f"{sql.case(level) if level else none} AS _word",
            f"{sql.case(stamp) if stamp else none} AS _stamp",
        )
        .drop("format", "level", "level_code", "ts_text")
        .selectExpr("*", "grok AS format", f"{word} AS level", "_stamp AS ts_text")
        .selectExpr("*", f"{lv.level_code('level')} AS level_code")
        .select(*PARSED_COLUMNS, *others, "fields")
    )
    return plain.unionByName(grokked)
