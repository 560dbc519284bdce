"""Detection of a file's format and parsing of its lines.

``log_lines``    path, line_number, value
``parsed_logs``  path, line_number, value, format, level, level_code, ts_text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import formats as fmt
from ..functions import levels as lv
from ..functions import sql
from ..functions import timestamps as ts
from . import lookup

# Lines of a file that are shuffled together where the formats don't fit a broadcast.
BLOCK_LINES = 1 << 19

PARSED_COLUMNS = (
    "path",
    "line_number",
    "value",
    "format",
    "level",
    "level_code",
    "ts_text",
)


def detect_formats(lines: DataFrame) -> DataFrame:
    """``path, format``: one row per file, from its extension and its first line.

    The first line is picked by its number, not by an aggregate, so on a stored
    table the test reaches the scan and no shuffle is needed.
    """
    first = lines.filter("line_number = 1")
    return first.selectExpr("path", f"{fmt.detect_format('path', 'value')} AS format")


def with_format(lines: DataFrame) -> DataFrame:
    """``lines`` plus the format of each line's file.

    A file whose first line is not among ``lines`` (a page, a sample, a slice) keeps its
    lines: its format is told from its name, else it is plain text. Formats too many to
    broadcast are shuffled by blocks of lines, so a file of any length is spread.
    """
    formats, size = lookup.store_measured(detect_formats(lines), "formats")
    if size <= lookup.BROADCAST_BYTES:
        told = lines.join(F.broadcast(formats), "path", "left")
    else:
        block = F.expr(f"(line_number - 1) DIV {BLOCK_LINES}")
        blocked = lines.withColumn("_block", block)
        by_block = blocked.select("path", "_block").distinct()
        by_block = by_block.join(formats, "path", "left")
        told = blocked.join(by_block, ["path", "_block"], "left").drop("_block")
    no_line = F.expr(fmt.format_name("path", "CAST(NULL AS TINYINT)"))
    return told.withColumn("format", F.coalesce("format", no_line))


def parse_logs(lines: DataFrame, format: str | None = None) -> DataFrame:
    """Derive level and timestamp text for every line.

    With ``format`` given, every line is read in that format (an unknown name
    means plain text). Otherwise the ``format`` column is used, and detected
    first where the frame has none. Other columns pass through.

    The work is laid out in steps so that no regular expression is copied into
    several branches: what the level is read from, its lower-cased form, then the
    choice. Steps whose outputs are not selected are pruned.
    """
    if format is not None:
        name = format if format in fmt.FORMATS else fmt.PLAIN
        lines = lines.drop("format").selectExpr("*", f"{sql.text(name)} AS format")
        choose = lambda branches: branches[name]
    else:
        if "format" not in lines.columns:
            lines = with_format(lines)
        choose = _by_format

    words, none = "_words", "CAST(NULL AS STRING)"
    stamp = choose(
        {
            fmt.PLAIN: ts.plain_stamp("value"),
            fmt.LOGCAT: ts.logcat_stamp("value"),
            fmt.SYSLOG: ts.syslog_stamp("value"),
            fmt.JSON: ts.json_stamp("value"),
        }
    )
    # The text that decides the level.
    subject = choose(
        {
            fmt.PLAIN: "value",
            fmt.LOGCAT: lv.logcat_letter("value"),
            fmt.SYSLOG: "value",
            fmt.JSON: lv.json_level_value("value"),
        }
    )
    lowered = choose(
        {
            fmt.PLAIN: "lower(_subject)",
            fmt.LOGCAT: none,
            fmt.SYSLOG: "lower(_subject)",
            fmt.JSON: "lower(_subject)",
        }
    )
    message = choose(
        {
            fmt.PLAIN: none,
            fmt.LOGCAT: none,
            fmt.SYSLOG: f"lower({lv.syslog_tail('value')})",
            fmt.JSON: none,
        }
    )
    number = choose(
        {
            fmt.PLAIN: "CAST(NULL AS BIGINT)",
            fmt.LOGCAT: "CAST(NULL AS BIGINT)",
            fmt.SYSLOG: "CAST(NULL AS BIGINT)",
            fmt.JSON: lv.level_number("_subject"),
        }
    )
    by_word = lv.word_branches(words)
    by_message = lv.word_branches("_message")
    by_number = lv.number_branches("_number")
    by_value = lv.word_branches(words, lv.VALUE_WORDS)
    level = choose(
        {
            fmt.PLAIN: sql.case(by_word, "'unknown'"),
            fmt.LOGCAT: lv.letter_level("_subject"),
            fmt.SYSLOG: sql.case(by_message + by_word, "'unknown'"),
            fmt.JSON: sql.case(by_number + by_value, "'unknown'"),
        }
    )
    others = [c for c in lines.columns if c not in PARSED_COLUMNS]
    return (
        lines.selectExpr("*", f"{stamp} AS _stamp", f"{subject} AS _subject")
        .selectExpr(
            "*",
            f"{sql.none_if_empty('_stamp')} AS ts_text",
            f"{lowered} AS _words",
            f"{message} AS _message",
            f"{number} AS _number",
        )
        .selectExpr("*", f"{level} AS level")
        .selectExpr("*", f"{lv.level_code('level')} AS level_code")
        .select(*PARSED_COLUMNS, *others)
    )


def pin_level(parsed: DataFrame) -> DataFrame:
    """Compute the level once per line, below any filter on it.

    A filter on a column that was just derived is moved under the derivation with
    the whole expression copied into it, here dozens of regular expressions. The
    one-element explode keeps such a filter above. Use it for lines that are
    filtered while they stream by; on a stored table it would only be in the way.
    """
    columns = [
        F.explode(F.array("level")).alias(c) if c == "level" else F.col(c)
        for c in parsed.columns
    ]
    return parsed.select(*columns)


def _by_format(branches: dict[str, str]) -> str:
    named = [
        (f"format = {sql.text(name)}", branches[name])
        for name in fmt.FORMATS
        if name != fmt.PLAIN
    ]
    return sql.case(named, branches[fmt.PLAIN])
