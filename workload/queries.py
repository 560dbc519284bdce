"""Registered queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

import linewright as lw
from linewright.functions import (
    json_timestamp,
    keyword_level,
    level_code,
    level_name,
    logcat_level,
    logcat_timestamp,
    number_field,
    plain_timestamp,
    string_field,
    syslog_level,
    syslog_message,
    syslog_timestamp,
)
from linewright import session
from linewright.operators.lookup import store
from linewright.operators.search import COUNTED_LEVELS
from linewright.plans import ingest
from linewright.streaming import sinks

from . import inputs

NEEDLE = "error"
SEARCH = ("USER=1", "error")
SPAN_NEEDLE = "er"
RARE = "user=17"
RANK = 7
PAGE = (100, 50)
CURRENT = 500
GOTO = 250
# Patterns that Java and RE2 read alike.
REGEX = r"user=[0-9]*7\b|Tag: (error|view)$"
TERM_REGEX = "level\":\"WARN.*sign"
USER_PATTERN = r"(?P<clock>[0-9]{2}:[0-9]{2}):[0-9.]+ (?P<word>[A-Za-z]+) user=(?P<user>[0-9]+)"
TOP = 5
SPAN_REGEX = r"[a-z]+=[0-9]+|E[A-Z]+|[0-9]{2}:"
DOCUMENT_REGEX = "[a-z]*e[rn]"
APP_FORMAT = lw.GrokFormat(
    "app",
    "%{TIMESTAMP:at} %{WORD:word} user=%{INT:user} %{REST:props}",
    level="word",
    stamp="at",
)
YEAR = 2024
UNFINISHED = 0.71
BATCHES = 12
GROWTH = (0.35, 0.6, 1.0)
DATE = "2024-02-03"
RANGE = ("2024-01-05 00:00:00", "2024-01-20 12:30:00")


# --- scans, sources, sinks -----------------------------------------------------


def scan_lines(spark, sf_dir) -> DataFrame:
    folder = inputs.run_dir(spark, "documents")
    inputs.write_files(inputs.document_lines(spark, sf_dir), folder)
    lines = lw.scan_lines(spark, folder)
    return lines.select(inputs.file_id(F.col("path")).alias("file_id"), "value")


def scan_nested(spark, sf_dir) -> DataFrame:
    """Plain files, ``k=v`` folders and nested folders side by side."""
    folder = inputs.run_dir(spark, "documents")
    lines = inputs.document_lines(spark, sf_dir)
    below = F.expr("element_at(array('', 'day=1/', 'a/b/'), CAST(file AS INT) % 3 + 1)")
    inputs.write_files(lines.withColumn("file", F.concat(below, "file")), folder)
    lines = lw.scan_lines(spark, folder)
    return lines.select(inputs.file_id(F.col("path")).alias("file_id"), "value")


def scan_invalid(spark, sf_dir) -> DataFrame:
    """Lines that end in CR LF; those with an e acute lack its second byte."""
    folder = inputs.run_dir(spark, "documents")
    edits = ((b"\n", b"\r\n"), (b"\xc3\xa9", b"\xc3"))
    inputs.write_files(inputs.document_lines(spark, sf_dir), folder, edits=edits)
    lines = lw.scan_lines(spark, folder)
    return lines.select(inputs.file_id(F.col("path")).alias("file_id"), "value")


def line_numbers(spark, sf_dir) -> DataFrame:
    folder = inputs.run_dir(spark, "documents")
    inputs.write_files(inputs.document_lines(spark, sf_dir), folder)
    lines = lw.read_log_lines(spark, folder)
    return lines.select(
        inputs.file_id(F.col("path")).alias("file_id"), "line_number", "value"
    )


def export_filtered(spark, sf_dir) -> DataFrame:
    folder = inputs.run_dir(spark, "export")
    matches = lw.search_logs(inputs.parsed_table(spark, sf_dir), "", "error")
    lw.export_lines(matches, folder)
    numbered = lw.number_lines(spark, folder)
    # One row per exported part file: lines in the parts before it.
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.files.select(
        "path", F.coalesce(F.sum("line_count").over(earlier), F.lit(0)).alias("start")
    )
    return numbered.lines.join(starts, "path").select(
        (F.col("start") + F.col("line_number")).alias("export_line"), "value"
    )


def _segments(spark, sf_dir) -> DataFrame:
    return inputs.segment_lines(
        spark, sf_dir, "app.log", "device.log", "sys.txt", "svc.jsonl"
    )


def ingest_manifest(spark, sf_dir) -> DataFrame:
    source = inputs.run_dir(spark, "segments")
    table = inputs.run_dir(spark, "table")
    inputs.write_files(_segments(spark, sf_dir), source)
    lw.ingest(spark, source, table)
    return lw.read_manifest(spark, table).select(
        inputs.file_id(F.col("path")).alias("file_id"),
        "file_size",
        "format",
        "line_count",
    )


def ingest_refresh(spark, sf_dir) -> DataFrame:
    source = inputs.run_dir(spark, "segments")
    table = inputs.run_dir(spark, "table")
    (made,) = inputs.make_files(_segments(spark, sf_dir), "true")
    inputs.write_files(made, source, share=0.6)
    lw.ingest(spark, source, table)
    inputs.write_files(made, source)
    lw.ingest(spark, source, table)
    return lw.read_parsed(spark, table).select(
        inputs.file_id(F.col("path")).alias("file_id"),
        "line_number",
        "value",
        "format",
        "level",
        "ts_text",
    )


def ingest_append(spark, sf_dir) -> DataFrame:
    """Files that grow twice: which commit holds each line tells that only new ones were read."""
    source = inputs.run_dir(spark, "segments")
    table = inputs.run_dir(spark, "table")
    (made,) = inputs.make_files(_segments(spark, sf_dir), "true")
    for share in GROWTH:
        inputs.write_files(made, source, share=share)
        lw.ingest(spark, source, table)
    current = ingest.current_lines(spark, table, ingest.live_rows(spark, table))
    return current.select(
        inputs.file_id(F.col("path")).alias("file_id"),
        F.col("ingest_id").alias("taken_in"),
        "line_number",
        "value",
        "format",
        "level",
        "ts_text",
    )


def ingest_compacted(spark, sf_dir) -> DataFrame:
    """Files that are replaced, compacted, appended to and compacted again."""
    source = inputs.run_dir(spark, "segments")
    table = inputs.run_dir(spark, "table")
    third, made = inputs.make_files(_segments(spark, sf_dir), "position % 3 = 0", "true")
    inputs.write_files(third, source)
    lw.ingest(spark, source, table)
    for share in (0.6, 1.0):
        inputs.write_files(made, source, share=share)
        lw.ingest(spark, source, table)
        lw.compact(spark, table)
    return lw.read_parsed(spark, table).select(
        inputs.file_id(F.col("path")).alias("file_id"),
        "line_number",
        "value",
        "format",
        "level",
        "ts_text",
    )


def ingest_after_crash(spark, sf_dir) -> DataFrame:
    """Runs that died while writing lines and while writing the manifest, then a good one."""
    source = inputs.run_dir(spark, "segments")
    table = inputs.run_dir(spark, "table")
    lines = _segments(spark, sf_dir)
    inputs.write_files(lines, source)
    for number, part in ((0, "lines"), (1, "manifest")):
        session.claim(spark, f"{table}/claims/{number}")
        session.claim(spark, f"{table}/{part}/ingest_id={number}/_temporary/left")
    lw.ingest(spark, source, table)
    return lw.read_parsed(spark, table).select(
        inputs.file_id(F.col("path")).alias("file_id"),
        "line_number",
        "value",
        "format",
        "level",
        "ts_text",
    )


def stale_files(spark, sf_dir) -> DataFrame:
    documents = inputs.table(spark, sf_dir, "documents")
    known = documents.filter("doc_id % 5 <> 4").select(
        F.col("doc_id").alias("path"),
        F.col("n_chars").alias("file_size"),
        (F.col("doc_id") * 10).alias("mtime_secs"),
    )
    grown = F.when(F.col("doc_id") % 7 == 3, 1).otherwise(0)
    touched = F.when(F.col("doc_id") % 11 == 5, 1).otherwise(0)
    listing = documents.select(
        F.col("doc_id").alias("path"),
        (F.col("n_chars") + grown).alias("file_size"),
        (F.col("doc_id") * 10 + touched).alias("mtime_secs"),
    )
    stale = lw.stale_files(listing, known)
    return stale.select(F.col("path").alias("path_id"), "file_size", "mtime_secs")


def file_summary(spark, sf_dir) -> DataFrame:
    parsed = inputs.parsed_table(spark, sf_dir)
    sizes = parsed.groupBy("path").agg(
        F.sum(F.octet_length("value").cast("bigint") + 1).alias("file_size")
    )
    files = lw.line_counts(parsed).join(sizes, "path")
    return lw.file_summary(files)


# --- formats --------------------------------------------------------------------


def detect_format(spark, sf_dir) -> DataFrame:
    return lw.detect_formats(inputs.all_lines(spark, sf_dir))


def detect_format_first_lines(spark, sf_dir) -> DataFrame:
    """Every odd line as the first line of a file of its own."""
    lines = inputs.odd_lines(spark, sf_dir)
    extension = F.when(F.col("line_number") % 3 == 0, ".JSONL").otherwise(".log")
    files = lines.select(
        F.concat(F.lit("f"), "line_number", extension).alias("path"),
        F.lit(1).cast("bigint").alias("line_number"),
        "value",
    )
    return lw.detect_formats(files)


def parse_logs(spark, sf_dir) -> DataFrame:
    return lw.parse_logs(inputs.all_lines(spark, sf_dir)).select(
        "path", "line_number", "format", "level", "ts_text"
    )


def parse_without_first_line(spark, sf_dir) -> DataFrame:
    """No file's first line is there: the name tells the format, else plain text."""
    lines = inputs.all_lines(spark, sf_dir).filter("line_number > 1")
    return lw.parse_logs(lines).select(
        "path", "line_number", "format", "level", "ts_text"
    )


def parse_fixed_format(spark, sf_dir) -> DataFrame:
    lines = inputs.with_odd(spark, sf_dir, "svc.jsonl")
    return lw.parse_logs(lines, "no such format").select(
        "path", "line_number", "format", "level", "ts_text"
    )


def _timestamps(path, timestamp):
    def query(spark, sf_dir) -> DataFrame:
        lines = inputs.with_odd(spark, sf_dir, path)
        return lines.select(
            "path", "line_number", timestamp("value").alias("ts_text")
        )

    return query


# --- levels and fields ------------------------------------------------------------


def _levels(path, level):
    def query(spark, sf_dir) -> DataFrame:
        lines = inputs.with_odd(spark, sf_dir, path)
        return lines.select(
            "path", "line_number", level("value").alias("level")
        )

    return query


def level_keyword_documents(spark, sf_dir) -> DataFrame:
    """Keyword level of whole document texts."""
    documents = inputs.table(spark, sf_dir, "documents")
    return documents.select("doc_id", keyword_level("text").alias("level"))


def level_json(spark, sf_dir) -> DataFrame:
    lines = inputs.with_odd(spark, sf_dir, "svc.jsonl")
    return lw.parse_logs(lines, "JSON").select("path", "line_number", "level")


def level_codes(spark, sf_dir) -> DataFrame:
    lines = inputs.with_odd(spark, sf_dir, "app.log").select(
        "path", "line_number", keyword_level("value").alias("level")
    )
    coded = lines.withColumn("level_code", level_code("level"))
    return coded.select(
        "path",
        "line_number",
        level_name("level_code").alias("level"),
        F.col("level_code").cast("bigint").alias("level_code"),
    )


def syslog_messages(spark, sf_dir) -> DataFrame:
    lines = inputs.with_odd(spark, sf_dir, "sys.txt")
    return lines.select(
        "path", "line_number", syslog_message("value").alias("message")
    )


def json_string_field(spark, sf_dir) -> DataFrame:
    lines = inputs.with_odd(spark, sf_dir, "svc.jsonl")
    return lines.select(
        "path", "line_number", string_field("value", "msg").alias("field")
    )


def json_number_field(spark, sf_dir) -> DataFrame:
    lines = inputs.with_odd(spark, sf_dir, "svc.jsonl")
    number = number_field("value", "level").cast("string")
    return lines.select("path", "line_number", number.alias("field"))


# --- search -----------------------------------------------------------------------


def filter_level(spark, sf_dir) -> DataFrame:
    matches = lw.search_logs(inputs.parsed_table(spark, sf_dir), "", "warn")
    return matches.select("path", "line_number", "value")


def search_substring(spark, sf_dir) -> DataFrame:
    matches = lw.search_logs(inputs.parsed_table(spark, sf_dir), NEEDLE)
    return matches.select("path", "line_number", "value")


def search_and_level(spark, sf_dir) -> DataFrame:
    matches = lw.search_logs(inputs.parsed_table(spark, sf_dir), *SEARCH)
    return matches.select("path", "line_number", "value")


def search_documents(spark, sf_dir) -> DataFrame:
    """Substring search over every line of the documents."""
    lines = inputs.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"),
        F.posexplode(F.split("text", "\n")).alias("position", "value"),
    )
    matches = lw.search_logs(lines, "THe")
    return matches.select("path", F.col("position").cast("bigint"), "value")


def search_indexed(spark, sf_dir) -> DataFrame:
    """The substring search by an index of the stored lines."""
    parsed = inputs.parsed_table(spark, sf_dir)
    index = store(lw.gram_index(parsed), "index")
    matches = lw.search_indexed(parsed, index, RARE)
    return matches.select("path", "line_number", "value")


def search_table(spark, sf_dir) -> DataFrame:
    """The same over a table that was indexed at ingest, and grew and was compacted since."""
    source = inputs.run_dir(spark, "segments")
    table = inputs.run_dir(spark, "table")
    (made,) = inputs.make_files(_segments(spark, sf_dir), "true")
    for share in (0.6, 1.0):
        inputs.write_files(made, source, share=share)
        lw.ingest(spark, source, table, index=True)
    lw.compact(spark, table)
    matches = lw.search_table(spark, table, RARE.upper())
    return matches.select(
        inputs.file_id(F.col("path")).alias("file_id"), "line_number", "value", "level"
    )


def _saved(spark, sf_dir, *search):
    return lw.save_search(lw.search_logs(inputs.parsed_table(spark, sf_dir), *search))


def saved_page(spark, sf_dir) -> DataFrame:
    """A page of a saved search, and one further on."""
    saved = _saved(spark, sf_dir, NEEDLE)
    lines = inputs.parsed_table(spark, sf_dir)
    pages = [saved.page(lines, offset, PAGE[1]) for offset in (PAGE[0], 5 * PAGE[0])]
    return pages[0].union(pages[1]).select("path", "line_number", "value", "match_rank")


def saved_and(spark, sf_dir) -> DataFrame:
    both = _saved(spark, sf_dir, SEARCH[0]) & _saved(spark, sf_dir, "", SEARCH[1])
    found = both.lines(inputs.parsed_table(spark, sf_dir))
    return found.select("path", "line_number", "value")


def saved_combined(spark, sf_dir) -> DataFrame:
    """Matches per file of one search or another, but not of a third."""
    either = _saved(spark, sf_dir, NEEDLE) | _saved(spark, sf_dir, "", "warn")
    return (either - _saved(spark, sf_dir, "7")).matches()


def _span_columns(spans: DataFrame, *more) -> DataFrame:
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return spans.select(
        "path",
        "line_number",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.coalesce(F.try_element_at("spans", F.lit(1)), F.lit(0))
        .cast("bigint")
        .alias("first_span"),
        F.coalesce(F.try_element_at("spans", F.lit(-1)), F.lit(0))
        .cast("bigint")
        .alias("last_span"),
        total.alias("span_sum"),
        *more,
    )


def match_spans(spark, sf_dir) -> DataFrame:
    return _span_columns(
        lw.match_spans(inputs.parsed_table(spark, sf_dir), SPAN_NEEDLE)
    )


def match_spans_documents(spark, sf_dir) -> DataFrame:
    """Spans in whole document texts, thousands to a text."""
    documents = inputs.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"),
        F.lit(1).cast("bigint").alias("line_number"),
        F.col("text").alias("value"),
    )
    return _span_columns(lw.match_spans(documents, SPAN_NEEDLE)).drop("span_sum")


def log_view(spark, sf_dir) -> DataFrame:
    return lw.log_view(inputs.parsed_table(spark, sf_dir))


def search_regex(spark, sf_dir) -> DataFrame:
    matches = lw.search_regex(inputs.parsed_table(spark, sf_dir), REGEX)
    return matches.select("path", "line_number", "value")


def search_terms(spark, sf_dir) -> DataFrame:
    wanted = lw.Has("USER=1") & ~lw.Has("error") | lw.Matches(TERM_REGEX)
    matches = lw.search_terms(inputs.parsed_table(spark, sf_dir), wanted)
    return matches.select("path", "line_number", "value")


def parse_pattern(spark, sf_dir) -> DataFrame:
    lines = inputs.with_odd(spark, sf_dir, "app.log")
    return lw.parse_pattern(lines, USER_PATTERN).select(
        "path", "line_number", "clock", "word", "user"
    )


def similar_lines(spark, sf_dir) -> DataFrame:
    return lw.similar_lines(inputs.parsed_table(spark, sf_dir))


def similar_lines_top(spark, sf_dir) -> DataFrame:
    return lw.similar_lines(inputs.parsed_table(spark, sf_dir), TOP)


def mined_templates(spark, sf_dir) -> DataFrame:
    return lw.mined_templates(inputs.wordy_lines(spark, sf_dir))


def match_spans_regex(spark, sf_dir) -> DataFrame:
    spans = lw.regex_matches(inputs.parsed_table(spark, sf_dir), SPAN_REGEX)
    starts = spans.select(
        "path", "line_number", F.expr("spans.start").alias("spans"), F.expr("spans.length").alias("l")
    )
    chars = F.aggregate("l", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return _span_columns(starts, chars.alias("chars"))


def match_spans_regex_documents(spark, sf_dir) -> DataFrame:
    """Places of an expression in whole document texts, thousands to a text."""
    documents = inputs.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"),
        F.lit(1).cast("bigint").alias("line_number"),
        F.col("text").alias("value"),
    )
    spans = lw.regex_matches(documents, DOCUMENT_REGEX)
    return _span_columns(
        spans.select("path", "line_number", F.expr("spans.start").alias("spans"))
    ).drop("span_sum")


def parse_grok(spark, sf_dir) -> DataFrame:
    """One file by a pattern, the others as ever."""
    parsed = lw.parse_grok(inputs.all_lines(spark, sf_dir), [APP_FORMAT])
    user, props = (F.try_element_at("fields", F.lit(n)).alias(n) for n in ("user", "props"))
    return parsed.select("path", "line_number", "format", "level", "ts_text", user, props)


# --- time ---------------------------------------------------------------------------


def _timed(spark, sf_dir) -> DataFrame:
    return lw.with_event_time(inputs.parsed_table(spark, sf_dir), year=YEAR)


def event_time(spark, sf_dir) -> DataFrame:
    """Every regular and odd line as plain text, with year and date given."""
    parsed = lw.parse_logs(inputs.with_odd(spark, sf_dir, "app.log"), "Plain text")
    timed = lw.with_event_time(parsed, year=YEAR, date=DATE)
    return timed.select(
        "path", "line_number", F.unix_micros("event_time").alias("micros")
    )


def time_range(spark, sf_dir) -> DataFrame:
    return lw.time_range(_timed(spark, sf_dir), *RANGE).select(
        "path", "line_number", F.unix_micros("event_time").alias("micros")
    )


def time_range_filled(spark, sf_dir) -> DataFrame:
    """A range over stored lines, where lines without a stamp have that of the line before."""
    lines = inputs.with_odd(spark, sf_dir, "app.log")
    unstamped = "concat('  at frame ', line_number)"
    lines = lines.withColumn(
        "value", F.expr(f"CASE WHEN line_number % 3 = 2 THEN {unstamped} ELSE value END")
    )
    parsed = lw.parse_logs(lines, "Plain text")
    timed = lw.carry_event_time(lw.with_event_time(parsed, year=YEAR, date=DATE))
    folder = inputs.run_dir(spark, "timed")
    lw.store_timed(timed.select("path", "line_number", "own_time", "event_time"), folder)
    return lw.time_range(lw.read_timed(spark, folder), *RANGE).select(
        "path", "line_number", "own_time", F.unix_micros("event_time").alias("micros")
    )


def event_time_rollover(spark, sf_dir) -> DataFrame:
    """Stamps of two files that leave out the year, over many years."""
    lines = inputs.yearless_lines(spark, sf_dir)
    timed = lw.with_rolling_year(lw.parse_logs(lines), inputs.FIRST_YEAR)
    return timed.select(
        "path", "line_number", F.unix_micros("event_time").alias("micros")
    )


def errors_over_time(spark, sf_dir) -> DataFrame:
    counted = lw.frequency(_timed(spark, sf_dir), "1 hour")
    return counted.withColumn("window_start", F.unix_seconds("window_start"))


# --- counts -------------------------------------------------------------------------


def level_counts(spark, sf_dir) -> DataFrame:
    return lw.level_counts(inputs.parsed_table(spark, sf_dir))


def search_counts(spark, sf_dir) -> DataFrame:
    counts = lw.search_counts(inputs.parsed_table(spark, sf_dir), "1", "error")
    return counts.withColumnRenamed("all", "n_all")


def search_counts_no_query(spark, sf_dir) -> DataFrame:
    counts = lw.search_counts(inputs.parsed_table(spark, sf_dir), "", "error")
    return counts.withColumnRenamed("all", "n_all")


def match_count(spark, sf_dir) -> DataFrame:
    return lw.match_count(inputs.parsed_table(spark, sf_dir), *SEARCH)


# --- positions ------------------------------------------------------------------------


def _matches(spark, sf_dir) -> DataFrame:
    parsed = inputs.parsed_table(spark, sf_dir)
    return lw.search_logs(parsed, NEEDLE).select("path", "line_number", "value")


def match_ranks(spark, sf_dir) -> DataFrame:
    ranked = lw.rank_matches(_matches(spark, sf_dir))
    return ranked.select("path", "line_number", "match_rank")


def nth_match(spark, sf_dir) -> DataFrame:
    found = lw.nth_match(_matches(spark, sf_dir), RANK)
    return found.select("path", "line_number", "value")


def match_page(spark, sf_dir) -> DataFrame:
    page = lw.match_page(_matches(spark, sf_dir), *PAGE)
    return page.select("path", "line_number", "value", "match_rank")


def next_match(spark, sf_dir) -> DataFrame:
    return lw.next_match(_matches(spark, sf_dir), CURRENT)


def prev_match(spark, sf_dir) -> DataFrame:
    return lw.prev_match(_matches(spark, sf_dir), CURRENT)


def next_match_wrapped(spark, sf_dir) -> DataFrame:
    return lw.next_match(_matches(spark, sf_dir), 10**12)


def prev_match_wrapped(spark, sf_dir) -> DataFrame:
    return lw.prev_match(_matches(spark, sf_dir), 1)


def goto_line(spark, sf_dir) -> DataFrame:
    lines = inputs.parsed_table(spark, sf_dir)
    return lw.goto_line(lines, GOTO).select("path", "line_number", "value")


def goto_line_clamped(spark, sf_dir) -> DataFrame:
    lines = inputs.parsed_table(spark, sf_dir)
    return lw.goto_line(lines, 10**12).select("path", "line_number", "value")


# --- streams -----------------------------------------------------------------------------


def _grow_and_follow(spark, sf_dir, run) -> None:
    """Files are written in part, followed, completed, and followed again."""
    source = inputs.run_dir(spark, "growing")
    lines = inputs.segment_lines(spark, sf_dir, "app.log")
    (made,) = inputs.make_files(lines, "true")
    inputs.write_files(made, source, share=0.6)
    paths = inputs.file_paths(spark, source)
    run(lw.follow(spark, paths))
    inputs.write_files(made, source)
    run(lw.follow(spark, paths))


def follow_parse(spark, sf_dir) -> DataFrame:
    out, checkpoint = (inputs.run_dir(spark, p) for p in ("out", "checkpoint"))
    _grow_and_follow(
        spark, sf_dir, lambda s: sinks.append_available(s, out, checkpoint)
    )
    return spark.read.parquet(out).select(
        inputs.file_id(F.col("path")).alias("file_id"),
        "byte_offset",
        "value",
        "format",
        "level",
        "ts_text",
    )


def follow_filter(spark, sf_dir) -> DataFrame:
    out, checkpoint = (inputs.run_dir(spark, p) for p in ("out", "checkpoint"))
    _grow_and_follow(
        spark,
        sf_dir,
        lambda s: sinks.append_available(
            lw.search_logs(s, *SEARCH), out, checkpoint
        ),
    )
    return spark.read.parquet(out).select(
        inputs.file_id(F.col("path")).alias("file_id"), "byte_offset", "value"
    )


def _follow_two(spark, paths, first, second) -> DataFrame:
    """What a followed stream yields of two states of some files, one after the other."""
    out, checkpoint = (inputs.run_dir(spark, p) for p in ("out", "checkpoint"))
    for write in (first, second):
        write()
        sinks.append_available(lw.follow(spark, paths()), out, checkpoint)
    return spark.read.parquet(out).select(
        inputs.file_id(F.col("path")).alias("file_id"),
        "byte_offset",
        "value",
        "format",
        "level",
        "ts_text",
    )


def follow_unfinished(spark, sf_dir) -> DataFrame:
    """Files of all formats that end within a line: that line isn't there yet."""
    source = inputs.run_dir(spark, "growing")
    (made,) = inputs.make_files(_segments(spark, sf_dir), "true")
    return _follow_two(
        spark,
        lambda: inputs.file_paths(spark, source),
        lambda: inputs.write_files(made, source, share=0.3),
        lambda: inputs.write_files(made, source, share=UNFINISHED),
    )


def follow_rotated(spark, sf_dir) -> DataFrame:
    """Files that are replaced by smaller ones: the lines of both are there."""
    source = inputs.run_dir(spark, "growing")
    third, made = inputs.make_files(_segments(spark, sf_dir), "position % 3 = 0", "true")
    return _follow_two(
        spark,
        lambda: inputs.file_paths(spark, source),
        lambda: inputs.write_files(made, source),
        lambda: inputs.write_files(third, source),
    )


def follow_replaced_larger(spark, sf_dir) -> DataFrame:
    """Files that are replaced by larger ones: the lines of both are there."""
    source = inputs.run_dir(spark, "growing")
    third, made = inputs.make_files(_segments(spark, sf_dir), "position % 3 = 1", "true")
    return _follow_two(
        spark,
        lambda: inputs.file_paths(spark, source),
        lambda: inputs.write_files(third, source),
        lambda: inputs.write_files(made, source),
    )


def follow_folder(spark, sf_dir) -> DataFrame:
    """A folder in bounded batches, with a restart between; files grow and join meanwhile."""
    source, state, out, checkpoint = (
        inputs.run_dir(spark, p) for p in ("growing", "state", "out", "checkpoint")
    )
    (made,) = inputs.make_files(_segments(spark, sf_dir), "true")

    def stream() -> DataFrame:
        there = lw.list_files(spark, source).agg(F.sum("file_size")).first()[0]
        return lw.follow_folder(spark, source, state, batch_bytes=1 + there // BATCHES)

    inputs.write_files(made.filter("file NOT LIKE 'svc%'"), source, share=0.6)
    sinks.append_available(stream(), out, checkpoint)
    inputs.write_files(made, source)
    sinks.append_until_idle(stream(), out, checkpoint)
    return spark.read.parquet(out).select(
        inputs.file_id(F.col("path")).alias("file_id"),
        "byte_offset",
        "value",
        "format",
        "level",
        "ts_text",
    )


def follow_level_counts(spark, sf_dir) -> DataFrame:
    out, checkpoint = (inputs.run_dir(spark, p) for p in ("out", "checkpoint"))
    _grow_and_follow(
        spark,
        sf_dir,
        lambda s: sinks.refresh_available(
            lw.live_level_counts(s), out, checkpoint
        ),
    )
    return sinks.read_totals(spark, out).select(
        inputs.file_id(F.col("path")).alias("file_id"), "level", "n"
    )


def follow_search_counts(spark, sf_dir) -> DataFrame:
    out, checkpoint = (inputs.run_dir(spark, p) for p in ("out", "checkpoint"))
    _grow_and_follow(
        spark,
        sf_dir,
        lambda s: sinks.refresh_available(
            lw.live_search_counts(s, "1").withColumnRenamed("all", "n_all"), out, checkpoint
        ),
    )
    return sinks.read_totals(spark, out).select(
        inputs.file_id(F.col("path")).alias("file_id"), "n_all", *COUNTED_LEVELS
    )


def follow_errors_over_time(spark, sf_dir) -> DataFrame:
    out, checkpoint = (inputs.run_dir(spark, p) for p in ("out", "checkpoint"))

    def run(stream: DataFrame) -> None:
        counted = lw.frequency(lw.with_event_time(stream), "1 hour", late="1 day")
        sinks.refresh_available(counted, out, checkpoint)

    _grow_and_follow(spark, sf_dir, run)
    return sinks.read_totals(spark, out).select(
        inputs.file_id(F.col("path")).alias("file_id"),
        F.unix_seconds("window_start").alias("window_start"),
        "level",
        "n",
    )


def stream_segments(spark, sf_dir) -> DataFrame:
    source, out, checkpoint = (
        inputs.run_dir(spark, p) for p in ("segments", "out", "checkpoint")
    )
    for path, format in (("app.log", "Plain text"), ("svc.jsonl", "Plain text")):
        inputs.write_files(inputs.segment_lines(spark, sf_dir, path), source)
        stream = lw.follow_segments(spark, source, format)
        sinks.append_available(stream, out, checkpoint)
    return spark.read.parquet(out).select(
        inputs.file_id(F.col("path")).alias("file_id"), "value", "level", "ts_text"
    )


QUERIES = {
    "scan_lines": scan_lines,
    "scan_nested": scan_nested,
    "scan_invalid": scan_invalid,
    "line_numbers": line_numbers,
    "export_filtered": export_filtered,
    "ingest_manifest": ingest_manifest,
    "ingest_refresh": ingest_refresh,
    "ingest_append": ingest_append,
    "ingest_compacted": ingest_compacted,
    "ingest_after_crash": ingest_after_crash,
    "stale_files": stale_files,
    "file_summary": file_summary,
    "detect_format": detect_format,
    "detect_format_first_lines": detect_format_first_lines,
    "parse_logs": parse_logs,
    "parse_without_first_line": parse_without_first_line,
    "parse_fixed_format": parse_fixed_format,
    "ts_plain": _timestamps("app.log", plain_timestamp),
    "ts_logcat": _timestamps("device.log", logcat_timestamp),
    "ts_syslog": _timestamps("sys.txt", syslog_timestamp),
    "ts_json": _timestamps("svc.jsonl", json_timestamp),
    "level_keyword": _levels("app.log", keyword_level),
    "level_keyword_documents": level_keyword_documents,
    "level_syslog": _levels("sys.txt", syslog_level),
    "level_logcat": _levels("device.log", logcat_level),
    "level_json": level_json,
    "level_code": level_codes,
    "syslog_message": syslog_messages,
    "json_string_field": json_string_field,
    "json_number_field": json_number_field,
    "filter_level": filter_level,
    "search_substring": search_substring,
    "search_and_level": search_and_level,
    "search_documents": search_documents,
    "search_indexed": search_indexed,
    "search_table": search_table,
    "saved_page": saved_page,
    "saved_and": saved_and,
    "saved_combined": saved_combined,
    "search_regex": search_regex,
    "search_terms": search_terms,
    "parse_pattern": parse_pattern,
    "parse_grok": parse_grok,
    "similar_lines": similar_lines,
    "mined_templates": mined_templates,
    "similar_lines_top": similar_lines_top,
    "event_time": event_time,
    "time_range": time_range,
    "time_range_filled": time_range_filled,
    "event_time_rollover": event_time_rollover,
    "errors_over_time": errors_over_time,
    "match_spans": match_spans,
    "match_spans_documents": match_spans_documents,
    "match_spans_regex": match_spans_regex,
    "match_spans_regex_documents": match_spans_regex_documents,
    "log_view": log_view,
    "level_counts": level_counts,
    "search_counts": search_counts,
    "search_counts_no_query": search_counts_no_query,
    "match_count": match_count,
    "match_ranks": match_ranks,
    "nth_match": nth_match,
    "match_page": match_page,
    "next_match": next_match,
    "prev_match": prev_match,
    "next_match_wrapped": next_match_wrapped,
    "prev_match_wrapped": prev_match_wrapped,
    "goto_line": goto_line,
    "goto_line_clamped": goto_line_clamped,
    "follow_parse": follow_parse,
    "follow_filter": follow_filter,
    "follow_unfinished": follow_unfinished,
    "follow_rotated": follow_rotated,
    "follow_replaced_larger": follow_replaced_larger,
    "follow_folder": follow_folder,
    "follow_level_counts": follow_level_counts,
    "follow_search_counts": follow_search_counts,
    "follow_errors_over_time": follow_errors_over_time,
    "stream_segments": stream_segments,
}
