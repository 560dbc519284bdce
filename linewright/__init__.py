"""Log files as Spark tables and streams: scan, detect, parse, search, follow."""

from .operators.carried import carry_event_time, with_rolling_year
from .operators.export import export_lines
from .operators.grams import gram_index, search_indexed
from .operators.grok import GrokFormat, parse_grok
from .operators.mining import mined_templates
from .operators.parse import detect_formats, parse_logs
from .operators.positions import (
    goto_line,
    match_page,
    next_match,
    nth_match,
    prev_match,
    rank_matches,
)
from .operators.saved import SavedSearch, save_search
from .operators.search import (
    live_search_counts,
    log_view,
    match_count,
    match_spans,
    search_counts,
    search_logs,
)
from .operators.stats import file_summary, level_counts, line_counts
from .operators.templates import parse_pattern, similar_lines
from .operators.terms import (
    Has,
    Matches,
    regex_matches,
    search_regex,
    search_terms,
    term_spans,
)
from .operators.timeline import (
    frequency,
    read_timed,
    store_timed,
    time_range,
    with_event_time,
)
from .plans.compact import compact, snapshot
from .plans.ingest import (
    index_table,
    ingest,
    read_manifest,
    read_parsed,
    search_table,
    stale_files,
)
from .session import scratch
from .sources.listing import list_files
from .sources.text_lines import number_lines, read_log_lines, scan_lines
from .streaming.follow import (
    follow,
    follow_folder,
    follow_segments,
    live_level_counts,
    tail_lines,
)

__all__ = [
    "GrokFormat",
    "Has",
    "Matches",
    "SavedSearch",
    "carry_event_time",
    "compact",
    "detect_formats",
    "export_lines",
    "file_summary",
    "follow",
    "follow_folder",
    "follow_segments",
    "frequency",
    "goto_line",
    "gram_index",
    "index_table",
    "ingest",
    "level_counts",
    "line_counts",
    "list_files",
    "live_level_counts",
    "live_search_counts",
    "log_view",
    "match_count",
    "match_page",
    "match_spans",
    "mined_templates",
    "next_match",
    "nth_match",
    "number_lines",
    "parse_grok",
    "parse_logs",
    "parse_pattern",
    "prev_match",
    "rank_matches",
    "read_log_lines",
    "read_manifest",
    "read_parsed",
    "read_timed",
    "regex_matches",
    "save_search",
    "scan_lines",
    "scratch",
    "search_counts",
    "search_indexed",
    "search_logs",
    "search_regex",
    "search_table",
    "search_terms",
    "similar_lines",
    "snapshot",
    "stale_files",
    "store_timed",
    "tail_lines",
    "term_spans",
    "time_range",
    "with_event_time",
    "with_rolling_year",
]
