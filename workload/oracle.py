"""The same results as SQL for DuckDB, from the tables and its own patterns.

DuckDB's engine (RE2) has neither look-ahead nor possessive quantifiers, so the
SQL goes another way than the Spark expressions: trim, take the token, test the
character after it.
"""

from __future__ import annotations

from linewright.operators.mining import MAX_WORDS, VARIES

from . import inputs, queries, shapes

# The patterns in RE2 form.
WS = r"[\p{Z}\t\n\x0B\f\r\x{85}]"
NWS = r"[^\p{Z}\t\n\x0B\f\r\x{85}]"
HMS = "[0-9]{2}:[0-9]{2}:[0-9]{2}"
DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
ASCII_END = r"(?:[ \t\n\f\r]|\z)"
T1 = rf"{DATE}T{HMS}(?:\.[0-9]+)?(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})?"
T2 = rf"{DATE} {HMS}(?:\.[0-9]+)?"
T3 = rf"{MON} (?:[0-9][0-9]|[0-9]| [\x00-\x7F]?[0-9]) {HMS}"
T4 = rf"{HMS}(?:\.[0-9]+)?"
T6 = rf"^[0-9]{{2}}-[0-9]{{2}} {HMS}\.[0-9]{{3}}{ASCII_END}"
T7A = rf"^{MON} [0-9]{{2}} {HMS}{ASCII_END}"
T7B = rf"^{MON}  [0-9] {HMS}[ \t\n\f\r]"
L5 = rf"^{WS}*{NWS}+{WS}+{NWS}+{WS}+([VDIWEF])(?:{WS}|\z)"
STRING = r'(?s)^"([^"\\]*(?:\\.[^"\\]*)*)"'


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(names: dict, other: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in names.items())
    return f"CASE event_type {whens} ELSE {lit(other)} END"


FIELDS = {
    "d": "strftime(ts,'%Y-%m-%d')",
    "t": "strftime(ts,'%H:%M:%S')",
    "f": "strftime(ts,'%g')",
    "m": "strftime(ts,'%b')",
    "dd": "strftime(ts,'%d')",
    "md": "strftime(ts,'%m-%d')",
    "u": "user_id::VARCHAR",
    "one": "(user_id % 10)::VARCHAR",
    "h": "(user_id % 7)::VARCHAR",
    "id": "event_id::VARCHAR",
    "type": "event_type",
    "lvl": _case(shapes.LEVEL_WORDS, shapes.OTHER_WORD),
    "mark": _case(shapes.LETTERS, shapes.OTHER_LETTER),
    "props": "props",
}


def _line(shape: str) -> str:
    parts = [
        FIELDS[text] if kind == "field" else lit(text)
        for kind, text in shapes.pieces(shape)
    ]
    return " || ".join(parts) or "''"


def file_lines(path: str) -> str:
    return (
        f"SELECT {lit(path)} AS path, event_id + 1 AS line_number, "
        f"{_line(shapes.FILES[path])} AS value FROM events"
    )


def all_lines() -> str:
    return " UNION ALL ".join(file_lines(path) for path in shapes.FILES)


def odd_lines() -> str:
    whens = " ".join(
        f"WHEN {i} THEN {_line(shape)}" for i, shape in enumerate(shapes.ODD_SHAPES)
    )
    return (
        "SELECT 'odd.log' AS path, event_id + 1 AS line_number, "
        f"CASE event_id % {len(shapes.ODD_SHAPES)} {whens} END AS value FROM events"
    )


def with_odd(path: str) -> str:
    return f"{file_lines(path)} UNION ALL {odd_lines()}"


# --- expressions over a column ``value`` and its trimmed form ``s`` ---------------

TRIM = f"regexp_replace(value, {lit('^' + WS + '+')}, '')"


def _token(pattern: str) -> str:
    token = f"regexp_extract(s, {lit('^(' + pattern + ')')}, 1)"
    after = f"regexp_matches(substr(s, length({token}) + 1, 1), '^[0-9A-Za-z]')"
    return f"CASE WHEN {token} <> '' AND NOT {after} THEN {token} END"


TS_PLAIN = (
    f"coalesce({_token(T1)}, {_token(T2)}, "
    f"CASE WHEN octet_length(encode(s)) >= 15 THEN {_token(T3)} END, {_token(T4)})"
)
TS_LOGCAT = f"CASE WHEN regexp_matches(s, {lit(T6)}) THEN substr(s, 1, 18) END"
TS_SYSLOG = (
    f"CASE WHEN regexp_matches(s, {lit(T7A)}) OR regexp_matches(s, {lit(T7B)}) "
    "THEN substr(s, 1, 15) END"
)


def _tail(key: str) -> str:
    pattern = rf'(?s)[{{,][ \t]*"{key}"[^:]*:[ \t]*([^ \t].*)\z'
    return f"regexp_extract(s, {lit(pattern)}, 1)"


def json_string(key: str) -> str:
    tail = _tail(key)
    return (
        f"CASE WHEN regexp_matches({tail}, {lit(STRING)}) "
        f"THEN regexp_extract({tail}, {lit(STRING)}, 1) END"
    )


def json_number(key: str) -> str:
    digits = f"regexp_extract({_tail(key)}, '^([0-9]+)', 1)"
    number = f"try_cast({digits} AS HUGEINT)"
    return (
        f"CASE WHEN {digits} <> '' AND {number} <= 18446744073709551615 "
        f"THEN {number}::VARCHAR END"
    )


IS_OBJECT = "starts_with(s, '{')"
TS_JSON = (
    f"CASE WHEN {IS_OBJECT} THEN nullif(coalesce("
    + ", ".join(json_string(k) for k in ("timestamp", "time", "ts", "@timestamp"))
    + "), '') END"
)


def keyword(text: str, other: str = "'unknown'") -> str:
    low = f"lower({text})"
    words = ("error", "warn", "info", "debug", "trace")
    whens = " ".join(f"WHEN contains({low}, {lit(w)}) THEN {lit(w)}" for w in words)
    return f"CASE {whens} ELSE {other} END"


_AFTER = f"regexp_replace(substr(s, 16), {lit('^' + WS + '+')}, '')"
MESSAGE = (
    f"CASE WHEN ({TS_SYSLOG}) IS NOT NULL AND instr({_AFTER}, ': ') > 0 THEN "
    f"regexp_replace(substr({_AFTER}, instr({_AFTER}, ': ') + 2), "
    f"{lit('^' + WS + '+')}, '') END"
)
LEVEL_PLAIN = keyword("value")
LEVEL_SYSLOG = keyword(f"coalesce({MESSAGE}, '')", f"({keyword('value')})")
LEVEL_LOGCAT = (
    f"CASE WHEN ({TS_LOGCAT}) IS NULL THEN 'unknown' ELSE "
    f"CASE regexp_extract(substr(s, 19), {lit(L5)}, 1) "
    "WHEN 'V' THEN 'trace' WHEN 'D' THEN 'debug' WHEN 'I' THEN 'info' "
    "WHEN 'W' THEN 'warn' WHEN 'E' THEN 'error' WHEN 'F' THEN 'error' "
    "ELSE 'unknown' END END"
)
LEVEL_VALUE = (
    f"CASE WHEN {IS_OBJECT} THEN coalesce("
    + ", ".join(
        f"{json_string(k)}, {json_number(k)}" for k in ("level", "severity", "lvl")
    )
    + ") END"
)


def _value_level(text: str) -> str:
    trimmed = (
        f"regexp_replace(regexp_replace({text}, {lit('^' + WS + '+')}, ''), "
        f"{lit(WS + '+' + chr(92) + 'z')}, '')"
    )
    number = (
        f"CASE WHEN regexp_matches({trimmed}, '^[+]?[0-9]+$') "
        f"THEN try_cast(ltrim({trimmed}, '+') AS HUGEINT) END"
    )
    words = [
        ("error", "error"),
        ("fatal", "error"),
        ("crit", "error"),
        ("warn", "warn"),
        ("info", "info"),
        ("debug", "debug"),
        ("trace", "trace"),
        ("verbose", "trace"),
    ]
    whens = " ".join(
        f"WHEN contains(lower({text}), {lit(w)}) THEN {lit(n)}" for w, n in words
    )
    return (
        f"CASE WHEN {text} IS NULL THEN 'unknown' "
        f"WHEN ({number}) > 4294967295 THEN 'unknown' WHEN ({number}) >= 60 THEN 'error' "
        f"WHEN ({number}) >= 50 THEN 'warn' WHEN ({number}) >= 40 THEN 'info' "
        f"WHEN ({number}) >= 30 THEN 'debug' WHEN ({number}) >= 0 THEN 'trace' "
        f"{whens} ELSE 'unknown' END"
    )


def with_trim(lines: str) -> str:
    return f"WITH t AS (SELECT *, {TRIM} AS s FROM ({lines}))"


def over(lines: str, columns: str) -> str:
    return f"{with_trim(lines)} SELECT {columns} FROM t"


FORMAT = (
    "CASE WHEN regexp_matches(lower(path), '[^/][.](json|jsonl|ndjson)$') THEN 'JSON' "
    f"WHEN starts_with(s, '--------- beginning') OR ({TS_LOGCAT}) IS NOT NULL "
    f"THEN 'Logcat' WHEN ({TS_SYSLOG}) IS NOT NULL THEN 'Syslog' "
    "WHEN starts_with(s, '{') OR starts_with(s, '[') THEN 'JSON' ELSE 'Plain text' END"
)


def parsed(
    lines: str, keep: str = "path, line_number, value", formats: str | None = None
) -> str:
    """Parsed lines as a query; the format of the first line holds for the file."""
    if formats is None:
        formats = f"SELECT path, {FORMAT} AS format FROM t WHERE line_number = 1"
    return (
        f"WITH t AS (SELECT *, {TRIM} AS s FROM ({lines})), "
        f"f AS ({formats}), "
        f"j AS (SELECT t.*, f.format, {LEVEL_VALUE} AS jv FROM t JOIN f USING (path)) "
        f"SELECT {keep}, format, CASE format WHEN 'Logcat' THEN {LEVEL_LOGCAT} "
        f"WHEN 'Syslog' THEN {LEVEL_SYSLOG} WHEN 'JSON' THEN {_value_level('jv')} "
        f"ELSE {LEVEL_PLAIN} END AS level, "
        f"CASE format WHEN 'Logcat' THEN {TS_LOGCAT} WHEN 'Syslog' THEN {TS_SYSLOG} "
        f"WHEN 'JSON' THEN {TS_JSON} ELSE {TS_PLAIN} END AS ts_text FROM j"
    )


PARSED = parsed(all_lines())


def found(query: str = "", level: str | None = None) -> str:
    tests = [f"contains(lower(value), {lit(query.lower())})"] if query else []
    tests += [f"level = {lit(level)}"] if level else []
    return " AND ".join(tests) or "true"


MATCHES = f"SELECT * FROM ({PARSED}) WHERE {found(queries.NEEDLE)}"

_LINES = (
    "SELECT doc_id, unnest(string_split(text, chr(10))) AS value, "
    "unnest(range(len(string_split(text, chr(10))))) AS k FROM documents"
)
_FILE = f"(doc_id // {inputs.SEGMENT_DOCS})::VARCHAR"

_STEM = "regexp_replace(path, '[.].*', '')"
_PART = f"((line_number - 1) // {inputs.SEGMENT_EVENTS})::VARCHAR"
_SEGMENT = f"{_STEM} || '-' || {_PART}"


def segment(lines: str) -> str:
    """Lines by segment file, numbered within it and with their byte offset."""
    return (
        f"SELECT {_SEGMENT} AS path, {_SEGMENT} AS file_id, value, "
        f"row_number() OVER (PARTITION BY {_SEGMENT} ORDER BY line_number) AS line_number, "
        "(coalesce(sum(octet_length(encode(value)) + 1) OVER "
        f"(PARTITION BY {_SEGMENT} ORDER BY line_number "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS byte_offset "
        f"FROM ({lines})"
    )


SEGMENTS = parsed(
    segment(all_lines()), "path, line_number, value, file_id, byte_offset"
)
APP_SEGMENTS = parsed(
    segment(file_lines("app.log")), "path, line_number, value, file_id, byte_offset"
)

_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE hit AND level = {lit(n)}) AS {n}"
    for n in ("error", "warn", "info", "debug")
)


def counts(condition: str) -> str:
    return (
        f"SELECT path, count(*) FILTER (WHERE hit) AS n_all, {_COUNTS} FROM "
        f"(SELECT path, level, {condition} AS hit FROM ({PARSED})) GROUP BY path"
    )


def spans(lines: str, needle: str, extra: str = "") -> str:
    n = len(needle)
    low = "lower(value)"
    pieces = f"(length({low}) - length(replace({low}, {lit(needle)}, ''))) // {n}"
    back = f"instr(reverse({low}), {lit(needle[::-1])})"
    return (
        f"SELECT path, line_number, ({pieces})::BIGINT AS n_spans, "
        f"instr({low}, {lit(needle)})::BIGINT AS first_span, "
        f"(CASE WHEN {back} = 0 THEN 0 ELSE length({low}) - {back} - {n - 2} END)::BIGINT "
        f"AS last_span{extra} FROM ({lines})"
    )


_SPAN_SUM = (
    ", coalesce(list_sum(list_filter(range(1, length(value) + 1), lambda x: "
    f"substr(lower(value), x, {len(queries.SPAN_NEEDLE)}) = {lit(queries.SPAN_NEEDLE)}"
    ")), 0)::BIGINT AS span_sum"
)


def step(direction: str, current: int) -> str:
    low, sign = ("min", ">") if direction == "next" else ("max", "<")
    return (
        f"WITH m AS ({MATCHES}) SELECT path, line_number, value FROM m "
        "WHERE (path, line_number) IN (SELECT (path, coalesce("
        f"{low}(line_number) FILTER (WHERE line_number {sign} {current}), "
        f"{low}(line_number))) FROM m GROUP BY path)"
    )


def goto(number: int) -> str:
    return (
        f"WITH p AS ({all_lines()}) SELECT path, line_number, value FROM p JOIN "
        "(SELECT path, count(*) AS n FROM p GROUP BY path) USING (path) "
        f"WHERE line_number = greatest(1, least({number}, n))"
    )


RANKED = (
    "SELECT path, line_number, value, "
    "row_number() OVER (PARTITION BY path ORDER BY line_number) AS match_rank "
    f"FROM ({MATCHES})"
)

# The instant of a timestamp text, by shape; DuckDB parses, what is out of range is null.
_WHOLE = rf"^{DATE}[T ]{HMS}([.][0-9]+)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})?$"


def micros(stamp: str, year: int, date: str | None) -> str:
    month = f"strptime(substr({stamp}, 1, 3) || ' 2000', '%b %Y')"
    day = f"lpad(regexp_extract({stamp}, '^[A-Z][a-z]{{2}} *[^0-9 ]?([0-9]{{1,2}}) ', 1), 2, '0')"
    clock = f"regexp_extract({stamp}, ' ({HMS})$', 1)"
    full = (
        f"CASE WHEN regexp_matches({stamp}, '^[0-9]{{4}}-') THEN {stamp} "
        f"WHEN regexp_matches({stamp}, '^[0-9]{{2}}-') THEN '{year}-' || {stamp} "
        f"WHEN regexp_matches({stamp}, '^{MON}') THEN '{year}-' || "
        f"strftime({month}, '%m') || '-' || {day} || ' ' || {clock} "
    )
    if date is not None:
        full += f"WHEN regexp_matches({stamp}, '^[0-9]{{2}}:') THEN '{date} ' || {stamp} "
    full += "END"
    local = f"regexp_replace({full}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', '')".replace("{{2}}", "{2}")
    zone = rf"regexp_extract({full}, '([+-][0-9]{{2}}:[0-9]{{2}})$', 1)"
    minutes = (
        f"CASE WHEN {zone} = '' THEN 0 ELSE (CASE WHEN {zone}[1] = '-' THEN -1 ELSE 1 END) "
        f"* (substr({zone}, 2, 2)::INT * 60 + substr({zone}, 5, 2)::INT) END"
    )
    return (
        f"CASE WHEN regexp_matches({full}, '{_WHOLE}') THEN "
        f"epoch_us(try_cast({local} AS TIMESTAMP)) - ({minutes})::BIGINT * 60000000 END"
    )


TIMED = (
    f"SELECT path, line_number, level, {micros('ts_text', queries.YEAR, None)} AS micros "
    f"FROM ({PARSED})"
)


UNSTAMPED = (
    "SELECT path, line_number, CASE WHEN line_number % 3 = 2 "
    "THEN '  at frame ' || line_number ELSE value END AS value "
    f"FROM ({with_odd('app.log')})"
)


def masked(value: str) -> str:
    for pattern, mark in MASKS:
        value = f"regexp_replace({value}, {lit(pattern)}, {lit(mark)}, 'g')"
    return value


# What varies between lines of one kind.
MASKS = (('"[^"]*"', '"*"'), ("'[^']*'", "'*'"), ("0x[0-9A-Fa-f]+", "#"), ("[0-9]+", "#"))
KINDS = (
    f"SELECT template, count(*) AS n, min(struct_pack(path, line_number, value)) AS e FROM "
    f"(SELECT *, {masked('value')} AS template FROM ({PARSED})) GROUP BY template"
)
_KIND = "template, n, e.path AS path, e.line_number AS line_number, e.value AS value"

_FOLLOWED = "file_id, byte_offset, value, format, level, ts_text"
_offset, _limit = queries.PAGE
_key = "path, line_number, "

def _wordy() -> str:
    value = f"[{', '.join(map(lit, inputs.WORDY))}][doc_id % {len(inputs.WORDY)} + 1]"
    for n in (1, 2, 3):
        value = f"replace({value}, '<{n}>', split_part(text, ' ', {n}))"
    for name in ("source", "lang"):
        value = f"replace({value}, '<{name}>', coalesce({name}, ''))"
    return f"SELECT 'words.log' AS path, doc_id + 1 AS line_number, {value} AS value FROM documents"


def _mined(places: int) -> str:
    """The tree of words, place by place, as one query after the other."""
    steps = []
    for p in range(places):
        steps.append(
            f"w{p} AS (SELECT size, words[1:{p}] AS prefix, words[{p + 1}] AS word, "
            f"sum(n) AS m FROM k{p} WHERE size > {p} GROUP BY ALL), "
            f"v{p} AS (SELECT size, prefix, word FROM w{p} QUALIFY "
            f"count(*) OVER (PARTITION BY size, prefix) > {MAX_WORDS} AND "
            f"m * {MAX_WORDS} < sum(m) OVER (PARTITION BY size, prefix)), "
            f"k{p + 1} AS (SELECT k.size, CASE WHEN v.size IS NULL THEN words ELSE "
            f"words[1:{p}] || ['{VARIES}'] || words[{p + 2}:] END AS words, "
            f"sum(n) AS n, min(e) AS e FROM k{p} k LEFT JOIN v{p} v ON k.size = v.size "
            f"AND words[1:{p}] = v.prefix AND words[{p + 1}] = v.word GROUP BY ALL)"
        )
    return (
        f"WITH l AS ({_wordy()}), k0 AS (SELECT len(words) AS size, words, count(*) AS n, "
        "min(struct_pack(path, line_number)) AS e FROM (SELECT *, "
        f"string_split({masked('value')}, ' ') AS words FROM l) GROUP BY ALL), "
        + ", ".join(steps)
        + " SELECT array_to_string(words, ' ') AS template, n::BIGINT AS n, l.path, "
        f"l.line_number, l.value FROM k{places} JOIN l "
        "ON l.path = e.path AND l.line_number = e.line_number"
    )


def regex_spans(lines: str, pattern: str, extra: bool) -> str:
    m, g = f"regexp_extract_all(value, {lit(pattern)})", f"string_split_regex(value, {lit(pattern)})"
    length = "list_sum(list_transform({}, lambda x: length(x)))".format
    before = "1 + {} + coalesce({}, 0)".format
    last = before(length("g[1:len(m)]"), length("m[1:len(m) - 1]"))
    each = before(length("g[1:i]"), length("m[1:i - 1]"))
    more = (
        f", coalesce(list_sum(list_transform(range(1, len(m) + 1), lambda i: {each})), 0)::BIGINT "
        f"AS span_sum, coalesce({length('m')}, 0)::BIGINT AS chars"
    )
    return (
        "SELECT path, line_number, len(m)::BIGINT AS n_spans, "
        "(CASE WHEN len(m) = 0 THEN 0 ELSE length(g[1]) + 1 END)::BIGINT AS first_span, "
        f"(CASE WHEN len(m) = 0 THEN 0 ELSE {last} END)::BIGINT AS last_span"
        f"{more if extra else ''} FROM (SELECT path, line_number, {m} AS m, {g} AS g FROM ({lines}))"
    )


_APP = r"^([0-9-]{10}[T ][0-9:.]+) (\w+) user=([0-9]+) (.*)"


def _grok_field(n: int) -> str:
    return f"regexp_extract(value, {lit(_APP)}, {n})"


ORACLE = {
    "scan_lines": f"SELECT {_FILE} AS file_id, value FROM ({_LINES})",
    "scan_nested": f"SELECT {_FILE} AS file_id, value FROM ({_LINES})",
    "scan_invalid": (
        f"SELECT {_FILE} AS file_id, CASE WHEN contains(value, chr(233)) THEN '' "
        f"ELSE value END AS value FROM ({_LINES})"
    ),
    "line_numbers": (
        f"SELECT {_FILE} AS file_id, row_number() OVER "
        f"(PARTITION BY {_FILE} ORDER BY doc_id, k) AS line_number, value "
        f"FROM ({_LINES})"
    ),
    "export_filtered": (
        "SELECT row_number() OVER (ORDER BY path, line_number) AS export_line, value "
        f"FROM ({PARSED}) WHERE level = 'error'"
    ),
    "ingest_manifest": (
        "SELECT file_id, sum(octet_length(encode(value)) + 1)::BIGINT AS file_size, "
        f"format, count(*) AS line_count FROM ({SEGMENTS}) GROUP BY file_id, format"
    ),
    "ingest_refresh": (
        "SELECT file_id, line_number, value, format, level, ts_text "
        f"FROM ({SEGMENTS})"
    ),
    "ingest_append": (
        f"WITH s AS (SELECT *, byte_offset + octet_length(encode(value)) + 1 AS stop "
        f"FROM ({SEGMENTS})), n AS (SELECT file_id, max(stop) AS n FROM s GROUP BY file_id) "
        "SELECT file_id, (CASE "
        + " ".join(
            f"WHEN stop <= floor(n * {share}) THEN {i}"
            for i, share in enumerate(queries.GROWTH)
        )
        + " END)::BIGINT AS taken_in, line_number, value, format, level, ts_text "
        "FROM s JOIN n USING (file_id)"
    ),
    "ingest_compacted": (
        "SELECT file_id, line_number, value, format, level, ts_text "
        f"FROM ({SEGMENTS})"
    ),
    "ingest_after_crash": (
        "SELECT file_id, line_number, value, format, level, ts_text "
        f"FROM ({SEGMENTS})"
    ),
    "stale_files": (
        "WITH l AS (SELECT doc_id AS path_id, "
        "n_chars + CASE WHEN doc_id % 7 = 3 THEN 1 ELSE 0 END AS file_size, "
        "doc_id * 10 + CASE WHEN doc_id % 11 = 5 THEN 1 ELSE 0 END AS mtime_secs "
        "FROM documents) SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM documents d "
        "WHERE d.doc_id % 5 <> 4 AND d.doc_id = l.path_id AND d.n_chars = l.file_size "
        "AND d.doc_id * 10 = l.mtime_secs)"
    ),
    "file_summary": (
        "SELECT path, format, count(*) AS line_count, "
        "sum(octet_length(encode(value)) + 1)::BIGINT AS file_size, "
        "round(sum(octet_length(encode(value)) + 1) / 1e9, 1) AS size_gb "
        f"FROM ({PARSED}) GROUP BY path, format"
    ),
    "detect_format": (
        f"{with_trim(all_lines())} SELECT path, {FORMAT} AS format FROM t "
        "WHERE line_number = 1"
    ),
    "detect_format_first_lines": over(
        "SELECT 'f' || line_number || CASE WHEN line_number % 3 = 0 THEN '.JSONL' "
        f"ELSE '.log' END AS path, value FROM ({odd_lines()})",
        f"path, {FORMAT} AS format",
    ),
    "parse_logs": f"SELECT {_key}format, level, ts_text FROM ({PARSED})",
    "parse_without_first_line": (
        f"SELECT {_key}format, level, ts_text FROM ("
        + parsed(
            f"SELECT * FROM ({all_lines()}) WHERE line_number > 1",
            formats="SELECT DISTINCT path, CASE WHEN regexp_matches(lower(path), "
            "'[^/][.](json|jsonl|ndjson)$') THEN 'JSON' ELSE 'Plain text' END AS format "
            "FROM t",
        )
        + ")"
    ),
    "parse_fixed_format": over(
        with_odd("svc.jsonl"),
        f"{_key}'Plain text' AS format, {LEVEL_PLAIN} AS level, {TS_PLAIN} AS ts_text",
    ),
    "ts_plain": over(with_odd("app.log"), f"{_key}{TS_PLAIN} AS ts_text"),
    "ts_logcat": over(with_odd("device.log"), f"{_key}{TS_LOGCAT} AS ts_text"),
    "ts_syslog": over(with_odd("sys.txt"), f"{_key}{TS_SYSLOG} AS ts_text"),
    "ts_json": over(with_odd("svc.jsonl"), f"{_key}{TS_JSON} AS ts_text"),
    "level_keyword": over(with_odd("app.log"), f"{_key}{LEVEL_PLAIN} AS level"),
    "level_keyword_documents": (
        f"SELECT doc_id, {keyword('text')} AS level FROM documents"
    ),
    "level_syslog": over(with_odd("sys.txt"), f"{_key}{LEVEL_SYSLOG} AS level"),
    "level_logcat": over(with_odd("device.log"), f"{_key}{LEVEL_LOGCAT} AS level"),
    "level_json": (
        f"{with_trim(with_odd('svc.jsonl'))}, j AS (SELECT *, {LEVEL_VALUE} AS jv FROM t) "
        f"SELECT {_key}{_value_level('jv')} AS level FROM j"
    ),
    "level_code": (
        f"WITH l AS (SELECT {_key}{LEVEL_PLAIN} AS level FROM ({with_odd('app.log')})) "
        "SELECT *, (list_position(['error','warn','info','debug','trace','unknown'], "
        "level) - 1)::BIGINT AS level_code FROM l"
    ),
    "syslog_message": over(with_odd("sys.txt"), f"{_key}{MESSAGE} AS message"),
    "json_string_field": over(
        with_odd("svc.jsonl"), f"{_key}{json_string('msg')} AS field"
    ),
    "json_number_field": over(
        with_odd("svc.jsonl"), f"{_key}{json_number('level')} AS field"
    ),
    "filter_level": f"SELECT {_key}value FROM ({PARSED}) WHERE {found('', 'warn')}",
    "search_substring": f"SELECT {_key}value FROM ({MATCHES})",
    "search_and_level": (
        f"SELECT {_key}value FROM ({PARSED}) WHERE {found(*queries.SEARCH)}"
    ),
    "search_documents": (
        "SELECT doc_id AS path, k AS position, value "
        f"FROM ({_LINES}) WHERE {found('THe')}"
    ),
    "search_indexed": (
        f"SELECT {_key}value FROM ({PARSED}) WHERE {found(queries.RARE)}"
    ),
    "search_table": (
        "SELECT file_id, line_number, value, level "
        f"FROM ({SEGMENTS}) WHERE {found(queries.RARE)}"
    ),
    "saved_page": (
        f"SELECT * FROM ({RANKED}) WHERE (match_rank > {_offset} "
        f"AND match_rank <= {_offset + _limit}) OR (match_rank > {5 * _offset} "
        f"AND match_rank <= {5 * _offset + _limit})"
    ),
    "saved_and": (
        f"SELECT {_key}value FROM ({PARSED}) WHERE {found(*queries.SEARCH)}"
    ),
    "saved_combined": (
        f"SELECT path, count(*) AS matches FROM ({PARSED}) WHERE "
        f"({found(queries.NEEDLE)} OR {found('', 'warn')}) AND NOT {found('7')} GROUP BY path"
    ),
    "search_regex": (
        f"SELECT {_key}value FROM ({PARSED}) WHERE regexp_matches(value, {lit(queries.REGEX)})"
    ),
    "search_terms": (
        f"SELECT {_key}value FROM ({PARSED}) WHERE (contains(lower(value), 'user=1') "
        "AND NOT contains(lower(value), 'error')) "
        f"OR regexp_matches(value, {lit(queries.TERM_REGEX)})"
    ),
    "parse_pattern": (
        f"SELECT {_key}"
        + ", ".join(
            f"CASE WHEN regexp_matches(value, {lit(queries.USER_PATTERN)}) THEN "
            f"regexp_extract(value, {lit(queries.USER_PATTERN)}, {i}) END AS {name}"
            for i, name in enumerate(("clock", "word", "user"), 1)
        ).replace("AS user", 'AS "user"')
        + f" FROM ({with_odd('app.log')})"
    ),
    "parse_grok": (
        "SELECT path, line_number, CASE WHEN path = 'app.log' THEN 'app' ELSE format END AS format, "
        f"CASE WHEN path <> 'app.log' THEN level ELSE CASE lower({_grok_field(2)}) "
        "WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warn' WHEN 'info' THEN 'info' "
        "WHEN 'debug' THEN 'debug' ELSE 'unknown' END END AS level, "
        f"CASE WHEN path = 'app.log' THEN {_grok_field(1)} ELSE ts_text END AS ts_text, "
        f"CASE WHEN path = 'app.log' THEN {_grok_field(3)} END AS user, "
        f"CASE WHEN path = 'app.log' THEN nullif({_grok_field(4)}, '') END AS props "
        f"FROM ({PARSED})"
    ).replace("AS user,", 'AS "user",'),
    "mined_templates": _mined(12),
    "similar_lines": f"SELECT {_KIND} FROM ({KINDS})",
    "similar_lines_top": (
        f"SELECT {_KIND} FROM ({KINDS}) ORDER BY n DESC, template LIMIT {queries.TOP}"
    ),
    "event_time": (
        f"WITH p AS ({over(with_odd('app.log'), _key + TS_PLAIN + ' AS ts_text')}) SELECT "
        f"{_key}{micros('ts_text', queries.YEAR, queries.DATE)} AS micros FROM p"
    ),
    "time_range": (
        f"SELECT {_key}micros FROM ({TIMED}) WHERE "
        f"micros >= epoch_us(TIMESTAMP '{queries.RANGE[0]}') "
        f"AND micros < epoch_us(TIMESTAMP '{queries.RANGE[1]}')"
    ),
    "time_range_filled": (
        f"WITH p AS ({over(UNSTAMPED, _key + TS_PLAIN + ' AS ts_text')}), "
        f"t AS (SELECT {_key}{micros('ts_text', queries.YEAR, queries.DATE)} AS own FROM p), "
        f"c AS (SELECT {_key}own IS NOT NULL AS own_time, last_value(own IGNORE NULLS) OVER "
        "(PARTITION BY path ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS micros FROM t) "
        f"SELECT {_key}own_time, micros FROM c WHERE "
        f"micros >= epoch_us(TIMESTAMP '{queries.RANGE[0]}') "
        f"AND micros < epoch_us(TIMESTAMP '{queries.RANGE[1]}')"
    ),
    "event_time_rollover": (
        "SELECT path, event_id + 1 AS line_number, CASE WHEN event_id % 5 <> 4 THEN "
        f"epoch_us(TIMESTAMP '{inputs.FIRST_TIME}') + 1000000 * (event_id * {inputs.STEP_SECS} "
        "- CASE WHEN event_id % 7 = 3 THEN 86400 ELSE 0 END) END AS micros "
        "FROM events, (VALUES ('sys.txt'), ('device.log')) AS f(path)"
    ),
    "errors_over_time": (
        "SELECT path, micros // 3600000000 * 3600 AS window_start, level, count(*) AS n "
        f"FROM ({TIMED}) WHERE micros IS NOT NULL GROUP BY ALL"
    ),
    "match_spans": spans(PARSED, queries.SPAN_NEEDLE, _SPAN_SUM),
    "match_spans_documents": spans(
        "SELECT doc_id AS path, 1::BIGINT AS line_number, text AS value FROM documents",
        queries.SPAN_NEEDLE,
    ),
    "match_spans_regex": regex_spans(PARSED, queries.SPAN_REGEX, True),
    "match_spans_regex_documents": regex_spans(
        "SELECT doc_id AS path, 1::BIGINT AS line_number, text AS value FROM documents",
        queries.DOCUMENT_REGEX,
        False,
    ),
    "log_view": f"SELECT {_key}coalesce(ts_text, '') AS ts_text, value FROM ({PARSED})",
    "level_counts": (
        "SELECT path, "
        + ", ".join(
            f"count(*) FILTER (WHERE level = {lit(n)}) AS {n}"
            for n in ("error", "warn", "info", "debug", "trace", "unknown")
        )
        + f" FROM ({PARSED}) GROUP BY path"
    ),
    "search_counts": counts(found("1", "error")),
    "search_counts_no_query": counts("true"),
    "match_count": (
        f"SELECT path, count(*) FILTER (WHERE {found(*queries.SEARCH)}) AS matches "
        f"FROM ({PARSED}) GROUP BY path"
    ),
    "match_ranks": f"SELECT {_key}match_rank FROM ({RANKED})",
    "nth_match": (
        f"SELECT {_key}value FROM ({RANKED}) WHERE match_rank = {queries.RANK + 1}"
    ),
    "match_page": (
        f"SELECT * FROM ({RANKED}) WHERE match_rank > {_offset} "
        f"AND match_rank <= {_offset + _limit}"
    ),
    "next_match": step("next", queries.CURRENT),
    "prev_match": step("prev", queries.CURRENT),
    "next_match_wrapped": step("next", 10**12),
    "prev_match_wrapped": step("prev", 1),
    "goto_line": goto(queries.GOTO),
    "goto_line_clamped": goto(10**12),
    "follow_parse": (
        "SELECT file_id, byte_offset, value, format, level, ts_text "
        f"FROM ({APP_SEGMENTS})"
    ),
    "follow_filter": (
        f"SELECT file_id, byte_offset, value FROM ({APP_SEGMENTS}) "
        f"WHERE {found(*queries.SEARCH)}"
    ),
    "follow_unfinished": (
        f"WITH s AS ({SEGMENTS}), n AS (SELECT file_id, "
        f"floor(max(byte_offset + octet_length(encode(value)) + 1) * {queries.UNFINISHED}) "
        f"AS n FROM s GROUP BY file_id) SELECT {_FOLLOWED} FROM s JOIN n USING (file_id) "
        "WHERE byte_offset + octet_length(encode(value)) + 1 <= n"
    ),
    "follow_rotated": (
        f"SELECT {_FOLLOWED} FROM ({SEGMENTS}) UNION ALL SELECT {_FOLLOWED} FROM ("
        + parsed(
            segment(f"SELECT * FROM ({all_lines()}) WHERE (line_number - 1) % 3 = 0"),
            "path, line_number, value, file_id, byte_offset",
        )
        + ")"
    ),
    "follow_replaced_larger": (
        f"SELECT {_FOLLOWED} FROM ({SEGMENTS}) UNION ALL SELECT {_FOLLOWED} FROM ("
        + parsed(
            segment(f"SELECT * FROM ({all_lines()}) WHERE (line_number - 1) % 3 = 1"),
            "path, line_number, value, file_id, byte_offset",
        )
        + ")"
    ),
    "follow_folder": f"SELECT {_FOLLOWED} FROM ({SEGMENTS})",
    "follow_level_counts": (
        f"SELECT file_id, level, count(*) AS n FROM ({APP_SEGMENTS}) GROUP BY ALL"
    ),
    "follow_search_counts": (
        "SELECT file_id, count(*) FILTER (WHERE hit) AS n_all, "
        f"{_COUNTS} FROM (SELECT file_id, level, {found('1')} AS hit "
        f"FROM ({APP_SEGMENTS})) GROUP BY file_id"
    ),
    "follow_errors_over_time": (
        "SELECT file_id, micros // 3600000000 * 3600 AS window_start, level, count(*) AS n "
        f"FROM (SELECT file_id, level, {micros('ts_text', queries.YEAR, None)} AS micros "
        f"FROM ({APP_SEGMENTS})) WHERE micros IS NOT NULL GROUP BY ALL"
    ),
    "stream_segments": (
        f"{with_trim(file_lines('app.log') + ' UNION ALL ' + file_lines('svc.jsonl'))} "
        f"SELECT {_SEGMENT} AS file_id, value, {LEVEL_PLAIN} AS level, "
        f"{TS_PLAIN} AS ts_text FROM t"
    ),
}
