"""Literal cases of timestamps, levels, JSON fields, formats and spans."""

import pytest

from linewright import functions as lf
from linewright.functions.patterns import U32, U64, quoted
from linewright.operators.parse import parse_logs

PLAIN = {
    "2024-01-15T14:23:05Z msg": "2024-01-15T14:23:05Z",
    "2024-01-15T14:23:05.123Z msg": "2024-01-15T14:23:05.123Z",
    "2024-01-15T14:23:05+05:30 msg": "2024-01-15T14:23:05+05:30",
    "2024-01-15T14:23:05-08:00": "2024-01-15T14:23:05-08:00",
    "2024-01-15T14:23:05+05:3 msg": "2024-01-15T14:23:05",
    "2024-01-15T14:23:05 msg": "2024-01-15T14:23:05",
    "2024-01-15T14:23:05. msg": "2024-01-15T14:23:05",
    "2024-01-15T14:23:05.5x msg": None,
    "2024-01-15T14:23:05Zulu": None,
    "2024-01-15 14:23:05 msg": "2024-01-15 14:23:05",
    "2024-01-15 14:23:05.456 msg": "2024-01-15 14:23:05.456",
    "2024-01-15 14:23:05Z": None,
    "2024/01/15 14:23:05": None,
    "Jan 15 14:23:05 host proc: msg": "Jan 15 14:23:05",
    "Jan  5 14:23:05 host proc: msg": "Jan  5 14:23:05",
    "Jan  5 14:23:05": "Jan  5 14:23:05",
    "Jan 5 14:23:05": None,
    "Jan 5 14:23:05 x": "Jan 5 14:23:05",
    "Jan 5 14:23:05é": "Jan 5 14:23:05",
    "Jan  X5 14:23:05 odd": "Jan  X5 14:23:05",
    "Foo 15 14:23:05": None,
    "14:23:05 msg": "14:23:05",
    "14:23:05.999 msg": "14:23:05.999",
    "99:99:99": "99:99:99",
    "  14:23:05 msg": "14:23:05",
    "  \u008514:23:05": "14:23:05",
    "14:23:05a": None,
    "no timestamp here at all": None,
    "": None,
    "abé2024": None,
}

LOGCAT_TS = {
    "05-28 14:23:05.123  1234  5678 I Tag: m": "05-28 14:23:05.123",
    "05-28 14:23:05.123": "05-28 14:23:05.123",
    "05-28 14:23:05.1X3 rest": None,
    "05-28 14:23:05.123x": None,
    "05-28 14:23:05.123\x0brest": None,
    "05/28 14:23:05.123 x": None,
    "\t05-28 14:23:05.123\tx": "05-28 14:23:05.123",
    "05-28 14:23": None,
}

SYSLOG_TS = {
    "Jan 15 14:23:05 host p: msg": "Jan 15 14:23:05",
    "Jan 15 14:23:05": "Jan 15 14:23:05",
    "Jan  5 14:23:05 host": "Jan  5 14:23:05",
    "Jan  5 14:23:05": None,
    "Jan 5 14:23:05 host": None,
    "Jan 15 14-23-05 host p: msg": None,
    "Jan 15 14:23:05x": None,
    "January 15": None,
}

LOGCAT_LEVEL = {
    "05-28 14:23:05.456  1111  2222 V VerboseTag: m": "trace",
    "05-28 14:23:05.456  1111  2222 D Tag: m": "debug",
    "05-28 14:23:05.456  1111  2222 I Tag: error": "info",
    "05-28 14:23:05.456  1111  2222 W Tag: m": "warn",
    "05-28 14:23:05.456  1111  2222 E Tag: m": "error",
    "05-28 14:23:05.456 1 2 F": "error",
    "05-28 14:23:05.456 1 2 EE Tag": "unknown",
    "05-28 14:23:05.456 1 2 X Tag": "unknown",
    "05-28 14:23:05.456 1": "unknown",
    "--------- beginning of main E E E": "unknown",
}

SYSLOG_LEVEL = {
    "Jan 15 14:23:05 error-host myproc[1]: disk space warning": "warn",
    "Jan 15 14:23:05 error-host myproc[1]: fine": "error",
    "Jan 15 14:23:05 host p: INFO then ERROR": "error",
    "Jan 15 14:23:05 host no colon trace": "trace",
    "no stamp: Debug": "debug",
    "Jan 15 14:23:05 host p: nothing": "unknown",
}

MESSAGE = {
    "Jan 15 14:23:05 myhost myproc[42]: something went wrong": "something went wrong",
    "Jan 15 14:23:05 host p:   padded: more": "padded: more",
    "Jan 15 14:23:05 : first": "first",
    "Jan 15 14:23:05 host p: ": "",
    "Jan 15 14:23:05 host p:none": None,
    "not syslog: text": None,
}

KEYWORD = {
    "ERROR in info handler": "error",
    "a terror": "error",
    "Warning": "warn",
    "information": "info",
    "DeBuG": "debug",
    "stack trace": "trace",
    "notice": "unknown",
    "": "unknown",
}

# line: (level, ts_text)
JSON = {
    '{"time":"2024-01-01T00:00:00Z","level":50,"msg":"t"}': (
        "warn",
        "2024-01-01T00:00:00Z",
    ),
    '{"message":"the level was high","level":"warn"}': ("warn", None),
    '{"level":60}': ("error", None),
    '{"level":59}': ("warn", None),
    '{"level":40}': ("info", None),
    '{"level":30.5}': ("debug", None),
    '{"level":10}': ("trace", None),
    '{"level":-3}': ("unknown", None),
    '{"level":-3,"lvl":"error"}': ("error", None),
    '{"level":4294967295}': ("error", None),
    '{"level":4294967296}': ("unknown", None),
    '{"level":18446744073709551615,"lvl":"error"}': ("unknown", None),
    '{"level":18446744073709551616,"lvl":"error"}': ("error", None),
    '{"level":"+50"}': ("warn", None),
    '{"level":" 0000000000000050 "}': ("warn", None),
    '{"level":"5 0"}': ("unknown", None),
    '{"level":"FATAL"}': ("error", None),
    '{"level":"critical"}': ("error", None),
    '{"level":"verbose"}': ("trace", None),
    '{"level":"notice","severity":"error"}': ("unknown", None),
    '{"level":"","severity":"error"}': ("unknown", None),
    '{"level":true,"severity":"error"}': ("error", None),
    '{"level":true,"level":"warn"}': ("unknown", None),
    '{"a":["x","level"],"b":"error"}': ("error", None),
    '{"x":{ \t"level" : \t"info"}}': ("info", None),
    '{"msg":"say \\"level\\":\\"error\\"","lvl":"info"}': ("info", None),
    '{"level":"err\\"or"}': ("unknown", None),
    '{"level":"error': ("unknown", None),
    '{"timestamp":"","ts":"x"}': ("unknown", None),
    '{"timestamp":5,"time":"x"}': ("unknown", "x"),
    '{"@timestamp":"t\\u0041"}': ("unknown", "t\\u0041"),
    '  {"ts":"x"}  ': ("unknown", "x"),
    '[{"ts":"x","level":"error"}]': ("unknown", None),
    "error": ("unknown", None),
    "": ("unknown", None),
}


@pytest.mark.parametrize(
    "function, cases",
    [
        (lf.plain_timestamp, PLAIN),
        (lf.logcat_timestamp, LOGCAT_TS),
        (lf.syslog_timestamp, SYSLOG_TS),
        (lf.logcat_level, LOGCAT_LEVEL),
        (lf.syslog_level, SYSLOG_LEVEL),
        (lf.syslog_message, MESSAGE),
        (lf.keyword_level, KEYWORD),
    ],
)
def test_line_functions(column_of, function, cases):
    got = column_of(list(cases), function("value"))
    assert dict(zip(cases, got)) == cases


@pytest.mark.parametrize(
    "format, level_cases, ts_cases",
    [
        ("Plain text", KEYWORD, PLAIN),
        ("Logcat", LOGCAT_LEVEL, LOGCAT_TS),
        ("Syslog", SYSLOG_LEVEL, SYSLOG_TS),
        ("JSON", {k: v[0] for k, v in JSON.items()}, {k: v[1] for k, v in JSON.items()}),
    ],
)
@pytest.mark.parametrize("fixed", [True, False])
def test_parse(lines, format, level_cases, ts_cases, fixed):
    frame = lines([*level_cases, *ts_cases])
    if fixed:
        parsed = parse_logs(frame, format)
    else:
        parsed = parse_logs(frame.selectExpr("*", f"'{format}' AS format"))
    rows = {r.value: r for r in parsed.collect()}
    assert {v: rows[v].level for v in level_cases} == level_cases
    assert {v: rows[v].ts_text for v in ts_cases} == ts_cases
    codes = {"error": 0, "warn": 1, "info": 2, "debug": 3, "trace": 4, "unknown": 5}
    assert all(r.level_code == codes[r.level] for r in rows.values())


def test_json_fields(column_of):
    cases = {
        '{"k":"v"}': "v",
        '{"k":"say \\"hello\\""}': 'say \\"hello\\"',
        '{"k":""}': "",
        '{"k":1}': None,
        '{"k":"open': None,
        '{"k":"open\\"': None,
        '"k":"no brace"': None,
        ', "k" x : "y"': "y",
        '{"k"': None,
    }
    got = column_of(list(cases), lf.string_field("value", "k"))
    assert dict(zip(cases, got)) == cases
    numbers = {'{"n":0012x}': 12, '{"n":"3"}': None, '{"n":18446744073709551615}': U64_MAX}
    got = column_of(list(numbers), lf.number_field("value", "n"))
    assert dict(zip(numbers, got)) == numbers


U64_MAX = 18446744073709551615


def test_long_escaped_string_does_not_overflow_the_stack(column_of):
    text = '{"ts":"' + '\\"' * 200_000 + '","level":"info"}'
    assert column_of([text], lf.json_timestamp("value"))[0] == '\\"' * 200_000


def test_detect_format(spark):
    cases = [
        ("a.json", "plain", "JSON"),
        ("/x/b.JSONL", "05-28 14:23:05.123 1 2 I T", "JSON"),
        ("c.ndjson", "", "JSON"),
        ("/x/.json", "plain", "Plain text"),
        ("/x.json/y", "plain", "Plain text"),
        ("d.log", "--------- beginning of main", "Logcat"),
        ("d.log", "  05-28 14:23:05.123 1 2 I T", "Logcat"),
        ("e.txt", "Jan 15 14:23:05 host p: msg", "Syslog"),
        ("e.txt", "January report", "Plain text"),
        ("f", " [1]", "JSON"),
        ("f", '{"a":1}', "JSON"),
        ("g", "", "Plain text"),
    ]
    frame = spark.createDataFrame(cases, "path string, first string, want string")
    got = frame.select("path", "first", "want", lf.detect_format("path", "first").alias("f"))
    assert [r for r in got.collect() if r.f != r.want] == []


def test_clean_line(spark):
    frame = spark.createDataFrame(
        [(1, b"a\r"), (2, b"a\r\r"), (3, b"\xff"), (4, "é".encode()), (5, b"")],
        "i int, raw binary",
    )
    frame = frame.selectExpr("i", "CAST(raw AS STRING) AS value")
    got = frame.select("i", lf.clean_line("value").alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == ["a", "a\r", "", "é", ""]


@pytest.mark.parametrize("needle", ["error", "aa", "E", "\\E", ".*", "é", ""])
def test_match_spans(column_of, needle):
    texts = [
        "Error: ERRORerror e",
        "aaaaa",
        "",
        "none",
        "\\E.*\\E",
        "éÉé" * 400,
        "xaa" * 3000,
    ]
    want = []
    for text in texts:
        low, sub, at, starts = text.lower(), needle.lower(), 0, []
        while needle and (at := low.find(sub, at)) >= 0:
            starts.append(at + 1)
            at += len(sub)
        want.append(starts)
    assert column_of(texts, lf.match_spans("value", needle)) == want


def test_number_patterns():
    import re

    for limit, pattern in ((4294967295, U32), (U64_MAX, U64)):
        whole = re.compile(rf"{pattern}\Z")
        for n in (0, 1, 9, 10, limit // 10, limit - 1, limit):
            assert whole.match(str(n)), n
        for n in (limit + 1, limit * 10, 10 ** len(str(limit))):
            assert not whole.match(str(n)), n


def test_quoted():
    assert quoted("a\\Eb") == "\\Qa\\E\\\\E\\Qb\\E"
