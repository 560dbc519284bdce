"""Search, counts, positions; and the joins that have two ways."""

import pytest

import linewright as lw
from linewright.operators import lookup, positions


@pytest.fixture
def parsed(lines):
    texts = ["ERROR a", "warn B", "info a", "debug", "trace a", "none", "Error b"] * 30
    quiet = ["nothing here"] * 5
    frame = lines(texts, "a.log").unionAll(lines(quiet, "b.log"))
    return lw.parse_logs(frame, "Plain text").cache()


def by_path(frame, *names):
    return {r.path: tuple(r[n] for n in names) for r in frame.collect()}


def test_search(parsed):
    assert lw.search_logs(parsed).count() == 215
    assert lw.search_logs(parsed, "A").count() == 120
    assert lw.search_logs(parsed, "", "error").count() == 60
    assert lw.search_logs(parsed, "B", "error").count() == 30
    assert lw.search_logs(parsed, " a ").count() == 0
    assert lw.search_logs(parsed, "err.r").count() == 0


def test_counts(parsed):
    names = ("error", "warn", "info", "debug")
    assert by_path(lw.level_counts(parsed), *lw.functions.LEVELS) == {
        "a.log": (60, 30, 30, 30, 30, 30),
        "b.log": (0, 0, 0, 0, 0, 5),
    }
    whole = {"a.log": (210, 60, 30, 30, 30), "b.log": (5, 0, 0, 0, 0)}
    assert by_path(lw.search_counts(parsed), "all", *names) == whole
    assert by_path(lw.search_counts(parsed, "", "error"), "all", *names) == whole
    assert by_path(lw.search_counts(parsed, "A", "error"), "all", *names) == {
        "a.log": (30, 30, 0, 0, 0),
        "b.log": (0, 0, 0, 0, 0),
    }
    assert by_path(lw.match_count(parsed, "b"), "matches") == {
        "a.log": (90,),
        "b.log": (0,),
    }


def test_view_and_summary(spark, parsed):
    rows = lw.log_view(parsed).filter("line_number = 1").collect()
    assert {(r.path, r.ts_text) for r in rows} == {("a.log", ""), ("b.log", "")}
    files = spark.createDataFrame(
        [("a", "JSON", 3, 1_250_000_000), ("b", "JSON", 0, 0)],
        "path string, format string, line_count bigint, file_size bigint",
    )
    summary = by_path(lw.file_summary(files), "file_size", "size_gb")
    assert summary == {"a": (1_250_000_000, 1.3), "b": (0, 0.0)}


@pytest.mark.parametrize("block, limit", [(4, lookup.BROADCAST_BYTES), (64, -1)])
def test_positions(monkeypatch, parsed, block, limit):
    monkeypatch.setattr(positions, "BLOCK_LINES", block)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
    matches = lw.search_logs(parsed, "a").filter("path = 'a.log'")
    found = sorted(r.line_number for r in matches.collect())
    ranked = lw.rank_matches(matches).collect()
    assert {r.match_rank: r.line_number for r in ranked} == dict(
        enumerate(found, start=1)
    )
    page = lw.match_page(matches, 10, 25).collect()
    assert sorted(r.line_number for r in page) == found[10:35]
    assert [r.line_number for r in lw.nth_match(matches, 0).collect()] == found[:1]
    assert [r.line_number for r in lw.nth_match(matches, 119).collect()] == found[119:]
    assert lw.nth_match(matches, 120).collect() == []

    def line(frame):
        return [r.line_number for r in frame.collect()]

    middle = found[50]
    assert line(lw.next_match(matches, middle)) == [found[51]]
    assert line(lw.prev_match(matches, middle)) == [found[49]]
    assert line(lw.next_match(matches, found[-1])) == [found[0]]
    assert line(lw.prev_match(matches, found[0])) == [found[-1]]
    assert sorted(line(lw.goto_line(parsed, 7))) == [5, 7]
    assert sorted(line(lw.goto_line(parsed, 0))) == [1, 1]
    assert sorted(line(lw.goto_line(parsed, 10**6))) == [5, 210]


def test_large_side_is_not_broadcast(monkeypatch, lines):
    frame = lines(["05-28 14:23:05.123 1 2 E T"] * 500, "hot.log")
    frame = frame.unionAll(lines(["INFO"] * 3, "cold.log"))
    small = lw.parse_logs(frame)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", -1)
    large = lw.parse_logs(frame)
    assert sorted(large.collect()) == sorted(small.collect())

    def plan(df):
        return df._jdf.queryExecution().logical().toString()

    assert "ResolvedHint" in plan(small) or "broadcast" in plan(small).lower()
    assert "_block" in plan(large)


def test_lines_without_a_first_line_stay(monkeypatch, lines):
    frame = lines(['{"level":"error"}'] * 3, "a.jsonl").unionAll(lines(["INFO"] * 2, "b.log"))
    frame = frame.unionAll(lines(["05-28 14:23:05.123 1 2 E T"] * 2, "c.log"))
    some = frame.filter("line_number > 1 OR path = 'c.log'")
    for limit in (lookup.BROADCAST_BYTES, -1):
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
        rows = lw.parse_logs(some).collect()
        assert sorted((r.path, r.line_number, r.format, r.level) for r in rows) == [
            ("a.jsonl", 2, "JSON", "error"),
            ("a.jsonl", 3, "JSON", "error"),
            ("b.log", 2, "Plain text", "info"),
            ("c.log", 1, "Logcat", "error"),
            ("c.log", 2, "Logcat", "error"),
        ]


def test_terms(lines):
    frame = lines(["Timeout a", "timeout retry", "code=503", "CODE=7", None, ""])
    tree = lw.Has("TIMEOUT") & ~lw.Has("retry") | lw.Matches("code=5[0-9]{2}")
    found = lw.search_terms(frame, tree).collect()
    assert sorted(r.line_number for r in found) == [1, 3]
    found = lw.search_regex(frame, "^code", ignore_case=True).collect()
    assert sorted(r.line_number for r in found) == [3, 4]
    assert lw.search_terms(frame, lw.Has("")).count() == 6


def test_event_times(spark):
    from linewright.functions.times import event_time

    cases = [
        ("2024-02-29T01:02:03.5Z", "2024-02-29 01:02:03.5"),
        ("2024-02-29T01:02:03+05:30", "2024-02-28 19:32:03"),
        ("2023-02-29 01:02:03", None),
        ("2024-01-02 25:00:00", None),
        ("02-29 01:02:03.250", "2024-02-29 01:02:03.25"),
        ("Feb  3 01:02:03", "2024-02-03 01:02:03"),
        ("Feb 3 01:02:03", "2024-02-03 01:02:03"),
        ("Jan  X5 01:02:03", "2024-01-05 01:02:03"),
        ("Jan 15 01:02:03", "2024-01-15 01:02:03"),
        ("01:02:03.004", "2020-05-06 01:02:03.004"),
        ("2024-01-02", None),
        ("noon", None),
        (None, None),
    ]
    frame = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    asked = event_time("t", 2024, "2020-05-06")
    got = [r[0] for r in frame.selectExpr(f"CAST({asked} AS STRING)").collect()]
    assert got == [want for _, want in cases]
    bare = [r[0] for r in frame.selectExpr(f"CAST({event_time('t')} AS STRING)").collect()]
    assert [g is None for g in bare[:3]] == [False, False, True] and set(bare[4:]) == {None}
    east = event_time("t", zone="+02:00")
    moved = spark.sql(f"SELECT CAST({east} AS STRING) FROM VALUES ('2024-01-02 03:00:00') v(t)")
    assert moved.first()[0] == "2024-01-02 01:00:00"


def test_templates_and_patterns(lines):
    frame = lines(['GET 12 "a b" 0xFf', 'GET 7 "" 0x0', "user 'x' 9", "none"])
    kinds = {r.template: (r.n, r.line_number) for r in lw.similar_lines(frame).collect()}
    assert kinds == {'GET # "*" #': (2, 1), "user '*' #": (1, 3), "none": (1, 4)}
    assert [r.n for r in lw.similar_lines(frame, 1).collect()] == [2]
    named = lw.parse_pattern(frame, r"(?P<verb>GET) (?:x)?(?P<code>[0-9]+)(?P<rest>z)?")
    got = {r.line_number: (r.verb, r.code, r.rest) for r in named.collect()}
    assert got == {
        1: ("GET", "12", ""),
        2: ("GET", "7", ""),
        3: (None, None, None),
        4: (None, None, None),
    }
    for pattern in ("no group", "(?P<value>x)"):
        with pytest.raises(ValueError):
            lw.parse_pattern(frame, pattern)
