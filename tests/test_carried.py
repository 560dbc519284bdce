"""Times that lines take over from those before them, and years that turn."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import linewright as lw
from linewright.operators import carried
from linewright.operators.search import COUNTED_LEVELS
from linewright.session import fresh_dir


@pytest.fixture(params=[1 << 19, 7])
def small_blocks(request, monkeypatch):
    monkeypatch.setattr(carried, "BLOCK_LINES", request.param)


def frame_of(spark, files):
    rows = [(p, i, v) for p, values in files.items() for i, v in enumerate(values, 1)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "path string, line_number bigint, value string")


def test_times_are_carried(spark, small_blocks):
    r = random.Random(4)
    files = {}
    for name, share in (("a", 0.5), ("b", 0.02), ("none", 0.0), ("all", 1.0)):
        files[name] = [
            f"2024-01-{1 + i % 28:02d} 10:00:{i % 60:02d} x" if r.random() < share else "  at f()"
            for i in range(200)
        ]
    parsed = lw.parse_logs(frame_of(spark, files), "Plain text")
    got = {
        (x.path, x.line_number): (x.own_time, x.event_time)
        for x in lw.carry_event_time(lw.with_event_time(parsed)).collect()
    }
    for name, values in files.items():
        last = None
        for i, value in enumerate(values, 1):
            own = value.startswith("2024")
            last = datetime.fromisoformat(value[:19]) if own else last
            assert got[name, i] == (own, last)
    assert len(got) == 800


def test_years_turn(spark, small_blocks):
    r = random.Random(5)
    files, want = {}, {}
    for name, year, step in (("a.txt", 1999, 20), ("b.txt", 2023, 3), ("c.txt", 1999, 30)):
        time, values = datetime(year, 11, 20, 3, 4, 5), []
        for i in range(150):
            shown = time - timedelta(hours=30) if r.random() < 0.2 else time
            if i and r.random() < 0.3:
                values.append("  at f()")
            else:
                values.append(f"{shown:%b %d %H:%M:%S} host p: x")
                want[name, len(values)] = shown
            time += timedelta(days=r.randrange(step + 1), minutes=7)
        files[name] = values
    frame = frame_of(spark, files)
    for year in (1999, 2023):
        names = [n for n in files if (n == "b.txt") == (year == 2023)]
        parsed = lw.parse_logs(frame.filter(F.col("path").isin(names)), "Syslog")
        got = lw.with_rolling_year(parsed, year).collect()
        assert {(x.path, x.line_number): x.event_time for x in got if x.event_time} == {
            k: v for k, v in want.items() if k[0] in names
        }
        assert len(got) == 150 * len(names)


def test_leap_days_need_the_right_year(spark):
    values = ["12-30 10:00:00.000  1  2 I T: a", "01-02 10:00:00.000  1  2 I T: b"]
    values += ["02-29 10:00:00.000  1  2 I T: c", "2025-03-01T00:00:00Z own year"]
    frame = frame_of(spark, {"a.log": values})
    times = {
        x.line_number: x.event_time
        for x in lw.with_rolling_year(lw.parse_logs(frame, "Logcat"), 2023).collect()
    }
    assert [times[i].year if times[i] else None for i in (1, 2, 3, 4)] == [2023, 2024, 2024, None]


def test_a_long_file_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(carried, "BLOCK_LINES", 1000)
    timed = spark.range(1, 100_001).selectExpr(
        "'a' AS path",
        "id AS line_number",
        "CASE WHEN id % 2500 = 1 THEN timestamp_seconds(id) END AS event_time",
    )
    filled = lw.carry_event_time(timed)
    rows = filled.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in rows) < 60_000 and len(rows) > 2
    bad = filled.filter("unix_seconds(event_time) <> (line_number - 1) DIV 2500 * 2500 + 1")
    assert bad.count() == 0 and filled.filter("event_time IS NULL").count() == 0


def test_a_range_leaves_blocks_unread(spark):
    timed = spark.range(1, 100_001).selectExpr(
        "'a' AS path", "id AS line_number", "timestamp_seconds(id) AS event_time"
    )
    folder = fresh_dir(spark, "test-timed")
    kind = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(kind)
    lw.store_timed(timed, folder)
    assert spark.conf.get(kind) == before
    found = lw.time_range(lw.read_timed(spark, folder), "1970-01-01 01:00:00", "1970-01-01 01:10:00")
    assert found.count() == 600
    found.collect()
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    read = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert read < 30_000  # of the row groups and pages, only those around the range


def test_live_counts_equal_the_batch_counts(spark, lines):
    parsed = lw.parse_logs(lines(["ERROR a1", "warn b", "info 1", "x", "debug 1 error"] * 30))
    for query in ("", "1", "no"):
        batch, live = lw.search_counts(parsed, query), lw.live_search_counts(parsed, query)
        assert [r.asDict() for r in batch.collect()] == [r.asDict() for r in live.collect()]
    assert live.columns == ["path", "all", *COUNTED_LEVELS]
