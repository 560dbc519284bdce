"""The source of growing files, and the parsed streams on it."""

import random

import pytest

import linewright as lw
from linewright.operators.parse import pin_level
from linewright.streaming import sinks, tail


def read_all(path, start, end, task_bytes, tasks=3):
    """Lines the source's tasks yield between two offsets, task by task."""
    got = []
    for ranges in tail.pack_ranges(start, end, task_bytes, tasks):
        for one in ranges:
            for batch in tail.read_range(*one):
                got += [(r["byte_offset"], r["value"]) for r in batch.to_pylist()]
    return got


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_ranges_cover_every_line_once(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(tail, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = ["x" * rng.choice([0, 1, 2, 5, 30, 200]) for _ in range(300)]
    data = "".join(t + "\n" for t in texts).encode()
    path = tmp_path / "a.log"
    path.write_bytes(data + b"unfinished")
    monkeypatch.setattr(tail, "LOOKBACK", chunk)
    size, end = tail.end_of_lines(str(path))
    assert (size, end) == (len(data) + 10, len(data))
    assert tail.end_of_lines(str(path), (size - 10, 3)) == (size, end)
    assert tail.end_of_lines(str(path), (size + 1, end + 1)) == (size, end)
    assert tail.end_of_lines(str(path), (size - 1, end)) == (size, end)
    want, at = [], 0
    for text in texts:
        want.append((at, text))
        at += len(text) + 1
    for task_bytes in (1, 3, 50, 1000, 1 << 30):
        assert read_all(str(path), {}, {str(path): (size, end)}, task_bytes) == want
    middle = want[100][0]
    start = {str(path): (middle, middle)}
    got = read_all(str(path), start, {str(path): (size, end)}, 50)
    assert got == want[100:]


def test_file_uri_with_odd_characters(tmp_path):
    path = tmp_path / "a b%20+[1].log"
    path.write_bytes(b"x\n")
    for name in (str(path), f"file:{path}", f"file://{path}"):
        assert tail.end_of_lines(name) == (2, 2)


def test_line_rules(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"a\r\n\xff\n\n\xc3\xa9\r\r\n")
    end = {str(path): tail.end_of_lines(str(path))}
    assert read_all(str(path), {}, end, 100) == [(0, "a"), (3, ""), (5, ""), (6, "é\r")]


def test_shorter_file_is_read_from_its_start():
    replaced = [("a", 0, 20, 30, True), ("a", 20, 30, 30, False)]
    assert tail.cut_ranges({"a": (100, 100)}, {"a": (30, 30)}, 20) == replaced
    # Longer than the old line end, but smaller than the old file with its open line.
    assert tail.cut_ranges({"a": (50, 10)}, {"a": (40, 30)}, 20) == replaced
    assert tail.cut_ranges({"a": (50, 10)}, {"a": (60, 30)}, 20) == [("a", 10, 30, 30, True)]
    assert tail.cut_ranges({"a": (30, 30)}, {"a": (30, 30)}, 20) == []
    assert tail.end_of_lines("/no/such/file") is None


def test_small_files_share_tasks():
    end = {f"f{i:03d}": (10, 10) for i in range(500)}
    assert len(tail.pack_ranges({}, end, tail.TASK_BYTES, 8)) == 1
    big = {"a": (100 * tail.CHUNK,) * 2, **end}
    packed = tail.pack_ranges({}, big, tail.TASK_BYTES, 8)
    assert 8 <= len(packed) <= 10
    assert sum(u - l for ranges in packed for _, l, u, _, _ in ranges) == sum(
        stop for _, stop in big.values()
    )


def test_follow_grow_partial_rotate_restart(spark, tmp_path):
    log, out, checkpoint = tmp_path / "a.log", tmp_path / "out", tmp_path / "cp"
    counts, counted = tmp_path / "counts", tmp_path / "cp2"

    def run():
        # Every run is a new query on the same checkpoint: a restart.
        parsed = lw.follow(spark, [str(log)])
        found = lw.search_logs(parsed, "o", None)
        sinks.append_available(found, str(out), str(checkpoint))
        totals = lw.live_level_counts(parsed)
        sinks.refresh_available(totals, str(counts), str(counted))
        rows = spark.read.parquet(str(out)).collect()
        levels = {r.level: r.n for r in sinks.read_totals(spark, str(counts)).collect()}
        return sorted((r.byte_offset, r.value, r.format, r.level) for r in rows), levels

    log.write_bytes(b"Jan 15 14:23:05 host p: error\nJan 15 14:23:06 host p: in")
    first = (0, "Jan 15 14:23:05 host p: error", "Syslog", "error")
    assert run() == ([first], {"error": 1})
    with log.open("ab") as f:
        f.write(b"fo\nno stamp, no match? NONE\n")
    second = (30, "Jan 15 14:23:06 host p: info", "Syslog", "info")
    third = (59, "no stamp, no match? NONE", "Syslog", "unknown")
    assert run() == ([first, second, third], {"error": 1, "info": 1, "unknown": 1})
    log.write_bytes(b'{"level":"warn","x":"o"}\n')
    rotated = (0, '{"level":"warn","x":"o"}', "JSON", "warn")
    rows, levels = run()
    assert rows == sorted([first, second, third, rotated])
    assert levels == {"error": 1, "info": 1, "unknown": 1, "warn": 1}


def test_filter_stays_above_the_pinned_level(lines):
    parsed = pin_level(lw.parse_logs(lines(["ERROR x", "info"]), "Plain text"))
    found = lw.search_logs(parsed, "", "error")
    assert [r.value for r in found.collect()] == ["ERROR x"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter (level") < plan.index("Generate explode")


def test_start_at_the_end(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"INFO old\n")
    reader = tail.TailReader({"paths": f'["{log}"]', "startingposition": "end"})
    # Digests of the first bytes follow.
    assert {p: s[:2] for p, s in reader.initialOffset().items()} == {str(log): [9, 9]}
    assert {p: s[:2] for p, s in reader.latestOffset().items()} == {str(log): [9, 9]}


def test_rotation_under_an_open_line(spark, tmp_path):
    log, out, checkpoint = tmp_path / "a.log", tmp_path / "out", tmp_path / "cp"

    def run():
        stream = lw.follow(spark, [str(log)], "Plain text")
        sinks.append_available(stream, str(out), str(checkpoint))
        rows = spark.read.parquet(str(out)).collect()
        return sorted((r.byte_offset, r.value) for r in rows)

    log.write_bytes(b"".join(b"old line %02d\n" % i for i in range(10)) + b"x" * 90)
    old = [(12 * i, f"old line {i:02d}") for i in range(10)]
    assert run() == old
    # Smaller than before, though longer than what was read.
    log.write_bytes(b"".join(b"new line number %02d\n" % i for i in range(8)))
    new = [(19 * i, f"new line number {i:02d}") for i in range(8)]
    assert run() == sorted(old + new)
    log.unlink()
    with pytest.raises(Exception, match="missing at a restart"):
        run()
    log.write_bytes(b"".join(b"new line number %02d\n" % i for i in range(9)))
    assert run() == sorted(old + new + [(19 * 8, "new line number 08")])


def test_missing_paths():
    reader = tail.TailReader({"paths": '["/no/such/file"]'})
    assert reader.initialOffset() == {} and reader.latestOffset() == {}
    restarted = tail.TailReader({"paths": '["/no/such/file"]'})
    with pytest.raises(FileNotFoundError):
        restarted.latestOffset()
    skipping = tail.TailReader({"paths": '["/no/such/file"]', "missing": "skip"})
    assert skipping.latestOffset() == {}


def test_schemes():
    assert tail.split_path("/a b%20/c.log") == ("local", "", "/a b%20/c.log")
    assert tail.split_path("file:/a b") == ("local", "", "/a b")
    assert tail.split_path("s3a://bucket/a b+%.log") == ("s3", "bucket", "/a b+%.log")
    assert tail.split_path("hdfs://h:8020/x y") == ("hdfs", "h:8020", "/x y")
    assert tail.split_path("gs://b/x") == ("gs", "b", "/x")
    azure = tail.split_path("abfss://c@a.dfs.core.windows.net/x y")
    assert azure == ("azure", "c@a.dfs.core.windows.net", "/x y")
    assert tail.azure_names(azure[1]) == ("c", "a")
    with pytest.raises(ValueError, match="container"):
        tail.azure_names("a.dfs.core.windows.net")
    for path in ("wasbs://c@a/x", "dbfs:/x"):
        with pytest.raises(ValueError, match=path.partition(":")[0]):
            tail.split_path(path)


def test_segments(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    for name, data in (("a.log", b"ERROR 1\r\nwarn 2"), ("b.log", b"x\ry\n")):
        (tmp_path / "in" / name).write_bytes(data)
        stream = lw.follow_segments(spark, source, "Plain text")
        sinks.append_available(stream, out, checkpoint)
    rows = spark.read.parquet(out).collect()
    assert sorted((r.value, r.level) for r in rows) == [
        ("ERROR 1", "error"),
        ("warn 2", "warn"),
        ("x\ry", "unknown"),
    ]
