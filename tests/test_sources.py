"""Scanning, numbering, listing, export, ingest."""

import os
import random

import pytest
from pyspark.sql import functions as F

import linewright as lw
from linewright import session
from linewright.plans.ingest import manifest_history
from linewright.session import claim, drop_dir, fresh_dir, shared_dir


def put(folder, name, data: bytes):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def values(frame):
    rows = frame.orderBy("path", "line_number").collect()
    return [(os.path.basename(r.path), r.line_number, r.value) for r in rows]


@pytest.mark.parametrize(
    "data, want",
    [
        (b"foo\r\nbar\r\nbaz\r\n", ["foo", "bar", "baz"]),
        (b"line one\nline two\nline three", ["line one", "line two", "line three"]),
        (b"", []),
        (b"only line", ["only line"]),
        (b"a\rb\nc\r", ["a\rb", "c"]),
        (b"\n\nx\n\n", ["", "", "x", ""]),
        (b"ok\n\xff\xfe\nok2\n", ["ok", "", "ok2"]),
        (b"x\r\r\n", ["x\r"]),
    ],
)
def test_line_rules(spark, tmp_path, data, want):
    put(tmp_path, "one.log", data)
    frame = lw.read_log_lines(spark, str(tmp_path))
    assert [v for _, _, v in values(frame)] == want
    assert [n for _, n, _ in values(frame)] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("broadcast_limit", [1 << 26, -1])
def test_numbers_across_many_splits(spark, tmp_path, broadcast_limit):
    rng = random.Random(7)
    want = {}
    for name, n in {"big.log": 9000, "b c+d%.log": 2500, "one.txt": 1, "z.out": 40}.items():
        texts = [f"{i} " + "é" * rng.randrange(60) for i in range(n)]
        want[name] = texts
        put(tmp_path, name, "\n".join(texts).encode())
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = spark.conf.get(size), spark.conf.get(cost)
    try:
        spark.conf.set(size, "20000")
        spark.conf.set(cost, "5000")
        numbered = lw.number_lines(spark, str(tmp_path), broadcast_limit)
        # The layout of splits may change before the lines are used.
        spark.conf.set(size, "1000000")
        got = values(numbered.lines)
    finally:
        spark.conf.set(size, old[0])
        spark.conf.set(cost, old[1])
    assert got == [
        (name, i, text)
        for name in sorted(want)
        for i, text in enumerate(want[name], start=1)
    ]
    counts = {os.path.basename(r.path): r.line_count for r in numbered.files.collect()}
    assert counts == {name: len(texts) for name, texts in want.items()}


def test_formats_of_files(spark, tmp_path):
    put(
        tmp_path,
        "device.log",
        b"--------- beginning of main\n"
        b"05-28 14:23:05.123 1234 5678 I Tag: info msg\n"
        b"05-28 14:23:06.456 1234 5678 E Tag: err msg\n",
    )
    put(tmp_path, "sys.txt", b"Jan 15 14:23:05 host p: msg\n")
    put(tmp_path, "svc.ndjson", b"plain first\n" + b'{"level":"warn","ts":"t"}\n')
    put(tmp_path, "app.log", b"\n2024-01-15 14:23:05 error\n")
    parsed = lw.parse_logs(lw.read_log_lines(spark, str(tmp_path)))
    got = [
        (os.path.basename(r.path), r.line_number, r.format, r.level, r.ts_text)
        for r in parsed.orderBy("path", "line_number").collect()
    ]
    assert got == [
        ("app.log", 1, "Plain text", "unknown", None),
        ("app.log", 2, "Plain text", "error", "2024-01-15 14:23:05"),
        ("device.log", 1, "Logcat", "unknown", None),
        ("device.log", 2, "Logcat", "info", "05-28 14:23:05.123"),
        ("device.log", 3, "Logcat", "error", "05-28 14:23:06.456"),
        ("svc.ndjson", 1, "JSON", "unknown", None),
        ("svc.ndjson", 2, "JSON", "warn", "t"),
        ("sys.txt", 1, "Syslog", "unknown", "Jan 15 14:23:05"),
    ]
    # The same through detection on a frame that has no format yet.
    again = lw.parse_logs(lw.read_log_lines(spark, str(tmp_path)).drop("format"))
    assert sorted(again.collect()) == sorted(parsed.collect())


def test_listing(spark, tmp_path):
    path = put(tmp_path, "a b+c%20.log", b"12345")
    os.utime(path, (1_700_000_000, 1_700_000_000.9))
    rows = lw.list_files(spark, [str(tmp_path), str(tmp_path / ".")]).collect()
    assert [(r.path, r.file_size, r.mtime_secs) for r in rows] == [
        (f"file:{path}", 5, 1_700_000_000)
    ]


def test_nested_folders_and_hidden_names(spark, tmp_path):
    for name in ("y.log", "host=a/x.log", "deep/er/z.log", "_hidden.log", ".dot/w.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        put(tmp_path, name, name.encode() + b"\n")
    seen = ["deep/er/z.log", "host=a/x.log", "y.log"]
    listed = [r.path for r in lw.list_files(spark, str(tmp_path)).collect()]
    assert sorted(p.partition(f"{tmp_path}/")[2] for p in listed) == seen
    scanned = lw.scan_lines(spark, str(tmp_path)).collect()
    assert sorted(r.value for r in scanned) == seen
    numbered = lw.read_log_lines(spark, str(tmp_path)).collect()
    assert sorted(r.value for r in numbered) == seen
    for read in (lw.scan_lines, lw.read_log_lines, lw.list_files):
        with pytest.raises(ValueError, match="_hidden"):
            read(spark, str(tmp_path / "_hidden.log"))


def test_export_keeps_order(spark, lines, tmp_path):
    texts = [f"line {i}" for i in range(1, 5001)]
    frame = lines(texts, "b.log").unionAll(lines(texts, "a.log")).repartition(16)
    out = tmp_path / "out"
    lw.export_lines(frame, str(out))
    written = b"".join(p.read_bytes() for p in sorted(out.glob("part-*")))
    assert written.decode() == "".join(t + "\n" for t in texts) * 2


def test_ingest_follows_its_files(spark, tmp_path):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    a = put(source, "a[1].log", b"INFO one\nERROR two\n")
    put(source, "b.jsonl", b'{"level":"warn"}\n')
    put(source, "c.ndjson", b"\n")
    put(source, "empty.log", b"")  # Spark lists no empty files
    assert lw.ingest(spark, str(source), table, max_files=2) == 2
    manifest = {
        os.path.basename(r.path): (r.file_size, r.format, r.line_count)
        for r in lw.read_manifest(spark, table).collect()
    }
    assert manifest == {
        "a[1].log": (19, "Plain text", 2),
        "b.jsonl": (17, "JSON", 1),
        "c.ndjson": (1, "JSON", 1),
    }
    assert lw.ingest(spark, str(source), table) == 0

    with open(a, "ab") as f:
        f.write(b"ERROR new line\n")
    # A commit that died before its manifest was written stays invisible.
    stray = spark.createDataFrame(
        [("x", 1, "stray", "Plain text", "info", 2, None)],
        "path string, line_number bigint, value string, format string, "
        "level string, level_code tinyint, ts_text string",
    )
    stray.write.parquet(f"{table}/lines/ingest_id=9")
    assert lw.ingest(spark, str(source), table) == 1
    assert values(lw.read_parsed(spark, table)) == [
        ("a[1].log", 1, "INFO one"),
        ("a[1].log", 2, "ERROR two"),
        ("a[1].log", 3, "ERROR new line"),
        ("b.jsonl", 1, '{"level":"warn"}'),
        ("c.ndjson", 1, ""),
    ]
    assert manifest_history(spark, table).count() == 4
    # Same size, other whole second: stale. Same second: fresh.
    stat = os.stat(a)
    os.utime(a, (stat.st_atime, int(stat.st_mtime) + 0.25))
    before = lw.ingest(spark, str(source), table)
    os.utime(a, (stat.st_atime, int(stat.st_mtime) + 0.75))
    assert lw.ingest(spark, str(source), table) == 0
    os.utime(a, (stat.st_atime, int(stat.st_mtime) + 7))
    assert before == 0 and lw.ingest(spark, str(source), table) == 1


def test_ingest_after_crashes(spark, tmp_path):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    for i in range(5):
        put(source, f"f{i}.log", b"INFO %d\n" % i)
    # Runs that died: after their claim, while writing lines, while writing the manifest.
    for number, part in ((0, None), (1, "lines"), (2, "manifest")):
        assert claim(spark, f"{table}/claims/{number}")
        if part:
            claim(spark, f"{table}/{part}/ingest_id={number}/_temporary/0/x")
    assert not claim(spark, f"{table}/claims/0")
    assert lw.ingest(spark, str(source), table, max_files=2) == 3
    ids = {r.ingest_id for r in manifest_history(spark, table).collect()}
    assert ids == {3, 4, 5}
    assert sorted(r.value for r in lw.read_parsed(spark, table).collect()) == [
        f"INFO {i}" for i in range(5)
    ]
    assert lw.ingest(spark, str(source), table) == 0


def test_level_filter_reaches_the_stored_table(spark, tmp_path):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    put(source, "a.log", b"INFO one\nERROR two\n")
    lw.ingest(spark, str(source), table)
    found = lw.search_logs(lw.read_parsed(spark, table), "two", "error")
    plan = found.select("line_number")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(level,error)" in plan
    assert "ts_text" not in plan


def test_shared_folder(spark):
    folder = fresh_dir(spark, "test")
    assert folder.startswith(shared_dir(spark) + "/linewright/test-")
    spark.range(3).write.parquet(folder)
    assert spark.read.parquet(folder).agg(F.sum("id")).first()[0] == 3
    drop_dir(spark, folder)
    with pytest.raises(ValueError):
        drop_dir(spark, "/somewhere/else")


def test_scratch_leaves_nothing(spark, tmp_path):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    for i in range(4):
        put(source, f"f{i}.log", b"INFO a\nERROR b\n" * 20)
    shared = shared_dir(spark)

    def folders():
        path, system = session._file_system(spark, f"{shared}/linewright")
        return {f.getPath().getName() for f in system.listStatus(path)}

    spark.range(1).write.parquet(fresh_dir(spark, "kept"))
    before = folders()
    with lw.scratch(spark):
        lw.ingest(spark, str(source), table)
        put(source, "f1.log", b"WARN c\n")
        lw.ingest(spark, str(source), table)
        lines = lw.read_parsed(spark, table).select("path", "line_number", "value")
        parsed = lw.parse_logs(lines)
        assert lw.match_page(parsed, 0, 5).count() == 16
        with lw.scratch(spark):
            assert lw.read_log_lines(spark, str(source)).count() == 121
        assert lw.next_match(parsed, 3).count() == 4
        assert folders() > before
    assert folders() == before
