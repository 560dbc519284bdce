"""Ingest of files that grow, snapshots, compaction."""

import gzip
import os
import random

import pytest

import linewright as lw
from linewright import session
from linewright.plans import compact as compaction
from linewright.plans import ingest as ingesting
from linewright.sources import byte_ranges


def put(folder, name, data: bytes):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return path


def add(path, data: bytes):
    with open(path, "ab") as f:
        f.write(data)


def lines_of(spark, table):
    rows = lw.read_parsed(spark, table).collect()
    return sorted((os.path.basename(r.path), r.line_number, r.value, r.format) for r in rows)


def expected(*files):
    """Lines of the given (name, bytes, format) as a batch reader sees them."""
    found = []
    for name, data, format in files:
        texts = data.decode().split("\n")
        texts = texts[:-1] if texts[-1] == "" else texts
        found += [(name, i, t.removesuffix("\r"), format) for i, t in enumerate(texts, 1)]
    return sorted(found)


def manifest(spark, table):
    return {os.path.basename(r.path): r for r in lw.read_manifest(spark, table).collect()}


PLAIN = "Plain text"


def test_only_appended_lines_are_read(spark, tmp_path):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    old = b"".join(b"INFO line %06d\n" % i for i in range(20_000))
    path = put(source, "a.log", old)
    lw.ingest(spark, str(source), table)
    # The middle of the old bytes, which a seal doesn't cover, is changed on the quiet:
    # it would show if those bytes were read again.
    middle = len(old) // 2
    assert byte_ranges.HEAD_BYTES < middle < len(old) - byte_ranges.TAIL_BYTES
    with open(path, "r+b") as f:
        f.seek(middle)
        f.write(b"#")
    more = b"".join(b"ERROR more %d\r\n" % i for i in range(200))
    add(path, more)
    assert lw.ingest(spark, str(source), table) == 1
    assert lines_of(spark, table) == expected(("a.log", old + more, PLAIN))
    row = manifest(spark, table)["a.log"]
    assert (row.first_line, row.line_count) == (20_001, 20_200)
    held = spark.read.parquet(f"{table}/lines/ingest_id=1")
    assert held.count() == 200  # one per cent more lines, so many lines read
    assert lw.ingest(spark, str(source), table) == 0


def test_a_changed_start_is_read_whole(spark, tmp_path):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    path = put(source, "a.log", b"INFO one\nINFO two\n")
    other = put(source, "b.log", b"INFO one\nINFO two\n")
    lw.ingest(spark, str(source), table)
    path.write_bytes(b"INFO 1\nINFO two\nINFO three\nINFO 4\n")  # another start
    other.write_bytes(b"INFO one\nINFO TWO\nINFO three\n")  # other bytes before the place
    lw.ingest(spark, str(source), table)
    assert lines_of(spark, table) == expected(
        ("a.log", path.read_bytes(), PLAIN), ("b.log", other.read_bytes(), PLAIN)
    )
    assert {r.first_line for r in manifest(spark, table).values()} == {1}
    # Smaller, and of the same size at another time.
    path.write_bytes(b"x\n")
    other.write_bytes(b"INFO one\nINFO TWO\nINFO THREE\n"[:-1] + b"\n")
    os.utime(other, (1, 1_000_000))
    lw.ingest(spark, str(source), table)
    assert lines_of(spark, table) == expected(
        ("a.log", b"x\n", PLAIN), ("b.log", other.read_bytes(), PLAIN)
    )


def test_unfinished_lines_are_read_again(spark, tmp_path):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    data = b""
    path = put(source, "a.log", b"")
    for piece in (b"no end", b" yet", b", now\nsecond", b"\n", b"\n\nx", b"\xc3", b"\xa9\nlast"):
        add(path, piece)
        data += piece
        assert lw.ingest(spark, str(source), table) == 1
        got = [(n, v) for _, n, v, _ in lines_of(spark, table)]
        want = [x if _valid(x) else b"" for x in data.split(b"\n")]
        want = want[:-1] if want[-1] == b"" and data.endswith(b"\n") else want
        assert got == [(i, x.decode()) for i, x in enumerate(want, 1)]


def _valid(data):
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_formats_and_marks_at_the_start(spark, tmp_path):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    log = put(source, "sys.txt", b"Jan 15 14:23:05 host p: msg\n")
    mark = put(source, "mark.log", b"\xef\xbb\xbfINFO")  # nothing but an unfinished line
    packed = source / "p.log.gz"
    packed.write_bytes(gzip.compress(b"INFO a\n"))
    lw.ingest(spark, str(source), table)
    add(log, b'{"level":"error"}\n')  # the format stays that of the first line
    add(mark, b" one\nWARN two\n")
    packed.write_bytes(gzip.compress(b"INFO a\nINFO b\n" + os.urandom(50).hex().encode() + b"\n"))
    lw.ingest(spark, str(source), table)
    got = lines_of(spark, table)
    assert [g[1:] for g in got if g[0] == "sys.txt"] == [
        (1, "Jan 15 14:23:05 host p: msg", "Syslog"),
        (2, '{"level":"error"}', "Syslog"),
    ]
    assert [g[1:3] for g in got if g[0] == "mark.log"] == [(1, "INFO one"), (2, "WARN two")]
    assert [g[1:3] for g in got if g[0] == "p.log.gz"][:2] == [(1, "INFO a"), (2, "INFO b")]
    assert manifest(spark, table)["p.log.gz"].end_offset is None


def test_a_file_that_grew_while_it_was_read(spark, tmp_path, monkeypatch):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    path = put(source, "a.log", b"INFO 1\nINFO 2\n")
    ends = ingesting.line_ends

    def grows(files):
        add(path, b"INFO grown\n")
        return ends(files)

    monkeypatch.setattr(ingesting, "line_ends", grows)
    lw.ingest(spark, str(source), table)
    assert manifest(spark, table)["a.log"].end_offset is None
    # The next time it is read by ranges, up to the size that was listed, whatever comes.
    lw.ingest(spark, str(source), table)
    row = manifest(spark, table)["a.log"]
    assert (row.first_line, row.line_count, row.end_offset) == (1, 3, 25)
    monkeypatch.undo()
    lw.ingest(spark, str(source), table)
    row = manifest(spark, table)["a.log"]
    assert (row.first_line, row.line_count) == (4, 4)
    assert lines_of(spark, table) == expected(("a.log", path.read_bytes(), PLAIN))


@pytest.mark.parametrize("broadcast_limit", [1 << 26, -1])
def test_many_ranges(spark, tmp_path, monkeypatch, broadcast_limit):
    r = random.Random(3)
    data = "\n".join("é" * r.randrange(40) + str(i) for i in range(4000)).encode()
    path = put(tmp_path, "a b+%41.log", data)
    monkeypatch.setattr(byte_ranges, "RANGE_BYTES", 5000)
    start = data.index(b"\n") + 1
    uri = f"file:{path}"
    files = spark.createDataFrame(
        [(uri, len(data), start, 1, None)],
        "path string, file_size bigint, resume_at bigint, lines_before bigint, format string",
    )
    # Ranges of a few hundred bytes, many of them within a line.
    for size in (7, 300, len(data)):
        got = []
        for lower in range(start, len(data), size):
            upper = min(lower + size, len(data))
            for part in byte_ranges.lines_of_range(uri, lower, upper, len(data), lower == start):
                got += [x.decode() for x in part.to_pylist()]
        assert got == data.decode().split("\n")[1:]
    numbered = byte_ranges.read_appended(spark, files, broadcast_limit)
    rows = numbered.lines.orderBy("line_number").collect()
    assert [(r.line_number, r.value) for r in rows] == list(
        enumerate(data.decode().split("\n")[1:], 2)
    )


def history(spark, source, table):
    """A table whose files were appended to, replaced and left alone; what it should hold."""
    files = {n: put(source, f"{n}.log", b"INFO %s\n" % n.encode() * 30) for n in "abcd"}
    lw.ingest(spark, str(source), table, max_files=3)
    add(files["a"], b"WARN more\nhalf")
    files["b"].write_bytes(b"ERROR new\n" * 5)
    lw.ingest(spark, str(source), table)
    add(files["a"], b" done\n")
    lw.ingest(spark, str(source), table)
    return files


def held(files):
    return expected(*((p.name, p.read_bytes(), PLAIN) for p in files.values()))


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_compaction(spark, tmp_path):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    files = history(spark, source, table)
    assert lines_of(spark, table) == held(files)
    before = plan_of(lw.read_parsed(spark, table))
    assert "Join" in before and "INSET" not in before and " IN (" not in before
    number = lw.compact(spark, table)
    assert lines_of(spark, table) == held(files)
    parsed = lw.read_parsed(spark, table)
    assert "Join" not in plan_of(parsed)
    assert ingesting.folder_numbers(spark, f"{table}/lines") == [number]
    assert ingesting.folder_numbers(spark, f"{table}/manifest") == []
    assert spark.read.parquet(f"{table}/lines").count() == len(held(files))
    assert lw.ingest(spark, str(source), table) == 0
    # It goes on from there, and is compacted again.
    add(files["a"], b"INFO a\n")
    add(files["c"], b"INFO c")
    files["d"].write_bytes(b"short\n")
    assert lw.ingest(spark, str(source), table) == 1
    assert manifest(spark, table)["c.log"].first_line == 31
    assert lines_of(spark, table) == held(files)
    lw.compact(spark, table)
    lw.compact(spark, table)
    assert lines_of(spark, table) == held(files)
    assert "Join" not in plan_of(lw.read_parsed(spark, table))
    assert lw.ingest(spark, str(source), table) == 0


def test_compaction_of_some_folders(spark, tmp_path):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    files = history(spark, source, table)
    # Folder 0 (a, b, c) has superseded lines of b; the others keep their place.
    number = lw.compact(spark, table, min_share=0.2, small_lines=0)
    assert sorted(ingesting.folder_numbers(spark, f"{table}/lines")) == [1, 2, 3, number]
    assert lines_of(spark, table) == held(files)
    # Superseded rows in folders that stayed are still left out later.
    add(files["a"], b"x\ny")
    lw.ingest(spark, str(source), table)
    add(files["a"], b"z\n")
    files["b"].write_bytes(b"ERROR b\n" * 7)
    lw.ingest(spark, str(source), table)
    assert lines_of(spark, table) == held(files)
    lw.snapshot(spark, table)
    assert lines_of(spark, table) == held(files)
    lw.compact(spark, table)
    assert lines_of(spark, table) == held(files)


def test_superseded_lines_by_blocks(spark, tmp_path, monkeypatch):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    files = history(spark, source, table)
    monkeypatch.setattr(ingesting, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(ingesting, "BLOCK_LINES", 7)
    assert lines_of(spark, table) == held(files)
    lw.compact(spark, table)
    assert lines_of(spark, table) == held(files)


# A step, and whether it is done or not yet when the run dies.
STEPS = [
    ("_rewrite", True),
    ("_write_snapshot", True),
    ("claim", False),
    ("drop_replaced", False),
    ("drop_part", True),
]


@pytest.mark.parametrize("step, after", STEPS)
def test_compaction_dies(spark, tmp_path, monkeypatch, step, after):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    files = history(spark, source, table)
    whole = getattr(compaction, step)
    calls = []

    def dies(*args):
        calls.append(args)
        if step == "claim" and not args[1].endswith("_DONE"):
            return whole(*args)
        if after:
            whole(*args)
        raise KeyboardInterrupt

    monkeypatch.setattr(compaction, step, dies)
    with pytest.raises(KeyboardInterrupt):
        lw.compact(spark, table)
    assert calls
    monkeypatch.undo()
    assert lines_of(spark, table) == held(files)
    add(files["d"], b"after\n")
    lw.ingest(spark, str(source), table)
    assert lines_of(spark, table) == held(files)
    lw.compact(spark, table)
    assert lines_of(spark, table) == held(files)
    assert lw.ingest(spark, str(source), table) == 0


def test_a_commit_during_a_compaction(spark, tmp_path, monkeypatch):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    files = history(spark, source, table)
    write = compaction._write_snapshot

    def meanwhile(*args):
        add(files["c"], b"meanwhile\n")
        lw.ingest(spark, str(source), table)
        write(*args)

    monkeypatch.setattr(compaction, "_write_snapshot", meanwhile)
    lw.compact(spark, table)
    monkeypatch.undo()
    assert lines_of(spark, table) == held(files)
    assert lw.ingest(spark, str(source), table) == 0
    lw.compact(spark, table)
    assert lines_of(spark, table) == held(files)


def test_a_second_compaction_gives_up(spark, tmp_path, monkeypatch):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    files = history(spark, source, table)
    write = compaction._write_snapshot

    def meanwhile(*args):
        monkeypatch.undo()
        lw.compact(spark, table)
        write(*args)

    monkeypatch.setattr(compaction, "_write_snapshot", meanwhile)
    with pytest.raises(RuntimeError, match="another compaction"):
        lw.compact(spark, table)
    assert lines_of(spark, table) == held(files)


def test_snapshots_by_themselves(spark, tmp_path, monkeypatch):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    monkeypatch.setattr(ingesting, "SNAPSHOT_COMMITS", 3)
    path = put(source, "a.log", b"")
    for i in range(7):
        add(path, b"INFO %d\n" % i)
        lw.ingest(spark, str(source), table)
        assert len(ingesting.folder_numbers(spark, f"{table}/manifest")) < 3
    assert lines_of(spark, table) == expected(("a.log", path.read_bytes(), PLAIN))
    assert manifest(spark, table)["a.log"].line_count == 7


def test_only_parts_are_dropped(spark, tmp_path):
    for folder in (str(tmp_path), f"{tmp_path}/lines", f"{tmp_path}/claims/3"):
        with pytest.raises(ValueError):
            session.drop_part(spark, folder)
