"""The source of a folder of growing files: bounds, turns, restarts."""

import json
import random
from re import _parser

import pytest

import linewright as lw
from linewright.functions import patterns as P
from linewright.streaming import folder, sinks, tail


def reader(tmp_path, **options):
    given = {"folder": str(tmp_path / "in"), "state": str(tmp_path / "state")}
    return folder.FolderReader({**given, "batchbytes": "100", **options})


def read(source, start, end):
    """``(name, byte offset, line)`` between two batches."""
    got = []
    for partition in source.partitions({"batch": start}, {"batch": end}):
        for batch in source.read(partition):
            rows = batch.to_pylist()
            got += [(r["path"].rpartition("/")[2], r["byte_offset"], r["value"]) for r in rows]
    return got


def lines_of(path):
    """What :func:`read` should give of a whole file."""
    found, at = [], 0
    for line in path.read_bytes().split(b"\n")[:-1]:
        found.append((path.name, at, line.decode()))
        at += len(line) + 1
    return found


def drain(source, at):
    """Everything from a batch on, batch by batch."""
    batches = []
    while (end := source.latestOffset()["batch"]) > at:
        batches.append(read(source, at, end))
        at = end
    return batches, at


def test_batches_are_bounded_and_whole(tmp_path):
    rng = random.Random(3)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    paths = [tmp_path / "in" / f"{i}.log" for i in range(40)]
    paths.append(tmp_path / "in" / "sub" / "deep.log")
    for path in paths:
        texts = ["x" * rng.choice([0, 3, 20, 40]) for _ in range(rng.randrange(30))]
        path.write_text("".join(t + "\n" for t in texts))
    batches, last = drain(reader(tmp_path), 0)
    assert last == len(batches) > 10
    assert all(sum(len(v) + 1 for _, _, v in batch) <= 100 for batch in batches)
    want = [row for path in paths for row in lines_of(path)]
    assert sorted(row for batch in batches for row in batch) == sorted(want)


def test_restart_at_every_batch(tmp_path):
    (tmp_path / "in").mkdir()
    for name in "abc":
        text = "".join(f"{name} line {i}\n" for i in range(60))
        (tmp_path / "in" / name).write_text(text)
    got, at = [], 0
    while True:
        end = reader(tmp_path).latestOffset()["batch"]
        if end == at:
            break
        # The driver dies once more before Spark has noted the batch.
        later = reader(tmp_path).latestOffset()["batch"]
        got += read(reader(tmp_path), at, later)
        at = later
    want = [row for name in "abc" for row in lines_of(tmp_path / "in" / name)]
    assert sorted(got) == sorted(want) and at > 10


def test_a_line_longer_than_a_batch(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("y" * 1000 + "\nshort\n" + "z" * 500)
    (tmp_path / "in" / "b").write_text("b\n")
    source = reader(tmp_path)
    batches, at = drain(source, 0)
    names = [[(name, len(value)) for name, _, value in batch] for batch in batches]
    assert names == [[("a", 1000)], [("b", 1), ("a", 5)]]
    with (tmp_path / "in" / "a").open("a") as f:
        f.write("z\n")
    batches, _ = drain(source, at)
    assert [[len(v) for _, _, v in batch] for batch in batches] == [[501]]


def test_a_busy_file_starves_none(tmp_path):
    (tmp_path / "in").mkdir()
    busy = tmp_path / "in" / "a"
    busy.write_text("busy line\n" * 100)
    source, at, seen = reader(tmp_path), 0, []
    for i in range(6):
        with busy.open("a") as f:
            f.write("busy line\n" * 100)
        (tmp_path / "in" / f"n{i}").write_text("new\n")
        end = source.latestOffset()["batch"]
        seen += [row[0] for row in read(source, at, end) if row[0] != "a"]
        at = end
    # With one batch of delay every new file has had its turn.
    assert set(seen) >= {f"n{i}" for i in range(4)}


def test_replaced_hidden_and_unwanted(tmp_path):
    (tmp_path / "in" / "_tmp").mkdir(parents=True)
    for name in ("a.log", "_b.log", ".c.log", "_tmp/d.log", "e.gz"):
        (tmp_path / "in" / name).write_text("old one\nold two\n")
    source = reader(tmp_path, pattern="*.log")
    batches, at = drain(source, 0)
    assert batches == [[("a.log", 0, "old one"), ("a.log", 8, "old two")]]
    (tmp_path / "in" / "a.log").write_text("new\n")
    batches, at = drain(source, at)
    assert batches == [[("a.log", 0, "new")]]
    (tmp_path / "in" / "a.log").write_text("other, and longer\n")
    batches, at = drain(reader(tmp_path, pattern="*.log"), at)
    assert batches == [[("a.log", 0, "other, and longer")]]
    (tmp_path / "in" / "a.log").unlink()
    assert drain(source, at) == ([], at)


def test_only_changed_files_are_noted_and_opened(tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for i in range(50):
        (tmp_path / "in" / f"f{i}").write_text("x\n")
    source = reader(tmp_path, batchbytes="1000000")
    _, at = drain(source, 0)
    opened = []

    def counted(path):
        opened.append(path)
        return tail.open_file(path)

    monkeypatch.setattr(folder, "open_file", counted)
    with (tmp_path / "in" / "f7").open("a") as f:
        f.write("y\n")
    end = source.latestOffset()["batch"]
    assert opened == [str(tmp_path / "in" / "f7")]
    plan = json.loads((tmp_path / "state" / f"plan-{end:012d}.json").read_text())
    assert list(plan["places"]) == opened and read(source, at, end) == [("f7", 2, "y")]


def test_snapshots_and_old_plans(tmp_path, monkeypatch):
    monkeypatch.setattr(folder, "PLANS_PER_SNAPSHOT", 4)
    monkeypatch.setattr(folder, "PLANS_KEPT", 6)
    (tmp_path / "in").mkdir()
    log = tmp_path / "in" / "a"
    log.write_text("")
    at, got = 0, []
    for i in range(40):
        with log.open("a") as f:
            f.write(f"line {i}\n")
        source = reader(tmp_path)
        end = source.latestOffset()["batch"]
        got += read(source, at, end)
        source.commit({"batch": end})
        at = end
    assert got == lines_of(log)
    plans = folder.Plans(str(tmp_path / "state"))
    assert plans.numbers("places") == [40] and min(plans.numbers("plan")) == 34
    # A new query can't have what is gone, and a lost state folder is seen.
    with pytest.raises(ValueError, match="no checkpoint"):
        reader(tmp_path).initialOffset()
    other = reader(tmp_path, state=str(tmp_path / "other"))
    assert other.latestOffset() == {"batch": 1}
    with pytest.raises(ValueError, match="ahead"):
        other.partitions({"batch": 40}, {"batch": 1})
    with pytest.raises(FileNotFoundError, match="not of the same query"):
        other.partitions({"batch": 0}, {"batch": 2})
    with pytest.raises(FileExistsError, match="two queries"):
        plans.write("plan", 40, {})


def test_planned_file_that_is_gone(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("a\n")
    (tmp_path / "in" / "b").write_text("b\n")
    assert reader(tmp_path).latestOffset() == {"batch": 1}
    (tmp_path / "in" / "a").unlink()
    with pytest.raises(FileNotFoundError):
        read(reader(tmp_path), 0, 1)
    assert read(reader(tmp_path, missing="skip"), 0, 1) == [("b", 0, "b")]


def test_no_folder_yet_and_bad_options(spark, tmp_path):
    source = reader(tmp_path)
    assert source.initialOffset() == source.latestOffset() == {"batch": 0}
    with pytest.raises(ValueError, match="must not lie"):
        lw.follow_folder(spark, "/a", "/a/state")
    with pytest.raises(ValueError, match="at least one byte"):
        lw.follow_folder(spark, "/a", "/b", batch_bytes=0)
    with pytest.raises(ValueError, match="error or skip"):
        lw.follow_folder(spark, "/a", "/b", missing="ignore")


def test_stream_in_bounded_batches(spark, tmp_path):
    source, state, out, checkpoint = (tmp_path / n for n in ("in", "state", "out", "cp"))
    source.mkdir()

    def stream():
        return lw.follow_folder(spark, str(source), str(state), batch_bytes=400)

    texts = [f"ERROR number {i}" if i % 3 else f"info number {i}" for i in range(200)]
    (source / "a.log").write_text("".join(t + "\n" for t in texts[:100]))
    for _ in range(2):  # each run is a restart, and takes one batch
        sinks.append_available(stream(), str(out), str(checkpoint))
    first = spark.read.parquet(str(out)).count()
    assert 0 < first < 60
    (source / "a.log").write_text("".join(t + "\n" for t in texts))
    (source / "b.log").write_text("".join(t + "\n" for t in texts))
    assert sinks.append_until_idle(stream(), str(out), str(checkpoint)) >= 10
    rows = spark.read.parquet(str(out)).collect()
    got = sorted((r.path.rpartition("/")[2], r.byte_offset, r.value) for r in rows)
    want = lines_of(source / "a.log") + lines_of(source / "b.log")
    assert got == sorted(want)
    assert {r.level for r in rows if r.value.startswith("E")} == {"error"}


def test_formats_are_told_by_few_characters():
    for pattern in (P.LOGCAT_BANNER, P.LOGCAT_TS, P.SYSLOG_TS, P.JSON_START):
        trimmed = pattern.replace(P.LEADING_WS, "").replace(r"\z", r"\Z")
        widest = _parser.parse(trimmed).getwidth()[1]
        # One character more may be looked at after the stamp.
        assert widest + 1 < tail.HEAD_CHARS
