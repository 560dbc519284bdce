"""Costs that grow with the number of files, and with the lines that name them."""

import time

from pyspark.sql import functions as F

import linewright as lw
from linewright import session
from linewright.functions import formats
from linewright.plans import ingest as ingesting
from linewright.sources import byte_ranges
from workload import inputs


def test_file_names(spark):
    names = {
        "file:/t/app-1.txt": "app-1",
        "/a.txt/b.txt": "b",
        "c.txt.txt": "c.txt",
        "/d/.txt": "",
        "/d/e.txt/": "",
        "/d/e.txt\n": "",
        "/d/e\nf.txt": "e\nf",
        "/d/e.log": "",
    }
    frame = spark.createDataFrame([(p,) for p in names], "path string")
    got = frame.select("path", inputs.file_id(F.col("path"))).collect()
    assert dict(map(tuple, got)) == names


def test_a_file_name_costs_no_square_of_its_folder(spark):
    frame = spark.range(8).select(F.repeat(F.lit("x"), 100_000).alias("folder"))
    frame = frame.select(F.concat(F.lit("/"), "folder", F.lit("/a.txt")).alias("path"))
    start = time.perf_counter()
    got = {r[0] for r in frame.select(inputs.file_id(F.col("path"))).collect()}
    assert got == {"a"} and time.perf_counter() - start < 5


def test_a_task_lists_many_files(spark, tmp_path):
    paths = [tmp_path / f"{i}.log" for i in range(150)]
    for i, path in enumerate(paths):
        path.write_text(f"line {i}\n")
    before = spark.conf.get(session._LISTING, None)
    context = spark.sparkContext
    context.setJobGroup("listing", "")
    try:
        lines = lw.scan_lines(spark, [str(path) for path in paths])
        tracker = context.statusTracker()
        stages = [
            tracker.getStageInfo(stage)
            for job in tracker.getJobIdsForGroup("listing")
            for stage in tracker.getJobInfo(job).stageIds
        ]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages) <= 4 * context.defaultParallelism
    assert lines.count() == len(paths)
    assert spark.conf.get(session._LISTING, None) == before


def test_files_are_looked_at_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"x\n")
    files = spark.range(40).groupBy((F.col("id") % 40).alias("n")).count()
    files = files.selectExpr(
        f"concat('{tmp_path}/', if(n = 7, 'a', 'b'), '.log') AS path",
        "2L AS file_size",
        "true AS exact",
        "n",
    )
    ends = byte_ranges.line_ends(files)
    assert {(r.n, r.end_offset) for r in ends.collect() if r.end_offset} == {(7, 2)}
    assert ends.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_an_index_goes_through_the_lines_once(spark, tmp_path, monkeypatch):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("".join(f"line {i}\n" for i in range(500)))
    seen = spark.sparkContext.accumulator(0)
    note = F.udf(lambda value: seen.add(1) or value, "string")
    name = "line_pieces" if hasattr(ingesting, "line_pieces") else "gram_index"
    build = getattr(ingesting, name)
    monkeypatch.setattr(
        ingesting, name, lambda lines: build(lines.withColumn("value", note("value")))
    )
    table = str(tmp_path / "table")
    lw.ingest(spark, str(tmp_path / "logs"), table, index=True)
    assert seen.value == 500
    assert lw.search_table(spark, table, "LINE 77").count() == 1


def _made(spark, lines, *kept):
    frame = spark.createDataFrame(lines, "file string, position bigint, value string")
    return inputs.make_files(frame, *kept)


def _texts(folder):
    return {p.relative_to(folder).as_posix(): p.read_bytes() for p in folder.rglob("*.txt")}


def test_made_files_are_written_like_their_lines(spark, tmp_path):
    lines = [("a", 2, "two"), ("a", 0, "né"), ("b/c", 1, "x"), ("a", 1, "1"), ("b/c", 4, "")]
    every, even = _made(spark, lines, "true", "position % 2 = 0")
    frame = spark.createDataFrame(lines, "file string, position bigint, value string")
    for number, (made, kept) in enumerate(
        [(every, "true"), (even, "position % 2 = 0"), (every.filter("file <> 'a'"), "file <> 'a'")]
    ):
        for share in (0.0, 0.37, 1.0):
            one, other = (tmp_path / f"{number}-{share}-{kind}" for kind in "lm")
            inputs.write_files(frame.filter(kept), str(one), share=share)
            inputs.write_files(made, str(other), share=share)
            assert _texts(one) == _texts(other) != {}
    # A file without a line of a condition isn't there.
    (none,) = _made(spark, lines, "file = 'a' AND position = 1")
    assert [r.file for r in none.collect()] == ["a"]


def test_lines_are_made_once_for_all_states_of_their_files(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    note = F.udf(lambda value: seen.add(1) or value, "string")
    lines = spark.range(60).selectExpr(
        "CAST(id % 3 AS STRING) AS file", "id AS position", "CAST(id AS STRING) AS value"
    )
    (made,) = inputs.make_files(lines.withColumn("value", note("value")), "true")
    for share in (0.3, 0.6, 1.0):
        inputs.write_files(made, str(tmp_path), share=share)
    assert seen.value == 60
    assert _texts(tmp_path)["2.txt"].split() == [str(i).encode() for i in range(2, 60, 3)]


def test_a_path_costs_no_square_of_its_length(spark):
    frame = spark.range(8).select(F.repeat(F.lit("x"), 100_000).alias("folder"))
    frame = frame.select(F.concat(F.lit("/"), "folder", F.lit("/a.JSON")).alias("path"))
    start = time.perf_counter()
    got = {r[0] for r in frame.select(F.expr(formats.has_json_extension("path"))).collect()}
    assert got == {True} and time.perf_counter() - start < 5


def test_format_of_odd_names_and_first_lines(spark):
    names = {
        "/a.json": "JSON", "/b/c.JsonL": "JSON", "x.ndjson": "JSON", "é.json": "JSON",
        "a..json": "JSON", "json": "Plain text", ".json": "Plain text", "/.ndjson": "Plain text",
        "/a.json/": "Plain text", "/a.json\n": "Plain text", "ajson": "Plain text",
        "a.json.gz": "Plain text", "q.ajson": "Plain text", "a.json/b": "Plain text",
    }
    lines = {
        "": "Plain text", "{": "JSON", "\t [": "JSON", "\u0085{": "JSON", "\x1c{": "Plain text",
        "--------- beginning of main": "Logcat", " --------- beginning": "Logcat",
        "---------": "Plain text", "01-02 03:04:05.678": "Logcat",
        "　01-02 03:04:05.678 x": "Logcat", "01-02 03:04:05.678x": "Plain text",
        "Jan 02 03:04:05": "Syslog", " Jan  2 03:04:05 h": "Syslog", "Jan  2 03:04:05": "Plain text",
        "a{": "Plain text", "é{": "Plain text", "2024-01-02 {": "Plain text",
    }
    cases = [(n, "", want) for n, want in names.items()]
    cases += [("/a.txt", text, want) for text, want in lines.items()]
    frame = spark.createDataFrame(cases, "path string, first string, want string")
    got = frame.withColumn("got", F.expr(formats.detect_format("path", "first")))
    assert [r for r in got.collect() if r.got != r.want] == []
