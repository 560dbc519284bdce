"""Saved searches, the block index, lines picked by ranges."""

import os
import random

import pytest
from pyspark.sql import functions as F

import linewright as lw
from linewright.operators import grams, ranges, saved
from linewright.session import fresh_dir

SCHEMA = "path string, line_number bigint, value string, level string"
WORDS = ["alpha", "Beta", "GAMMA", "δelta", "error", "x", "", "12", "user=7", "ab"]


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, k=r.randrange(5))) for _ in range(n)]


@pytest.fixture
def table(spark):
    """Stored lines of three files, in row groups of a few hundred lines."""
    rows = [
        (path, i, text, ["error", "info"][i % 3 == 0])
        for path, n in (("a.log", 3000), ("b.log", 700), ("it's \\ c", 5))
        for i, text in enumerate(texts(path, n), 1)
    ]
    folder = fresh_dir(spark, "test-lines")
    frame = spark.createDataFrame(rows, SCHEMA).orderBy("path", "line_number").coalesce(1)
    writer = frame.write.option("parquet.block.size", 4096)
    writer = writer.option("parquet.page.size", 1024)
    writer.option("parquet.block.size.row.check.min", 10).parquet(folder)
    return rows, spark.read.schema(SCHEMA).parquet(folder)


def scanned(frame):
    """Rows that the scans of a filter-only plan have put out."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(
        leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())
    )


def keyed(frame):
    return sorted((r.path, r.line_number) for r in frame.collect())


def having(rows, *tests):
    return sorted((p, n) for p, n, v, level in rows if all(t(v, level) for t in tests))


def with_word(word):
    return lambda v, level: word in v.lower()


@pytest.mark.parametrize("size", [64, 256, 1 << 16])
def test_saved_sets(spark, table, monkeypatch, size):
    monkeypatch.setattr(saved, "SET_LINES", size)
    monkeypatch.setattr(saved, "_WORDS", size // 64)
    monkeypatch.setattr(saved, "_EMPTY", f"array_repeat(0L, {size // 64})")
    rows, lines = table
    one = lw.save_search(lw.search_logs(lines, "alpha"))
    two = lw.save_search(lw.search_logs(lines, "", "error"))
    has, bad = with_word("alpha"), lambda v, level: level == "error"
    assert keyed(one.lines(lines)) == having(rows, has)
    assert keyed((one & two).lines(lines)) == having(rows, has, bad)
    assert keyed((one | two).lines(lines)) == sorted({*having(rows, has), *having(rows, bad)})
    rest = sorted({*having(rows, has)} - {*having(rows, bad)})
    less = one - two
    assert keyed(less.lines(lines)) == rest
    counts = {r.path: r.matches for r in less.matches().collect()}
    assert counts == {p: sum(q == p for q, _ in rest) for p in {q for q, _ in rest}}
    for offset, limit in ((0, 3), (60, 50), (99, 1), (10_000, 5)):
        page = less.page(lines, offset, limit).select("path", "line_number", "match_rank")
        want = [
            (p, n, rank)
            for p in {q for q, _ in rest}
            for rank, n in enumerate([n for q, n in rest if q == p], 1)
            if offset < rank <= offset + limit
        ]
        assert sorted(map(tuple, page.collect())) == sorted(want)
    assert keyed(less.nth(lines, 2)) == keyed(less.page(lines, 2, 1))
    nothing = one - one
    assert nothing.sets.count() == 0 and nothing.page(lines, 0, 5).count() == 0


def test_a_page_reads_its_stretch_only(spark, table):
    rows, lines = table
    found = lw.save_search(lw.search_logs(lines, "alpha"))
    page = found.ranks(101, 110)
    span = page.groupBy("path").agg(
        F.min("line_number").alias("low"), F.max("line_number").alias("high")
    )
    read = scanned(ranges.within(lines, span))
    assert 0 < read < len(rows) / 4
    plan = found.page(lines, 100, 10)
    assert plan.count() == 2 * 10


def test_large_sets_stay_small(spark):
    """A match on every line of a long file takes one bit a line."""
    lines = spark.range(1, 1_000_001).selectExpr("'big' AS path", "id AS line_number")
    found = lw.save_search(lines)
    assert found.matches().first().matches == 1_000_000
    folder = found.sets.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    size = sum(f.stat().st_size for f in os.scandir(folder) if f.name.endswith(".parquet"))
    assert size < 200_000
    assert found.nth(lines, 765_432).first().line_number == 765_433


NEEDLES = ["alpha", "ALPHA b", "δEl", "user=7", "ab", "x", "", "nowhere", "12 error", "α"]


@pytest.mark.parametrize("pushed", [200, 0])
def test_index_finds_what_a_search_finds(spark, table, monkeypatch, pushed):
    monkeypatch.setattr(grams, "INDEX_LINES", 32)
    monkeypatch.setattr(ranges, "PUSHED", pushed)
    monkeypatch.setattr(ranges, "BLOCK_LINES", 100)
    rows, lines = table
    index = lw.gram_index(lines.repartition(3)).persist()
    for needle in NEEDLES:
        got = keyed(lw.search_indexed(lines, index, needle, "error"))
        assert got == keyed(lw.search_logs(lines, needle, "error")), needle


def test_blocks_read_fall_with_selectivity(spark, monkeypatch):
    monkeypatch.setattr(grams, "INDEX_LINES", 64)
    n = 20_000
    value = "concat('line ', id, CASE WHEN id % 5000 = 77 THEN ' needle' ELSE '' END)"
    folder = fresh_dir(spark, "test-lines")
    frame = spark.range(1, n + 1).selectExpr("'a' AS path", "id AS line_number", f"{value} AS value")
    frame.coalesce(1).write.option("parquet.block.size", 4096).option(
        "parquet.page.size", 1024
    ).parquet(folder)
    lines = spark.read.parquet(folder)
    index = lw.gram_index(lines).persist()
    assert grams.candidate_blocks(index, "needle").count() == 4
    assert grams.candidate_blocks(index, "line 1").count() > 150
    assert grams.candidate_blocks(index, "no such").count() == 0
    assert grams.candidate_blocks(index, "ne") is None
    found = lw.search_indexed(lines, index, "NEEDLE")
    assert scanned(found) < n / 10
    assert sorted(r.line_number for r in found.collect()) == [77, 5077, 10077, 15077]


def test_pieces_stay_within_a_line(spark, lines):
    index = lw.gram_index(lines(["ab", "cd", "abc", "", "éa"]))
    got = {r.gram for r in index.collect()}
    want = {g for text in ("abc", "éa") for g in grams.needle_grams(spark, text)}
    assert got == want


def test_an_index_that_covers_part_of_a_table(spark, tmp_path):
    source, table = tmp_path / "logs", str(tmp_path / "table")
    source.mkdir()
    (source / "a.log").write_bytes(b"INFO needle one\n" * 3)
    lw.ingest(spark, str(source), table)

    def found(query):
        rows = lw.search_table(spark, table, query).collect()
        return sorted((os.path.basename(r.path), r.line_number) for r in rows)

    assert len(found("needle")) == 3
    (source / "b.log").write_bytes(b"INFO hay\nINFO NEEDLE two\n")
    lw.ingest(spark, str(source), table, index=True)
    assert found("needle") == [("a.log", 1), ("a.log", 2), ("a.log", 3), ("b.log", 2)]
    assert lw.index_table(spark, table) == 1 and lw.index_table(spark, table) == 0
    assert found("needle t") == [("b.log", 2)]
    # From now on the index is kept up, and compacted with the lines.
    (source / "a.log").write_bytes(b"INFO nothing\n")
    with open(source / "b.log", "ab") as f:
        f.write(b"INFO needle three\n")
    lw.ingest(spark, str(source), table)
    assert found("needle") == [("b.log", 2), ("b.log", 3)]
    lw.compact(spark, table)
    assert found("needle") == [("b.log", 2), ("b.log", 3)]
    assert found("ne") == [("b.log", 2), ("b.log", 3)]
    assert lw.index_table(spark, table) == 0
