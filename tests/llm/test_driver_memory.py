"""What the pipeline's stages take on the driver: jobs, copies of the sample, broadcasts."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from linewright.llm import common, components, ecoc_language, simhash

from .conftest import prose


@pytest.fixture
def collections(spark):
    """How often the driver's garbage was collected because it was asked for."""
    factory = spark._jvm.java.lang.management.ManagementFactory
    beans = factory.getGarbageCollectorMXBeans()
    old = next(b for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))
    return old.getCollectionCount


def test_a_stored_table_relieves_a_grown_heap(spark, monkeypatch, collections):
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0, raising=False)
    before = collections()
    assert common.staged(spark.range(3), "relief").count() == 3
    assert collections() > before


def test_a_small_heap_is_left_alone(spark, monkeypatch, collections):
    monkeypatch.setattr(common, "HEAP_SHARE", 1.0, raising=False)
    before = collections()
    common.staged(spark.range(3), "no-relief")
    assert collections() == before


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_a_stage_begins_with_a_collected_heap(spark, docs, tmp_path, monkeypatch, collections, name):
    """The session is its own executor here; the driver's own relief is off."""
    monkeypatch.setattr(common, "HEAP_SHARE", 1.0)
    frame = docs([(i, prose(i, 30)) for i in range(4)])
    spark.createDataFrame([(0, prose(9, 30))], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    before = collections()
    dict(corpus_pipeline.STAGES)[name](spark, frame, str(tmp_path))
    assert collections() > before


def test_a_round_of_components_is_one_job_with_its_sums(spark):
    """A chain takes several rounds; each used to run another job to see if it changed."""
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    read = []
    frame = type(links)
    first = frame.first

    def counted(self):
        read.append(1)
        return first(self)

    frame.first = counted
    try:
        found = components.components(links).collect()
    finally:
        frame.first = first
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(41)}
    assert not read


def test_no_links_have_no_components(spark):
    links = spark.createDataFrame([(1, 1)], "a bigint, b bigint")
    assert components.components(links).collect() == []


def _sample(n):
    r = np.random.default_rng(3)
    rows = r.random((n, ecoc_language.FEATURES), dtype=np.float32).astype(np.float16)
    rows[n // 2 :, :2] = rows[: n - n // 2, :2]
    langs = [("de", "en", "fr")[i % 3] for i in range(n)]
    return rows, langs


def _table(rows, langs, cut):
    return pa.Table.from_batches(
        [
            pa.RecordBatch.from_arrays(
                [
                    pa.array(langs[a:b], pa.string()),
                    pa.array([x.tobytes() for x in rows[a:b]], pa.binary()),
                ],
                names=["lang", "x"],
            )
            for a, b in ((0, cut), (cut, cut), (cut, len(rows)))
        ]
    )


def test_the_sample_is_in_memory_once():
    rows, langs = _sample(600)
    got = _table(rows, langs, 250)
    tracemalloc.start()
    x, labels = ecoc_language._in_order(got, ["de", "en", "fr"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.2 * x.nbytes
    # The same rows in the same order as by sorting copies of the whole.
    whole = np.array([("de", "en", "fr").index(v) for v in langs])
    order = np.lexsort((rows[:, 1], rows[:, 0], rows.sum(axis=1, dtype=np.float32), whole))
    assert np.array_equal(x, rows[order].astype(np.float32))
    assert np.array_equal(labels, whole[order])


def test_the_order_rows_arrive_in_does_not_matter():
    rows, langs = _sample(60)
    mixed = np.random.default_rng(4).permutation(60)
    a = ecoc_language._in_order(_table(rows, langs, 20), ["de", "en", "fr"])
    b = ecoc_language._in_order(
        _table(rows[mixed], [langs[i] for i in mixed], 41), ["de", "en", "fr"]
    )
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_a_side_counts_as_large_as_the_driver_holds_it(spark, docs, monkeypatch):
    """Two keys and a number take about 108 bytes there, not 24."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 40 * 60)
    frame = docs([(i, prose(i, 30)) for i in range(40)])
    kept = simhash.keep_first(frame)
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
