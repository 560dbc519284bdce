import corpus_pipeline
from linewright.llm import queries, rlz_dedup

from .conftest import SCHEMA, prose
from .test_dedup import brute_copies, brute_groups, brute_print, key
from .test_scans import brute_contained

ITEMS = "item_id bigint, text string"


def rows_and_items():
    shared = prose(0, 70)
    items = [(i, prose(900 + i, 30)) for i in range(5)]
    rows = [(i, prose(i + 1, 60 + i), "aa") for i in range(40)]
    rows += [(100 + i, rows[i][1], "aa") for i in range(5)]
    rows += [(200 + i, f"{prose(300 + i, 80)} {shared} {prose(400 + i, 50)}", "aa") for i in range(6)]
    rows += [(300 + i, f"{prose(600 + i, 70)} {items[i][1]} {prose(700 + i, 70)}", "aa") for i in range(5)]
    rows += [(400, None, "aa"), (401, "12 34", "aa"), (402, "", None), (403, "short", None)]
    return rows, items


def test_stages_against_brute_force(spark, docs, tmp_path):
    rows, items = rows_and_items()
    frame = docs(rows).selectExpr("*", "'x' AS fp", "1 AS h")
    stages = dict(corpus_pipeline.STAGES)
    columns = frame.columns
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")

    def step(name, before):
        after = stages[name](spark, before, str(tmp_path))
        assert after.columns == columns
        return after, sorted(((r.doc_id, r.text) for r in after.collect()), key=key)

    frame, left = step("language", frame)
    want = [(d, t) for d, t, _ in rows if t and any(c.isalpha() for c in t)]
    assert left == sorted(want)

    frame, left = step("near_duplicates", frame)
    roots = brute_groups({d: brute_print(t) for d, t in want})
    want = [(d, t) for d, t in want if roots[d] == d]
    assert left == sorted(want) and not any(100 <= d < 105 for d, _ in left)

    frame, left = step("substrings", frame)
    shas = [r[3] for r in sorted(brute_copies(want))]
    got = sorted(
        (r.doc_id, r.kept_sha256) for r in rlz_dedup.digest(frame).collect()
    )
    assert [s for _, s in got] == shas
    want = left

    frame, left = step("decontaminate", frame)
    bad = {d for d, *_ in brute_contained(want, items)}
    assert left == [(d, t) for d, t in want if d not in bad] and len(bad) == 5

    packed = stages["packing"](spark, frame, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in left}


def test_run_and_registration(spark, docs, tmp_path):
    rows, items = rows_and_items()
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in packed}
    assert 0 in ids and not ids & {100, 300, 400, 401, 402}
    for name in ("op1_rlz_dedup", "op3_token_files", "op4_ecoc_language", "op5_kd_shards"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == len(rows)


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
