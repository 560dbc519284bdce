import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from linewright.llm import mask_ranking
from linewright.llm.mask_ranking import rank_documents

from .conftest import SCHEMA, prose

ITEMS = "item_id bigint, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=20):
    counted = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    counted = [(d, c) for d, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    found = []
    for item, text in {(i, t) for i, t in items if i is not None and t is not None}:
        ranked = []
        for d, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                ranked.append((-score, d))
        for rank, (score, d) in enumerate(sorted(ranked)[:k], 1):
            found.append((item, rank, d, -score))
    return sorted(found)


def check(spark, docs, rows, items, **options):
    frame = docs(rows).repartition(3).selectExpr("*", "1 AS item_id", "2 AS n", "3 AS terms")
    table = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS doc_id", "2 AS score")
    got = sorted(tuple(r) for r in rank_documents(frame, table, **options).collect())
    assert got == brute(rows, items, options.get("k", 20))
    return got


def corpus(n, seed):
    r = random.Random(seed)
    rows = [(i, prose(r.randrange(n // 2), r.randrange(1, 60))) for i in range(n)]
    rows += [(1000 + i, rows[i][1].upper() + "!") for i in range(0, n, 7)]
    return rows


def test_against_brute_force(spark, docs):
    rows = corpus(300, 1)
    rows += [(5000, None), (5001, ""), (5002, " .,!?\x00 "), (None, rows[0][1]), rows[3], rows[3]]
    rows += [(5003, "Éa éa ÉA ünï 9th 12.5 中文,字"), (5004, prose(77, 30_000))]
    items = [(i, f"{prose(i, 4)}, {prose(i + 3, 9)}") for i in range(40)]
    items += [(50, None), (51, ""), (52, "..."), (None, "ba"), (53, "nowhere at all"), items[0]]
    items += [(1, prose(9, 5)), (54, "Éa 中文 9TH 9th"), (55, prose(77, 300)), (56, "ko " * 50)]
    check(spark, docs, rows, items)
    check(spark, docs, rows, items, k=3)
    # Items in several blocks, each against all documents.
    check(spark, docs, rows, items, item_bytes=600)


def test_blocks_of_documents(spark, docs, monkeypatch):
    rows, items = corpus(200, 2), [(i, prose(i, 12)) for i in range(10)]
    frame = docs(rows).coalesce(1)
    table = spark.createDataFrame(items, ITEMS)
    stored = list(frame.select("doc_id", "text").toArrow().to_batches(max_chunksize=16))
    monkeypatch.setattr(mask_ranking, "BLOCK_DOCS", 48)
    vocabulary = sorted({t for _, text in items for t in mask_ranking._item_terms(text)})
    batches = mask_ranking.postings(frame, vocabulary).toArrow().to_batches(max_chunksize=16)
    sizes = [len(b[0]) for b in mask_ranking._blocks(batches)]
    assert stored and max(sizes) <= 48 and sum(sizes) == len(rows)
    assert sorted(map(tuple, rank_documents(frame, table).collect())) == brute(rows, items)


def test_ties_go_by_id(spark, docs):
    rows = [(i, "ba ko" if i % 2 else "ko ba") for i in range(60)] + [(90, "other words")] * 30
    got = check(spark, docs, rows, [(1, "ko ba"), (2, "words words")])
    assert [r[2] for r in got if r[0] == 1] == list(range(20))
    assert [r[2] for r in got if r[0] == 2] == [90] * 20


def test_groups_below_the_kth_score_are_left_out():
    n = 4000
    rare = np.arange(0, n, 100)
    owner = np.concatenate([np.arange(n), rare])
    names = np.concatenate([np.zeros(n, dtype=np.int64), np.ones(len(rare), dtype=np.int64)])
    block = mask_ranking.Block(
        np.arange(n), np.full(n, 100), owner, names, np.ones(len(owner), dtype=np.int64)
    )
    item = mask_ranking.Item(0, 0, [0, 1], [5, 700])
    # Documents with both terms are one group, and the only one that is scored.
    assert block.search(item, 20) == len(rare)
    assert item.docs.tolist() == rare[:20].tolist()
    assert block.search(item, 20) == len(rare)


def test_large_numbers():
    n = np.array([10**9, 5, 10**6])
    got = mask_ranking._norms(n, 10**11, 7 * 10**17)
    assert got.tolist() == [75 + 25 * int(x) * 10**11 // (7 * 10**17) for x in n]


@pytest.mark.parametrize("rows, items", [([], [(1, "a")]), ([(1, "a")], []), ([], [])])
def test_empty_tables(spark, rows, items):
    frame = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA)
    table = spark.createDataFrame(items, ITEMS)
    assert rank_documents(frame, table).collect() == []
