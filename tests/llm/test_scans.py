import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import contain_minhash, ecoc_language, patience
from linewright.llm.license_texts import TEMPLATES

from .conftest import SCHEMA, prose

ITEMS = "item_id bigint, text string"


def shingles(text):
    import re

    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    if not words:
        return set()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_contained(rows, items):
    texts = {}
    for d, t in rows:
        if d is not None and t is not None:
            texts.setdefault(d, set()).update(shingles(t))
    found = set()
    for i, t in items:
        own = shingles(t)
        for d, have in texts.items():
            if own and i is not None and len(own & have) * 5 >= len(own) * 4:
                found.add((d, i, len(own & have), len(own)))
    return found


def planted_items():
    r = random.Random(5)
    items = [(i, prose(500 + i, 6 + i * 3)) for i in range(25)]
    rows = []
    for n in range(120):
        item = items[n % 25][1].split()
        for _ in range(n % 4):  # changed words may bring it below the threshold
            item[r.randrange(len(item))] = "other"
        text = f"{prose(n, n % 50)}. {' '.join(item).upper()}! {prose(1000 + n, n * 7)}"
        rows.append((n, text))
    rows += [(500, items[3][1] + " " + items[4][1]), (501, ""), (502, None), (None, items[5][1])]
    items += [(50, "one two"), (51, ""), (52, None), (None, "x y z u v"), (53, items[0][1])]
    rows += [(503, "One, TWO."), (504, "one two three"), (505, " !? ")]
    return rows, items


def test_contained_items(spark, docs):
    rows, items = planted_items()
    frame = docs(rows).selectExpr("*", "1 AS item_id", "2 AS h", "3 AS n")
    table = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS doc_id")
    found = contain_minhash.contained_items(frame, table).collect()
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found}
    want = brute_contained(rows, items)
    assert got == want and len(found) == len(want) > 60
    assert all(r.containment == r.n_shared / r.n_item for r in found)
    clean = contain_minhash.keep_clean(frame, table)
    bad = {d for d, *_ in want}
    assert clean.columns == frame.columns
    kept = sorted(str(r.doc_id) for r in clean.collect())
    assert kept == sorted(str(d) for d, _ in rows if d not in bad)


def test_contained_in_empty_tables(spark, docs):
    none, no_items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    some = docs([(1, prose(1, 30))])
    assert contain_minhash.contained_items(none, no_items).count() == 0
    assert contain_minhash.contained_items(some, no_items).count() == 0
    assert contain_minhash.keep_clean(some, no_items).count() == 1


def test_contained_in_odd_rows(spark, odd_docs):
    table = spark.createDataFrame([(1, prose(2, 80)), (1, prose(2, 80))], ITEMS)
    got = contain_minhash.contained_items(odd_docs, table).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(8, 1)]


def languages(n=60):
    kinds = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu", "dd": "éèüñöäß"}
    rows = []
    for i in range(n):
        for j, (lang, letters) in enumerate(kinds.items()):
            r = random.Random(i * 10 + j)
            words = ["".join(r.choices(letters, k=r.randint(1, 6))) for _ in range(1 + i)]
            rows.append((i * 4 + j, " ".join(words), lang))
    return rows


def test_languages(docs):
    rows = languages()
    odd = [(1000, None, "aa"), (1001, "12 !?", "bb"), (1002, "hijk lmn", None), (None, "opq", None)]
    frame = docs(rows + odd + [rows[5], rows[5]]).selectExpr("*", "1 AS score", "'x' AS lang_pred")
    found = ecoc_language.identify(frame).collect()
    assert len(found) == len(rows) + 6
    truth = {r[0]: r[2] for r in rows}
    right = [r.lang_pred == truth[r.doc_id] for r in found if r.doc_id in truth]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[1000].lang_pred == by_id[1001].lang_pred == "und"
    assert by_id[1000].score == 0 and by_id[1002].lang_pred == "bb"
    assert by_id[None].lang_pred == "cc" and by_id[None].held_out is False
    import zlib

    for r in found:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    kept = ecoc_language.keep_identified(frame)
    assert kept.columns == frame.columns and kept.count() == len(found) - 2


def test_languages_do_not_learn_from_held_out_rows(docs):
    rows = languages(30)
    ids = [r[0] for r in rows]
    import zlib

    held = {i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2}
    shuffled = [(i, t, "zz" if i in held else lang) for i, t, lang in rows]
    a = ecoc_language.identify(docs(rows)).collect()
    b = ecoc_language.identify(docs(shuffled)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_languages_of_small_tables(spark, docs):
    assert ecoc_language.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = ecoc_language.identify(docs([(1, "abc", None, None)])).collect()
    assert unlabelled[0].lang_pred == "und"
    single = docs([(1, "abc", "aa"), (5, "xyz", None)])
    assert {r.lang_pred for r in ecoc_language.identify(single).collect()} == {"aa"}


@pytest.mark.parametrize("n", [2, 4, 7, 12, 40])
def test_codewords(n):
    words = ecoc_language.codewords(n)
    apart = (words[:, None] != words[None]).sum(axis=2)
    np.fill_diagonal(apart, 99)
    assert words.shape[0] == n and (np.abs(words.sum(axis=0)) < n).all()
    assert apart.min() >= (1 if n == 2 else 2 if n < 4 else 4)


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def test_alignment_is_a_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a = [r.choice("abcdefghijkl") for _ in range(r.randint(0, 20))]
        b = [r.choice("abcdefghijkl") for _ in range(r.randint(0, 20))]
        pairs = patience.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
        assert len(patience.align(a, a)) == len(a) or len(set(a)) < len(a)


def test_licences(docs):
    changed = TEMPLATES["MIT"].replace("copies", "samples").replace("free of charge", "free")
    rows = [
        (i, f"{prose(i, 40)}\n{text}\n{prose(i + 50, 30)}", name)
        for i, (name, text) in enumerate(TEMPLATES.items())
    ]
    rows += [
        (100, changed, "MIT"),
        (101, " . ".join([TEMPLATES["MIT (short)"]] * 3), "MIT (short)"),
        (102, prose(7, 5000), None),
        (103, "license under the version 2 of it", None),
        (104, None, None),
        (105, "", None),
        (None, TEMPLATES["CC-BY-NC-4.0 (short)"].upper(), "CC-BY-NC-4.0 (short)"),
    ]
    frame = docs(rows).selectExpr("*", "1 AS license", "2 AS start")
    found = patience.scan(frame).collect()
    for doc, text, name in rows:
        own = [r for r in found if r.doc_id == doc]
        assert name in {r.license for r in own} if name else not own
        words = patience.words_of(text or "")
        for r in own:
            notice = patience.words_of(TEMPLATES[r.license])
            assert r.n_matched == lcs(words[r.start : r.end], notice)
            assert r.coverage == r.n_matched / len(notice) >= 0.8
    assert len([r for r in found if r.doc_id == 101 and r.license == "MIT (short)"]) == 3
    spans = sorted((r.start, r.end) for r in found if r.doc_id == 101 and "MIT" in r.license)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_licences_of_odd_tables(spark, odd_docs, docs):
    assert patience.scan(odd_docs).count() == 0
    assert patience.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    some = docs([(1, TEMPLATES["MIT"]), (1, TEMPLATES["MIT"])])
    assert patience.scan(some, {"MIT": TEMPLATES["MIT"]}).count() == 2
    assert patience.scan(some, {}).count() == 0 == patience.scan(some, {"none": ""}).count()
