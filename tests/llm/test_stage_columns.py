"""Stages of the pipeline on rows with columns named like their own helpers."""

import re
from pathlib import Path

import pytest

import linewright.llm
from linewright.llm import contain_minhash, ecoc_language, rlz_dedup, simhash

from .conftest import SCHEMA, prose

ITEMS = "item_id bigint, text string"
FOLDER = Path(linewright.llm.__file__).parent


def helper_names(*modules):
    """Every quoted name in some modules that could be a column's."""
    found = set()
    for module in (*modules, "common", "components"):
        source = (FOLDER / f"{module}.py").read_text()
        found |= set(re.findall(r"\b_?[a-z][a-z0-9_]*\b", " ".join(re.findall(r'"([^"\n]*)"', source))))
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars", "as", "and"})


def widened(frame, names):
    return frame.selectExpr("*", *[f"doc_id * 7 + {i} AS `{n}`" for i, n in enumerate(names)])


STAGES = {
    "ecoc_language": ecoc_language.keep_identified,
    "simhash": simhash.keep_first,
    "rlz_dedup": rlz_dedup.remove_copies,
}


@pytest.mark.parametrize("module", STAGES)
def test_columns_like_the_stage_s_own(docs, module):
    shared = prose(1, 70)
    rows = [(i, f"{prose(50 + i, 30)} {shared}", ["aa", "bb"][i % 2]) for i in range(6)]
    plain = docs([*rows, (9, rows[0][1], "aa"), (10, "12", "aa")])
    names = helper_names(module)
    assert len(names) > 20
    want = {(r.doc_id, r.text) for r in STAGES[module](plain).collect()}
    out = STAGES[module](widened(plain, names))
    assert out.columns == [*plain.columns, *names]
    got = out.collect()
    assert {(r.doc_id, r.text) for r in got} == want
    for r in got:
        assert [r[n] for n in names] == [r.doc_id * 7 + i for i in range(len(names))]


def test_columns_like_the_containment_s_own(spark, docs):
    items = spark.createDataFrame([(1, prose(5, 30))], ITEMS)
    rows = [(1, prose(1, 80)), (2, f"{prose(2, 40)} {prose(5, 30)}"), (3, None)]
    names = helper_names("contain_minhash")
    out = contain_minhash.keep_clean(widened(docs(rows), names), widened_items(items, names))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert out.columns[-len(names) :] == names


def widened_items(items, names):
    names = [n for n in names if n != "item_id"]
    return items.selectExpr("*", "1 AS doc_id", *[f"{i} AS `{n}`" for i, n in enumerate(names)])


def test_without_labels_texts_with_letters_stay(spark):
    rows = [(1, "some words", None, "s", 1), (2, "12 34", None, "s", 1), (3, None, None, "s", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [r.doc_id for r in ecoc_language.keep_identified(frame).collect()] == [1]


def test_texts_of_no_language_are_rejected(docs):
    """Bits that lean to no codeword are an error the code detects, not a language."""
    import numpy as np
    import pyarrow as pa

    words = ecoc_language.codewords(4)
    bits = words.shape[1]
    weights = np.zeros((ecoc_language.FEATURES, bits), dtype=np.float32)
    model = ecoc_language.Model(list("abcd"), words, weights, words[2] * 2.0, np.ones(bits))
    x = ecoc_language.features_of(pa.array(["some text"]))
    assert model.losses(x).argmin() == 2 and model.losses(x).min() < model.undecided()
    # Every second bit of the codeword turned round.
    model.bias = words[2] * np.where(np.arange(bits) % 2, 2.0, -2.0)
    assert model.losses(x).min() >= model.undecided()
    frame = docs([(1, "some text"), (2, "12")])
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in ecoc_language.predict(frame, model).collect()}
    assert got[1][1] and got[2] == ("und", False)


def test_languages_of_the_given_documents_are_kept(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in ecoc_language.keep_identified(frame).collect()}
    letters = frame.filter(r"text RLIKE '\\p{L}'").select("doc_id").collect()
    assert kept == {r.doc_id for r in letters}
