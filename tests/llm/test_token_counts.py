import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from linewright.llm import token_counts
from linewright.llm.token_counts import TokenCounter, count_tokens, pieces

from .conftest import SCHEMA, prose

TEXTS = [
    "", " ", "Hello, World. it's  don't'S we'LL", "<|endoftext|> x<|endoftext|>9<|endo",
    "a  b   c \n\n d\t\te  ", "é é ́x 9th 12.5, ½ ǅ ß ΑΣ", "中文字。العربية 🙂🙂‍🙂",
    "x" * 5000, "1a2b3c-4d_5e" * 300, " " * 3000 + "end", "'s't're" * 200, "a|b|c|" * 200,
    "nbsp and em\u0085nel", prose(4, 2000), "word.\n" * 700, "<|endoftext|>" * 100,
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def count(plain, text):
    return len(plain.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("batch", [1, 500, 1 << 20])
def test_counts_as_the_library(plain, piece, batch):
    got = TokenCounter().count(pa.array([*TEXTS, None]), piece, batch)
    assert got.tolist() == [count(plain, t) for t in [*TEXTS, None]]


ODD = st.text(
    alphabet=st.one_of(
        st.sampled_from("ab1 .'|<>\n\tsé中٣ ́"), st.characters(exclude_categories=["Cs"])
    ),
    max_size=60,
)
STRINGS = st.lists(st.one_of(ODD, st.just("<|endoftext|>"), st.just("it's")), max_size=6)


@settings(max_examples=300, deadline=None)
@given(STRINGS, st.integers(1, 12))
def test_pieces_never_change_a_count(parts, piece):
    text = "".join(parts)
    plain = test_pieces_never_change_a_count.counter
    assert plain.count(pa.array([text]), piece)[0] == plain.lengths([text])[0]


test_pieces_never_change_a_count.counter = TokenCounter()


def test_pieces_cover_a_text():
    import numpy as np

    data = np.frombuffer(prose(9, 4000).encode(), dtype=np.uint8)
    found = pieces(data, 1000)
    assert found[0][0] == 0 and found[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert max(b - a for a, b in found) <= 1000
    assert pieces(np.frombuffer(b"x" * 5000, dtype=np.uint8), 1000) == [(0, 5000)]


def test_only_byte_level_texts_are_cut():
    assert TokenCounter().cuts
    assert not TokenCounter("word_bpe_49k.json").cuts


def test_table(spark, odd_docs, plain):
    rows = odd_docs.collect()
    frame = odd_docs.selectExpr("*", "1 AS n_tokens", "2 AS n_bytes", "true AS over_limit")
    got = [tuple(r) for r in count_tokens(frame).collect()]
    want = [
        (r.doc_id, len((r.text or "").encode()), count(plain, r.text), count(plain, r.text) > 512)
        for r in rows
    ]
    order = lambda r: (r[0] is None, r)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_limit_and_empty_table(spark, docs):
    frame = docs([(1, "a b c"), (2, "a b c d")])
    got = {r.doc_id: r.over_limit for r in count_tokens(frame, limit=3).collect()}
    assert got == {1: False, 2: True}
    assert count_tokens(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_are_cut(monkeypatch, plain):
    counter, calls = TokenCounter(), []
    lengths = counter.lengths
    monkeypatch.setattr(counter, "lengths", lambda x: calls.append(list(x)) or lengths(x))
    text = prose(3, 200_000)
    assert counter.count(pa.array([text, "x"]))[0] == count(plain, text)
    sizes = [sum(map(len, x)) for x in calls]
    assert max(len(t) for x in calls for t in x) <= token_counts.PIECE_BYTES
    assert max(sizes) <= token_counts.BATCH_BYTES + token_counts.PIECE_BYTES
