"""Decoding of language codewords, held against a sum over bits, word by word."""

import math

import pyarrow as pa
import pytest

from linewright.llm import ecoc_language as ecoc

TEXTS = {
    "aa": "the quick brown fox jumps over the lazy dog and runs through the green field",
    "bb": "der schnelle braune fuchs springt ueber den faulen hund und laeuft durch das feld",
    "cc": "быстрая коричневая лиса прыгает через ленивую собаку и бежит по полю",
    "dd": "le renard brun saute par dessus le chien paresseux et court dans la prairie",
}


def sample():
    """Rows of each language: its words, turned round by some places."""
    rows = []
    for lang, text in TEXTS.items():
        words = text.split()
        for i in range(40):
            at = i % len(words)
            rows.append((len(rows), " ".join(words[at:] + words[:at]) * (1 + i % 3), lang))
    return rows


def brute_force(model, text):
    """``lang_pred, score, ambiguous, rejected`` by the module's description."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, False, False
    x = ecoc.features_of(pa.array([text]))[0].astype(float)
    costs, know_nothing = [], 0.0
    for bit in range(model.words.shape[1]):
        know_nothing += model.trust[bit] * math.log(2)
    for word in model.words:
        cost = 0.0
        for bit in range(model.words.shape[1]):
            margin = float(x @ model.weights[:, bit].astype(float)) + float(model.bias[bit])
            agreed = margin if word[bit] > 0 else -margin
            cost += float(model.trust[bit]) * math.log1p(math.exp(-agreed))
        costs.append(cost)
    best = min(range(len(costs)), key=lambda i: (costs[i], i))
    chances = [math.exp(costs[best] - c) for c in costs]
    chances = sorted(c / sum(chances) for c in chances)
    return model.languages[best], chances[-1], chances[-2] > ecoc.AMBIGUOUS, costs[best] >= know_nothing


def test_decoding_against_every_codeword(docs):
    rows = sample()
    model = ecoc.learn(docs(rows))
    assert model.languages == sorted(TEXTS)
    mixed = " ".join(TEXTS.values())
    odd = [(1000, mixed), (1001, "zq xj"), (1002, "a"), (1003, "?! 12"), (1004, ""), (1005, None)]
    frame = docs([(d, t, None) for d, t in odd] + rows)
    got = {r.doc_id: r for r in ecoc.predict(frame, model).collect()}
    for doc, text in [*odd, *((r[0], r[1]) for r in rows)]:
        lang, score, ambiguous, rejected = brute_force(model, text)
        row = got[doc]
        assert row.lang_pred == lang
        assert row.score == pytest.approx(score, abs=1e-3)
        assert (row.ambiguous, row.rejected) == (ambiguous, rejected)
    held = [r for r in rows if got[r[0]].lang_pred == r[2]]
    assert len(held) == len(rows)
