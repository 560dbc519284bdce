"""Language identification by error-correcting output codes.

Each language has a codeword. For every bit of it a logistic classifier over hashed
byte n-grams tells whether a text's language has that bit set; the language whose
codeword costs least under the classifiers' losses, each weighted by how reliable its
bit proved in training, is the answer. An answer is ambiguous if another codeword costs
nearly as little, and a text is rejected if even the nearest codeword costs as much as
it would under classifiers that know nothing: its bits are no language's.

Texts are counted whole: A-Z in lower case (other letters by Unicode's rules), ASCII
other than letters as a space, square roots of the counts of byte pairs and triples
scaled to length one. The classifiers are fitted on a sample of ``SAMPLE_ROWS`` labelled rows
in all, the same number of each language at most, chosen by a hash of ``doc_id``;
everything else sees every row.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without
any labelled row every text is; with one language every text with a letter is in it.
Rows with a null ``doc_id`` or ``lang`` are not learned from but predicted; repeated rows
keep their number; a very long text is counted whole, in a step by itself; of languages that
cost the same the first by name is the answer; an empty table gives no rows; other columns
take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import Aside, frugal, give_back, steps, text_buffers

UNKNOWN = "und"
# Bound on the labelled rows the classifiers are fitted on, over all languages.
SAMPLE_ROWS = 4000
FEATURES = 4096
# A second codeword of more than this share of the posterior makes an answer ambiguous.
AMBIGUOUS = 0.4
_NEW = ("lang_pred", "score", "ambiguous", "rejected")

# Letters stay, other ASCII is a space, bytes of longer characters stay.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def features_of(texts: pa.Array) -> np.ndarray:
    """One row of length one per text; zero where a text has no n-gram."""
    offsets, raw = text_buffers(pc.utf8_lower(texts))
    code = _FOLD[raw].astype(np.uint32)
    result = np.zeros((len(offsets) - 1, FEATURES), dtype=np.float32)
    if len(code) < 2:
        return result
    pairs = code[:-1] << 8 | code[1:]
    triples = (pairs[:-1] << 8 | code[2:]) * np.uint32(2654435761)
    blank_pair = pairs == 0x2020
    half = FEATURES // 2
    bits = half.bit_length() - 1
    triples = triples >> np.uint32(32 - bits)
    pairs = pairs * np.uint32(2654435761) >> np.uint32(32 - bits)
    blank_triple = blank_pair[:-1] | blank_pair[1:]
    pairs[blank_pair] = half
    triples[blank_triple] = half
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b - a >= 2:
            result[i, :half] = np.bincount(pairs[a : b - 1], minlength=half + 1)[:half]
        if b - a >= 3:
            counts = np.bincount(triples[a : b - 2], minlength=half + 1)
            result[i, half:] = counts[:half]
    np.sqrt(result, out=result)
    norm = np.sqrt((result * result).sum(axis=1, keepdims=True))
    return result / np.maximum(norm, 1e-12)


def codewords(n: int, bits: int = 63) -> np.ndarray:
    """Rows of +1 and -1, one per language.

    Up to seven languages get every useful bit there is (two sides, neither empty,
    no bit twice); more get random words, the best set of many by least distance.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        sides = np.arange(1, 2 ** (n - 1))
        words = np.array([(sides >> i & 1) * 2 - 1 for i in range(n - 1)])
        return np.vstack([-np.ones(len(sides), dtype=int), words])
    random, best, apart = np.random.default_rng(7), None, -1
    for _ in range(200):
        words = random.choice([-1, 1], size=(n, bits))
        words = words[:, np.abs(words.sum(axis=0)) < n]
        agree = words @ words.T
        np.fill_diagonal(agree, -bits)
        if -agree.max() > apart or best is None:
            best, apart = words, -agree.max()
    return best


@dataclass
class Model:
    """Fitted classifiers: a few hundred kilobytes, sent along with the tasks."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def undecided(self) -> float:
        """The loss of any codeword where no classifier leans to either side."""
        return float(self.trust.sum() * np.log(2))

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each row under each language's codeword."""
        margins = x @ self.weights + self.bias
        agree = np.logaddexp(0, -margins) * self.trust
        differ = np.logaddexp(0, margins) * self.trust
        has = (self.words > 0).astype(np.float64)
        return agree @ has.T + differ @ (1 - has).T


def fit(x: np.ndarray, labels: np.ndarray, languages: list[str]) -> Model:
    """All bits' logistic regressions together, by gradient steps with momentum."""
    words = codewords(len(languages))
    bits = words.shape[1]
    weights = np.zeros((x.shape[1], bits), dtype=np.float32)
    bias = np.zeros(bits, dtype=np.float32)
    trust = np.ones(bits)
    if len(languages) > 1:
        target = words[labels].astype(np.float32)
        # Every language weighs the same, whatever its share of the sample.
        share = 1.0 / np.bincount(labels, minlength=len(languages))[labels]
        share = (share / share.sum()).astype(np.float32)[:, None]
        speed, bias_speed = np.zeros_like(weights), np.zeros_like(bias)
        for _ in range(200):
            margins = target * (x @ weights + bias)
            slope = -target * share / (1 + np.exp(np.clip(margins, -30, 30)))
            speed = 0.9 * speed - 8.0 * (x.T @ slope + 1e-6 * weights)
            bias_speed = 0.9 * bias_speed - 0.8 * slope.sum(axis=0)
            weights += speed
            bias += bias_speed
        right = ((target * (x @ weights + bias) > 0) * share).sum(axis=0)
        trust = np.maximum(right.astype(np.float64) * 2 - 1, 0.01)
    return Model(languages, words, weights, bias, trust)


def held_out(doc_id: str = "doc_id"):
    """True for the documents kept for testing: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``doc_id, text, lang`` of the rows that are not held out."""
    rows = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(~held_out())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    languages = sorted(r.lang for r in counts)
    if not languages:
        return Model([], codewords(0), np.zeros((FEATURES, 1)), np.zeros(1), np.ones(1))
    each = max(1, sample_rows // len(languages))
    # A hash threshold leaves about twice the rows wanted, the ranks cut them exactly.
    spark = docs.sparkSession
    shares = spark.createDataFrame(
        [(r.lang, min(1.0, 2.0 * each / r.n)) for r in counts],
        "lang string, share double",
    )
    place = "pmod(xxhash64(doc_id), 1000000) / 1000000.0"
    order = Window.partitionBy("lang").orderBy("_place", "doc_id", F.xxhash64("text"))
    sample = (
        rows.select("doc_id", "text", "lang")
        .join(F.broadcast(shares), "lang")
        .withColumn("_place", F.expr(place))
        .filter("_place < share")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= each)
        .select("text", "lang")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(batch.column("text"), 1 << 20):
                x = features_of(batch.column("text").slice(a, b - a))
                rows = [r.tobytes() for r in x.astype(np.float16)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(a, b - a), pa.array(rows, pa.binary())],
                    names=["lang", "x"],
                )

    got = sample.mapInArrow(frugal(measure), "lang string, x binary").toArrow()
    x, labels = _in_order(got, languages)
    del got
    model = fit(x, labels, languages)
    del x
    give_back()
    return model


def _in_order(got: pa.Table, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of ``lang, x`` in an order that the order of the rows can't change.

    Rows go to their places one batch at a time, so that the matrix is there only once.
    """
    place_of = {name: i for i, name in enumerate(languages)}
    labels = np.array([place_of[v] for v in got["lang"].to_pylist()], dtype=np.int64)
    keys = np.zeros((3, len(labels)), dtype=np.float32)

    def parts() -> Iterator[tuple[int, np.ndarray]]:
        at = 0
        for batch in got.to_batches():
            column = batch.column("x").cast(pa.large_binary())
            if len(column):
                _, cuts, raw = column.buffers()
                first = int(np.frombuffer(cuts, np.int64)[column.offset])
                rows = np.frombuffer(raw, np.float16, len(column) * FEATURES, first)
                yield at, rows.reshape(-1, FEATURES)
            at += len(column)

    for at, rows in parts():
        keys[:, at : at + len(rows)] = rows[:, 1], rows[:, 0], rows.sum(axis=1, dtype=np.float32)
    order = np.lexsort((*keys, labels))
    places = np.empty_like(order)
    places[order] = np.arange(len(order))
    x = np.empty((len(order), FEATURES), dtype=np.float32)
    for at, rows in parts():
        x[places[at : at + len(rows)]] = rows
    return x, labels[order]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``lang_pred, score, ambiguous, rejected`` of each whole text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        last = len(model.languages)
        for batch in batches:
            texts = batch.column("_lid_text")
            some = batch.column("_lid_letter").to_numpy(zero_copy_only=False)
            best, score, unsure, none = [], [], [], []
            for a, b in steps(texts, 1 << 20):
                if not last:
                    best.append(np.full(b - a, last))
                    score.append(np.zeros(b - a))
                    unsure.append(np.zeros(b - a, dtype=bool))
                    none.append(np.zeros(b - a, dtype=bool))
                    continue
                loss = model.losses(features_of(texts.slice(a, b - a)))
                low = loss.min(axis=1, keepdims=True)
                chance = np.exp(low - loss)
                chance /= chance.sum(axis=1, keepdims=True)
                order = np.sort(chance, axis=1)
                second = order[:, -2] if last > 1 else np.zeros(b - a)
                known = some[a:b]
                best.append(np.where(known, loss.argmin(axis=1), last))
                score.append(np.where(known, order[:, -1], 0.0))
                unsure.append(known & (second > AMBIGUOUS))
                far = low[:, 0] >= model.undecided()
                none.append(known & far & (last > 1))
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            carried = [c for c in batch.schema.names if not c.startswith("_lid_")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carried),
                    pa.array(names[join(best, np.int64)].tolist(), pa.string()),
                    pa.array(join(score, np.float64)),
                    pa.array(join(unsure, bool)),
                    pa.array(join(none, bool)),
                ],
                names=[*carried, *_NEW],
            )

    kept = [c for c in docs.columns if c not in _NEW]
    rows = docs.select(
        *kept,
        F.coalesce("text", F.lit("")).alias("_lid_text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_lid_letter"),
    )
    schema = docs.select(
        *kept,
        F.lit("").alias("lang_pred"),
        F.lit(0.0).alias("score"),
        F.lit(True).alias("ambiguous"),
        F.lit(True).alias("rejected"),
    ).schema
    return rows.mapInArrow(frugal(decode), schema)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous, rejected``, learned from the rows."""
    model = learn(docs, sample_rows)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return predict(rows, model).select(
        "doc_id", held_out().alias("held_out"), *_NEW
    )


def keep_identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with a language: those without a letter go, and those that are rejected.

    An ambiguous document stays: it has words of a known language, only too few to
    tell which. Where nothing could be learned, every document with a letter stays. Extra
    columns keep their names and values, whatever they are called.
    """
    aside = Aside(docs, ("doc_id", "text", "lang"))
    model = learn(aside.docs, sample_rows)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        return docs.filter(letter)
    found = predict(aside.docs, model)
    return aside.back(found.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("rejected")))
