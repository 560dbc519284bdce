"""The best documents for each item, by groups of documents with the same matched terms.

A document's score for an item is a sum over the item's terms, so which of the terms
it holds, its presence mask, bounds the score from above: the sum of the terms' weights
times the most that any document of the block gets for them. Within a block of documents the
masks of one item are made by bitmap operations over the terms' postings, documents with
equal masks are one group, and the groups are scored from the highest bound down until the
next bound is below the k-th score found. A task takes that score along from block to
block, so later blocks score less, and passes on ``k`` rows an item.

The first pass counts: it writes for every document how many terms it has and which
of the items' terms how often, one row per document where the document is read, without
a shuffle. From that table come N, L and the document frequencies; the search reads
it again. Items are handled in blocks of at most ``ITEM_BYTES`` of text, so the terms that
go to every task are bounded however many items there are, and all documents are ranked
for every block.

Defined cases: a null or empty text has no terms and isn't counted; a very long text is
one row like any other; documents of a null id take no part, nor do items of one; items without
a term, or with terms no document holds, give no rows; equal scores go by id, and rows
that repeat an id are documents of their own; equal item rows count once, items that share
an id but not a text are ranked each by itself; empty tables give no rows; columns besides
``doc_id``, ``item_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import Words, frugal, staged, steps, text_buffers

K = 20
# Bounds on what one task holds: text of the items, documents of a block, its postings.
ITEM_BYTES = 8 << 20
BLOCK_DOCS = 1 << 16
BLOCK_POSTINGS = 4 << 20
# Documents scored at once at first; the steps double.
FIRST_STEP = 256

_POSTINGS = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"
_HITS = "item int, item_id bigint, doc_id bigint, score bigint"

# Every byte that is no part of a term becomes a space, A-Z become a-z.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def term_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``first, terms``: text ``i`` has ``terms[first[i]:first[i + 1]]``, as bytes.

    Each term keeps the space after it, so that they lie one behind the other.
    """
    offsets, raw = text_buffers(texts)
    folded = pa.Array.from_buffers(
        pa.large_string(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_FOLD[raw])],
    )
    words = Words(folded)
    cuts = np.append(words.start, len(words.data)).astype(np.int64)
    terms = pa.Array.from_buffers(
        pa.large_binary(),
        len(words.start),
        [None, pa.py_buffer(cuts), pa.py_buffer(words.data)],
    )
    return words.first, terms


def _item_terms(text: str) -> list[bytes]:
    return term_lists(pa.array([text]))[1].to_pylist()


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, tfs``: a document's count of terms, and those of the vocabulary."""
    known = pa.array(vocabulary, type=pa.large_binary())
    width = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in steps(texts):
                first, terms = term_lists(texts.slice(a, b - a))
                coded = terms.dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1)
                place = place.to_numpy()[coded.indices.to_numpy()].astype(np.int64)
                owner = np.repeat(np.arange(b - a), np.diff(first))
                ours = place >= 0
                keys, tfs = np.unique(
                    owner[ours] * width + place[ours], return_counts=True
                )
                cuts = np.searchsorted(keys, np.arange(b - a + 1) * width)
                cuts = pa.array(cuts.astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32)))
                    for x in (keys % width, tfs)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(np.diff(first).astype(np.int64)),
                        *lists,
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").selectExpr(
        "CAST(doc_id AS BIGINT) AS doc_id", "text"
    )
    return texts.mapInArrow(frugal(count), _POSTINGS).filter("n > 0")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Item:
    """One item's distinct terms, as places in the vocabulary, and what each is worth."""

    def __init__(self, item: int, item_id: int, terms: list[int], gains: list[int]):
        self.item, self.item_id = item, item_id
        self.terms, self.gains = terms, gains
        self.scores = np.zeros(0, dtype=np.int64)
        self.docs = np.zeros(0, dtype=np.int64)

    def least(self, k: int) -> int:
        """The score a document needs at least to be among the best so far."""
        return max(1, int(self.scores[-1])) if len(self.scores) == k else 1

    def add(self, docs: np.ndarray, scores: np.ndarray, k: int) -> None:
        docs = np.concatenate([self.docs, docs])
        scores = np.concatenate([self.scores, scores])
        best = np.lexsort((docs, -scores))[:k]
        best = best[scores[best] > 0]
        self.docs, self.scores = docs[best], scores[best]


class Block:
    """Postings of a block of documents, by term, with what each adds per unit of weight."""

    def __init__(self, docs: np.ndarray, sizes, owner, terms, tfs):
        self.docs = docs
        order = np.argsort(terms, kind="stable")
        self.owner, terms, tfs = owner[order], terms[order], tfs[order].astype(np.int64)
        own = sizes[self.owner]
        self.parts = (1_000_000_000 * tfs) // (1000 * tfs + 12 * own)
        self.names, starts = np.unique(terms, return_index=True)
        self.cuts = np.append(starts, len(terms))
        self.most = np.maximum.reduceat(self.parts, starts) if len(terms) else None

    def term(self, term: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Documents of a term in ascending order, their parts, and the largest of those."""
        at = int(np.searchsorted(self.names, term))
        if at == len(self.names) or self.names[at] != term:
            return None
        a, b = self.cuts[at], self.cuts[at + 1]
        return self.owner[a:b], self.parts[a:b], int(self.most[at])

    def search(self, item: Item, k: int) -> int:
        """Add this block's documents to the item's best; returns how many were scored."""
        found = [(self.term(t), g) for t, g in zip(item.terms, item.gains, strict=True)]
        found = [(*held, gain) for held, gain in found if held and gain > 0]
        bounds = [most * gain for _, _, most, gain in found]
        if not found or sum(bounds) < item.least(k):
            return 0
        # One bit a term: the bitmaps of the terms, laid across the documents.
        words = (len(found) + 63) // 64
        masks = np.zeros((len(self.docs), words), dtype=np.uint64)
        for bit, (owner, _, _, _) in enumerate(found):
            masks[owner, bit // 64] |= np.uint64(1 << (bit % 64))
        matched = np.flatnonzero(masks.any(axis=1))
        masks = masks[matched]
        if words == 1:
            groups, group = np.unique(masks[:, 0], return_inverse=True)
            groups = groups[:, None]
        else:
            groups, group = np.unique(masks, axis=0, return_inverse=True)
        highest = np.zeros(len(groups), dtype=np.int64)
        for bit, bound in enumerate(bounds):
            has = (groups[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
            highest += has.astype(np.int64) * bound
        # Documents in order of their group's bound, whole groups at a time.
        by_bound = np.argsort(-highest, kind="stable")
        rank = np.empty(len(groups), dtype=np.int64)
        rank[by_bound] = np.arange(len(groups))
        group = rank[group.reshape(-1)]
        highest = highest[by_bound]
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(groups)))
        at, done, size = 0, 0, FIRST_STEP
        while at < len(groups) and highest[at] >= item.least(k):
            # Up to the first group that can't reach the k-th score any more.
            within = int(np.searchsorted(-highest, -item.least(k), side="right"))
            upto = int(np.searchsorted(ends, done + size, side="right"))
            upto = max(at + 1, min(upto, within))
            rows = np.sort(matched[order[done : ends[upto - 1]]])
            scores = np.zeros(len(rows), dtype=np.int64)
            for owner, parts, _, gain in found:
                place = np.searchsorted(owner, rows)
                place[place == len(owner)] = 0
                has = owner[place] == rows
                scores[has] += gain * parts[place[has]]
            item.add(self.docs[rows], scores, k)
            at, done, size = upto, int(ends[upto - 1]), 2 * size
        return done


def _norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``100 - 25 + (25 n N) div L`` of each document."""
    if not len(n) or 25 * int(n.max()) * n_docs < 1 << 63:
        return 75 + (25 * n * n_docs) // n_terms
    return np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)


def _search(
    stored: DataFrame, items: list[tuple], n_docs: int, n_terms: int, k: int
) -> DataFrame:
    """``item, item_id, doc_id, score``: at most ``k`` rows an item from each task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Item(*x) for x in items]
        for held in _blocks(batches):
            docs, n, counts, terms, tfs = held
            owner = np.repeat(np.arange(len(docs)), counts)
            block = Block(docs, _norms(n, n_docs, n_terms), owner, terms, tfs)
            for item in own:
                block.search(item, k)
        lengths = [len(x.docs) for x in own]
        if sum(lengths):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([x.item for x in own], lengths), type=pa.int32()),
                    pa.array(np.repeat([x.item_id for x in own], lengths), type=pa.int64()),
                    pa.array(np.concatenate([x.docs for x in own])),
                    pa.array(np.concatenate([x.scores for x in own])),
                ],
                names=["item", "item_id", "doc_id", "score"],
            )

    return stored.mapInArrow(frugal(search), _HITS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Postings of several batches as arrays: ids, sizes, postings a document, terms, tfs."""
    held: list[tuple] = []
    docs = found = 0

    def joined() -> tuple:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for batch in batches:
        lists = batch.column("terms")
        part = (
            batch.column("doc_id").to_numpy(),
            batch.column("n").to_numpy(),
            pc.list_value_length(lists).to_numpy(),
            lists.flatten().to_numpy(),
            batch.column("tfs").flatten().to_numpy(),
        )
        if held and (
            docs + len(part[0]) > BLOCK_DOCS or found + len(part[3]) > BLOCK_POSTINGS
        ):
            yield joined()
            held, docs, found = [], 0, 0
        held.append(part)
        docs, found = docs + len(part[0]), found + len(part[3])
    if docs:
        yield joined()


def _rank_block(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """The best documents of a bounded list of items; None where no item has a term."""
    counted = [Counter(_item_terms(row.text)) for row in rows]
    vocabulary = sorted({term for terms in counted for term in terms})
    if not vocabulary:
        return None
    stored = staged(postings(docs, vocabulary), "postings")
    n_docs, n_terms = stored.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    # One row per term of these items.
    dfs = stored.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    weights = {row["t"]: weight(n_docs, row["count"]) for row in dfs}
    places = {term: i for i, term in enumerate(vocabulary)}
    items = []
    for i, (row, terms) in enumerate(zip(rows, counted, strict=True)):
        held = [(places[t], c) for t, c in terms.items() if places[t] in weights]
        ids = [place for place, _ in held]
        items.append((i, row.item_id, ids, [weights[p] * c for p, c in held]))
    hits = _search(stored, items, n_docs, n_terms, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, of all documents."""
    spark = docs.sparkSession
    texts = items.filter("item_id IS NOT NULL AND text IS NOT NULL").selectExpr(
        "CAST(item_id AS BIGINT) AS item_id", "text"
    )
    texts = texts.distinct()
    size = texts.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // item_bytes)
    # Dealt by hash, a block holds about its share of the text, or one text larger than that.
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    found = None
    for i in range(blocks):
        rows = texts.filter(block == i).orderBy("item_id", "text").collect()
        part = _rank_block(docs, rows, k) if rows else None
        if part is not None:
            part = staged(part, "ranked")
            found = part if found is None else found.unionByName(part)
    if found is None:
        names = "item_id bigint, rank int, doc_id bigint, score bigint"
        return spark.createDataFrame([], names)
    return found
