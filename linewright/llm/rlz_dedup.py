"""Substring dedup by relative Lempel-Ziv parsing against all earlier documents.

A document's factors are its longest runs of words that copy one place of a document
with a smaller ``doc_id``. Factors of ``window`` words or more are duplicate spans,
and every word that some such factor covers is removed.

Reference blocks. Of the ``anchor``-word shingles in a window of words, the one with
the least hash is its anchor. Neighbouring windows mostly share it, so a text falls
into blocks: the windows with one anchor and the words they cover. Where a block
begins and ends depends on its words alone, so a long copy shows the same blocks
wherever it stands, and every block of every document is indexed by its anchor and
the hash of its words.

Parsing. A block whose words stand in an earlier document is copied as a whole, and
copies that go on in the same place of the same document join into one factor. Where a
copy begins or ends inside a block its words differ from the reference's: at such
factor boundaries, that is where one anchor has several blocks, each window is looked
up by itself. A block that stands in many documents is looked up once, for the first
of them. So the result is exact: a window is copied if and only if its words start in
a document with a smaller id.

Defined cases: null, empty and short texts have no window and lose nothing; rows with
the same ``doc_id`` are one document to each other: neither removes words of the
other; a null ``doc_id`` takes no part (nothing is removed, nothing is removed for
it); an empty table gives no rows. The text that is left is its words joined by one
space; a text of which nothing is removed is given in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Aside, KeySet, Words, frugal, mix, signed, staged, steps

WINDOW = 50
ANCHOR = 8
# Bytes of text parsed at once.
_STEP = 1 << 20


def _anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle at each word, and for each window its anchor's word.

    Values near the end of a text reach into the next one; no whole window uses them.
    """
    codes = words.hashes()
    n = len(codes)
    shingles = np.zeros(n, dtype=np.uint64)
    for j in range(anchor):
        shingles[: n - j] = shingles[: n - j] * np.uint64(0xD6E8FEB86659FD93)
        shingles[: n - j] += codes[j:]
    shingles = mix(shingles)
    best = np.arange(n)
    width = window - anchor + 1

    def leaner(left: np.ndarray, shift: int) -> np.ndarray:
        right = left[np.minimum(np.arange(n) + shift, n - 1)]
        return np.where(shingles[left] <= shingles[right], left, right)

    span = 1
    while span * 2 <= width:
        best = leaner(best, span)
        span *= 2
    if span < width:
        best = leaner(best, width - span)
    return shingles, best


def _digest(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    """128-bit hashes of slices, as two signed 64-bit columns."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    raw = b"".join(
        [digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    )
    pairs = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def blocks_of(
    texts: pa.Array, window: int = WINDOW, anchor: int = ANCHOR
) -> dict[str, np.ndarray]:
    """Blocks of a batch: row, anchor hash, first window, windows, hash of the words."""
    words = Words(texts)
    n_words = np.diff(words.first)
    n_windows = np.maximum(n_words - window + 1, 0)
    row = np.repeat(np.arange(len(n_words)), n_windows)
    local = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = words.first[row] + local
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return dict(row=row, h=none, s=none, m=none, c1=none, c2=none, words=n_words)
    shingles, best = _anchors(words, window, anchor)
    best = best[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    m = np.diff(np.append(head, len(at)))
    first = at[head]
    c1, c2 = _digest(
        words.data.tobytes(), words.start[first], words.end[first + m - 1 + window - 1]
    )
    return dict(
        row=row[head],
        h=signed(shingles[best[head]]),
        s=local[head],
        m=m,
        c1=c1,
        c2=c2,
        words=n_words,
    )


_BLOCK = (
    "doc_id bigint, t bigint, h bigint, s int, m int, c1 bigint, c2 bigint"
)
_FACTORS = "array<struct<start:int,length:int,ref_doc:bigint,ref_start:int>>"


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, t, text``: ``t`` tells apart texts that share a ``doc_id``."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def index_blocks(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """Every reference block of every document, stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(batch.column("text"), _STEP):
                found = blocks_of(batch.column("text").slice(a, b - a), window, anchor)
                row = pa.array(found["row"] + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(row),
                        batch.column("t").take(row),
                        pa.array(found["h"]),
                        pa.array(found["s"].astype(np.int32)),
                        pa.array(found["m"].astype(np.int32)),
                        pa.array(found["c1"]),
                        pa.array(found["c2"]),
                    ],
                    names=["doc_id", "t", "h", "s", "m", "c1", "c2"],
                )

    rows = _keyed(docs.filter("doc_id IS NOT NULL"))
    return staged(rows.mapInArrow(frugal(cut), _BLOCK), "blocks")


def _expand(docs: DataFrame, reps: DataFrame, window: int) -> DataFrame:
    """``w1, w2, doc_id, c1, j``: each window of the blocks ``reps`` (doc_id, s, m, c1, c2)."""
    wanted = reps.groupBy("doc_id").agg(
        F.collect_set(F.struct("s", "m", "c1", "c2")).alias("blocks")
    )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("blocks")
            for a, b in steps(texts, _STEP):
                words = Words(texts.slice(a, b - a))
                part = lists.slice(a, b - a)
                owner = np.repeat(np.arange(b - a), pc.list_value_length(part))
                flat = part.flatten()
                s, m, c1, c2 = (
                    flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)
                )
                first = words.first[owner] + s
                last = first + m + window - 2
                # A row that shares its doc_id with the block's may be shorter.
                fits = np.flatnonzero(last < words.first[owner + 1])
                owner, m, c1, c2, first, last = (
                    x[fits] for x in (owner, m, c1, c2, first, last)
                )
                data = words.data.tobytes()
                d1, d2 = _digest(data, words.start[first], words.end[last])
                same = np.flatnonzero((d1 == c1) & (d2 == c2))
                owner, m, c1, first = (x[same] for x in (owner, m, c1, first))
                each = np.repeat(np.arange(len(m)), m)
                j = np.arange(len(each)) - np.repeat(np.cumsum(m) - m, m)
                head = first[each] + j
                w1, w2 = _digest(data, words.start[head], words.end[head + window - 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w1),
                        pa.array(w2),
                        batch.column("doc_id").take(pa.array(owner[each] + a)),
                        pa.array(c1[each]),
                        pa.array(j.astype(np.int16)),
                    ],
                    names=["w1", "w2", "doc_id", "c1", "j"],
                )

    texts = KeySet(reps.select("doc_id").distinct(), "doc_id").among(_keyed(docs), "doc_id")
    rows = texts.join(wanted, "doc_id").select("doc_id", "text", "blocks")
    schema = "w1 bigint, w2 bigint, doc_id bigint, c1 bigint, j smallint"
    return staged(rows.mapInArrow(frugal(windows), schema), "windows")


def copied_blocks(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """``doc_id, t, s, m, ref_doc, ref_s``: windows that stand in an earlier document.

    ``m`` windows from ``s`` on, at ``ref_s`` of document ``ref_doc``; a window found at
    a factor boundary has no ``ref_s``.
    """
    blocks = index_blocks(docs, window, anchor)
    shared = (
        blocks.groupBy("h")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .filter("least < most")
        .select("h")
    )
    shared = staged(shared, "shared-anchors")
    blocks = KeySet(shared, "h").among(blocks, "h").join(shared, "h")
    blocks = staged(blocks.select("h", "doc_id", "t", "s", "m", "c1", "c2"), "shared")
    kinds = staged(
        blocks.groupBy("h", "c1", "c2").agg(
            F.min(F.struct("doc_id", "s")).alias("ref"), F.min("m").alias("m")
        ),
        "block-kinds",
    )
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    reps = kinds.join(mixed, "h", "left_semi").select(
        "ref.doc_id", "ref.s", "m", "c1", "c2"
    )
    windows = _expand(docs, staged(reps, "boundary-blocks"), window)
    firsts = (
        windows.groupBy("w1", "w2")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .drop("last")
    )
    firsts = staged(firsts, "shared-windows")
    marks = (
        KeySet(firsts, "w1")
        .among(windows, "w1")
        .join(firsts, ["w1", "w2"])
        .filter("doc_id > first")
        .select("doc_id", "c1", "j", F.col("first").alias("ref_doc"))
        .dropDuplicates(["doc_id", "c1", "j"])
    )
    known = blocks.join(kinds.select("h", "c1", "c2", "ref"), ["h", "c1", "c2"])
    whole = known.filter("ref.doc_id < doc_id").selectExpr(
        "doc_id", "t", "s", "m", "ref.doc_id AS ref_doc", "ref.s AS ref_s"
    )
    edges = (
        known.filter("ref.doc_id = doc_id")
        .select("doc_id", "t", "s", "c1")
        .join(marks, ["doc_id", "c1"])
        .selectExpr(
            "doc_id", "t", "CAST(s + j AS INT) AS s", "1 AS m", "ref_doc",
            "CAST(NULL AS INT) AS ref_s",
        )
    )
    return whole.unionByName(edges)


def parse_factors(
    found: list[tuple], window: int = WINDOW
) -> list[tuple[int, int, int, int | None]]:
    """Greedy factors ``(start, length, ref_doc, ref_start)`` in words, from copied windows.

    From left to right, a factor goes on as long as the next windows are copies from
    the same place of the same document.
    """
    factors: list[list] = []
    for s, m, ref_doc, ref_s in sorted(found, key=lambda x: (x[0], x[3] is None)):
        end = s + m + window - 1
        if factors:
            start, length, doc, ref = factors[-1]
            adjacent = s <= start + length - window + 1 and doc == ref_doc
            if adjacent and (ref_s is None or ref is None or ref_s - s == ref - start):
                factors[-1][1] = max(length, end - start)
                if ref is None and ref_s is not None:
                    factors[-1][3] = ref_s - (s - start)
                continue
        factors.append([s, end - s, ref_doc, ref_s])
    return [tuple(x) for x in factors]


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, t, found``: what each document copies from earlier ones."""
    copied = copied_blocks(docs, window, anchor)
    # At most as many as the document has windows; equal rows give one set.
    return copied.groupBy("doc_id", "t").agg(
        F.collect_set(F.struct("s", "m", "ref_doc", "ref_s")).alias("found")
    )


def _kept(words: Words, doc: int, spans: list) -> tuple[bytes, int]:
    """The words left of a text, joined by one space, and the number removed."""
    first, after = int(words.first[doc]), int(words.first[doc + 1])
    if first == after:
        return b"", 0
    view = words.data
    if not spans:
        return view[words.start[first] : words.end[after - 1]].tobytes(), 0
    gone = np.zeros(after - first + 1, dtype=np.int64)
    for start, length, *_ in spans:
        gone[start] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True]))))
    pieces = [
        view[words.start[first + a] : words.end[first + b - 1]].tobytes()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
    ]
    return b" ".join(pieces), int(gone.sum())


def _with_found(
    docs: DataFrame, window: int, anchor: int
) -> tuple[KeySet, DataFrame, DataFrame]:
    """Which documents may have copies; ``docs`` ready to be told so; those with theirs.

    ``_rlz_text`` is the text, ``_rlz_hash`` what the set is asked for, ``_rlz_found`` the
    copied windows. Only texts that may have copies are shuffled.
    """
    found = factors(docs, window, anchor).selectExpr(
        "doc_id AS _rlz_doc", "t AS _rlz_t", "found AS _rlz_found"
    )
    found = staged(found, "factors")
    some = KeySet(found.select("_rlz_doc").distinct(), "_rlz_doc")
    rows = docs.withColumns(
        {
            "_rlz_doc": F.col("doc_id").cast("bigint"),
            "_rlz_text": F.coalesce("text", F.lit("")),
            "_rlz_t": F.xxhash64(F.coalesce("text", F.lit(""))),
        }
    )
    all_rows = rows.withColumn("_rlz_hash", F.xxhash64("_rlz_doc"))
    told = some.among(rows, "_rlz_doc").join(found, ["_rlz_doc", "_rlz_t"], "left")
    return some, all_rows, told


def digest(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, factors`` of every document."""

    def rows_of(ids: pa.Array, texts: pa.Array, lists: list) -> Iterator[pa.RecordBatch]:
        for a, b in steps(texts, _STEP):
            words = Words(texts.slice(a, b - a))
            removed, digests, parsed = [], [], []
            for i, rows in enumerate(lists[a:b]):
                spans = parse_factors(
                    [(x["s"], x["m"], x["ref_doc"], x["ref_s"]) for x in rows or ()],
                    window,
                )
                kept, n = _kept(words, i, spans)
                removed.append(n)
                digests.append(hashlib.sha256(kept).hexdigest())
                parsed.append(
                    [
                        dict(start=s, length=n, ref_doc=d, ref_start=r)
                        for s, n, d, r in spans
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a),
                    pa.array(np.diff(words.first).astype(np.int64)),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(parsed, _FACTOR_TYPE),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "factors"],
            )

    some, rows, told = _with_found(docs, window, anchor)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            free = pa.array(~some.holds(batch.column("_rlz_hash").to_numpy()))
            batch = batch.filter(free)
            yield from rows_of(
                batch.column("_rlz_doc"), batch.column("_rlz_text"), [None] * len(batch)
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("_rlz_found").to_pylist()
            yield from rows_of(batch.column("_rlz_doc"), batch.column("_rlz_text"), found)

    schema = (
        "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, "
        f"factors {_FACTORS}"
    )
    free = rows.select("_rlz_doc", "_rlz_text", "_rlz_hash").mapInArrow(frugal(whole), schema)
    told = told.select("_rlz_doc", "_rlz_text", "_rlz_found").mapInArrow(frugal(cut), schema)
    return free.unionByName(told)


_FACTOR_TYPE = pa.list_(
    pa.struct(
        [
            ("start", pa.int32()),
            ("length", pa.int32()),
            ("ref_doc", pa.int64()),
            ("ref_start", pa.int32()),
        ]
    )
)


def remove_copies(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """``docs`` with the words of every factor gone from ``text``; other columns as they are.

    A text that loses words is given as its kept words joined by one space; any other
    text, null included, stays as it is. ``n_chars``, where there is one, follows. Extra
    columns keep their names and values, whatever they are called.
    """
    aside = Aside(docs, ("doc_id", "text", "n_chars"))
    return aside.back(_remove_copies(aside.docs, window, anchor))


def _remove_copies(docs: DataFrame, window: int, anchor: int) -> DataFrame:

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("_rlz_text"), batch.column("_rlz_found")
            result = []
            for a, b in steps(texts, _STEP):
                lists = found.slice(a, b - a)
                if lists.null_count == b - a:
                    result += [None] * (b - a)
                    continue
                words = Words(texts.slice(a, b - a))
                for i, rows in enumerate(lists.to_pylist()):
                    copied = [(x["s"], x["m"], x["ref_doc"], x["ref_s"]) for x in rows or ()]
                    spans = parse_factors(copied, window)
                    kept = _kept(words, i, spans)[0].decode() if spans else None
                    result.append(kept)
            names = [c for c in batch.schema.names if c not in ("_rlz_text", "_rlz_found")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(result, pa.string())],
                names=[*names, "_rlz_kept"],
            )

    some, rows, told = _with_found(docs, window, anchor)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            free = pa.array(~some.holds(batch.column("_rlz_hash").to_numpy()))
            yield batch.drop_columns(["_rlz_hash"]).filter(free)

    schema = T.StructType([*docs.schema.fields, T.StructField("_rlz_kept", T.StringType())])
    new = {"text": F.coalesce("_rlz_kept", "text")}
    if "n_chars" in docs.columns:
        length = F.length("_rlz_kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.coalesce(length, "n_chars")
    told = (
        told.select(*docs.columns, "_rlz_text", "_rlz_found")
        .mapInArrow(frugal(rewrite), schema)
        .withColumns(new)
        .select(*docs.columns)
    )
    free = rows.select(*docs.columns, "_rlz_hash").mapInArrow(frugal(untouched), docs.schema)
    return free.unionByName(told)
