"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Fingerprints: words are runs outside white space, A-Z in lower case; every three
consecutive words (all of them, if fewer) joined by a space are hashed by XXH64, and a
bit of the fingerprint is set where more than half of the hashes have it.

Links: fingerprints that differ in at most ``radius`` bits. Cut into more blocks than
that, two of them agree in the blocks left over, so each choice of blocks gives buckets
of candidates. Within a bucket, 64 fingerprints at a time are held as bit planes; the
distances of a fingerprint to all of them grow plane by plane in carry-save counters,
and a block is abandoned once every counter has passed the radius. A bucket gives
only the links that join its parts, never all its pairs.

Defined cases: a null or empty text or one of white space has fingerprint zero,
which links like any other; rows with a null ``doc_id`` are left out of the result, as
they can't name a group; repeated rows keep their number; a very long text is a step by
itself; distances that tie are all links alike; an empty table gives no rows; columns besides
``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.lookup import BROADCAST_BYTES, store_measured
from .common import Words, frugal, join_side, partitions, signed, staged, steps
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
# Larger buckets are compared in parts of this many fingerprints, two parts at a time.
BUCKET = 8192
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """``hashes, n``: text ``i`` has the next ``n[i]`` of the hashes."""
    import xxhash

    words = Words(texts, lower=True)
    n_words = np.diff(words.first)
    n = np.maximum(n_words - shingle + 1, np.minimum(n_words, 1))
    ends = np.cumsum(n)
    # The words each shingle starts and ends with.
    doc = np.repeat(np.arange(len(n)), n)
    head = words.first[doc] + np.arange(len(doc)) - (ends - n)[doc]
    tail = head + np.minimum(shingle, n_words)[doc] - 1
    data, digest = words.data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (
            digest(data[a:b], SEED)
            for a, b in zip(
                words.start[head].tolist(), words.end[tail].tolist(), strict=True
            )
        ),
        dtype=np.uint64,
        count=len(head),
    )
    return hashes, n


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text of an Arrow array, as unsigned 64-bit values."""
    return _majority(*shingle_hashes(texts, shingle))


def _majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per group of ``n`` consecutive hashes, the bits more than half of them have.

    Eight counters share a word: bytes count up to 255 hashes before they are added up.
    """
    result = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return result
    size = n[some]
    first = np.cumsum(size) - size
    runs = -(-size // 255)
    run_first = np.cumsum(runs) - runs
    run = np.repeat(np.arange(len(some)), runs)
    cuts = first[run] + 255 * (np.arange(len(run)) - run_first[run])
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, cuts)
        counts = np.add.reduceat(
            sums.view(np.uint8).reshape(-1, 8).astype(np.int64), run_first, axis=0
        )
        is_set = (counts * 2 > size[:, None]).astype(np.uint64)
        places = np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit)
        result[some] |= (is_set << places).sum(axis=1, dtype=np.uint64)
    return result


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *others: str) -> DataFrame:
    """``doc_id, fp``: fingerprints of whole texts, as signed 64-bit values.

    ``others`` are SQL of named whole numbers that go along with each row.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            along = [name for name in batch.schema.names if name != "text"]
            for a, b in steps(batch.column("text"), 2 << 20):
                fp = fingerprints_of(batch.column("text").slice(a, b - a), shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(name).slice(a, b - a) for name in along),
                        pa.array(signed(fp)),
                    ],
                    names=[*along, "fp"],
                )

    rows = docs.filter("doc_id IS NOT NULL").selectExpr(
        "CAST(doc_id AS BIGINT) AS doc_id", *others, "text"
    )
    names = ", ".join(f"{name} bigint" for name in rows.columns if name != "text")
    return rows.mapInArrow(frugal(compute), f"{names}, fp bigint")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """``planes[i, p]``: bit ``p`` of the fingerprints ``64 * i`` to ``64 * i + 63``."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    turned = bits.reshape(-1, 64, 64).transpose(0, 2, 1)
    packed = np.packbits(turned, axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(-1, 64)


def within_radius(queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """Of each query of each row, a mask of the row's 64 fingerprints within the radius.

    ``queries`` and ``planes`` are (rows, 64). The counters start so far up that they
    overflow just beyond the radius; overflow stays set, and rows in which it is set
    everywhere are dropped on the way.
    """
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    beyond = np.zeros_like(queries)
    result = np.zeros_like(queries)
    counters = [
        np.full_like(queries, _ALL if start >> i & 1 else 0) for i in range(width)
    ]
    rows = np.arange(len(queries))
    one = np.uint64(1)
    for p in range(64):
        wanted = np.uint64(0) - ((queries >> np.uint64(p)) & one)
        carry = planes[:, p, None] ^ wanted
        for counter in counters:
            over = counter & carry
            counter ^= carry
            carry = over
        beyond |= carry
        if p % 8 == 7 and p > radius:
            alive = (beyond != _ALL).any(axis=1)
            if alive.sum() < 0.7 * len(alive):
                rows, queries, planes = rows[alive], queries[alive], planes[alive]
                beyond = beyond[alive]
                counters = [c[alive] for c in counters]
    result[rows] = ~beyond
    return result


def _join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the pairs ``a, b`` into a table of parents; every parent is a root."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        low = np.minimum(a, b)[apart]
        high = np.maximum(a, b)[apart]
        np.minimum.at(parent, high, low)
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent = further
        a, b = low, high
    return parent


def linked(group: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by ``group``, the first row each one hangs together with.

    Groups hang together inside only, unless rows of two groups in the same block
    happen to be within the radius, which is a link all the same.
    """
    n = len(fps)
    padded = np.zeros(-(-n // 64) * 64, dtype=np.uint64)
    padded[:n] = fps
    planes, queries = bit_planes(padded), padded.reshape(-1, 64)
    blocks = len(planes)
    heads = group[::64]
    lasts = group[np.minimum(np.arange(blocks) * 64 + 63, n - 1)]
    # A block is compared with itself and with those after it its last group reaches.
    reach = np.searchsorted(heads, lasts, side="right")
    reach = np.maximum(reach, np.arange(blocks) + 1)
    count = reach - np.arange(blocks)
    left = np.repeat(np.arange(blocks), count)
    right = left + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
    parent = np.arange(n)
    for at in range(0, len(left), 512):
        x, y = left[at : at + 512], right[at : at + 512]
        hits = within_radius(queries[x], planes[y], radius)
        pair, query = np.nonzero(hits)
        found = np.ascontiguousarray(hits[pair, query])
        bits = np.unpackbits(
            found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        which, place = np.nonzero(bits)
        a = x[pair[which]] * 64 + query[which]
        b = y[pair[which]] * 64 + place
        good = (a < b) & (b < n)
        parent = _join_up(parent, a[good], b[good])
    return parent


def _block_keys(n_fps: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each table, the (first bit, width) of the blocks that make up its key.

    More tables with longer keys once buckets would outgrow one block of planes.
    """
    blocks = radius + 1
    while blocks < radius + 3:
        key_bits = 64 * (blocks - radius) // blocks
        if n_fps >> key_bits < 64:
            break
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = list(zip(cuts[:-1], np.diff(cuts).tolist(), strict=True))
    return [list(x) for x in combinations(parts, blocks - radius)]


def close_links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links that join all nodes (``fp, node``, fp distinct) within the radius."""
    spark = nodes.sparkSession
    tables = []
    for i, parts in enumerate(_block_keys(nodes.count(), radius)):
        key, shift = f"CAST({i} AS BIGINT)", 0
        for first, width in parts:
            piece = f"(shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L)"
            key, shift = f"(shiftleft({key}, {width}) | {piece})", shift + width
        tables.append(key)
    keyed = nodes.selectExpr("fp", "node", f"explode(array({', '.join(tables)})) AS key")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.filter(F.col("n") > bucket)
    sizes = sizes.selectExpr("key", f"CAST(n DIV {bucket} + 1 AS INT) AS parts")
    large, size = store_measured(sizes, "llm-large-buckets")
    large = F.broadcast(large) if size <= BROADCAST_BYTES else large
    # A row of a bucket in several parts meets each part once.
    part = "pmod(xxhash64(fp), parts)"
    other = "explode(sequence(0, coalesce(parts, 1) - 1)) AS other"
    dealt = (
        keyed.join(large, "key", "left")
        .selectExpr("*", f"CAST(coalesce({part}, 0) AS INT) AS part")
        .selectExpr("key", "fp", "node", "part", other)
        .selectExpr("key", "fp", "node", "least(part, other) AS p", "greatest(part, other) AS q")
        .repartition(partitions(spark), "key", "p", "q")
        .sortWithinPartitions("key", "p", "q", "fp")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
            fps = rows["fp"].to_numpy().view(np.uint64)
            node = rows["node"].to_numpy()
            first = linked(group, fps, radius)
            apart = first != np.arange(len(first))
            return pa.RecordBatch.from_arrays(
                [pa.array(node[apart]), pa.array(node[first[apart]])], names=["a", "b"]
            )

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            group = _groups(rows)
            # The last group may go on in the next batch.
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield links(rows.slice(0, whole), group[:whole])
            held = rows.slice(whole)
        if held is not None and held.num_rows:
            yield links(held, _groups(held))

    return dealt.mapInArrow(frugal(compare), "a bigint, b bigint")


def _groups(rows: pa.Table) -> np.ndarray:
    change = np.zeros(rows.num_rows, dtype=bool)
    for name in ("key", "p", "q"):
        column = rows[name].to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.cumsum(change)


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """``doc_id, fp, component_id``: the least ``doc_id`` each row hangs together with."""
    prints = staged(fingerprints(docs, shingle), "fingerprints")
    # Equal fingerprints are one node, named by its least document.
    nodes = staged(
        prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes"
    )
    roots = components(close_links(nodes, radius))
    named = nodes.join(roots, "node", "left").select(
        "fp", F.coalesce("root", "node").alias("component_id")
    )
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(groups: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` with the fingerprint in hexadecimal."""
    return groups.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def first_of_groups(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """``id, hash, n``: of each group the row with the least id, and how often it is there.

    Rows are named by their id and a hash of their text. Groups are those of
    :func:`near_duplicates`, over fingerprints instead of ids, so that rows which share an
    id but not a text do not join their groups.
    """
    named = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    prints = staged(
        fingerprints(named, shingle, "xxhash64(text) AS hash")
        .groupBy("fp", "doc_id", "hash")
        .agg(F.count(F.lit(1)).alias("n")),
        "near-prints",
    )
    # A fingerprint of any number of rows is one node from here on.
    least = F.min(F.struct("doc_id", "hash", "n")).alias("first")
    nodes = staged(prints.groupBy("fp").agg(least), "near-nodes")
    roots = components(close_links(nodes.selectExpr("fp", "fp AS node"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return (
        rooted.groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("first").alias("first"))
        .selectExpr("first.doc_id AS id", "first.hash AS hash", "first.n AS n")
    )


def keep_first(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group of near copies: the one with the least id.

    Near copies are rows whose fingerprints hang together within ``radius`` bits, as for
    :func:`near_duplicates`.

    Defined cases: texts without words are one group; rows with a null ``doc_id`` belong to
    no group and stay; rows that share an id but not a text are documents of their own, and
    of those with the least id in one group the one whose text has the least hash stays; of
    rows that repeat an id and its text one stays; a very long text is one row like any
    other; extra columns keep their names and values, whatever they are called.
    """
    stay = staged(first_of_groups(docs, radius, shingle), "near-firsts")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("bigint").alias("id"),
        F.xxhash64("text").alias("hash"),
    )
    kept = join_side(rows, stay, ["id", "hash"], "left", "24", "near-firsts")
    once = kept.filter("id IS NULL OR n = 1")
    if not stay.filter("n > 1").isEmpty():
        again = kept.filter("n > 1").dropDuplicates(["id", "hash"])
        once = once.unionByName(again)
    return once.select("row.*")
