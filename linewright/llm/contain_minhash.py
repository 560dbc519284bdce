"""Benchmark decontamination by size-partitioned MinHash containment search.

Texts are lower-cased, cut into words of letters and digits, and taken as sets of
five-word shingles. A document contains an item if at least ``CONTAINED`` of the item's
shingles stand in it; documents may be any number of times longer than items.

Search. Items are parted by their number of shingles in powers of two. Of a part
whose largest item has ``n`` shingles, each item's ``floor(n / 5) + 1`` least hashes are its
sketch. A document that misses no more than a fifth of the item's shingles has some of
its sketch; how many at least follows from the item's own size. So comparing a
document's hashes up to the largest sketch value with the sketches finds every document
there is to find, whatever its length, and few others.

Check. Only documents found are cut again, and their shingles compared as text.

All work is built-in expressions. Defined cases: a text of fewer than five words is one
shingle of all its words; one without a word has none, and contains nothing; rows
with the same ``doc_id`` are searched as one document, rows with a null ``doc_id`` or
``item_id`` are not searched; repeated rows change nothing; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import join_side, staged

WORDS = 5
# A document contains an item with four of five of its shingles.
_PART, _WHOLE = 4, 5
CONTAINED = _PART / _WHOLE

_HASH = "xxhash64(" + ", ".join(f"get(_w, _p + {i})" for i in range(WORDS)) + ")"
_TEXT = "concat_ws(' ', " + ", ".join(f"get(_w, _p + {i})" for i in range(WORDS)) + ")"


def _positions(rows: DataFrame, key: str) -> DataFrame:
    """``key, _w, _p``: the words of each text and where its shingles begin.

    Cutting leaves an empty word before or after a text that begins or ends between
    words. Long texts step around them; short ones, whose only shingle would reach
    into them, are rid of them.
    """
    words = r"split(lower(text), '[^\\p{L}\\p{N}]+')"
    return (
        rows.filter(f"{key} IS NOT NULL AND text IS NOT NULL")
        .selectExpr(f"CAST({key} AS BIGINT) AS {key}", f"{words} AS _w")
        .selectExpr(
            key,
            f"CASE WHEN size(_w) < {WORDS + 2} THEN filter(_w, x -> x <> '') ELSE _w END AS _w",
        )
        .filter("size(_w) > 0")
        .selectExpr(
            key,
            "_w",
            "CASE WHEN get(_w, 0) = '' THEN 1 ELSE 0 END AS _first",
            "size(_w) - CASE WHEN get(_w, size(_w) - 1) = '' THEN 1 ELSE 0 END AS _end",
        )
        .selectExpr(
            key, "_w", f"explode(sequence(_first, greatest(_first, _end - {WORDS}))) AS _p"
        )
    )


def item_shingles(items: DataFrame) -> DataFrame:
    """``item_id, h, shingle, n``: distinct shingles of each item and their number."""
    cut = _positions(items, "item_id").selectExpr(
        "item_id", f"{_HASH} AS h", f"{_TEXT} AS shingle"
    )
    cut = staged(cut.distinct(), "item-shingles")
    sizes = cut.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return cut.join(sizes, "item_id")


def sketches(shingles: DataFrame) -> DataFrame:
    """``h, items``: for each sketch value, the items that have it and the hits they need."""
    sized = shingles.withColumn("part", F.expr("floor(log2(n))"))
    largest = sized.groupBy("part").agg(F.max("n").alias("n_max"))
    missing = _WHOLE - _PART
    return (
        sized.join(largest, "part")
        .withColumn("m", F.expr(f"n_max * {missing} DIV {_WHOLE} + 1"))
        .groupBy("item_id", "n", "m")
        .agg(F.array_sort(F.collect_list("h")).alias("hashes"))
        .selectExpr(
            "item_id",
            f"least(m, n) - n * {missing} DIV {_WHOLE} AS needed",
            "explode(slice(hashes, 1, CAST(least(m, n) AS INT))) AS h",
        )
        .groupBy("h")
        .agg(F.collect_list(F.struct("item_id", "needed")).alias("items"))
    )


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of all items in all documents."""
    shingles = staged(item_shingles(items), "items")
    sketch = staged(sketches(shingles), "sketches")
    # The largest sketch value: no greater hash of a document needs looking up.
    top = sketch.agg(F.max("h")).first()[0]
    top = -(1 << 63) if top is None else top
    hashes = (
        _positions(docs, "doc_id")
        .selectExpr("doc_id", f"{_HASH} AS h")
        .filter(F.col("h") <= F.lit(top))
    )
    hits = join_side(hashes, sketch, ["h"], "inner", "40 + 16 * size(items)", "probe")
    found = (
        hits.selectExpr("doc_id", "h", "inline(items)")
        .groupBy("doc_id", "item_id", "needed")
        .agg(F.countDistinct("h").alias("hits"))
        .filter("hits >= needed")
        .select("doc_id", "item_id")
    )
    found = staged(found, "found")
    wanted = found.select("doc_id").distinct()
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    again = join_side(texts, wanted, ["doc_id"], "left_semi", "16", "found-docs")
    cut = _positions(again, "doc_id").selectExpr(
        "doc_id", f"{_HASH} AS h", f"{_TEXT} AS shingle"
    )
    shared = (
        join_side(
            cut, shingles, ["h", "shingle"], "inner", "64 + octet_length(shingle)", "verify"
        )
        .join(found, ["doc_id", "item_id"], "left_semi")
        .groupBy("doc_id", "item_id", "n")
        .agg(F.countDistinct("shingle").alias("n_shared"))
        .filter(f"n_shared * {_WHOLE} >= n * {_PART}")
    )
    return shared.selectExpr(
        "doc_id", "item_id", "n_shared", "n AS n_item", "n_shared / n AS containment"
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item."""
    found = contained_items(docs.select("doc_id", "text"), items)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(
        *docs.columns
    )
