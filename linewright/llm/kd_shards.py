"""Sharding by a k-d tree over document metadata, shards of nearly equal bytes.

A node that is to give several shards is cut in two along the dimension in which its
documents spread widest (as a share of that dimension's spread over all documents): at
the point that parts its bytes as the two sides' numbers of shards, their weighted
median for equal numbers. Leaves therefore hold the target bytes, whatever their place.

Dimensions are numbers: the id, the size, and hashes of source and language. Documents
with the same value are ordered by a second key, a hash of text and id that keeps equal
texts side by side, so a value that holds a third of all rows can still be cut anywhere.

The cut of each node is found by histograms: all open nodes count their bytes in bins
in one aggregation, and the bin with the cut is cut into bins again, first of the
value, then of the second key, until it holds one point. What the driver sees is at
most ``BINS`` rows per open node and pass.

Defined cases: null texts have no bytes besides the ``ROW_BYTES`` each row counts, null
metadata one fixed place; rows equal in every way may lie on either side of a cut only
together, so a shard differs from the target by at most one such group; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from .common import join_side, staged

SHARDS = 24
ROW_BYTES = 8
BINS = 1024
LAW = "bytes"
# Rows numbered together within a shard.
_BLOCK_ROWS = 1 << 18
DIMENSIONS = {
    "d0": "coalesce(doc_id, -1)",
    "d1": "size",
    "d2": "pmod(xxhash64(coalesce(source, '')), 65536)",
    "d3": "pmod(xxhash64(coalesce(lang, '')), 65536)",
}
# The second key: equal texts share its upper half.
_TIE = (
    "shiftleft(pmod(xxhash64(coalesce(text, '')), 1073741824), 32)"
    " + pmod(xxhash64(doc_id, text), 4294967296)"
)


@dataclass
class Node:
    """Part of the tree: the rows for which ``test`` holds give ``shards`` from ``first``."""

    first: int
    shards: int
    test: str


@dataclass
class _Cut:
    """Where a node is being cut: the bin of ``key`` the cut lies in, and what lies below."""

    node: Node
    dim: str
    low: int
    high: int
    wanted: float
    below: float = 0.0
    value: int | None = None  # set once the second key is being cut

    @property
    def key(self) -> str:
        return self.dim if self.value is None else "tie"

    @property
    def step(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))

    def rows(self) -> str:
        inside = f"{self.key} BETWEEN {self.low} AND {self.high}"
        same = "" if self.value is None else f" AND {self.dim} = {self.value}"
        return f"({self.node.test}) AND {inside}{same}"


def metadata(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, tie`` and the dimensions of every document, stored.

    ``docs`` needs ``doc_id, text``; ``source`` and ``lang`` are used where they are there.
    """
    have = [
        c if c in docs.columns else f"CAST(NULL AS STRING) AS {c}"
        for c in ("source", "lang")
    ]
    return staged(
        docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", *have)
        .selectExpr(
            "*",
            f"CAST(coalesce(octet_length(text), 0) + {ROW_BYTES} AS BIGINT) AS size",
            "crc32(CAST(coalesce(text, '') AS BINARY)) AS text_crc32",
            f"{_TIE} AS tie",
        )
        .selectExpr(
            "doc_id",
            "size",
            "text_crc32",
            "tie",
            *(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in DIMENSIONS.items()),
        ),
        "shard-metadata",
    )


def _case(tests: list[str]) -> str:
    branches = " ".join(f"WHEN {test} THEN {i}" for i, test in enumerate(tests))
    return f"CASE {branches} END"


def _open_cuts(meta: DataFrame, nodes: list[Node], spread: dict) -> list[_Cut]:
    """The widest dimension of each node and the bytes its left side should get."""
    aggs = [F.sum("size").alias("bytes")]
    for d in DIMENSIONS:
        aggs += [F.min(d).alias(f"{d}_low"), F.max(d).alias(f"{d}_high")]
    found = (
        meta.withColumn("node", F.expr(_case([n.test for n in nodes])))
        .filter("node IS NOT NULL")
        .groupBy("node")
        .agg(*aggs)
        .collect()
    )
    cuts = []
    for row in found:
        node = nodes[row["node"]]
        width = {
            d: (row[f"{d}_high"] - row[f"{d}_low"]) / max(1, spread[d])
            for d in DIMENSIONS
        }
        dim = max(width, key=lambda d: (width[d], d))
        left = node.shards // 2
        cuts.append(
            _Cut(
                node,
                dim,
                row[f"{dim}_low"],
                row[f"{dim}_high"],
                row["bytes"] * left / node.shards,
            )
        )
    return cuts


def _find(meta: DataFrame, cuts: list[_Cut]) -> list[tuple[_Cut, str]]:
    """For each cut, SQL that holds for the rows on its left side."""
    done: list[tuple[_Cut, str]] = []
    while cuts:
        which = _case([c.rows() for c in cuts])
        place = " ".join(
            f"WHEN {i} THEN ({c.key} - {c.low}) DIV {c.step}" for i, c in enumerate(cuts)
        )
        key = " ".join(f"WHEN {i} THEN {c.key}" for i, c in enumerate(cuts))
        counted = (
            meta.withColumn("cut", F.expr(which))
            .filter("cut IS NOT NULL")
            .withColumn("bin", F.expr(f"CASE cut {place} END"))
            .withColumn("key", F.expr(f"CASE cut {key} END"))
            .groupBy("cut", "bin")
            .agg(
                F.sum("size").alias("bytes"),
                F.min("key").alias("low"),
                F.max("key").alias("high"),
                F.min("tie").alias("tie_low"),
                F.max("tie").alias("tie_high"),
            )
            .collect()
        )
        still = []
        for i, cut in enumerate(cuts):
            bins = sorted(
                (r for r in counted if r["cut"] == i), key=lambda r: r["bin"]
            )
            for row in bins:
                if cut.below + row["bytes"] > cut.wanted:
                    break
                cut.below += row["bytes"]
            if row["low"] < row["high"]:
                cut.low, cut.high = row["low"], row["high"]
                still.append(cut)
                continue
            if cut.value is None:
                cut.value = row["low"]
                cut.low, cut.high = row["tie_low"], row["tie_high"]
                if cut.low < cut.high:
                    still.append(cut)
                    continue
            # One point: it goes to the side that it leaves nearer to its share.
            nearer = cut.below + row["bytes"] - cut.wanted <= cut.wanted - cut.below
            sign = "<=" if nearer else "<"
            done.append(
                (
                    cut,
                    f"({cut.dim} < {cut.value} OR "
                    f"({cut.dim} = {cut.value} AND tie {sign} {row['tie_low']}))",
                )
            )
        cuts = still
    return done


def build_tree(meta: DataFrame, shards: int = SHARDS) -> list[Node]:
    """The leaves; each has one shard and the test its rows pass."""
    ranges = meta.agg(
        *(F.expr(f"max({d}) - min({d})").alias(d) for d in DIMENSIONS)
    ).first()
    spread = {d: ranges[d] or 0 for d in DIMENSIONS}
    nodes, leaves = [Node(0, shards, "true")], []
    while nodes:
        leaves += [n for n in nodes if n.shards == 1]
        nodes = [n for n in nodes if n.shards > 1]
        children = []
        for cut, left in _find(meta, _open_cuts(meta, nodes, spread)) if nodes else []:
            node, half = cut.node, cut.node.shards // 2
            children += [
                Node(node.first, half, f"{node.test} AND {left}"),
                Node(node.first + half, node.shards - half, f"{node.test} AND NOT {left}"),
            ]
        nodes = children
    return leaves


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: the shard and place of every document.

    Slots are counted in blocks of a shard; the blocks' sums, one row each, give where
    a block begins. So no shard is ever sorted whole.
    """
    meta = metadata(docs)
    leaves = build_tree(meta, shards)
    if not leaves:
        leaves = [Node(0, 1, "true")]
    shard = " ".join(f"WHEN {n.test} THEN {n.first}" for n in leaves)
    blocks = max(1, meta.count() // (shards * _BLOCK_ROWS) + 1)
    rows = meta.selectExpr(
        "doc_id",
        "size",
        "text_crc32",
        f"CASE {shard} END AS shard",
        f"pmod(tie, {blocks}) AS _block",
    )
    before = (
        Window.partitionBy("shard")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = (
        rows.groupBy("shard", "_block")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "shard", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")
        )
    )
    order = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")
    local = rows.withColumn("_at", F.row_number().over(order) - 1)
    return join_side(local, bases, ["shard", "_block"], "inner", "32", "slots").select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("_base") + F.col("_at")).alias("slot"),
    )


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """Write the documents as Parquet, one folder ``shard=N`` per shard.

    Each task writes what it holds of a shard to a file of its own.
    """
    leaves = build_tree(metadata(docs), shards)
    shard = " ".join(f"WHEN {n.test} THEN {n.first}" for n in leaves)
    source = "source" if "source" in docs.columns else "NULL"
    lang = "lang" if "lang" in docs.columns else "NULL"
    names = {"source": source, "lang": lang}
    size = f"CAST(coalesce(octet_length(text), 0) + {ROW_BYTES} AS BIGINT)"
    keyed = docs.selectExpr(
        "struct(*) AS _row", "CAST(doc_id AS BIGINT) AS doc_id", "text",
        *(f"CAST({sql} AS STRING) AS {name}" for name, sql in names.items()),
        f"{size} AS size",
    )
    for name, sql in DIMENSIONS.items():
        keyed = keyed.withColumn(name, F.expr(f"CAST({sql} AS BIGINT)"))
    keyed = keyed.withColumn("tie", F.expr(_TIE))
    keyed = keyed.withColumn("_shard", F.expr(f"CASE {shard} END" if leaves else "0"))
    keyed.select("_row.*", F.col("_shard").alias("shard")).write.partitionBy(
        "shard"
    ).parquet(folder)


def digest(placed: DataFrame) -> DataFrame:
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
