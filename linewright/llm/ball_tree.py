"""Exact top-k inner product search by ball trees, shard by shard.

Components are made whole numbers first (``floor(64 x)``), so scores are exact. Equal
vectors are one point, which keeps its ``k + 1`` least ids: no other copy can be among
the ``k`` best of any query, itself left out. Queries with equal vectors are one search.

Points go to the nearest of a few pivots and from there to shards of bounded size.
Each shard builds a ball tree; a node with centre c and radius r holds no score above
q·c + |q| r. A search goes down the nodes for a whole block of queries, those with the
higher bounds first, and leaves a node to the queries whose k-th score so far its bound
still reaches. First every query searches the shard with its highest bound. The k-th
score found there goes along to the other shards, and a shard whose own ball can't reach
it doesn't see the query at all.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no
part; vectors are compared with those of their own length only; ties go to the smaller
id; rows that repeat an id and its vector count once; a null id takes no part; where scores
may pass 2^53 they are computed in whole numbers of 64 bits, and where they may pass those
too, as no long holds them, the search is refused; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import join_side, staged

SCALE = 64
K = 20
# Bounds on what one task holds: points of a shard, queries of a block.
SHARD_POINTS = 16384
BLOCK_QUERIES = 4096
BLOCK_BALLS = 4096
LEAF = 128
# Sample of points that serve as pivots, for each vector length.
PIVOTS = 32

_POINT = "point bigint, v array<bigint>"
_HITS = "query bigint, vec_id bigint, score bigint"


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: whole-numbered vectors, none of them empty or with a null or non-finite part."""
    x = "CAST(x AS DOUBLE)"
    good = f"x IS NOT NULL AND NOT isnan({x}) AND abs({x}) < double('infinity')"
    return (
        vectors.filter("vec_id IS NOT NULL AND size(embedding) > 0")
        .filter(f"forall(embedding, x -> coalesce({good}, false))")
        .selectExpr(
            "CAST(vec_id AS BIGINT) AS vec_id",
            f"transform(embedding, x -> CAST(floor({scale} * {x}) AS BIGINT)) AS v",
        )
    )


# Stands for no score yet; its negative is a number too.
_NONE = -np.iinfo(np.int64).max


class BallTree:
    """Nodes over a shard's points; leaves hold at most ``LEAF`` of them."""

    def __init__(self, whole: np.ndarray):
        self.order = np.arange(len(whole))
        self.whole = whole
        self.points = points = whole.astype(np.float64)
        self.nodes: list[tuple] = []
        # (first, last, centre, radius, left, right)
        pending = [(0, len(points), -1, 0)]
        while pending:
            a, b, parent, side = pending.pop()
            own = points[self.order[a:b]]
            centre = own.mean(axis=0)
            gap = ((own - centre) ** 2).sum(axis=1)
            self.nodes.append([a, b, centre, float(np.sqrt(gap.max())), -1, -1])
            me = len(self.nodes) - 1
            if parent >= 0:
                self.nodes[parent][4 + side] = me
            if b - a <= LEAF or not gap.any():
                continue
            # Along the line between two points far apart, half to either side.
            one = own[gap.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            along = np.argsort(own @ (other - one), kind="stable")
            self.order[a:b] = self.order[a:b][along]
            middle = (a + b) // 2
            pending += [(middle, b, me, 1), (a, middle, me, 0)]

    def search(self, asked: np.ndarray, kth: np.ndarray, k: int):
        """Rows and scores of the ``k`` best points per query, among those above ``kth``.

        ``kth`` is a score already reached ``k`` times elsewhere: points below it are not
        looked for, points equal to it are, as a smaller id may win.
        """
        n = len(asked)
        queries = asked.astype(np.float64)
        # Products in floating point are exact below 2^53, and fast.
        largest = np.abs(queries).max() * np.abs(self.points).max() * queries.shape[1]
        if largest >= 2**63:
            raise ValueError("scores beyond 64 bits")
        left_side, right_side = (
            (queries, self.points) if largest < 2**53 else (asked, self.whole)
        )
        best = np.full((n, k), _NONE, dtype=np.int64)
        rows = np.full((n, k), -1, dtype=np.int64)
        kth = kth.astype(np.float64).copy()
        norms = np.sqrt((queries * queries).sum(axis=1))

        def bounds(node: int, which: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[node][2], self.nodes[node][3]
            # A hair more than the exact bound, for what floating point rounds off.
            bound = queries[which] @ centre + norms[which] * radius
            return bound + 1e-6 * (1 + np.abs(bound))

        everyone = np.arange(n)
        stack = [(0, everyone, bounds(0, everyone))]
        while stack:
            node, which, bound = stack.pop()
            alive = bound >= kth[which]
            which = which[alive]
            if not len(which):
                continue
            a, b, _, _, left, right = self.nodes[node]
            if left < 0:
                own = self.order[a:b]
                scores = (left_side[which] @ right_side[own].T).astype(np.int64)
                merged = np.concatenate([best[which], scores], axis=1)
                names = np.concatenate(
                    [rows[which], np.broadcast_to(own, scores.shape)], axis=1
                )
                # Higher scores first, then the smaller row: rows are in order of id.
                names = np.where(names < 0, np.iinfo(np.int64).max, names)
                top = np.lexsort((names, -merged), axis=1)[:, :k]
                best[which] = np.take_along_axis(merged, top, axis=1)
                names = np.take_along_axis(names, top, axis=1)
                rows[which] = np.where(best[which] == _NONE, -1, names)
                last = best[which, -1].astype(np.float64)
                kth[which] = np.maximum(kth[which], np.where(last > _NONE, last, -np.inf))
                continue
            low, high = bounds(left, which), bounds(right, which)
            nodes = [(left, which, low), (right, which, high)]
            # The child with more to offer is searched first.
            stack += nodes if high.sum() >= low.sum() else nodes[::-1]
        return rows, best


def _search_block(points: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best points of one shard for one block of queries."""
    if not len(points) or not len(queries):
        return pd.DataFrame({"query": [], "vec_id": [], "score": []}, dtype="int64")
    points = points.sort_values("point")
    tree = BallTree(np.stack(points["v"]).astype(np.int64))
    asked = np.stack(queries["v"]).astype(np.int64)
    rows, best = tree.search(asked, queries["kth"].to_numpy(), k)
    found = rows >= 0
    which = np.nonzero(found)[0]
    return pd.DataFrame(
        {
            "query": queries["point"].to_numpy()[which],
            "vec_id": points["point"].to_numpy()[rows[found]],
            "score": best[found],
        }
    )


def _shards(points: DataFrame, pivots: int, shard_points: int) -> DataFrame:
    """``point, v, shard``: nearest pivot, cut further where one draws too many points."""
    spread = "xxhash64(point)"
    sample = (
        points.selectExpr("point", "v", "size(v) AS n", f"{spread} AS place")
        .withColumn(
            "rank", F.row_number().over(Window.partitionBy("n").orderBy("place", "point"))
        )
        .filter(F.col("rank") <= pivots)
        .select("n", "v")
        .collect()
    )
    by_length: dict[int, np.ndarray] = {}
    for row in sorted(sample):
        by_length.setdefault(row.n, []).append(row.v)
    by_length = {n: np.array(v, dtype=np.float64) for n, v in by_length.items()}

    def nearest(batches):
        for rows in batches:
            place = np.zeros(len(rows), dtype=np.int32)
            lengths = rows["v"].map(len).to_numpy()
            for n in np.unique(lengths):
                own, at = by_length[int(n)], np.flatnonzero(lengths == n)
                x = np.array(rows["v"].iloc[at].tolist(), dtype=np.float64).reshape(-1, n)
                place[at] = ((own * own).sum(axis=1) - 2 * x @ own.T).argmin(axis=1)
            yield rows.assign(n=lengths.astype("int32"), pivot=place)

    placed = staged(
        points.mapInPandas(nearest, f"{_POINT}, n int, pivot int"), "placed"
    )
    counts = placed.groupBy("n", "pivot").count()
    return join_side(placed, counts, ["n", "pivot"], "inner", "32", "pivots").selectExpr(
        "point",
        "v",
        "n",
        "shiftleft(CAST(n AS BIGINT), 44) + shiftleft(CAST(pivot AS BIGINT), 36)"
        f" + pmod({spread}, count DIV {shard_points} + 1) AS shard",
    )


def repeated(points: DataFrame, asked: DataFrame) -> DataFrame:
    """``point, v, shard, block``: points once per block of queries that asks their shard."""
    wanted = asked.select("shard", "block").distinct()
    blocks = wanted.groupBy("shard").agg(F.collect_list("block").alias("blocks"))
    size = "8 + 4 * size(blocks)"
    joined = join_side(points.select("point", "v", "shard"), blocks, ["shard"], "inner", size, "asked")
    return joined.select("point", "v", "shard", F.explode("blocks").alias("block"))


def top_k(
    vectors: DataFrame,
    is_query: str,
    k: int = K,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    shard_points: int = SHARD_POINTS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows for which the SQL ``is_query`` holds.

    Every other row is a candidate, as are the other queries.
    """
    rows = staged(quantized(vectors, scale).distinct(), "vectors")
    # Copies: a point is named by its least id and lists its k + 1 least.
    copies = rows.withColumn(
        "copy", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ).filter(F.col("copy") <= k + 1)
    listed = staged(
        copies.groupBy("v").agg(
            F.min("vec_id").alias("point"),
            F.array_sort(F.collect_list("vec_id")).alias("ids"),
        ),
        "points",
    )
    points = staged(
        _shards(listed.select("point", "v"), pivots, shard_points), "shards"
    )
    asked = rows.filter(is_query).select("v").distinct()
    queries = staged(listed.join(asked, "v").select("point", "v"), "queries")
    blocks = queries.count() // BLOCK_QUERIES + 1

    # The ball around each shard: the mean of its points and the farthest of them.
    def ball(own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own["v"]).astype(np.float64)
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
        head = own.iloc[0]
        return pd.DataFrame(
            {"shard": [head["shard"]], "n": [head["n"]], "c": [centre], "r": [radius]}
        )

    balls = staged(
        points.groupBy("shard").applyInPandas(
            ball, "shard bigint, n int, c array<double>, r double"
        ),
        "balls",
    )
    ball_blocks = balls.count() // BLOCK_BALLS + 1

    def bounds(asked: DataFrame, every: bool) -> DataFrame:
        """``point, shard, bound``: shards whose ball reaches a query's k-th score.

        Of each block of balls all such shards, or the one with the highest bound.
        """

        def measure(balls: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            if not len(balls) or not len(queries):
                return pd.DataFrame({"point": [], "shard": [], "bound": []}, dtype="int64")
            x = np.stack(queries["v"]).astype(np.float64)
            bound = x @ np.stack(balls["c"]).T
            bound += np.sqrt((x * x).sum(axis=1))[:, None] * balls["r"].to_numpy()
            bound += 1e-6 * (1 + np.abs(bound))
            if every:
                row, column = np.nonzero(bound >= queries["kth"].to_numpy()[:, None])
            else:
                row, column = np.arange(len(x)), bound.argmax(axis=1)
            return pd.DataFrame(
                {
                    "point": queries["point"].to_numpy()[row],
                    "shard": balls["shard"].to_numpy()[column],
                    "bound": bound[row, column],
                }
            )

        left = balls.selectExpr(
            "*",
            f"pmod(xxhash64(shard), {ball_blocks}) AS of_balls",
            f"explode(sequence(0, {blocks - 1})) AS of_queries",
        )
        right = asked.selectExpr(
            "point",
            "v",
            "kth",
            "size(v) AS n",
            f"explode(sequence(0, {ball_blocks - 1})) AS of_balls",
            f"CAST(pmod(xxhash64(point), {blocks}) AS INT) AS of_queries",
        )
        key = ["n", "of_balls", "of_queries"]
        return (
            left.withColumn("of_balls", F.col("of_balls").cast("int"))
            .groupBy(*key)
            .cogroup(right.groupBy(*key))
            .applyInPandas(measure, "point bigint, shard bigint, bound double")
        )

    lowest = F.lit(float("-inf"))
    fresh = queries.withColumn("kth", lowest)
    home = staged(
        bounds(fresh, every=False)
        .groupBy("point")
        .agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard")),
        "home-shards",
    )
    width = k + 1

    def search(asked: DataFrame) -> DataFrame:
        """``asked``: point, v, shard, kth. A shard goes to the blocks of queries that ask it."""
        block = f"CAST(pmod(xxhash64(point), {blocks}) AS INT)"
        right = staged(
            asked.selectExpr("point", "v", "shard", "kth", f"{block} AS block"), "asked"
        )
        left = repeated(points, right)
        return (
            left.groupBy("shard", "block")
            .cogroup(right.groupBy("shard", "block"))
            .applyInPandas(lambda a, b: _search_block(a, b, width), _HITS)
        )

    first = staged(search(fresh.join(home, "point")), "first-hits")
    # The score a query has reached often enough, if it has.
    reached = first.groupBy("query").agg(
        F.when(F.count(F.lit(1)) >= width, F.min("score").cast("double"))
        .otherwise(lowest)
        .alias("kth")
    )
    known = queries.join(
        reached.withColumnRenamed("query", "point"), "point", "left"
    ).withColumn("kth", F.coalesce("kth", lowest))
    rest = (
        bounds(known, every=True)
        .join(home, ["point", "shard"], "left_anti")
        .join(known, "point")
        .select("point", "v", "shard", "kth")
    )
    hits = first.unionByName(staged(search(rest), "more-hits"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("place", F.row_number().over(best)).filter(
        F.col("place") <= width
    )
    # From points back to rows: the copies of each hit, for each row of the query.
    spelled = (
        hits.join(listed.select(F.col("point").alias("vec_id"), "ids"), "vec_id")
        .select("query", "score", F.explode("ids").alias("vec_id"))
    )
    spelled = spelled.withColumn("place", F.row_number().over(best)).filter(
        F.col("place") <= width
    )
    per_point = spelled.groupBy("query").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))
        ).alias("hits")
    )
    asked = (
        rows.filter(is_query)
        .join(listed.select("v", F.col("point").alias("query")), "v")
        .select(F.col("vec_id").alias("query_id"), "query")
    )
    return (
        asked.join(per_point, "query")
        .selectExpr(
            "query_id",
            f"posexplode(slice(filter(hits, h -> h.vec_id <> query_id), 1, {k})) AS (at, h)",
        )
        .selectExpr(
            "query_id",
            "CAST(at + 1 AS INT) AS rank",
            "h.vec_id AS vec_id",
            "-h.minus AS score",
        )
    )
