"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from .common import staged


def _stored(links: DataFrame) -> tuple[DataFrame, dict]:
    """The links, stored, and what tells one set of them from another, summed up on the way."""
    seen = Observation()
    told = links.observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.expr("bit_xor(xxhash64(a, b))").alias("x"),
        F.expr("sum(CAST(pmod(xxhash64(b, a), 1000003) AS BIGINT))").alias("s"),
    )
    return staged(told, "links"), seen.get


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b); root is the least node reachable.

    A large star ties each node's greater neighbours to its least one, a small star
    does so with the lesser neighbours; in a few rounds only stars around the
    roots are left. Each round is a minimum per node (combined before the shuffle)
    and a join that adaptive execution can split, and is stored, so a lost executor
    costs one round at most. Links of a node to itself and repeated links don't matter.
    """
    links, state = _stored(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    while state.get("n"):
        both = links.select("a", "b").union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").selectExpr("b AS a", "m AS b")
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .filter("b <> m")
            .selectExpr("b AS a", "m AS b")
            .union(least.selectExpr("a", "m AS b"))
            .distinct()
        )
        before = state
        links, state = _stored(small)
        if state == before:
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.selectExpr("a AS node", "b AS root").union(
        roots.selectExpr("node", "node AS root")
    )
