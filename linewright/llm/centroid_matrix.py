"""Clusters of whole-numbered vectors, by a distance matrix that is kept up to date.

Components are made whole numbers first (``floor(1024 x)``), so all that follows is exact
and doesn't depend on the order of rows or the number of tasks. Each vector's row in a
stored table holds its inner products with every centroid. When a centroid moves, only
the components that changed are multiplied again, ``dot += sum of v[j] * change[j]``, and
the nearest centroid follows from ``|v|^2 - 2 dot + |c|^2``. Centroids that stay cost
nothing. The sums behind the centroids are kept up to date as well: a round adds only the
vectors that changed cluster, to the sums of the new one and off those of the old.

Each round's table is written to the shared folder and the one before it dropped, so
neither lineage nor disk grows with the rounds. The driver holds the centroids: as many
rows as there are clusters.

Numbers beyond 64 bits: where a component is so large that a distance might not fit, all
arithmetic is done in Python's unbounded integers and stored as decimal digits, with the
same results, only slower. A distance that no long can hold is null, and so is
the inertia that it is part of.

Defined cases: vectors that are null, of another length or hold a null or non-finite
component take no part, nor do those of which ``1024 x`` overflows a double; ties go to the
smaller cluster number; rows that repeat an id are vectors of their own, and where one
becomes a first centroid, equal hashes go by component; a null id is clustered too, but
its hash comes last; fewer vectors than clusters give fewer centroids; an empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import drop_dir, fresh_dir
from .common import frugal

CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
LENGTH = 64
SEED = "3"
# Up to this size of the components no distance comes near 64 bits.
NARROW = 1 << 26
# Sums of unbounded integers are added up by Spark in parts of so many bits.
_LIMB = 40

_SUMS = "cluster int, place int, limb int, value bigint"


def whole_vectors(vectors: DataFrame, length: int, scale: int) -> DataFrame:
    """``vec_id, x``: vectors that take part, as whole-numbered doubles."""
    scaled = f"{scale} * CAST(x AS DOUBLE)"
    good = f"x IS NOT NULL AND NOT isnan(x) AND abs({scaled}) < double('infinity')"
    return vectors.filter(f"size(embedding) = {length}").filter(
        f"forall(embedding, x -> coalesce({good}, false))"
    ).selectExpr(
        "CAST(vec_id AS BIGINT) AS vec_id",
        f"transform(embedding, x -> {scaled}) AS x",
    )


class Numbers:
    """How integers are held in arrays and in stored lists: 64 bits, or without bound."""

    def __init__(self, wide: bool):
        self.wide = wide
        self.sql = "string" if wide else "bigint"

    def load(self, column: pa.Array, width: int) -> np.ndarray:
        listed = pa.types.is_list(column.type)
        flat = column.flatten() if listed else column
        if self.wide:
            values = np.array([int(x) for x in flat.to_pylist()], dtype=object)
        else:
            values = flat.to_numpy(zero_copy_only=False)
        return values.reshape(-1, width) if listed else values

    def floor(self, column: pa.Array, width: int) -> np.ndarray:
        whole = np.floor(column.flatten().to_numpy(zero_copy_only=False))
        if self.wide:
            whole = np.array([int(x) for x in whole], dtype=object)
        else:
            whole = whole.astype(np.int64)
        return whole.reshape(-1, width)

    def dump(self, values: np.ndarray) -> pa.Array:
        flat = values.reshape(-1)
        stored = (
            pa.array([str(x) for x in flat], type=pa.string())
            if self.wide
            else pa.array(flat.astype(np.int64, copy=False))
        )
        if values.ndim == 1:
            return stored
        cuts = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(cuts), stored)

    def array(self, values: list) -> np.ndarray:
        return np.array(values, dtype=object if self.wide else np.int64)

    def limbs(self, total: int) -> Iterator[tuple[int, int]]:
        """``limb, value``: the number is the sum of ``value << (limb * _LIMB)``."""
        if not self.wide:
            yield 0, int(total)
            return
        sign, rest, limb = (1, int(total), 0) if total >= 0 else (-1, -int(total), 0)
        while rest:
            yield limb, sign * (rest & ((1 << _LIMB) - 1))
            rest, limb = rest >> _LIMB, limb + 1


class _Table:
    """The stored matrix of one round."""

    def __init__(self, spark: SparkSession, rows: DataFrame):
        self.spark, self.folder = spark, fresh_dir(spark, "llm-matrix")
        rows.write.parquet(self.folder)
        self.rows = spark.read.schema(rows.schema).parquet(self.folder)

    def drop(self) -> None:
        drop_dir(self.spark, self.folder)


def first_centroids(whole: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """The vectors with the least hashes of ``seed:vec_id``, in that order."""
    ids = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    chosen = (
        whole.select(F.sha2(ids, 256).alias("hash"), "x")
        .orderBy(F.asc_nulls_last("hash"), "x")
        .limit(clusters)
        .collect()
    )
    return [[int(np.floor(x)) for x in row.x] for row in chosen]


def _advance(
    rows: DataFrame, numbers: Numbers, length: int, change: list, centroids: list
) -> DataFrame:
    """The matrix after the centroids moved by ``change``; the first time from vectors."""
    first = "x" in rows.columns
    k = len(centroids)
    moved = numbers.array(change)
    places = [np.flatnonzero([x != 0 for x in row]) for row in change]
    norms = numbers.array([sum(x * x for x in row) for row in centroids])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if first:
                v = numbers.floor(batch.column("x"), length)
                norm = (v * v).sum(axis=1)
                dots = numbers.array([[0] * k] * n)
                was = np.full(n, -1, dtype=np.int32)
            else:
                v = numbers.load(batch.column("v"), length)
                norm = numbers.load(batch.column("norm"), 1)
                dots = numbers.load(batch.column("dots"), k).copy()
                was = batch.column("cluster").to_numpy()
            for c in range(k):
                if len(places[c]):
                    dots[:, c] += v[:, places[c]] @ moved[c, places[c]]
            distances = norm[:, None] - 2 * dots + norms[None, :]
            nearest = np.argmin(distances, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    numbers.dump(v),
                    numbers.dump(norm),
                    numbers.dump(dots),
                    pa.array(nearest),
                    pa.array(was),
                    numbers.dump(distances[np.arange(n), nearest]),
                ],
                names=["vec_id", "v", "norm", "dots", "cluster", "was", "distance"],
            )

    kind = numbers.sql
    schema = (
        f"vec_id bigint, v array<{kind}>, norm {kind}, dots array<{kind}>, "
        f"cluster int, was int, distance {kind}"
    )
    return rows.mapInArrow(frugal(step), schema)


def _changed_sums(rows: DataFrame, numbers: Numbers, length: int, k: int) -> list:
    """``cluster, place, limb, value``: what the vectors that moved add to the sums.

    Place ``length`` counts vectors. A task adds up its own rows first.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, length + 1), dtype=object)
        for batch in batches:
            v = numbers.load(batch.column("v"), length)
            to, off = batch.column("cluster").to_numpy(), batch.column("was").to_numpy()
            for c in range(k):
                for sign, mine in ((1, to == c), (-1, off == c)):
                    if mine.any():
                        own = v[mine].sum(axis=0)
                        sums[c, :length] += sign * own.astype(object)
                        sums[c, length] += sign * int(mine.sum())
        parts = [
            (c, place, limb, value)
            for c in range(k)
            for place in range(length + 1)
            for limb, value in numbers.limbs(sums[c, place])
            if value
        ]
        columns = list(zip(*parts, strict=True)) or [[]] * 4
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        arrays = [pa.array(x, type=t) for x, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["cluster", "place", "limb", "value"])

    moved = rows.filter("cluster <> was").select("v", "cluster", "was")
    total = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    parts = moved.mapInArrow(frugal(add), _SUMS)
    return parts.groupBy("cluster", "place", "limb").agg(total).collect()


def digest_of(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    length: int = LENGTH,
    seed: str = SEED,
) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every vector after ``rounds`` rounds, and the centroids.

    ``vectors`` has ``vec_id, embedding``. A round assigns all vectors to the nearest
    centroid and replaces every centroid that has vectors by their floored mean; after
    the last one the vectors are assigned once more.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, length, scale)
    size = whole.agg(F.max(F.expr("array_max(transform(x, x -> abs(x)))"))).first()[0]
    numbers = Numbers(size is not None and size > NARROW)
    centroids = first_centroids(whole, clusters, seed)
    k = len(centroids)
    if not k:
        empty = "vec_id bigint, cluster int, distance bigint"
        return spark.createDataFrame([], empty), []
    sums = [[0] * (length + 1) for _ in range(k)]
    table, source, change = None, whole, [list(row) for row in centroids]
    for done in range(rounds + 1):
        stored = _Table(spark, _advance(source, numbers, length, change, centroids))
        if table is not None:
            table.drop()
        table, source = stored, stored.rows
        if done == rounds:
            break
        for row in _changed_sums(source, numbers, length, k):
            sums[row.cluster][row.place] += int(row.value) << (row.limb * _LIMB)
        means = [
            [x // own[length] for x in own[:length]] if own[length] else old
            for own, old in zip(sums, centroids, strict=True)
        ]
        change = [
            [a - b for a, b in zip(new, old, strict=True)]
            for new, old in zip(means, centroids, strict=True)
        ]
        centroids = means
        if not any(any(row) for row in change):
            break  # nothing moves any more: all later rounds would give this table again
    distance = F.expr("try_cast(distance AS BIGINT)").alias("distance")
    return source.select("vec_id", "cluster", distance), centroids


def digest(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with the inertia of each cluster and of all, and centroid digests."""
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = F.count(F.lit(1)) == F.count("distance")
    totals = assigned.groupBy("cluster").agg(F.when(whole, exact).alias("total")).collect()
    # One row per cluster.
    inertia = {row.cluster: row.total for row in totals}
    every = None if None in inertia.values() else sum(inertia.values())
    sides = assigned.sparkSession.createDataFrame(
        [(c, _long(x), _long(every), digest_of(centroids[c])) for c, x in inertia.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(sides), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _long(total: int | None) -> int | None:
    return None if total is None or int(total) >= 1 << 63 else int(total)
