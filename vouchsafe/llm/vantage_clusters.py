"""Clustering of integer vectors around centroids that each vector finds in a vantage-point tree.

In every round the tree is rebuilt over the present centroids and broadcast, and each vector looks for its
nearest centroid best-first: the open subtree with the least possible distance is visited next, and a
subtree is left out only if nothing in it can be as near as the best found. Distances that decide are exact
integers; floating-point bounds carry a slack that only ever makes a subtree look nearer.

Defined cases: a vector that is null, of another length, or has a null, NaN or infinite component is left
out. Components beyond +-2^20 count as +-2^20, so that a squared distance fits a long. Vectors at the same
distance from several centroids go to the smallest number. Rows with the same id or vector are each a vector
of their own; equal ids are started from in the order of their vectors. A null id never precedes another in
the choice of the first centroids. With fewer vectors than ``k`` there are as many centroids as vectors; an
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe.llm.common import settle
from vouchsafe.session import small_frame

SCALE = 64
LIMIT = 1 << 26
#: Centroids are gathered on the driver and sent to every task; more than this is refused.
MAX_TREE_BYTES = 64 << 20
#: Vectors that a task searches for at once.
BLOCK = 2048
#: Share of the distances by which a bound is lowered against rounding.
SLACK = 1e-12

ID, POINT = "vec_id", "point"


# ------------------------------------------------------------------ the tree


@dataclass
class VantageTree:
    """Node i holds centroid ``number[i]``; its children are the near and the far half of the rest below it.

    ``low`` and ``high`` bound the distances between the node's centroid and those below each child.
    """

    points: np.ndarray
    number: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def over(points: np.ndarray) -> VantageTree:
        n = len(points)
        number, child = np.zeros(n, np.int64), np.full((n, 2), -1)
        low, high = np.zeros((n, 2)), np.zeros((n, 2))
        todo, made = [(np.arange(n), -1, 0)], 0
        while todo:
            members, parent, side = todo.pop()
            if parent >= 0:
                child[parent, side] = made
            vantage, rest = members[0], members[1:]
            number[made] = vantage
            if len(rest):
                away = squared(points[rest], points[vantage])
                order = np.argsort(away, kind="stable")
                rest, away = rest[order], np.sqrt(away[order].astype(np.float64))
                half = (len(rest) + 1) // 2
                for side, part in enumerate((slice(0, half), slice(half, None))):
                    if len(rest[part]):
                        low[made, side], high[made, side] = away[part][0], away[part][-1]
                        todo.append((rest[part], made, side))
            made += 1
        return VantageTree(points, number, child, low, high)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, and the squared distance."""
        n = len(vectors)
        best, best_number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.points))
        # Each vector's open nodes and the least distance possible in them; a visit frees a place and fills two.
        nodes, bounds = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        active = np.arange(n)
        while len(active):
            rows = np.arange(len(active))
            at = bounds.argmin(axis=1)
            node = nodes[rows, at]
            away = squared(vectors[active], self.points[self.number[node]])
            number = self.number[node]
            better = (away < best[active]) | ((away == best[active]) & (number < best_number[active]))
            best[active[better]], best_number[active[better]] = away[better], number[better]
            away = np.sqrt(away.astype(np.float64))[:, None]
            low, high = self.low[node], self.high[node]
            possible = np.maximum(np.maximum(away - high, low - away) - SLACK * (away + high), 0.0)
            # what is below is at least as far as the parent's bound
            possible = np.maximum(possible, bounds[rows, at][:, None])
            possible[self.child[node] < 0] = np.inf
            bounds[rows, at], nodes[rows, at] = possible[:, 0], self.child[node][:, 0]
            bounds = np.concatenate([bounds, possible[:, 1:]], axis=1)
            nodes = np.concatenate([nodes, self.child[node][:, 1:]], axis=1)
            # Inclusive: a subtree that may hold an equal distance may hold a smaller number.
            radius = np.sqrt(best[active].astype(np.float64)) * (1 + SLACK)
            bounds[bounds > radius[:, None]] = np.inf
            going = np.isfinite(bounds.min(axis=1))
            active, bounds, nodes = active[going], bounds[going], nodes[going]
        return best_number, best


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact in 64-bit integers."""
    difference = a - b
    return np.einsum("ij,ij->i", difference, difference)


# ------------------------------------------------------------------ vectors


def integer_points(vectors: DataFrame, dim: int, id_column: str = ID, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``point``, the components as ``floor(64 x)``, of the vectors that are whole and finite."""
    component = lambda x: x.cast("double")
    whole = F.forall(
        vector, lambda x: F.coalesce(~F.isnan(component(x)) & (F.abs(component(x)) < F.lit(float("inf"))), F.lit(False))
    )
    most = F.lit(float(LIMIT))
    integer = lambda x: F.floor(F.greatest(F.least(component(x) * SCALE, most), -most)).cast("int")
    return vectors.where((F.size(vector) == dim) & whole).select(
        F.col(id_column).cast("bigint").alias(ID), F.transform(vector, integer).alias(POINT)
    )


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids, with the seed before them, have the least hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ID).cast("string")).cast("binary"), 256)
    first = (
        points.select(name.alias("name"), POINT).orderBy(F.col("name").asc_nulls_last(), POINT).limit(k).collect()
    )
    return np.array([row[POINT] for row in first], np.int64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


# ------------------------------------------------------------------ rounds


def _sums(points: DataFrame, tree, k: int, dim: int) -> DataFrame:
    """The vectors' count and sum for each cluster and component, added up within each task first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                vectors = matrix(batch.column(0).slice(start, BLOCK), dim)
                number, _ = tree.value.nearest(vectors)
                np.add.at(totals, number, vectors)
                counts += np.bincount(number, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(totals[some]), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"],
        )

    part = points.select(POINT).mapInArrow(add, "cluster int, n bigint, total array<bigint>")
    single = part.select("cluster", "n", F.posexplode("total").alias("place", "part"))
    total = F.sum(F.col("part").cast("decimal(20,0)"))
    return single.groupBy("cluster", "place").agg(F.sum("n").alias("n"), total.alias("total"))


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means; a centroid without vectors stays."""
    k, dim = centroids.shape
    tree = points.sparkSession.sparkContext.broadcast(VantageTree.over(centroids))
    rows = _sums(points, tree, k, dim).collect()  # at most k * dim rows
    tree.unpersist()
    centroids = centroids.copy()
    for row in rows:
        centroids[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return centroids


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    dim = centroids.shape[1]
    tree = points.sparkSession.sparkContext.broadcast(VantageTree.over(centroids))
    schema = T.StructType.fromDDL("vec_id bigint, cluster int, distance bigint")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                number, distance = tree.value.nearest(matrix(piece.column(1), dim))
                yield pa.record_batch(
                    [piece.column(0), pa.array(number, pa.int32()), pa.array(distance)], names=schema.names
                )

    return points.select(ID, POINT).mapInArrow(find, schema)


def clusters(
    vectors: DataFrame, dim: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, id_column: str = ID,
    vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """Each vector's ``vec_id, cluster, distance``, and the centroids that it was assigned to at the end.

    ``k * dim`` integers are what the driver holds and broadcasts; beyond ``MAX_TREE_BYTES`` it is refused.
    """
    if k * dim * 8 > MAX_TREE_BYTES:
        raise ValueError(f"{k} centroids of {dim} components are more than {MAX_TREE_BYTES} bytes")
    points = settle(integer_points(vectors, dim, id_column, vector), "points")
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.select(ID, F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(points, centroids)
    return settle(assigned(points, centroids), "clusters"), centroids


def long_sum(column: str) -> Column:
    """A sum of longs that ends at the greatest long."""
    total = F.sum(F.col(column).cast("decimal(20,0)"))
    return F.least(total, F.lit(2**63 - 1).cast("decimal(30,0)")).cast("bigint")


def with_inertia(members: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``members`` with their cluster's and all clusters' summed distances and their centroid's digest.

    One row for each cluster is what is joined, so it is small whatever the number of vectors.
    """
    spark = members.sparkSession
    totals = members.groupBy("cluster").agg(long_sum("distance").alias("cluster_inertia")).collect()
    everything = min(sum(row["cluster_inertia"] for row in totals), 2**63 - 1)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = [row.asDict() | {"inertia": everything, "centroid_sha256": digest[row["cluster"]]} for row in totals]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return members.join(F.broadcast(small_frame(spark, about, schema)), "cluster")
