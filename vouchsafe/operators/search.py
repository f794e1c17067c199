"""Collections of vectors and exact cosine search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchsafe.functions.vectors import cosine_to, matrix, unit_rows

#: Bytes of vectors in a tile, of points as of queries; a task holds one of each.
TILE_BYTES = 16 * 1024 * 1024
#: Scores are rounded before they are ranked, so that equal vectors tie whatever block they were multiplied in.
DIGITS = 9


def positions(df: DataFrame, order: list[str]) -> tuple[DataFrame, str]:
    """The rows with a number that is unique in the whole batch and follows its order; and its name.

    One order column is such a number itself. Several name a file or split and a place in it: rows are
    numbered within each split and splits are placed one after the other, so no task sees
    more than a split.
    """
    if len(order) == 1:
        return df, order[0]
    groups, last = order[:-1], order[-1]
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_count"))
    before = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*groups).orderBy(last)) - 1
    placed = df.withColumn("_within", within).join(starts, groups)
    return placed.withColumn("_position", F.col("_start") + F.col("_within")), "_position"


def stage_points(embedded: DataFrame, position: str, payload: list[str]) -> DataFrame:
    """Points of a collection: rows with a vector, under their position in the whole batch."""
    return embedded.where(F.col("_vector").isNotNull()).select(
        F.col(position).alias("id"), F.col("_vector").alias("vector"), *payload
    )


def collection_counts(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("points"))


def search(
    points: DataFrame,
    query: list[float],
    k: int = 5,
    id_col: str = "id",
    vector_col: str = "vector",
) -> DataFrame:
    """The ``k`` best points for one vector. Each task keeps its own ``k`` best.

    Only ids and vectors are scored at first; the other columns are read for the at most ``k`` ids found. Points
    may share an id: those are scored again and ranked like all others.
    """
    shown = [c for c in points.columns if c not in (vector_col, id_col)]
    score = cosine_to(F.col(vector_col), query).alias("score")
    best = points.select(id_col, score).orderBy(F.desc("score"), F.asc(id_col)).limit(k)
    if shown:
        found = points.join(F.broadcast(best.select(id_col).distinct()), points[id_col].eqNullSafe(best[id_col]), "left_semi")
        best = found.select(id_col, *shown, score).orderBy(F.desc("score"), F.asc(id_col)).limit(k)
    return best.select(id_col, *shown, "score")


def search_many(
    points: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "id",
    vector_col: str = "vector",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """The ``k`` best points for each of many vectors: ``query_id, id, score, rank``.

    Points and queries are dealt into tiles of bounded size, and each pair of tiles is a task that multiplies two
    matrices and keeps ``k`` per query; a window merges what the tiles kept. Vectors never pass the driver. The
    smaller side is copied once for each tile of the other.
    """
    dim = queries.agg(F.max(F.size(query_vector))).first()[0]
    per_tile = max(1, tile_bytes // (8 * max(dim or 0, 1)))
    point_tiles, query_tiles = (max(1, -(-df.count() // per_tile)) for df in (points, queries))

    def dealt(df: DataFrame, name: Column, vector: str, own: int, other: int, this: str, that: str) -> DataFrame:
        tile = F.pmod(F.xxhash64(name, F.col(vector)), F.lit(own)).cast("int")
        return df.select(
            name.alias("_name"), F.col(vector).cast("array<double>").alias("_vector"), tile.alias(this),
            F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(that),
        )

    left = dealt(points, F.col(id_col), vector_col, point_tiles, query_tiles, "_p", "_q")
    right = dealt(queries, F.col(query_id), query_vector, query_tiles, point_tiles, "_q", "_p")
    schema = _result_schema(points, queries, id_col, query_id)
    names = [query_id, id_col, "score"]

    def best_of_tiles(tile_points: pa.Table, tile_queries: pa.Table) -> pa.Table:
        ids, keys = tile_points["_name"], tile_queries["_name"]
        if not len(ids) or not len(keys):
            kept, of, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            units, wanted = (unit_rows(matrix(t["_vector"].combine_chunks(), dim)) for t in (tile_points, tile_queries))
            order = np.argsort(np.array(pc.rank(ids.combine_chunks(), sort_keys="ascending", tiebreaker="first")))
            kept, of, scores = _best(units[order], wanted, k)
            kept = order[kept]
        return pa.table([keys.take(pa.array(of)), ids.take(pa.array(kept)), pa.array(scores)], names=names)

    candidates = left.groupBy("_p", "_q").cogroup(right.groupBy("_p", "_q")).applyInArrow(best_of_tiles, schema)
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(id_col))
    return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _best(units: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the ``k`` best of units that stand in the order of their ids: their places, the query, the score."""
    kept, of, scores = [], [], []
    step = max(1, (1 << 22) // len(units))
    for start in range(0, len(wanted), step):
        block = np.round(wanted[start : start + step] @ units.T, DIGITS)
        bars = np.full(len(block), -np.inf)
        if len(units) > k:
            bars = np.partition(block, len(units) - k, axis=1)[:, len(units) - k]
        # all that reach the k-th best, ties included; then k of each query by score and place
        query, place = np.nonzero(block >= bars[:, None])
        order = np.lexsort((place, -block[query, place], query))
        query, place = query[order], place[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        query, place = query[rank < k], place[rank < k]
        kept.append(place)
        of.append(query + start)
        scores.append(block[query, place])
    return np.concatenate(kept), np.concatenate(of), np.concatenate(scores)


def _result_schema(points: DataFrame, queries: DataFrame, id_col: str, query_id: str) -> str:
    return (
        f"{query_id} {queries.schema[query_id].dataType.simpleString()},"
        f"{id_col} {points.schema[id_col].dataType.simpleString()}, score double"
    )


def present(hits: DataFrame, score: str = "score") -> DataFrame:
    """Hits as they are shown: score to four digits, internal fields left out."""
    shown = [c for c in hits.columns if not c.startswith("_") and c != score]
    return hits.select(F.round(score, 4).alias(score), *shown)


def collection_name(dataset: Column, version_id: Column) -> Column:
    return F.concat_ws("__", dataset, version_id)
