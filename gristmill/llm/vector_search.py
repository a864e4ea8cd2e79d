"""Exact top-k search by inner product of whole-number vectors.

Queries are cut into tiles and candidates into shards of bounded size. Every tile meets every
shard: a tile is copied to all shards, a shard to all tiles, and both are brought together by the
pair's number, so that no task holds more than one tile and one shard. There a matrix product
gives all scores, and a partial selection keeps the best ``k`` of each query. The lists of the
shards are merged as a tree, groups of ``FAN`` shards at a time.

Vectors whose lengths differ are never compared; empty ones are compared with each other. Vectors
that are null, or hold null or non-finite components, take no part, nor do rows without an id. A
row is a candidate for every row but itself: repeated rows, and several vectors under one id, are
each a candidate, and as queries have a list each. An empty table gives no rows. Only a score
that is returned and leaves 64 bits raises an error; scores are right whatever the size of others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.scratch import Scratch

# Components of one shard and of one tile, 8 bytes each.
SHARD_VALUES = 1 << 19
TILE_VALUES = 1 << 16
# Columns of a matrix product at a time.
COLUMNS = 2048
FAN = 32
SCALE = 256
# Stands for a score below all that fit into 64 bits.
UNFIT = -(2**63) + 1


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of each component as bigint; null if the vector takes no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(wide, lambda x: F.floor(x * SCALE)))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows)


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))


def _products(queries: np.ndarray, candidates: np.ndarray, allowed: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of the ``allowed`` pairs; those below 64 bits are ``UNFIT``.

    ``bound`` is at least the greatest product of two norms.
    """
    if bound < 2.0**53:
        # Doubles are exact up to there and multiply much faster than 64-bit integers.
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    # Whole numbers wrap around, so a sum that fits in the end is right.
    scores = queries @ candidates.T
    if bound >= 2.0**62:
        near = queries.astype(np.float64) @ candidates.astype(np.float64).T
        error = bound * 2.0**-52 * (queries.shape[1] + 2)
        for i, j in zip(*np.nonzero((np.abs(near) + error >= 2.0**63) & allowed)):
            exact = sum(x * y for x, y in zip(queries[i].tolist(), candidates[j].tolist()))
            if exact >= 2**63:
                raise ValueError("a score among the best doesn't fit into 64 bits")
            scores[i, j] = exact if exact > UNFIT else UNFIT
    return scores


def best_of_block(
    queries: np.ndarray, query_rows: np.ndarray, candidates: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
):
    """(query place, id, score) of each query's ``k`` best candidates, ties to smaller ids.

    ``query_rows`` and ``rows`` number the rows; a row is no candidate for itself.
    """
    order = np.argsort(ids, kind="stable")
    ids, candidates, rows = ids[order], candidates[order], rows[order]
    bound = float(_norms(queries).max(initial=0) * _norms(candidates).max(initial=0)) * (1 + 1e-9)
    kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for at in range(0, len(ids), COLUMNS):
        part = ids[at : at + COLUMNS]
        allowed = query_rows[:, None] != rows[None, at : at + COLUMNS]
        scores = _products(queries, candidates[at : at + COLUMNS], allowed, bound)
        scores[~allowed] = np.iinfo(np.int64).min
        cut = max(0, scores.shape[1] - k)
        least = np.partition(scores, cut, axis=1)[:, cut]
        row, column = np.nonzero((scores >= least[:, None]) & allowed)
        found = (row, part[column], scores[row, column])
        row, own, score = (np.concatenate(x) for x in zip(kept, found))
        order = np.lexsort((own, -score, row))
        row, own, score = row[order], own[order], score[order]
        first = np.searchsorted(row, row, side="left")
        top = np.arange(len(row)) - first < k
        kept = row[top], own[top], score[top]
    return kept


def _search(k: int):
    def run(tile: pa.Table, shard: pa.Table) -> pa.Table:
        ids, query_ids = shard.column("vec_id").to_numpy(), tile.column("query_id").to_numpy()
        query_rows = tile.column("query_row").to_numpy()
        if len(ids) and len(query_ids):
            place, own, score = best_of_block(
                _matrix(tile.column("query"), len(query_ids)),
                query_rows,
                _matrix(shard.column("vector"), len(ids)),
                ids,
                shard.column("row").to_numpy(),
                k,
            )
            query, query_row = query_ids[place], query_rows[place]
        else:
            query = query_row = own = score = np.empty(0, np.int64)
        part = shard.column("shard").to_pylist()[:1] * len(query)
        columns = [pa.array(x, pa.int64()) for x in (query, query_row, own, score, part)]
        return pa.table(columns, names=["query_id", "query_row", "vec_id", "score", "shard"])

    return run


def top_k(
    df: DataFrame, is_query: Column, k: int, row_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows for each row with ``is_query``."""
    scratch = Scratch(df.sparkSession, "vector-search")
    rows = (
        df.where(F.col(row_id).isNotNull())
        .select(
            F.col(row_id).cast("bigint").alias("vec_id"),
            whole_numbers(F.col(vector)).alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
        .where(F.col("vector").isNotNull())
        .withColumn("size", F.size("vector"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    rows = scratch.keep(rows, "rows")
    n, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()

    def parts(of: int, values: int) -> Column:
        return F.greatest(F.ceil(F.lit(of) * F.col("size") / values), F.lit(1)).cast("bigint")

    shards, tiles = parts(n, SHARD_VALUES), parts(asking, TILE_VALUES)
    key = F.xxhash64("row")

    def every(numbers: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), numbers - 1))

    # New names on one side: a grouping of two frames with the same columns would mix them up.
    left = rows.where("asks").select(
        F.col("vec_id").alias("query_id"),
        F.col("row").alias("query_row"),
        F.col("vector").alias("query"),
        F.col("size").alias("size"),
        F.pmod(key, tiles).alias("tile"),
        every(shards).alias("shard"),
    )
    right = rows.select(
        F.col("vec_id").alias("vec_id"),
        F.col("row").alias("row"),
        F.col("vector").alias("vector"),
        F.col("size").alias("size"),
        F.pmod(key, shards).alias("shard"),
        every(tiles).alias("tile"),
    )
    by = ("size", "tile", "shard")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        _search(k), "query_id bigint, query_row bigint, vec_id bigint, score bigint, shard bigint"
    )
    order = (F.col("score").desc(), F.col("vec_id"))
    most = rows.agg(F.max(shards)).first()[0] or 1
    while most > FAN:
        most = -(-most // FAN)
        found = found.withColumn("shard", F.expr(f"shard div {FAN}"))
        window = Window.partitionBy("query_row", "shard").orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).drop("rank")
    last = Window.partitionBy("query_row").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    unfit = F.raise_error(F.lit("a returned score doesn't fit into 64 bits"))
    fitting = F.when(F.col("score") == UNFIT, unfit.cast("bigint")).otherwise(F.col("score"))
    return found.select("query_id", "rank", "vec_id", fitting.alias("score"))
