"""Exact top-k inner products by no-random-access aggregation over sorted lists.

In each block of candidates, every dimension has its list of components, read from the top for
positive query weights and from the bottom for negative ones. After each depth, a candidate's score
lies between what its seen components give with the worst, and with the best, that its unseen ones
can still be. A query stops as soon as all but a few candidates fall below the k-th lower bound;
the scores of those left are then resolved. All queries of a block read their lists together, so the
bounds of a depth are two matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlake.llm.common import cut, prepare

QUERY_ROWS, BLOCK_ROWS = 1024, 8192
#: Tasks that the blocks are spread over at most.
PARTITIONS = 20_000
DEPTHS = (0.25, 0.5, 1.0)


def block_top_k(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best in one block, ties to the smaller id; own: the queries' ids, which aren't theirs."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    n, dim = x.shape
    bound = float((np.abs(q).astype(np.float64) @ np.abs(x).astype(np.float64).max(axis=0)).max())
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
    q, x = q.astype(kind), x.astype(kind)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    rank = np.empty((n, dim), np.int32)
    rank[np.argsort(x, axis=0, kind="stable"), np.arange(dim)] = np.arange(n, dtype=np.int32)[:, None]
    ascending = np.sort(x, axis=0)
    least, most = ascending[0], ascending[-1]
    weights = np.concatenate([plus, minus], axis=1)
    waiting, out = np.arange(len(q)), []
    is_own = ids[None, :] == own[:, None]

    def resolve(row: int, some: np.ndarray) -> None:
        score = (x[some] * q[row]).sum(axis=1)
        best = np.lexsort((some, -score))[:k]
        out.append((np.full(len(best), row), some[best], score[best].astype(np.int64)))

    for depth in DEPTHS:
        t = min(n, max(k + 1, int(n * depth)))
        down, up = rank >= n - t, rank < t  # seen from the top, from the bottom
        front_down, front_up = ascending[n - t], ascending[t - 1]
        low = weights[waiting] @ np.concatenate([np.where(down, x, least), np.where(up, x, most)], axis=1).T
        high = low if t == n else weights[waiting] @ np.concatenate([np.where(down, x, front_down), np.where(up, x, front_up)], axis=1).T
        low = np.where(is_own[waiting], -np.inf, low) if kind is not object else np.where(is_own[waiting], -(1 << 200), low)
        kth = np.partition(low, n - min(k, n), axis=1)[:, n - min(k, n)] if kind is not object else np.sort(low, axis=1)[:, n - min(k, n)]
        alive = (high >= kth[:, None]) & ~is_own[waiting]
        stop = (alive.sum(axis=1) <= max(8 * k, n // 16)) | (t == n)
        for i in np.flatnonzero(stop).tolist():
            resolve(int(waiting[i]), np.flatnonzero(alive[i]))
        waiting = waiting[~stop]
        if not len(waiting):
            break
    rows, at, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, int),) * 3
    return rows, order[at], score


def _whole(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates by inner product of floor(scale * x).

    Both frames need vec_id and embedding; other columns are ignored. Queries are compared with all
    vectors but those of their own vec_id, ties go to the smaller vec_id. Vectors that are null or
    empty, or hold null or non-finite components, and rows without vec_id take no part; vectors of
    other dimensions than the query's aren't its candidates. A query id that repeats counts once,
    with its smallest vector; candidates that repeat are separate rows. Empty tables give no rows.
    """
    prepare(vectors.sparkSession)

    def numbers(df: DataFrame) -> DataFrame:
        e = F.col("embedding").cast("array<double>")
        good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return (
            df.filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.coalesce(good, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.size(e).alias("dim"), F.transform(e, lambda x: F.floor(x * scale)).alias("v"))
        )

    asked = numbers(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    x = numbers(vectors)
    blocks = x.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    parts = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
    cell = ["dim", "part", "block"]
    grid = cut(blocks.join(parts, "dim"))
    left = asked.join(grid, "dim").select(
        "dim", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v"
    )
    right = x.join(grid, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v"
    )

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            rows = at = score = np.empty(0, np.int64)
        else:
            rows, at, score = block_top_k(_whole(a), _whole(b), b.column("vec_id").to_numpy(), a.column("vec_id").to_numpy(), k)
        return pa.table({
            "query_id": pa.array(a.column("vec_id").to_numpy()[rows], pa.int64()),
            "vec_id": pa.array(b.column("vec_id").to_numpy()[at], pa.int64()),
            "score": pa.array(score, pa.int64()),
        })

    # Blocks are small in bytes and long in work: their partitions are named, so that none are merged.
    cells = grid.agg(F.sum(F.col("blocks") * F.col("parts"))).first()[0] or 0
    n = int(min(max(1, 2 * cells), PARTITIONS))
    left, right = left.repartition(n, *cell), right.repartition(n, *cell)
    best = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
