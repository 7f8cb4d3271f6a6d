"""Near-duplicate vectors by int8 tile products with certified quantisation error.

Each unit vector is stored as whole numbers q of -127..127 and a scale s, with the exact length of
what rounding lost, e = |x - s q|. For two vectors, |x.y - s s' q.q'| <= e + |s q| e', so the whole
number product of two tiles decides most pairs for certain. Only pairs whose interval holds the
threshold are computed again in double precision from the full vectors.

Every pair of different vectors is covered by one tile: the number of tiles grows with the square of
the number of blocks, which is the price of an exact all-pairs answer. Tiles report link counts and a
spanning forest, never pairs; equal vectors are one row with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.llm.common import cut, prepare
from symlake.llm.components import connected_components

BLOCK_ROWS, BLOCK_CELLS, STRIPE = 8192, 1 << 20, 512
#: Tasks that the tiles are spread over at most.
PARTITIONS = 20_000


def usable(vector: str) -> F.Column:
    """Neither null nor empty, all components there and finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, |scale q|, error) of unit vectors; error is an upper bound also under rounding."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.linalg.norm(near, axis=1) + 1e-12, np.linalg.norm(unit - near, axis=1) + 1e-12


class Forest:
    """Smallest-index labels under unions given as arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            if (x == y).all():
                return
            low = np.minimum(x, y)
            np.minimum.at(self.label, x, low)
            np.minimum.at(self.label, y, low)
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def _stack(table: pa.Table) -> np.ndarray:
    column = table.column("embedding").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def link_tile(raw: np.ndarray, times: np.ndarray, rows: np.ndarray, cols: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, Forest, int]:
    """(links of each vector, forest, pairs computed in full) between vectors rows and cols of raw; same: rows is cols."""
    # Extreme magnitudes are brought to 1 first, so that no square over- or underflows.
    top = np.abs(raw).max(axis=1, keepdims=True)
    size = np.linalg.norm(raw / top, axis=1)
    unit = raw / top / size[:, None]
    q, scale, length, error = quantise(unit)
    right, links, forest, full = q[cols].astype(np.float32).T.copy(), np.zeros(len(raw), np.int64), Forest(len(raw)), 0
    dim = raw.shape[1]
    exact = dim * 127 * 127 < 1 << 24  # float32 sums whole numbers exactly up to here
    if not exact:
        right = right.astype(np.float64)
    most_error, most_scale, least_scale = error[cols].max(), scale[cols].max(), scale[cols].min()
    for at in range(0, len(rows), STRIPE):
        part = rows[at : at + STRIPE]
        product = q[part].astype(right.dtype) @ right
        # The least whole number that can still mean a link, for any partner in this tile.
        room = threshold - 1e-9 - error[part] - length[part] * most_error
        least = room / (scale[part] * np.where(room < 0, least_scale, most_scale))
        r, c = np.nonzero(product >= least[:, None].astype(right.dtype))
        value = product[r, c].astype(np.float64)
        a, b = part[r], cols[c]
        if same:
            keep = a < b
            a, b, value = a[keep], b[keep], value[keep]
        value *= scale[a] * scale[b]
        bound = error[a] + length[a] * error[b] + 1e-9
        possible = value + bound >= threshold
        a, b, sure = a[possible], b[possible], (value - bound >= threshold)[possible]
        ask = np.flatnonzero(~sure)
        full += len(ask)
        for k in range(0, len(ask), 1 << 16):
            i = ask[k : k + (1 << 16)]
            sure[i] = np.einsum("ij,ij->i", unit[a[i]], unit[b[i]]) >= threshold
        a, b = a[sure], b[sure]
        np.add.at(links, a, times[b])
        np.add.at(links, b, times[a])
        forest.union(a, b)
    return links, forest, full


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    vectors needs vec_id and embedding; other columns are ignored. Vectors link where their cosine in
    double precision reaches the threshold; vectors of different dimensions don't. Null or zero
    vectors and such with null or non-finite components link with nothing. Rows with one vec_id are
    separate vectors of one component. A null vec_id takes no part: no links, no component, kept.
    An empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.filter(usable("embedding") & F.col("vec_id").isNotNull())
    classes = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")))
    sizes = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    per = F.greatest(F.lit(64), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_CELLS) / F.col("dim"))))
    sizes = cut(sizes.select("dim", F.ceil(F.col("n") / per).cast("int").alias("blocks")))
    tiles = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    placed = classes.withColumn("dim", F.size("embedding")).join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("rep", "embedding"), F.col("blocks")).cast("int"))
    cells = placed.select(
        "dim", "rep", "times", "embedding", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "times", "embedding")

    def tile(batch: pa.Table) -> pa.Table:
        i, j = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
        raw, times, ids = _stack(batch), batch.column("times").to_numpy(), batch.column("rep").to_numpy()
        block = batch.column("block").to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, forest, _ = link_tile(raw, times, left, right, i == j, threshold) if len(left) and len(right) else (np.zeros(len(ids), np.int64), Forest(len(ids)), 0)
        some, joined = np.flatnonzero(links), np.flatnonzero(forest.label != np.arange(len(ids)))
        return pa.table({
            "rep": pa.array(np.concatenate([ids[some], ids[joined]]), pa.int64()),
            "class_of": pa.array(np.concatenate([some * 0, ids[forest.label[joined]]]), pa.int64()),
            "links": pa.array(np.concatenate([links[some], joined * 0]), pa.int64()),
        })

    # A class is known by its smallest id; two classes share one only if a vec_id repeats with different vectors.
    # Tiles are small in bytes and long in work: their partitions are named, so that none are merged.
    spread = cells.repartition(int(min(max(1, 2 * tiles), PARTITIONS)), "dim", "i", "j")
    found = cut(spread.groupBy("dim", "i", "j").applyInArrow(tile, "rep long, class_of long, links long"))
    links = found.filter("links > 0").groupBy("rep").agg(F.sum("links").alias("linked"))
    grouped = connected_components(found.filter("links = 0").select(F.col("rep").alias("src"), F.col("class_of").alias("dst")))
    members = rows.join(classes.select(F.col("embedding"), "rep", "times"), "embedding", "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("rep")).alias("rep"), "times")
    return (
        members.join(links, "rep", "left").join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "vec_id",
            F.when(F.col("rep").isNull(), F.lit(0)).otherwise(F.coalesce("linked", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
