"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds its distinct word shingles. SuperMinHash gives each element a random
permutation of the slots instead of independent ranks; element e puts rank r + j into the slot
that its permutation visits in step j, and a document stops as soon as every slot holds a value
below j. Signatures are cut into bands; documents that share a band are candidates.
No link is taken on trust: candidates are compared on their full shingle sets.

Bands: 32 of 5 slots. A pair at similarity 0.8 is missed with probability (1 - 0.8^5)^32 = 3e-6,
less above it.

Scale. Documents with equal sets form one class and only its smallest id goes on, so copies cost
no pairs. In each bucket, the member with most company is compared with the others; buckets whose
members are then still in different components get their remaining cross pairs compared: small ones
by a join, those of over SMALL members in cells of two blocks of CELL members, where sizes and
sketches of the signatures are held against each other and only pairs that pass both come out (a pair
at the threshold fails to with probability below 1e-8). Texts are
shipped to the comparison for candidates only, once per group of candidates that hang together, or per
pair of its blocks where the group is large; no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.llm.common import cut, prepare
from symlake.llm.components import connected_components

BANDS, BAND_SLOTS = 32, 5
SLOTS = BANDS * BAND_SLOTS
#: Buckets of the id filter that is broadcast before texts are joined: its size is bounded by this, not by the data.
ID_BUCKETS = 1 << 18
#: Shingles in a block of candidates that are compared in one task.
BLOCK_SHINGLES = 500_000
#: Members of a bucket whose pairs a join makes; members in a block of a larger bucket; tasks that cells are spread over at most.
SMALL, CELL, PARTITIONS = 64, 1000, 20_000
_CACHE = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash; emptied when full, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; with fewer words, of the sequence as one."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(width, len(h))
    n = len(h) - k + 1
    acc = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        acc = _mix(acc * _GOLD + h[i : i + n])
    return np.unique(acc)


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures of many sets at once, level by level; rows of empty sets stay infinite."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets) * slots, np.inf)
    if not sizes.sum():
        return out.reshape(-1, slots)
    x = np.concatenate(sets)
    base = np.repeat(np.arange(len(sets)) * slots, sizes)
    places: np.ndarray | None = None  # the permutation of each element that is still drawn for
    for j in range(slots):
        draw = _mix(x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        rank = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
        k = j + (_mix(draw + _GOLD) % np.uint64(slots - j)).astype(np.int64)
        rows = np.arange(len(x))
        slot = k if places is None else places[k, rows]
        np.minimum.at(out, base + slot, rank)
        # Early stop: later ranks are j + 1 or more, so a document whose slots all hold less is done;
        # drawing on for it would change nothing, so finished elements leave when they are half of all.
        going = (out.reshape(-1, slots).max(axis=1) > j + 1)[base // slots]
        left = int(going.sum())
        if not left:
            break
        if places is None:
            x, base, k = x[going], base[going], k[going]
            places = np.repeat(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32)[:, None], left, axis=1)
            places[k, np.arange(left)] = 0
        else:
            places[k, rows] = places[j]
            if 2 * left < len(x):
                x, base, places = x[going], base[going], places[:, going]
    return out.reshape(-1, slots)


def _band_keys(signature: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), BANDS, BAND_SLOTS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS)).copy()
    for i in range(BAND_SLOTS):
        acc = _mix(acc * _GOLD + bits[:, :, i])
    return acc.view(np.int64)


def _sketches(signature: np.ndarray) -> list[bytes]:
    """Two bytes of hash a slot."""
    return [row.tobytes() for row in (_mix(np.ascontiguousarray(signature).view(np.uint64)) >> np.uint64(48)).astype("<u2")]


def _cell_pairs(percent: int):
    """The pairs of a cell's two blocks that are in different parts, near enough in size, and agree in so many slots that the similarity may be reached."""
    p = percent / 100
    least = SLOTS * (p - 6 * (p * (1 - p) / SLOTS) ** 0.5)

    def run(cell: pa.Table) -> pa.Table:
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        rep, n, part, block = (cell.column(c).to_numpy() for c in ("rep", "n", "part", "block"))
        sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), "<u2").reshape(len(rep), SLOTS)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for k in range(0, len(left), 64):
            a = left[k : k + 64]
            good = (part[a][:, None] != part[right]) & (100 * np.minimum(n[a][:, None], n[right]) >= percent * np.maximum(n[a][:, None], n[right]))
            good &= (rep[a][:, None] < rep[right]) if i == j else True
            x, y = np.nonzero(good)
            for m in range(0, len(x), 1 << 16):
                s, t = a[x[m : m + (1 << 16)]], right[y[m : m + (1 << 16)]]
                near = (sketch[s] == sketch[t]).sum(axis=1) >= least
                found.append(np.stack([rep[s[near]], rep[t[near]]]))
        both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.table({"a": pa.array(both.min(axis=0), pa.int64()), "b": pa.array(both.max(axis=0), pa.int64())})

    return run


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()

        def some(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            signature = super_minhash(sets)
            keys = _band_keys(signature)
            bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), bands, pa.array(_sketches(signature), pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "bands", "sketch"],
            )

        for batch in batches:
            ids: list = []
            sets: list[np.ndarray] = []
            total = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                sets.append(shingle_set(text.as_py(), width, words))
                total += len(sets[-1])
                if total > 100_000:  # bounds the permutations in memory
                    yield some(ids, sets)
                    ids, sets, total = [], [], 0
            if ids:
                yield some(ids, sets)

    return run


def _verified(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of pairs whose full sets reach the similarity; sizes: rep, n.

    Candidates that hang together are compared in one place, so a text moves once however many
    partners it has. A large group is cut into blocks of about BLOCK_SHINGLES by a hash of the id, and
    its texts go to those pairs of blocks that have candidates: no task holds more than two blocks.
    """
    near = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).alias("bucket")
    groups = connected_components(pairs, "a", "b")
    blocks = groups.join(sizes, F.col("node") == F.col("rep")).groupBy("component").agg((F.floor(F.sum("n") / BLOCK_SHINGLES) + 1).cast("int").alias("blocks"))
    placed = cut(groups.join(blocks, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    ends = pairs.join(placed.select(F.col("node").alias("a"), "component", F.col("block").alias("x")), "a").join(placed.select(F.col("node").alias("b"), F.col("block").alias("y")), "b")
    asked = cut(ends.select("component", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", "b"))
    cells = asked.select("component", "i", "j").distinct()
    sides = cells.select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    # At most ID_BUCKETS longs, whatever the data: rows that can't matter leave before the shuffle.
    wanted = placed.select(F.col("node").alias("doc_id")).select(near).distinct()
    texts = docs.select("doc_id", "text", near).join(F.broadcast(wanted), "bucket", "left_semi").select("doc_id", "text")
    where = placed.join(sides, ["component", "block"]).select(F.col("node").alias("doc_id"), "component", "i", "j")
    rows = texts.join(where, "doc_id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, sets = _Words(), {}
        for doc_id, text in zip(left.column("doc_id").to_pylist(), left.column("text"), strict=True):
            sets.setdefault(doc_id, []).append(shingle_set(text.as_py(), width, words))
        found = [(a, b) for a, b in zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True) if any(_similar(x, y, percent) for x in sets.get(a, ()) for y in sets.get(b, ()))]
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    cell = ("component", "i", "j")
    rows = rows.select(*(F.col(c).alias(c) for c in rows.columns))  # new attributes: both sides come from the same checkpoint
    return rows.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(run, "a long, b long")


def _crowded(slots: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of large buckets' members (key, rep, n, part, m) that may be similar, cell by cell."""
    blocks = F.ceil(F.col("m") / CELL).cast("int")
    cells = int(slots.select("key", blocks.alias("k")).distinct().agg(F.sum(F.col("k") * (F.col("k") + 1) / 2)).first()[0] or 0)
    if not cells:
        return slots.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    placed = slots.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).join(sketches, "rep")
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "part", "sketch")
    return spread.repartition(min(2 * cells, PARTITIONS), "key", "i", "j").groupBy("key", "i", "j").applyInArrow(_cell_pairs(percent), "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    docs needs doc_id and text; other columns are ignored. Links join documents with
    100 * intersection >= percent * union of their word shingles. Cases:
    null, empty or blank text: no shingles, its own component; fewer words than width: one shingle
    of the whole sequence; several rows with one doc_id: one node, linked if any of its texts is;
    null doc_id: links with nothing, component_id null and kept true; empty table: no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(docs.mapInArrow(_signatures(width), "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary"))
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(usable.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n")))
    slots = classes.select(F.explode("bands").alias("key"), "rep", "n")
    shared = slots.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    slots = cut(slots.join(shared, "key"))
    company = slots.groupBy("rep").agg(F.sum("c").alias("deg"))
    centre = slots.join(company, "rep").groupBy("key").agg(F.max(F.struct("deg", (-F.col("rep")).alias("low"), "n")).alias("x"))
    sized = "100 * least(na, nb) >= {p} * greatest(na, nb)".format(p=percent)
    first = cut(
        slots.join(centre, "key").select((-F.col("x.low")).alias("a"), F.col("x.n").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb"))
        .filter("a <> b").filter(sized).select("a", "b").distinct()
    )
    sizes = classes.select("rep", "n")
    links = cut(_verified(first, sizes, docs, width, percent))
    grouped = connected_components(links, "a", "b")
    slots = slots.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("part"))
    split = slots.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("m")).filter("p <> q").select("key", "m")
    slots = cut(slots.join(split, "key"))
    few = slots.filter(F.col("m") <= SMALL)
    left, right = (few.select("key", *(F.col(c).alias(c + s) for c in ("rep", "n", "part"))) for s in "ab")
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = cut(
        left.join(right, "key").filter("repa < repb and parta <> partb").filter(sized).select(F.col("repa").alias("a"), F.col("repb").alias("b"))
        .unionByName(_crowded(slots.filter(F.col("m") > SMALL), classes.select("rep", "sketch"), percent)).distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    links = links.unionByName(cut(_verified(second, sizes, docs, width, percent)))
    member = signed.join(classes.select("set_hash", "rep"), "set_hash", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"))
    several = member.filter("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("doc_id")
    joined = member.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = connected_components(links.unionByName(joined.filter("b is not null")), "a", "b").select(F.col("node").alias("rep"), "component")
    return member.join(final, "rep", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
