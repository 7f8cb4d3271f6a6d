"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

The token shares p of the sources are exponentiated: w = p^a / sum(p^a). The exponent a is bisected
on a grid to the largest one that meets a target entropy, and further down or up to none beyond a
repetition limit. A budget of tokens then gives every source a quota. A source is read in epochs;
each epoch visits its documents in a permutation of its own, cut into BLOCKS blocks by key. Whole
epochs and whole blocks are taken while the quota lasts; only the block in which it ends is sorted.

Sums per source, epoch and block are taken before anything moves, so a source with a third of all
rows is 4,096 numbers, and the largest sorted group is one block of it.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlake.llm.common import broadcast_if_small, cut, prepare, stored

GRID, BLOCKS = 1024, 4096
#: Entropy of the mixture as a share of the greatest possible one; times that a source is repeated at most.
ENTROPY, REPEATS = 0.95, 4.0


def tokens_of(text: Column) -> Column:
    """Words between white space, at least one: so every document has a weight. Null text counts as empty."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def order_key(doc_id: Column, text_md5: Column, epoch: Column) -> Column:
    """Only rows with one doc_id and one text share a key."""
    return F.md5(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("")), epoch.cast("string"), text_md5).cast("binary"))


def weights(sizes: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, lengths: float | None = None) -> DataFrame:
    """sizes (source, tokens) with w, the weight, and quota, the source's tokens in the mixture.

    The exponent is the largest on the grid 0, 1/GRID, ... 1 at which the entropy of w reaches
    `entropy` times that of equal shares; then, if some source would be repeated more than `repeats`
    times, the smallest above it at which none is (1 at most). The budget is a number of tokens, or of
    lengths of the corpus. Without one, the mixture is as large as it must be to hold every document
    once. Each round of the bisection is one pass over one
    row per source with sixteen candidate exponents side by side, so the number of sources isn't
    bounded by a task.
    """
    total, n = sizes.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return sizes.select("source", "tokens", F.lit(1.0).alias("w"), F.lit(0).cast("long").alias("quota"))
    budget = int(lengths * total) if lengths is not None else budget
    target = entropy * log(n)
    p = F.col("tokens") / float(total)

    def at(steps: list[int]) -> dict[int, tuple[float, float, float]]:
        """Of each exponent: entropy, most repetitions of a source, sum of powers."""
        some = sizes.select(p.alias("p"), F.explode(F.array(*map(F.lit, steps))).alias("k")).withColumn("q", F.pow("p", F.col("k") / float(GRID)))
        # sum(q log q) and sum(q) give the entropy of q / sum(q) without a second pass.
        rows = some.groupBy("k").agg(F.sum("q").alias("s"), F.sum(F.col("q") * F.log("q")).alias("l"), F.max(F.col("q") / F.col("p")).alias("m"), F.max(F.col("p") / F.col("q")).alias("c")).collect()
        return {r["k"]: (log(r["s"]) - r["l"] / r["s"], r["m"] * r["c"] if budget is None else r["m"] / r["s"] * budget / total, r["c"] * r["s"]) for r in rows}

    def last(good, low: int, high: int) -> int:
        """The largest step of low..high for which good holds, if it holds up to some step; low otherwise."""
        while low < high:
            stride = max(1, (high - low) // 16)
            seen = at(steps := sorted({*range(low + stride, high, stride), high}))
            ok = [k for k in steps if good(seen[k])]
            if ok and max(ok) == high:
                return high
            low, high = max(ok, default=low), min(k for k in steps if k > max(ok, default=low)) - 1
        return low

    k = last(lambda x: x[0] >= target - 1e-12, 0, GRID)
    if at([k])[k][1] > repeats:
        k = min(GRID, last(lambda x: x[1] > repeats, k, GRID) + 1)
    q = F.pow(p, F.lit(k / GRID))
    s = sizes.agg(F.sum(q)).first()[0]
    size = total * at([k])[k][2] if budget is None else budget
    quota = F.floor(q / s * float(size)).cast("long")
    return sizes.select("source", "tokens", (q / s).alias("w"), (F.greatest(quota, "tokens") if budget is None else quota).alias("quota"))


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, lengths: float | None = None) -> DataFrame:
    """The mixture: the rows of docs, as often as they are taken, with three more columns epoch, place and mix_tokens.

    docs needs doc_id, text and source; its other columns stay. Columns named epoch, place or
    mix_tokens are replaced. A source's quota is filled by whole epochs first; in the last one, by its
    documents in the order of the epoch's permutation while the next still fits in whole. Null source
    is a source; null and repeated doc_ids are rows of their own. Rows with one doc_id and one text
    share a place in the permutation; where the quota ends among them, as many are taken as fit.
    place is the row's key in its source's epoch. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("epoch", "place", "mix_tokens")
    text = F.col("text").cast("string")
    rows = docs.withColumn("mix_tokens", tokens_of(text)).withColumn("key_", text_key(text))
    # What the quotas are filled by; texts stay where they are.
    slim = stored(rows.select(F.col("source").cast("string").alias("source"), "doc_id", "key_", "mix_tokens"))
    sizes = cut(slim.groupBy("source").agg(F.sum("mix_tokens").cast("long").alias("tokens")))
    plan = weights(sizes, entropy, repeats, budget, lengths).select(F.col("source").alias("s_"), F.floor(F.col("quota") / F.col("tokens")).cast("int").alias("whole"), (F.col("quota") % F.col("tokens")).alias("rest"))
    plan = broadcast_if_small(cut(plan))

    def keyed(epoch: Column) -> Column:
        return order_key(F.col("doc_id"), F.col("key_"), epoch)

    block = F.conv(F.substring("place", 1, 3), 16, 10).cast("int")
    last = slim.join(plan, F.col("source").eqNullSafe(F.col("s_"))).select("s_", "rest", "mix_tokens", keyed(F.col("whole")).alias("place"))
    sums = last.groupBy("s_", "rest", block.alias("block")).agg(F.sum("mix_tokens").alias("t"))
    upto = Window.partitionBy("s_").orderBy("block")
    before = sums.withColumn("upto", F.sum("t").over(upto)).withColumn("before", F.col("upto") - F.col("t"))
    # The block in which the quota ends: all before it are taken, none after it. There is one, since rest < tokens.
    edge = cut(before.filter("before <= rest and upto > rest").select(F.col("s_").alias("e_"), F.col("block").alias("edge"), "before"))
    inside = last.withColumn("block", block).join(broadcast_if_small(edge), F.col("s_").eqNullSafe(F.col("e_"))).filter(F.col("block") == F.col("edge"))
    # One row per place: rows that share it are counted before they move.
    places = inside.groupBy("s_", "rest", "before", "place").agg(F.sum("mix_tokens").alias("all"), F.min("mix_tokens").alias("each"))
    sofar = F.col("before") + F.sum("all").over(Window.partitionBy("s_").orderBy("place"))
    ends = places.withColumn("sofar", sofar).filter("sofar > rest").groupBy("s_").agg(F.min(F.struct("place", F.floor((F.col("rest") - F.col("sofar") + F.col("all")) / F.col("each")).alias("some"))).alias("e"))
    limit = cut(plan.select("s_", "whole").join(ends.select(F.col("s_").alias("u_"), F.col("e.place").alias("until"), F.col("e.some").alias("some")), F.col("s_").eqNullSafe(F.col("u_"))).select("s_", "whole", "until", "some"))
    placed = (
        rows.join(broadcast_if_small(limit), F.col("source").cast("string").eqNullSafe(F.col("s_")))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
        .withColumn("place", keyed(F.col("epoch")))
    )
    out = [*docs.columns, "mix_tokens", "epoch", "place"]
    taken = placed.filter((F.col("epoch") < F.col("whole")) | (F.col("place") < F.col("until"))).select(*out)
    if not limit.filter("some > 0").limit(1).count():
        return taken
    # Rows at the place where the quota ends: equal rows are one with a number, of which as many are taken as fit.
    tied = placed.filter((F.col("some") > 0) & (F.col("epoch") == F.col("whole")) & (F.col("place") == F.col("until"))).groupBy(*out, "s_", "some").agg(F.count("*").alias("n_"))
    prior = F.sum("n_").over(Window.partitionBy("s_").orderBy(F.xxhash64(*out))) - F.col("n_")
    some = tied.withColumn("k_", F.least(F.col("n_"), F.col("some") - prior)).filter("k_ > 0")
    return taken.unionByName(some.withColumn("x_", F.explode(F.sequence(F.lit(1), F.col("k_").cast("int")))).select(*out))
