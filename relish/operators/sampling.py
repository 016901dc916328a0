"""Sampling by hashed draws: exact sizes, no product of users and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relish.functions.hashing import hash_below
from relish.session import materialize

_CHUNK = 65_536           # positions one generated row may expand to
_BIGINT_SAFE = 3_037_000_499  # products of two smaller numbers fit in 64 bits


def next_prime(n: int) -> int:
    """The smallest prime >= n."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


class Shuffle:
    """A seeded order of the items 0..n-1 for every key, computed by position.

    Position i holds item ``(a + b*i) mod p`` with p the next prime and a, b hashed from
    the key: a pairwise independent family, so each item, and each pair, is equally
    likely to come early. Places that hold numbers >= n are skipped by the caller.
    """

    def __init__(self, n: int, seed: str):
        self.n, self.p, self.seed = n, next_prime(n), seed
        self.gap = self.p - n
        self.number = "bigint" if self.p < _BIGINT_SAFE else "decimal(38,0)"

    def start(self, key: Column) -> Column:
        return hash_below(self.p, F.lit(f"{self.seed}a"), key)

    def stride(self, key: Column) -> Column:
        return F.lit(1) + hash_below(max(self.p - 1, 1), F.lit(f"{self.seed}b"), key)

    def item(self, start: Column, stride: Column, position: Column) -> Column:
        return ((start + stride.cast(self.number) * position.cast(self.number)) % F.lit(self.p)).cast("bigint")


def sample_rows(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), F.col(key)).limit(n)


def sample_items_per_key(keys: DataFrame, key: str, k: int, n_items: int, seed: str) -> DataFrame:
    """``k`` distinct random item indexes per key, all items when there are fewer. Row-local."""
    order = Shuffle(n_items, seed)
    placed = keys.select(key, order.start(F.col(key)).alias("_a"), order.stride(F.col(key)).alias("_b"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(min(k + order.gap, order.p) - 1)),
                        lambda i: order.item(F.col("_a"), F.col("_b"), i))
    picks = F.slice(F.filter(drawn, lambda x: x < F.lit(n_items)), 1, k)
    return placed.select(key, F.posexplode(picks).alias("draw", "item_idx"))


def _spots(seen: DataFrame, key: str, k: int, slack: int, size: int, **per_key: Column) -> DataFrame:
    """Per key the positions that can hold its first ``k`` unseen items: k plus what it has seen, by rows or by the sum of ``_n``.

    ``per_key`` columns are computed once per key, before its positions are expanded. A
    key that has seen millions of items is cut into chunks first, which spread out.
    """
    upto = F.least(F.lit(k) + F.lit(slack) + F.col("_n"), F.lit(size))
    count = F.sum("_n") if "_n" in seen.columns else F.count("*")
    spans = (seen.groupBy(key).agg(count.alias("_n"))
                 .select(key, upto.alias("_upto"), *[c.alias(n) for n, c in per_key.items()])
                 .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_upto") - 1) / _CHUNK))))
                 .repartition(F.col(key), F.col("_chunk")))
    last = F.least((F.col("_chunk") + 1) * _CHUNK, F.col("_upto")) - 1
    return spans.select(key, *per_key, F.explode(F.sequence(F.col("_chunk") * _CHUNK, last)).alias("pos"))


def first_unseen(seen: DataFrame, key: str, item: str, k: int, n_items: int, order: Shuffle | None = None) -> DataFrame:
    """Per key the first ``k`` items of its order that are not among its seen ones.

    ``seen`` holds distinct (key, item) rows; items are numbered 0..n_items-1, in rank
    order unless a ``Shuffle`` gives every key its own order. Only k + |seen| positions
    per key are looked at, so the work is linear in the input, and exact: at most |seen|
    of them can fall out. The rank window keeps k rows per key before it shuffles.
    """
    if order is None:
        # a key's k unseen items lie before k and all it has seen, so only what it has seen there can push them further back
        count = seen.groupBy(key).agg(F.count("*").alias("_n"))
        early = materialize(seen.join(count, key).where(F.col(item) < F.lit(k) + F.col("_n")).select(key, item), "early")
        keys = count.select(key, F.lit(0).alias("_n")).unionByName(early.select(key, F.lit(1).alias("_n")))
        spots = _spots(keys, key, k, 0, n_items).withColumn(item, F.col("pos"))
        seen = early
    else:
        spots = _spots(seen, key, k, order.gap, order.p, _a=order.start(F.col(key)), _b=order.stride(F.col(key)))
        spots = spots.select(key, "pos", order.item(F.col("_a"), F.col("_b"), F.col("pos")).alias(item)).where(F.col(item) < n_items)
    free = spots.join(seen.select(key, item), [key, item], "left_anti")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return free.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).drop("pos")


def random_negative(key: Column, epoch: int, n_items: int) -> Column:
    """One uniform item index per row and epoch; it may hit a positive."""
    return hash_below(n_items, F.lit("neg"), F.lit(epoch).cast("string"), key)
