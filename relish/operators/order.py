"""Global order without a global sort task: positions, running totals, medians, cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relish.session import materialize

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partition and sort, remembering each row's partition and place in it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    slotted = materialize(ranged.withColumn("_slot", F.monotonically_increasing_id()), "ordered")
    return (slotted.withColumn("_part", F.shiftright("_slot", _SLOT_BITS))
                   .withColumn("_slot", F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))))


def _starts(placed: DataFrame, amount: Column) -> DataFrame:
    """What lies before each range partition; one row per shuffle partition, so small."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(amount.alias("_amount"))
    return sums.select("_part", F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("_start"))


def dense_positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the row's 0-based position in a total order (``order`` must have no ties)."""
    placed = _placed(df, order)
    starts = _starts(placed, F.count("*"))
    return (placed.join(F.broadcast(starts), "_part")
                  .withColumn(name, F.col("_start") + F.col("_slot"))
                  .drop("_part", "_slot", "_start"))


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add the running sum of ``value`` in a total order, this row included."""
    placed = _placed(df, order)
    starts = _starts(placed, F.sum(value))
    within = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    return (placed.withColumn("_within", F.sum(value).over(within))
                  .join(F.broadcast(starts), "_part")
                  .withColumn(name, F.col("_start") + F.col("_within"))
                  .drop("_part", "_slot", "_start", "_within"))


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row, one column: the exact median of the non-null values.

    Values are counted before they are ordered, so a value that fills a third of the
    table is a single row with a large count.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_total(counts, [F.col("_v").asc()], "_n", "_cum")
    total = placed.agg(F.sum("_n")).scalar()
    ranked = placed.select("_v", "_cum", (F.col("_cum") - F.col("_n")).alias("_from"), total.alias("_total"))

    def covers(rank: Column) -> Column:
        return ((F.col("_from") <= rank) & (rank < F.col("_cum"))).cast("int")

    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    return ranked.agg((F.sum(F.col("_v") * (covers(low) + covers(high))) / 2).alias(column))


def hash_threshold(df: DataFrame, digest: Column, take: int, digits: int = 3, small: int = 10_000) -> str | None:
    """The ``take``-th smallest hex digest, found by narrowing a digit histogram.

    The input is read once, for a stored column of digests. Each pass scans that and
    returns at most ``16**digits`` counts; only the last bucket, a few thousand rows, is
    ever sorted. None when nothing is to be taken.
    """
    if take <= 0:
        return None
    rows, prefix, width = materialize(df.select(digest.alias("_h")), "digests"), "", 32
    while len(prefix) + digits <= width:
        counts = rows.groupBy(F.substring("_h", len(prefix) + 1, digits).alias("_d")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
        hit = counts.withColumn("_cum", upto).where(F.col("_cum") >= take).orderBy("_d").first()
        take -= hit["_cum"] - hit["_n"]
        prefix += hit["_d"]
        rows = rows.where(F.col("_h").startswith(prefix))
        if hit["_n"] <= small:
            break
    return rows.orderBy("_h").limit(take).agg(F.max("_h")).first()[0]
