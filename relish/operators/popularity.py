"""Item means and the rankings built on one global order of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relish.functions.hashing import hash32, md5_mod


def item_means(ratings: DataFrame, item: str = "game_title", rating: str = "rating") -> DataFrame:
    """Mean rating per item; partial averages combine before the shuffle, so a hot item is cheap.

    Ratings are added as decimals, exactly: the order in which doubles are added, which
    changes with the partitioning, would otherwise decide between items that tie.
    """
    mean = F.try_divide(F.sum(F.col(rating).cast("decimal(28,9)")).cast("double"), F.count(rating))
    return ratings.where(F.col(item).isNotNull()).groupBy(item).agg(mean.alias("mean_rating"))


def best_first(score: str, key: str) -> list[Column]:
    return [F.col(score).desc_nulls_last(), F.col(key).asc()]


def head_array(df: DataFrame, order: list[Column], n: int, *columns: str) -> Column:
    """The first ``n`` rows as one array of ``(pos, columns...)`` structs, a scalar subquery.

    ``n`` is a report length, never a table size. The value is computed once and travels
    with the plan, so nothing is joined.
    """
    head = df.orderBy(*order).limit(n)
    pos = F.row_number().over(Window.orderBy(*order))
    packed = head.select(F.struct(pos.alias("pos"), *columns).alias("_s"))
    return packed.agg(F.array_sort(F.collect_list("_s"))).scalar()


def top_n_excluding_self(means: DataFrame, n: int, item: str = "game_title") -> DataFrame:
    """For every target item: the ``n`` best other items.

    The score does not depend on the target, so each list lies inside the global top n+1.
    """
    top = head_array(means, best_first("mean_rating", item), n + 1, item, "mean_rating")
    targets = means.select(F.col(item).alias("target"), top.alias("_top"))
    others = F.slice(F.filter("_top", lambda s: s[item] != F.col("target")), 1, n)
    return (targets.select("target", F.posexplode(others).alias("_i", "_s"))
                   .select("target", (F.col("_i") + 1).cast("bigint").alias("rank"),
                           F.col("_s")[item].alias(item), F.col("_s.mean_rating").alias("mean_rating")))


def most_rated(catalog: DataFrame, n: int) -> DataFrame:
    """The cold-start list: the ``n`` items with most ratings."""
    order = best_first("user_ratings_count", "title")
    head = catalog.select("title", "user_ratings_count").orderBy(*order).limit(n)
    return head.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "title", "user_ratings_count")


def rank_band(position: Column, top: int = 10, mid: int = 30) -> Column:
    return F.when(position <= top, "top").when(position <= mid, "mid").otherwise("rest")


def variety_picks(targets: DataFrame, means: DataFrame, n: int, target: str = "target",
                  item: str = "game_title", top: int = 10, mid: int = 30) -> DataFrame:
    """A varied but repeatable pick of ``n`` items per target title.

    About 70 % come from the best ``top`` candidates, the others from the band below, and
    what is still missing from the ranking in order. Only the lower-cased target is left
    out of the candidates, so a mixed-case title can be recommended to itself. Order
    within a band follows a hash seeded by the target.
    """
    head = head_array(means, best_first("mean_rating", item), max(mid, n) + 1, item)
    share = int(n * 0.7) + 1
    seeded = targets.select("*", md5_mod(F.col(target), 10000).alias("_seed"), head.alias("_head"))
    ranked = seeded.withColumn("_cand", F.filter("_head", lambda s: s[item] != F.lower(F.col(target))))

    def drawn(band: Column, step: str) -> Column:
        keyed = F.transform(band, lambda s: F.struct(
            hash32(F.col("_seed").cast("string"), F.lit(step), s[item]).alias("h"), s[item].alias("t")))
        return F.transform(F.array_sort(keyed), lambda s: s["t"])

    picked = (
        ranked
        .withColumn("_a", F.slice(drawn(F.slice("_cand", 1, top), "top"), 1, share))
        .withColumn("_b", F.slice(drawn(F.slice("_cand", top + 1, mid - top), "mid"), 1,
                                  F.greatest(F.lit(n) - F.size("_a"), F.lit(0))))
        .withColumn("_ab", F.concat("_a", "_b"))
        .withColumn("_c", F.slice(F.array_except(F.transform("_cand", lambda s: s[item]), F.col("_ab")), 1,
                                  F.greatest(F.lit(n) - F.size("_ab"), F.lit(0))))
    )
    final = F.slice(F.transform(F.array_sort(F.transform(F.concat("_ab", "_c"), lambda t: F.struct(
        hash32(F.col("_seed").cast("string"), F.lit("order"), t).alias("h"), t.alias("t")))),
        lambda s: s["t"]), 1, n)
    kept = [c for c in targets.columns]
    return (picked.select(*kept, F.posexplode(final).alias("_i", item))
                  .select(*kept, (F.col("_i") + 1).cast("bigint").alias("rank"), item))
