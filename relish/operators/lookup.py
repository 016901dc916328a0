"""Key-to-index tables and the joins that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relish.operators.order import dense_positions


def dense_ids(df: DataFrame, key: str, index: str) -> DataFrame:
    """``(key, index)``: distinct non-null keys numbered 0.. in key order.

    Keys are numbered through a range sort, so no task sees them all. Duplicate keys get
    one id, which keeps every id below the table size.
    """
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    return dense_positions(keys, [F.col(key).asc()], index)


def map_key(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Attach the index; an unmapped key gives NULL."""
    return df.join(ids, key, "left")


def interactions(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Ratings with both indexes; rows with any NULL are dropped."""
    mapped = map_key(map_key(ratings, users, "user_id"), items, "game_title")
    return mapped.select("row_key", "user_idx", "game_idx", "rating").na.drop("any")


def unlike(rows: DataFrame, liked: DataFrame, title: str = "title") -> DataFrame:
    """Rows whose exact title was not liked."""
    return rows.join(liked.select(title).distinct(), title, "left_anti")


def only_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``. The keys are made distinct before they are
    shuffled, so one that fills a third of its table arrives once per partition."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def title_key(column: Column) -> Column:
    """Trimmed lower-case title for forgiving matches."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def predict_item_mean(test: DataFrame, train: DataFrame, item: str = "game_title", rating: str = "rating") -> DataFrame:
    """Test rows with ``predicted``: the item's train mean, else the global train mean."""
    means = train.where(F.col(item).isNotNull()).groupBy(item).agg(F.avg(rating).alias("_mean"))
    overall = train.agg(F.avg(rating)).scalar()
    return (test.join(means, item, "left")
                .select(*test.columns, F.coalesce("_mean", overall).alias("predicted")))
