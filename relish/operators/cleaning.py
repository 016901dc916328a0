"""Projection, filtering and imputation over the ratings and the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from relish.functions import text
from relish.operators.order import exact_median
from relish.session import materialize


def to_ratings(reviews: DataFrame) -> DataFrame:
    """Review dump to ``(user_id, game_title, rating)``; 0-100 becomes 0-10, NULL stays NULL."""
    return reviews.select(
        F.col("Reviewer Name").alias("user_id"), F.col("Game Title").alias("game_title"),
        (F.col("Rating Given By The Reviewer") / 10).alias("rating"))


def coerce_number(column: Column) -> Column:
    return column.try_cast("double")


def fill_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.na.fill({"developer": "unknown", "publisher": "unknown", "product_rating": "unknown",
                            "genres": "", "user_ratings_count": 0})


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """Fill NULLs with the exact median, held as a scalar subquery."""
    return df.withColumn(column, F.coalesce(F.col(column), exact_median(df, column).scalar()))


def widen_map(df: DataFrame, mapping: str, prefix: str, keys: Sequence[str]) -> DataFrame:
    """One integer column for each of the given map keys, 0 where absent. Row-local, so no shuffle."""
    return df.select("*", *[F.coalesce(F.try_element_at(mapping, F.lit(k)), F.lit(0)).cast("int").alias(prefix + k)
                            for k in keys])


def widen_list(df: DataFrame, items: str, prefix: str, keys: Sequence[str]) -> DataFrame:
    """One 0/1 column for each of the given list members. Row-local, so no shuffle."""
    return df.select("*", *[F.array_contains(items, k).cast("int").alias(prefix + k) for k in keys])


def with_platform_scores(df: DataFrame, literal: str, name: str) -> DataFrame:
    """Add the platform score map of a literal column, parsed once per row."""
    parsed = df.withColumn("_parsed", text.parse_platforms(F.col(literal)))
    return parsed.withColumn(name, text.platform_scores(F.col("_parsed"))).drop("_parsed")


def clean_catalog(catalog: DataFrame) -> DataFrame:
    """Cleaned catalog for the neural recommender: fills, year, median score, a list of genres and a map of platform scores.

    ``widen_catalog`` makes columns of the two; ``dictionary`` encodes them whatever the number of values.
    """
    base = with_platform_scores(fill_catalog(catalog), "platforms_info", "_platforms").select(
        "title", "release_date", "product_rating", "publisher", "developer",
        F.coalesce(text.parse_year(F.col("release_date")), F.lit(0)).alias("release_year"),
        coerce_number(F.col("user_score")).alias("user_score"), "user_ratings_count",
        text.clean_genres(F.col("genres")).alias("genres"),
        F.col("_platforms").alias("platforms"))
    return impute_median(materialize(base, "catalog"), "user_score")


def widen_catalog(cleaned: DataFrame, genres: Sequence[str], platforms: Sequence[str]) -> DataFrame:
    """The cleaned catalog with a column for each of the given genres and platforms."""
    return widen_map(widen_list(cleaned, "genres", "genre_", genres), "platforms", "platform_", platforms).drop("genres", "platforms")


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values, ties by name."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_rows"))
              .orderBy(F.col("n_rows").desc(), F.col(column).asc()).limit(n))


def bucket_other(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Keep the ``n`` most frequent values; all others, NULL included, become ``Other``."""
    top = top_values(df, column, n).agg(F.collect_set(column)).scalar()
    keep = F.coalesce(F.array_contains(top, F.col(column)), F.lit(False))
    return df.withColumn(column, F.when(keep, F.col(column)).otherwise("Other"))


def prepare_catalog(catalog: DataFrame, reference_year: int = 2025, top: int = 20) -> DataFrame:
    """Cleaned catalog for the forest: typed score, year, age, log count, genre list, bucketed makers."""
    rows = (catalog.select("title", "release_date", "genres", "product_rating", "publisher", "developer",
                           "user_score", "user_ratings_count")
            .na.drop(subset=["user_score", "release_date", "genres", "product_rating", "user_ratings_count"])
            .withColumn("user_score", coerce_number(F.col("user_score")))
            .withColumn("release_year", text.parse_year(F.col("release_date")))
            .na.drop(subset=["user_score", "release_year"])
            .withColumn("log_ratings_count", F.log1p(F.col("user_ratings_count").cast("double")))
            .withColumn("game_age", F.lit(reference_year) - F.col("release_year"))
            .withColumn("genres", text.split_genres(F.col("genres"))))
    return bucket_other(bucket_other(rows, "publisher", top), "developer", top)
