"""Known users are scored from stored vectors, new ones are fitted first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relish.operators import ncf, ncf_train, popularity
from relish.operators.lookup import dense_ids
from relish.session import materialize

# Answers that are no recommendation.
NO_INPUT = "Must provide either user_id or new_user_ratings."
NO_MATCH = "None of the provided games exist in our database"


def route(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Parsed requests with ``route``: known user, new user with ratings, popular titles for an empty map of ratings, or none."""
    marked = known.select(F.col("user_id").alias("username"), F.lit(True).alias("_known")).distinct()
    rows = requests.join(marked, "username", "left")
    return rows.withColumn("route", F.when(F.col("_known"), "known").when(F.size("gameRatings") > 0, "new")
                           .when(F.col("has_ratings"), "popular").otherwise("none")).drop("_known")


def recommend(routed: DataFrame, users: DataFrame, items: DataFrame, dense: ncf.Dense, k: int, key: str = "event_id",
              catalog: DataFrame | None = None, **fit_options) -> DataFrame:
    """``(key, route, rank, game_title)``; a request that cannot be answered has one row with the reason.

    ``users`` has ``user_id, user_idx, gmf, mlp`` and ``items`` has ``game_title,
    game_idx, gmf, mlp``. ``catalog`` (``title, user_ratings_count``) answers the popular route,
    which without it has no rows. A known user is scored once however many requests it sent.
    """
    titles = items.select("game_idx", "game_title")
    known = routed.where(F.col("route") == "known").select(key, "route", F.col("username").alias("user_id"))
    wanted = users.join(known.select("user_id").distinct(), "user_id")
    stored = ncf.top_items(wanted, items, dense, k).join(users.select("user_id", "user_idx"), "user_idx")
    told = known.join(stored, "user_id").join(titles, "game_idx").select(key, "route", "rank", "game_title")

    given = routed.where(F.col("route") == "new").select(key, F.explode("gameRatings").alias("game_title", "given"))
    valid = given.join(titles, "game_title").select(F.col(key).cast("string").alias("request"), "game_idx", F.col("given").cast("double").alias("rating"))
    valid = materialize(valid, "new-ratings")
    ids = dense_ids(valid, "request", "user_idx")
    rows = valid.join(ids, "request").select(F.concat_ws("|", "request", "game_idx").alias("row_key"), "user_idx", "game_idx", "rating")
    fitted = materialize(ncf_train.fit_users(rows, ncf_train.new_vectors(ids.select("user_idx"), dense.dim), items, dense, **fit_options), "new-users")
    ktype = dict(routed.dtypes)[key]
    fresh = (ncf.top_items(fitted, items, dense, k).join(ids, "user_idx").join(titles, "game_idx")
             .select(F.col("request").cast(ktype).alias(key), F.lit("new").alias("route"), "rank", "game_title"))

    missed = (routed.where(F.col("route") == "new").select(key)
              .join(ids.select(F.col("request").cast(ktype).alias(key)), key, "left_anti")
              .select(key, F.lit("new").alias("route"), F.lit(NO_MATCH).alias("game_title")))
    empty = routed.where(F.col("route") == "none").select(key, "route", F.lit(NO_INPUT).alias("game_title"))
    notes = missed.unionByName(empty).select(key, "route", F.lit(None).cast("bigint").alias("rank"), "game_title")
    answers = told.unionByName(fresh).unionByName(notes)
    if catalog is None:
        return answers
    return answers.unionByName(popular(routed, catalog, k, key))


def popular(routed: DataFrame, catalog: DataFrame, k: int, key: str = "event_id") -> DataFrame:
    """The ``k`` most rated titles for each request of the popular route; the short list is worked out once."""
    top = popularity.head_array(catalog, popularity.best_first("user_ratings_count", "title"), k, "title")
    rows = routed.where(F.col("route") == "popular").select(key, "route", F.explode(top).alias("_s"))
    return rows.select(key, "route", F.col("_s.pos").cast("bigint").alias("rank"), F.col("_s.title").alias("game_title"))
