"""Answering request messages in sets: parse, route to a recommender, format, pad."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from relish import schemas
from relish.functions import text, wording
from relish.functions.hashing import hash32
from relish.operators import forest, popularity, similarity
from relish.session import materialize

Texts = Sequence[tuple[str, str]]


def parse(messages: DataFrame, body: str = "body") -> DataFrame:
    """Typed request columns; a malformed body counts as an empty one, missing fields get defaults.

    ``has_ratings`` tells an empty map of ratings from none at all.
    """
    r = F.from_json(body, schemas.REQUEST)
    return (messages.withColumn("_r", r)
            .withColumn("username", F.coalesce("_r.username", F.lit("anonymous")))
            .withColumn("model_type", valid_model(F.col("_r.modelType")))
            .withColumn("games", F.coalesce("_r.games", F.array().cast("array<string>")))
            .withColumn("has_ratings", F.col("_r.gameRatings").isNotNull())
            .withColumn("gameRatings", F.coalesce("_r.gameRatings", F.create_map().cast("map<string,int>")))
            .withColumn("retry_count", F.coalesce("_r._retryCount", F.lit(0)))
            .drop("_r"))


def valid_model(name: Column) -> Column:
    return F.when(name.isin(*wording.MODEL_TYPES), name).otherwise(wording.DEFAULT_MODEL)


def option_count(asked: Column) -> Column:
    """How many game options to offer: 9 unless asked, between 1 and 20."""
    return F.greatest(F.lit(1), F.least(F.coalesce(asked, F.lit(9)), F.lit(20)))


def texts(rows: Texts) -> Column:
    """A literal ``array<struct<title, description>>``."""
    return F.array(*[F.struct(F.lit(t).alias("title"), F.lit(d).alias("description")) for t, d in rows])


def numbered(df: DataFrame, key: str, rows: str) -> DataFrame:
    """Explode an answer list into ``(key, id, title, description)``."""
    out = df.select(key, F.posexplode(rows).alias("_i", "_s"))
    return out.select(key, (F.col("_i") + 1).cast("bigint").alias("id"), F.col("_s.title").alias("title"),
                      F.col("_s.description").alias("description"))


def padded(rows: Column, fill: Column, size: int) -> Column:
    """The list followed by as many filler rows as it lacks."""
    missing = F.greatest(F.lit(size) - F.size(rows), F.lit(0))
    return F.concat(rows, F.slice(fill, F.lit(1), missing))


def generated_description(title: Column) -> Column:
    """The known description of a title, else one made of two different genres."""
    genres = F.array(*[F.lit(g) for g in wording.GENRES])
    n = len(wording.GENRES)
    one = hash32(F.lit("genre1"), title) % F.lit(n)
    other = hash32(F.lit("genre2"), title) % F.lit(n - 1)
    other = F.when(other >= one, other + 1).otherwise(other)
    made = F.concat(F.lit("A "), F.get(genres, one.cast("int")), F.lit(" "), F.get(genres, other.cast("int")),
                    F.lit(" experience with unique gameplay elements"))
    known = F.create_map(*[F.lit(x) for pair in wording.DESCRIPTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(title)), made)


def reason(target: Column, title: Column) -> Column:
    patterns = F.array(*[F.lit(r) for r in wording.REASONS])
    pattern = F.get(patterns, (hash32(F.lit("reason"), target, title) % F.lit(len(wording.REASONS))).cast("int"))
    return F.replace(pattern, F.lit("{game}"), target)


def format_naive(picks: DataFrame, key: str) -> DataFrame:
    """Picks ``(key, target, rank, game_title)`` to ``(key, rank, title, description)``."""
    title = F.col("game_title")
    return picks.select(key, "rank", text.title_case(title).alias("title"),
                        F.concat(reason(F.col("target"), title), F.lit(": "), generated_description(title)).alias("description"))


def naive_lists(targets: DataFrame, means: DataFrame, size: int = 5) -> DataFrame:
    """``(target, recs)``: the formatted picks of every distinct target title as one short list."""
    picks = popularity.variety_picks(targets.where("target is not null").select("target").distinct(), means, size)
    rows = format_naive(picks, "target").groupBy("target").agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", "description"))).alias("_made"))
    return rows.select("target", F.transform("_made", lambda s: F.struct(
        s["title"].alias("title"), s["description"].alias("description"))).alias("recs"))


def answer_naive(requests: DataFrame, means: DataFrame, key: str = "event_id", size: int = 5) -> DataFrame:
    """Exactly ``size`` rows per request from its first game; defaults when it names none.

    A title is worked out once however many requests name it.
    """
    asked = requests.select(key, F.get("games", 0).alias("target"))
    rows = asked.join(naive_lists(asked, means, size), "target", "left")
    fill = F.concat(texts([wording.COMING_SOON]), texts(wording.GENERIC))
    found = F.coalesce("recs", F.array().cast("array<struct<title:string,description:string>>"))
    answer = F.when(F.col("target").isNull(), texts(wording.NO_GAMES)).otherwise(padded(found, fill, size))
    return numbered(rows.select(key, F.slice(answer, 1, size).alias("_answer")), key, "_answer")


def answer_vector(requests: DataFrame, items: DataFrame, key: str = "event_id", size: int = 5, least: int = 3) -> DataFrame:
    """Vector recommendations with explanations; the default list when no profile can be made.

    With a profile the list is filled up to ``least``, also when every item is owned.
    """
    owned = similarity.owned_titles(requests, key)
    told = similarity.recommend(requests, items, key, size, matches=True).join(items.select("item", "title", "description"), "item")
    described = told.select(key, F.struct("rank", "title", similarity.describe(
        F.col("score"), F.col("description"), F.col("match"), F.col("match_rating"), F.col("match_sim")).alias("description")).alias("s"))
    lists = described.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("_made"))
    profiled = similarity.profiled(owned, items, key).withColumn("_profiled", F.lit(True))
    made = F.coalesce("_made", F.array().cast(lists.schema["_made"].dataType))
    rows = requests.select(key).join(profiled, key, "left").join(lists, key, "left").withColumn(
        "_recs", F.transform(made, lambda s: F.struct(s["title"].alias("title"), s["description"].alias("description"))))
    answer = F.when(F.col("_profiled").isNull(), texts(wording.VECTOR_DEFAULTS)).otherwise(
        padded(F.col("_recs"), texts(wording.VECTOR_DEFAULTS), least))
    return numbered(rows.select(key, answer.alias("_answer")), key, "_answer")


def answer_traditional(requests: DataFrame, scores: DataFrame, key: str = "event_id", size: int = 5) -> DataFrame:
    return forest.recommend(requests, scores, key, "games", size).withColumnRenamed("rank", "id")


def dispatch(requests: DataFrame, means: DataFrame, scores: DataFrame, items: DataFrame, key: str = "event_id") -> DataFrame:
    """``(key, model_used, id, title, description)`` for parsed requests, each branch answered as a set.

    The parsed columns are written once: the branches pass over them several times, and a
    body is not parsed again for each.
    """
    requests = materialize(requests.select(key, "model_type", "games", "gameRatings"), "requests")
    named, unnamed = requests.where(F.size("games") > 0), requests.where(F.size("games") == 0)
    branches = {"Naive": lambda rows: answer_naive(rows, means, key),
                "Deep Learning": lambda rows: answer_vector(rows, items, key),
                "Traditional": lambda rows: answer_traditional(rows, scores, key)}
    answers = unnamed.select(key, F.col("model_type").alias("model_used"), F.posexplode(texts(wording.DISPATCH_DEFAULTS)).alias("_i", "_s")).select(
        key, "model_used", (F.col("_i") + 1).cast("bigint").alias("id"), "_s.title", "_s.description")
    for model, answer in branches.items():
        rows = answer(named.where(F.col("model_type") == model))
        answers = answers.unionByName(rows.withColumn("model_used", F.lit(model)))
    return answers


def responses(answers: DataFrame, key: str = "event_id") -> DataFrame:
    """One JSON response body per request from its few answer rows."""
    rows = answers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "title", "description"))).alias("recommendations"),
                                    F.first("model_used").alias("model_used"))
    # Field names and status of a response message.
    return rows.select(key, F.to_json(F.struct(F.lit(200).alias("statusCode"), "recommendations",
                                               F.lit(True).alias("ec2_processed"), "model_used")).alias("body"))
