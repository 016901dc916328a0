"""Index lookups, semi and anti joins."""

from pyspark.sql import functions as F

from relish import schemas
from relish.operators import lookup, split
from relish.queries import oracle, query
from relish.sources import warehouse

USERS = "users as (select user_id, row_number() over (order by user_id) - 1 as user_idx from (select distinct user_id from fx_ratings where user_id is not null))"
ITEMS = "items as (select title as game_title, row_number() over (order by title) - 1 as game_idx from (select distinct title from fx_catalog where title is not null))"
BUCKET = "('0x'||substr(md5(row_key),1,8))::bigint"
SPLIT = f"train as (select * from fx_ratings where {BUCKET} % 10 >= 2),\ntest as (select * from fx_ratings where {BUCKET} % 10 < 2)"
LIKED = """
liked as (select event_id, unnest(cast(json_extract(body, '$.games') as varchar[])) as title from fx_requests)"""


def user_ids(spark, sf_dir):
    return lookup.dense_ids(warehouse.ratings(spark, sf_dir).select("user_id"), "user_id", "user_idx")


def item_ids(spark, sf_dir):
    titles = warehouse.catalog(spark, sf_dir).select(F.col("title").alias("game_title"))
    return lookup.dense_ids(titles, "game_title", "game_idx")


def known_titles(spark, sf_dir):
    """Titles of rated items in the train split, the ones a model knows."""
    rows = warehouse.ratings(spark, sf_dir)
    return rows.where(~split.tenths_test(F.col("row_key"))).select("game_title").distinct()


@query("index_users", oracle("ratings", ctes=USERS, select="select user_id, user_idx from users"))
def index_users(spark, sf_dir):
    return user_ids(spark, sf_dir).select("user_id", "user_idx")


@query("index_items", oracle("catalog", ctes=ITEMS, select="select game_title, game_idx from items"))
def index_items(spark, sf_dir):
    return item_ids(spark, sf_dir).select("game_title", "game_idx")


@query("join_user_idx", oracle("ratings", ctes=USERS, select="select row_key, user_idx from fx_ratings left join users using (user_id)"))
def join_user_idx(spark, sf_dir):
    rows = warehouse.ratings(spark, sf_dir).select("row_key", "user_id")
    return lookup.map_key(rows, user_ids(spark, sf_dir), "user_id").select("row_key", "user_idx")


@query("join_item_idx", oracle("ratings", ctes=f"""{SPLIT},
known as (select game_title, row_number() over (order by game_title) - 1 as game_idx from (select distinct game_title from train where rating >= 9))""",
       select="select row_key, game_idx from fx_ratings left join known using (game_title)"))
def join_item_idx(spark, sf_dir):
    """Index over the highly rated train items only, so that some rows stay unmapped."""
    rows = warehouse.ratings(spark, sf_dir)
    known = rows.where(~split.tenths_test(F.col("row_key")) & (F.col("rating") >= 9)).select("game_title")
    ids = lookup.dense_ids(known, "game_title", "game_idx")
    return lookup.map_key(rows.select("row_key", "game_title"), ids, "game_title").select("row_key", "game_idx")


@query("interactions_prep", oracle("ratings", "catalog", ctes=f"{USERS},\n{ITEMS}", select="""
select row_key, user_idx, game_idx, round(rating, 6) as rating from fx_ratings join users using (user_id) join items using (game_title)
where rating is not null"""))
def interactions_prep(spark, sf_dir):
    return lookup.interactions(warehouse.ratings(spark, sf_dir), user_ids(spark, sf_dir), item_ids(spark, sf_dir)) \
                 .withColumn("rating", F.round("rating", 6))


@query("semi_train_users", oracle("ratings", ctes=SPLIT, select="select row_key, user_id from test where user_id in (select user_id from train)"))
def semi_train_users(spark, sf_dir):
    rows = warehouse.ratings(spark, sf_dir).select("row_key", "user_id")
    test = split.tenths_test(F.col("row_key"))
    return lookup.only_keys(rows.where(test), rows.where(~test), "user_id").select("row_key", "user_id")


@query("predict_item_mean", oracle("ratings", ctes=f"""{SPLIT},
means as (select game_title, avg(rating) as m from train group by game_title)""", select="""
select row_key, round(coalesce(m, (select avg(rating) from train)), 6) as predicted from test left join means using (game_title)"""))
def predict_item_mean(spark, sf_dir):
    rows = warehouse.ratings(spark, sf_dir)
    test = split.tenths_test(F.col("row_key"))
    return (lookup.predict_item_mean(rows.where(test), rows.where(~test))
                  .select("row_key", F.round("predicted", 6).alias("predicted")))


@query("anti_seen", oracle("ratings", ctes=SPLIT, select="""
select distinct user_id, game_title from test t
where not exists (select 1 from train r where r.user_id = t.user_id and r.game_title = t.game_title)"""))
def anti_seen(spark, sf_dir):
    rows = warehouse.ratings(spark, sf_dir).select("row_key", "user_id", "game_title")
    test = split.tenths_test(F.col("row_key"))
    pairs = ["user_id", "game_title"]
    return rows.where(test).select(pairs).distinct().join(rows.where(~test).select(pairs).distinct(), pairs, "left_anti")


@query("anti_liked", oracle("catalog", "requests", ctes=LIKED, select="select title from fx_catalog where title not in (select title from liked)"))
def anti_liked(spark, sf_dir):
    liked = _liked(spark, sf_dir).select("title")
    return lookup.unlike(warehouse.catalog(spark, sf_dir).select("title"), liked)


@query("anti_liked_norm", oracle("catalog", "requests", ctes=LIKED + """,
keys as (select distinct event_id, lower(trim(title)) as k from liked),
sizes as (select lower(trim(title)) as k, count(*) as n from fx_catalog group by 1),
left_over as (select event_id, (select count(*) from fx_catalog) - sum(coalesce(n, 0)) as n_left from keys left join sizes using (k) group by event_id)""",
       select="select event_id, cast(case when n_left = 0 then (select count(*) from fx_catalog) else n_left end as bigint) as n_candidates, n_left = 0 as used_full_set from left_over"))
def anti_liked_norm(spark, sf_dir):
    """How many catalog rows each request can choose from; the full set when nothing is left."""
    rows = warehouse.catalog(spark, sf_dir)
    sizes = rows.groupBy(lookup.title_key(F.col("title")).alias("k")).agg(F.count("*").alias("n"))
    keys = _liked(spark, sf_dir).select("event_id", lookup.title_key(F.col("title")).alias("k")).distinct()
    total = rows.agg(F.count("*")).scalar()
    left = (keys.join(sizes, "k", "left").groupBy("event_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("gone"))
                .select("event_id", total.alias("total"), (total - F.col("gone")).alias("n_left")))
    return left.select("event_id", F.when(F.col("n_left") == 0, F.col("total")).otherwise(F.col("n_left")).alias("n_candidates"),
                       (F.col("n_left") == 0).alias("used_full_set"))


@query("valid_ratings", oracle("ratings", "requests", ctes=f"""{SPLIT},
known as (select distinct game_title from train where rating >= 9.5),
given as (select event_id, unnest(map_keys(cast(json_extract(body, '$.gameRatings') as map(varchar, integer)))) as game_title from fx_requests)""", select="""
select event_id, count(*) as n_given, count(k.game_title) as n_valid, count(k.game_title) > 0 as has_valid
from given g left join known k on k.game_title = g.game_title group by event_id"""))
def valid_ratings(spark, sf_dir):
    """Request ratings whose item is known; a request with none is flagged."""
    rows = warehouse.ratings(spark, sf_dir)
    known = (rows.where(~split.tenths_test(F.col("row_key")) & (F.col("rating") >= 9.5))
                 .select("game_title").distinct().withColumn("hit", F.lit(1)))
    given = warehouse.requests(spark, sf_dir).select(
        "event_id", F.explode(F.from_json("body", schemas.REQUEST)["gameRatings"]).alias("game_title", "given"))
    return given.join(known, "game_title", "left").groupBy("event_id").agg(
        F.count("*").alias("n_given"), F.count("hit").alias("n_valid"), (F.count("hit") > 0).alias("has_valid"))


def _liked(spark, sf_dir):
    return warehouse.requests(spark, sf_dir).select(
        "event_id", F.explode(F.from_json("body", schemas.REQUEST)["games"]).alias("title"))
