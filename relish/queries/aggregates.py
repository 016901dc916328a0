"""Aggregates over the ratings and set operations."""

from pyspark.sql import functions as F

from relish.operators import lookup, metrics, popularity, split
from relish.queries import oracle, query
from relish.queries.joins import BUCKET, ITEMS, SPLIT
from relish.sources import warehouse


@query("item_mean", oracle("ratings", select="select game_title, round(avg(rating), 6) as mean_rating from fx_ratings where game_title is not null group by game_title"))
def item_mean(spark, sf_dir):
    return popularity.item_means(warehouse.ratings(spark, sf_dir)).withColumn("mean_rating", F.round("mean_rating", 6))


@query("dataset_stats", oracle("ratings", select="""
select count(*) as n_rows, count(distinct user_id) as n_users, count(distinct game_title) as n_items,
       min(rating) as min_rating, max(rating) as max_rating, round(avg(rating), 6) as mean_rating from fx_ratings"""))
def dataset_stats(spark, sf_dir):
    """Counted from per-pair rows, so the distinct counts share one shuffle and no key is hot."""
    rows = warehouse.ratings(spark, sf_dir)
    basic = rows.agg(F.count("*").alias("n_rows"), F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"),
                     F.round(F.avg("rating"), 6).alias("mean_rating"))
    users = rows.select("user_id").distinct().agg(F.count("user_id")).scalar()
    items = rows.select("game_title").distinct().agg(F.count("game_title")).scalar()
    return basic.select("n_rows", users.alias("n_users"), items.alias("n_items"), "min_rating", "max_rating", "mean_rating")


@query("user_item_set", oracle("ratings", ctes=SPLIT, select="select distinct user_id, game_title from train"))
def user_item_set(spark, sf_dir):
    """The set of items per user, kept long: no user's set is ever one value."""
    rows = warehouse.ratings(spark, sf_dir)
    return rows.where(~split.tenths_test(F.col("row_key"))).select("user_id", "game_title").distinct()


@query("user_test_items", oracle("ratings", ctes=SPLIT, select="select user_id, game_title, count(*) as n_rows from test group by all"))
def user_test_items(spark, sf_dir):
    rows = warehouse.ratings(spark, sf_dir)
    return rows.where(split.tenths_test(F.col("row_key"))).groupBy("user_id", "game_title").agg(F.count("*").alias("n_rows"))


@query("last_rating_per_item", oracle("ratings", select="""
select user_id, game_title, rating from (
  select *, row_number() over (partition by user_id, game_title order by rated_at desc, row_key desc) as rn from fx_ratings) where rn = 1"""))
def last_rating_per_item(spark, sf_dir):
    """Later rows overwrite earlier ones, as assigning into a dictionary does."""
    rows = warehouse.ratings(spark, sf_dir)
    return rows.groupBy("user_id", "game_title").agg(F.max_by("rating", F.struct("rated_at", "row_key")).alias("rating"))


@query("regression_metrics", oracle("ratings", ctes=f"""{SPLIT},
means as (select game_title, avg(rating) as m from train group by game_title),
p as (select rating, coalesce(m, (select avg(rating) from train)) as predicted from test left join means using (game_title) where rating is not null)""", select="""
select count(*) as n_rows, round(avg((rating - predicted) ** 2), 6) as mse, round(sqrt(avg((rating - predicted) ** 2)), 6) as rmse,
       round(1 - sum((rating - predicted) ** 2) / (select sum((rating - (select avg(rating) from p)) ** 2) from p), 6) as r2 from p"""))
def regression_metrics(spark, sf_dir):
    rows = warehouse.ratings(spark, sf_dir)
    test = split.tenths_test(F.col("row_key"))
    return _rounded(metrics.regression(lookup.predict_item_mean(rows.where(test), rows.where(~test))))


@query("rmse_holdout", oracle("ratings", ctes=f"""
cut as (select *, row_number() over (order by md5(row_key)) as rn from fx_ratings),
train as (select * from cut where rn > floor((select count(*) from fx_ratings) * 0.2)),
test as (select * from cut where rn <= floor((select count(*) from fx_ratings) * 0.2)),
means as (select game_title, avg(rating) as m from train group by game_title)""", select="""
select round(sqrt(avg((rating - coalesce(m, (select avg(rating) from train))) ** 2)), 6) as rmse from test left join means using (game_title)"""))
def rmse_holdout(spark, sf_dir):
    rows = warehouse.ratings(spark, sf_dir)
    test = split.exact_ratio_test(rows, "row_key", 0.2)
    return _rounded(metrics.regression(lookup.predict_item_mean(rows.where(test), rows.where(~test)))).select("rmse")


@query("distinct_items", oracle("ratings", select="select distinct game_title from fx_ratings"))
def distinct_items(spark, sf_dir):
    return warehouse.ratings(spark, sf_dir).select("game_title").distinct()


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
