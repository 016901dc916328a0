"""Popularity rankings, per-user rankings and ranking metrics."""

from pyspark.sql import functions as F

from relish.operators import lookup, metrics, popularity, split
from relish.operators.order import dense_positions
from relish.plans import naive
from relish.queries import oracle, query
from relish.queries.joins import SPLIT
from relish.session import materialize
from relish.sources import warehouse

MEANS = "means as (select game_title, sum(rating::decimal(28,9))::double / count(rating) as mean_rating from fx_ratings where game_title is not null group by game_title)"


@query("naive_topn", oracle("ratings", ctes=MEANS, select="""
select target, rank, game_title, round(mean_rating, 6) as mean_rating from (
  select t.game_title as target, m.game_title, m.mean_rating,
         row_number() over (partition by t.game_title order by m.mean_rating desc nulls last, m.game_title) as rank
  from means t join means m on m.game_title <> t.game_title) where rank <= 5"""))
def naive_topn(spark, sf_dir):
    means = popularity.item_means(warehouse.ratings(spark, sf_dir))
    return popularity.top_n_excluding_self(means, 5).withColumn("mean_rating", F.round("mean_rating", 6))


@query("naive_exclude_ci", oracle("ratings", ctes=MEANS, select="""
select target, rank, game_title from (
  select t.target, m.game_title,
         row_number() over (partition by t.target order by m.mean_rating desc nulls last, m.game_title) as rank
  from (select upper(game_title) as target from means union all select game_title from means) t
  join means m on m.game_title <> lower(t.target)) where rank <= 3"""))
def naive_exclude_ci(spark, sf_dir):
    """Targets in either case lose the same item: the target is lower-cased, the stored title is not."""
    means = popularity.item_means(warehouse.ratings(spark, sf_dir))
    targets = means.select(F.explode(F.array(F.upper("game_title"), F.col("game_title"))).alias("target"))
    head = popularity.head_array(means, popularity.best_first("mean_rating", "game_title"), 4, "game_title")
    kept = F.slice(F.filter("_head", lambda s: s["game_title"] != F.lower(F.col("target"))), 1, 3)
    return (targets.select("target", head.alias("_head"))
                   .select("target", F.posexplode(kept).alias("_i", "_s"))
                   .select("target", (F.col("_i") + 1).cast("bigint").alias("rank"), F.col("_s.game_title").alias("game_title")))


@query("variety_topn", oracle("ratings", ctes=MEANS + """,
seeded as (select game_title as target, (
      ((('0x'||substr(md5(game_title),1,8))::bigint % 10000 * 7296 + ('0x'||substr(md5(game_title),9,8))::bigint) % 10000 * 7296
       + ('0x'||substr(md5(game_title),17,8))::bigint) % 10000 * 7296 + ('0x'||substr(md5(game_title),25,8))::bigint) % 10000 as seed from means),
ranked as (select game_title, row_number() over (order by mean_rating desc nulls last, game_title) as g from means),
cand as (select s.target, s.seed, r.game_title, row_number() over (partition by s.target order by r.g) as pos
         from seeded s join ranked r on r.game_title <> lower(s.target) and r.g <= 31),
band as (select *, case when pos <= 10 then 'top' else 'mid' end as band from cand where pos <= 30),
drawn as (select *, row_number() over (partition by target, band order by ('0x'||substr(md5(concat_ws('|', seed, band, game_title)),1,8))::bigint, game_title) as d from band),
picked as (select target, seed, game_title from drawn where (band = 'top' and d <= 4) or (band = 'mid' and d <= 1))""", select="""
select target, row_number() over (partition by target order by ('0x'||substr(md5(concat_ws('|', seed, 'order', game_title)),1,8))::bigint, game_title) as rank,
       game_title from picked"""))
def variety_topn(spark, sf_dir):
    means = popularity.item_means(warehouse.ratings(spark, sf_dir))
    return popularity.variety_picks(means.select(F.col("game_title").alias("target")), means, 5)


@query("rank_tiers", oracle("ratings", ctes=MEANS, select="""
select game_title, rank, case when rank <= 10 then 'top' when rank <= 30 then 'mid' else 'rest' end as tier from (
  select game_title, row_number() over (order by mean_rating desc nulls last, game_title) as rank from means)"""))
def rank_tiers(spark, sf_dir):
    means = popularity.item_means(warehouse.ratings(spark, sf_dir))
    placed = dense_positions(means, popularity.best_first("mean_rating", "game_title"), "pos")
    rank = F.col("pos") + 1
    return placed.select("game_title", rank.alias("rank"), popularity.rank_band(rank).alias("tier"))


RANK_CTES = f"""{SPLIT},
means as (select game_title, sum(rating::decimal(28,9))::double / count(rating) as m from train group by game_title),
scored as (select game_title, coalesce(m, (select avg(rating) from train)) as score from (select distinct game_title from fx_ratings) left join means using (game_title)),
eligible as (select distinct user_id from test where user_id in (select user_id from train)),
top as (select user_id, game_title, score, rank from (
  select e.user_id, s.game_title, s.score, row_number() over (partition by e.user_id order by s.score desc, s.game_title) as rank
  from eligible e cross join scored s
  where not exists (select 1 from train r where r.user_id = e.user_id and r.game_title = s.game_title)) where rank <= 10),
truth as (select distinct user_id, game_title from test),
hits as (select t.*, case when h.user_id is null then 0 else 1 end as hit from top t left join truth h on h.user_id = t.user_id and h.game_title = t.game_title),
cum as (select *, sum(hit) over (partition by user_id order by rank) as c from hits),
sizes as (select user_id, count(*) as n_actual from test group by user_id),
users as (select s.user_id, any_value(n_actual) as n_actual, coalesce(sum(hit), 0) as n_hits, coalesce(sum(hit * c / cast(rank as double)), 0) / any_value(least(n_actual, 10)) as ap,
          coalesce(sum(hit / log2(rank + 1)), 0) as dcg from sizes s join eligible e on e.user_id = s.user_id left join cum on cum.user_id = s.user_id group by s.user_id),
graded as (select *, case when n_hits = 0 then 0.0 else dcg / list_sum(list_transform(range(1, cast(n_hits + 1 as bigint)), lambda i: 1 / log2(i + 1))) end as ndcg from users)"""


def _split_ratings(spark, sf_dir):
    """The ratings view written once, as the plans below pass over it several times."""
    rows = warehouse.ratings(spark, sf_dir)
    return materialize(rows.select("user_id", "game_title", "rating", split.tenths_test(F.col("row_key")).alias("is_test")), "ratings")


@query("naive_topk_per_user", oracle("ratings", ctes=RANK_CTES, select="select user_id, rank, game_title, round(score, 6) as score from top"))
def naive_topk_per_user(spark, sf_dir):
    top = naive.topk_per_user(_split_ratings(spark, sf_dir), F.col("is_test"), 10)
    return top.withColumn("score", F.round("score", 6))


def _per_user(spark, sf_dir):
    rows = _split_ratings(spark, sf_dir)
    top = naive.topk_per_user(rows, F.col("is_test"), 10)
    return metrics.per_user(top, lookup.only_keys(rows.where("is_test"), rows.where("not is_test"), "user_id"), 10, "user_id", "game_title")


@query("map_at_k", oracle("ratings", ctes=RANK_CTES, select="select user_id, cast(n_actual as bigint) as n_actual, cast(n_hits as bigint) as n_hits, round(ap, 6) as ap from graded"))
def map_at_k(spark, sf_dir):
    return _per_user(spark, sf_dir).select("user_id", "n_actual", "n_hits", F.round("ap", 6).alias("ap"))


@query("ndcg_at_k", oracle("ratings", ctes=RANK_CTES, select="select user_id, round(ndcg, 6) as ndcg from graded"))
def ndcg_at_k(spark, sf_dir):
    return _per_user(spark, sf_dir).select("user_id", F.round("ndcg", 6).alias("ndcg"))


NAIVE_EVAL_SELECT = """
select (select count(*) from test where rating is not null) as n_rows, round(mse, 6) as mse, round(sqrt(mse), 6) as rmse, round(r2, 6) as r2,
       n_users, n_hits, round(map_k, 6) as map_k, round(ndcg_k, 6) as ndcg_k
from (select avg((rating - coalesce(m, (select avg(rating) from train))) ** 2) as mse,
             1 - avg((rating - coalesce(m, (select avg(rating) from train))) ** 2) / var_pop(rating) as r2
      from test left join means using (game_title) where rating is not null),
     (select count(*) as n_users, cast(sum(n_hits) as bigint) as n_hits, avg(ap) as map_k, avg(ndcg) as ndcg_k from graded)"""


@query("naive_eval", oracle("ratings", ctes=RANK_CTES, select=NAIVE_EVAL_SELECT))
def naive_eval(spark, sf_dir):
    row = naive.evaluate(_split_ratings(spark, sf_dir), F.col("is_test"), 10)
    return row.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes])


@query("popular_topn", oracle("catalog", select="""
select row_number() over (order by user_ratings_count desc nulls last, title) as rank, title, user_ratings_count
from fx_catalog order by user_ratings_count desc nulls last, title limit 5"""))
def popular_topn(spark, sf_dir):
    rows = popularity.most_rated(warehouse.catalog(spark, sf_dir), 5)
    return rows.select(F.col("rank").cast("bigint").alias("rank"), "title", "user_ratings_count")
