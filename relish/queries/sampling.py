"""Splits, samples and negatives."""

from pyspark.sql import functions as F

from relish.operators import lookup, sampling, split
from relish.queries import oracle, query
from relish.queries.joins import BUCKET, ITEMS, SPLIT, USERS, item_ids, user_ids
from relish.session import materialize
from relish.sources import warehouse

# Smallest prime not below the number of items, and every user's shuffled item order over it.
PRIME = """
n as (select count(*) as n from items),
prime as (select min(c) as p from (select n + unnest(range(0, 400)) as c from n)
          where not exists (select 1 from (select unnest(range(2, 2000)) as d) where d * d <= c and c % d = 0))"""


def order_sql(key, seed):
    return (f"(('0x'||substr(md5(concat_ws('|', '{seed}a', {key})),1,15))::bigint % p + "
            f"(1 + ('0x'||substr(md5(concat_ws('|', '{seed}b', {key})),1,15))::bigint % (p - 1)) * pos) % p")


@query("split_exact_ratio", oracle("ratings", select="""
select row_key, rn <= floor((select count(*) from fx_ratings) * 0.2) as is_test
from (select row_key, row_number() over (order by md5(row_key)) as rn from fx_ratings)"""))
def split_exact_ratio(spark, sf_dir):
    rows = warehouse.ratings(spark, sf_dir)
    return rows.select("row_key", split.exact_ratio_test(rows, "row_key", 0.2).alias("is_test"))


@query("split_hash", oracle("ratings", select=f"select row_key, {BUCKET} % 10 < 2 as is_test from fx_ratings"))
def split_hash(spark, sf_dir):
    return warehouse.ratings(spark, sf_dir).select("row_key", split.tenths_test(F.col("row_key")).alias("is_test"))


@query("split_65", oracle("ratings", select=f"select row_key, {BUCKET} % 100 < 65 as is_test from fx_ratings"))
def split_65(spark, sf_dir):
    return warehouse.ratings(spark, sf_dir).select("row_key", split.is_test(F.col("row_key"), 65).alias("is_test"))


@query("sample_n", oracle("ratings", select="""
select row_key, user_id, game_title from fx_ratings order by md5(concat_ws('|', '42', row_key)), row_key limit 20"""))
def sample_n(spark, sf_dir):
    return sampling.sample_rows(warehouse.ratings(spark, sf_dir), "row_key", 20, "42").select("row_key", "user_id", "game_title")


@query("sample_k_per_request", oracle("catalog", "requests", ctes=f"""{ITEMS},{PRIME},
spots as (select event_id, p, unnest(range(0, (select least(9 + p - n, p) from n, prime))) as pos from fx_requests, prime),
drawn as (select event_id, pos, {order_sql('event_id', 'pick')} as item_idx from spots),
kept as (select event_id, item_idx, row_number() over (partition by event_id order by pos) - 1 as draw from drawn where item_idx < (select n from n))""",
       select="select event_id, draw, game_title from kept join items on game_idx = item_idx where draw < 9"))
def sample_k_per_request(spark, sf_dir):
    items = item_ids(spark, sf_dir)
    keys = warehouse.requests(spark, sf_dir).select(F.col("event_id").cast("string").alias("event"))
    picks = sampling.sample_items_per_key(keys, "event", 9, items.count(), "pick")
    return (picks.join(items, picks["item_idx"] == items["game_idx"])
                 .select(F.col("event").cast("bigint").alias("event_id"), F.col("draw").cast("bigint").alias("draw"), "game_title"))


def negatives(spark, sf_dir, k=100):
    """``(user_idx, game_idx)`` test positives and ``k`` sampled others per user, with the item count."""
    items, users = item_ids(spark, sf_dir), user_ids(spark, sf_dir)
    rows = warehouse.ratings(spark, sf_dir)
    test = rows.where(split.tenths_test(F.col("row_key")))
    pos = lookup.interactions(test, users, items).select("user_idx", "game_idx").distinct()
    pos = materialize(pos, "positives")
    n_items = items.count()
    neg = sampling.first_unseen(pos, "user_idx", "game_idx", k, n_items, sampling.Shuffle(n_items, "neg"))
    return pos, neg, n_items


NEG_CTES = f"""{USERS},
{ITEMS},
{SPLIT},
pos as (select distinct user_idx, game_idx from test join users using (user_id) join items using (game_title) where rating is not null),{PRIME},
spots as (select user_idx, p, unnest(range(0, (select p from prime))) as pos from (select distinct user_idx from pos), prime),
drawn as (select user_idx, pos, {order_sql('user_idx', 'neg')} as game_idx from spots),
free as (select user_idx, game_idx, row_number() over (partition by user_idx order by pos) as rank from drawn
         where game_idx < (select n from n) and not exists (select 1 from pos q where q.user_idx = drawn.user_idx and q.game_idx = drawn.game_idx)),
neg as (select * from free where rank <= 100)"""


@query("neg_sample_eval", oracle("ratings", "catalog", ctes=NEG_CTES, select="select user_idx, game_idx, rank from neg"))
def neg_sample_eval(spark, sf_dir):
    return negatives(spark, sf_dir)[1].select("user_idx", "game_idx", "rank")


@query("candidates_union", oracle("ratings", "catalog", ctes=NEG_CTES, select="""
select user_idx, game_idx, 1 as relevant from pos union all select user_idx, game_idx, 0 as relevant from neg"""))
def candidates_union(spark, sf_dir):
    pos, neg, _ = negatives(spark, sf_dir)
    return pos.withColumn("relevant", F.lit(1)).unionByName(neg.select("user_idx", "game_idx", F.lit(0).alias("relevant")))


@query("neg_sample_bpr", oracle("ratings", "catalog", ctes=f"{USERS},\n{ITEMS}", select="""
select row_key, user_idx, game_idx, ('0x'||substr(md5(concat_ws('|', 'neg', '0', row_key)),1,15))::bigint % (select count(*) from items) as neg_idx
from fx_ratings join users using (user_id) join items using (game_title) where rating is not null"""))
def neg_sample_bpr(spark, sf_dir):
    items = item_ids(spark, sf_dir)
    rows = lookup.interactions(warehouse.ratings(spark, sf_dir), user_ids(spark, sf_dir), items)
    return rows.select("row_key", "user_idx", "game_idx",
                       sampling.random_negative(F.col("row_key"), 0, items.count()).alias("neg_idx"))


@query("items_minus_seen", oracle("catalog", "ratings", ctes=SPLIT, select="""
select title as game_title from fx_catalog where title not in (select game_title from test where rating >= 9)"""))
def items_minus_seen(spark, sf_dir):
    """All items less the set of highly rated test items."""
    rows = warehouse.ratings(spark, sf_dir)
    liked = rows.where(split.tenths_test(F.col("row_key")) & (F.col("rating") >= 9)).select("game_title")
    return warehouse.catalog(spark, sf_dir).select(F.col("title").alias("game_title")).subtract(liked)
