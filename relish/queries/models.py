"""Neural collaborative filtering and forest queries.

Forward, loss and ranking queries use layers and factors hashed from their names, so SQL
can state every number; the training queries report what must hold for a learned model.
"""

from pyspark.sql import functions as F

from relish.functions.hashing import bucket
from relish.operators import cleaning, features, forest, lookup, metrics, ncf, ncf_train, sampling, split
from relish.operators.ncf_kernels import flatten
from relish.operators.order import dense_positions
from relish.queries import oracle, query
from relish.queries.cleaning import PREP_CTE
from relish.queries.joins import ITEMS, SPLIT, USERS, item_ids, user_ids
from relish.queries.ranking import NAIVE_EVAL_SELECT, RANK_CTES
from relish.queries.sampling import NEG_CTES
from relish.session import materialize, scratch_dir
from relish.sources import warehouse

DIM, HIDDEN = 4, (8, 4)
DENSE = ncf.hash_dense(DIM, HIDDEN)


def _unit(name, key):
    return f"(('0x'||substr(md5(concat_ws('|', '{name}', {key})),1,8))::bigint % 2001 - 1000) / 1000.0::double"


def _factors(alias, table, key, side):
    cols = ", ".join(f"{_unit(f'{side}{part}{j}', key)} as {side}{part}{j}" for part in "gm" for j in range(DIM))
    return f"{alias} as (select {key}, {cols} from {table})"


def _num(x):
    return f"({float(x)!r}::double)"


def _score(v="v"):
    """The forward pass as one expression over columns ug*, um* and the item columns."""
    def hidden1(i):
        terms = [f"um{j} * {_num(DENSE.w1[j, i])} + {v}m{j} * {_num(DENSE.w1[DIM + j, i])}" for j in range(DIM)]
        return f"greatest({' + '.join(terms)} + {_num(DENSE.b1[i])}, 0)"

    def hidden2(i):
        return f"greatest({' + '.join(f'{v}h{j} * {_num(DENSE.w2[j, i])}' for j in range(HIDDEN[0]))} + {_num(DENSE.b2[i])}, 0)"
    first = ", ".join(f"{hidden1(i)} as {v}h{i}" for i in range(HIDDEN[0]))
    gmf = " + ".join(f"ug{j} * {v}g{j} * {_num(DENSE.out[j])}" for j in range(DIM))
    mlp = " + ".join(f"{hidden2(i)} * {_num(DENSE.out[DIM + i])}" for i in range(HIDDEN[1]))
    return first, f"{gmf} + {mlp} + {_num(DENSE.bias)}"


def _scored(alias, source, keep, name="score", v="v"):
    first, total = _score(v)
    return f"{alias} as (select {keep}, {total} as {name} from (select *, {first} from {source}))"


FACTORS = f"""{USERS},
{ITEMS},
{_factors('uf', 'users', 'user_idx', 'u')},
{_factors('vf', 'items', 'game_idx', 'v')}"""
RATED = "rated as (select row_key, user_idx, game_idx, rating from fx_ratings join users using (user_id) join items using (game_title) where rating is not null)"
NEGS = (f"negs as (select *, ('0x'||substr(md5(concat_ws('|', 'neg', '0', row_key)),1,15))::bigint % (select count(*) from items) as neg_idx from rated),\n"
        f"{_factors('nf', 'items', 'game_idx', 'v').replace('nf as (select game_idx', 'nf as (select game_idx as neg_idx')},\n"
        + _scored("pos_s", "negs join uf using (user_idx) join vf using (game_idx)", "row_key, rating, user_idx, neg_idx", "pos") + ",\n"
        + _scored("both_s", "pos_s join uf using (user_idx) join nf using (neg_idx)", "row_key, rating, pos", "neg"))


def rated(spark, sf_dir, users=None, items=None):
    users, items = users or user_ids(spark, sf_dir), items or item_ids(spark, sf_dir)
    return lookup.interactions(warehouse.ratings(spark, sf_dir), users, items)


def rated_factors(spark, sf_dir, users, items, uf, vf, *more):
    """``rated`` with the factors of both sides, and further columns of a rating."""
    rows = warehouse.ratings(spark, sf_dir).select("row_key", "user_id", "game_title", "rating", *more)
    return ncf.rated_factors(rows, users, items, uf, vf)


def factors(spark, sf_dir):
    """Indexes and stored factor tables."""
    users, items = user_ids(spark, sf_dir), item_ids(spark, sf_dir)
    return (users, items, materialize(ncf.hash_factors(users.select("user_idx"), "user_idx", "u", DIM), "user-factors"),
            materialize(ncf.hash_factors(items.select("game_idx"), "game_idx", "v", DIM), "item-factors"))


@query("factor_join", oracle("ratings", "catalog", ctes=f"{FACTORS},\n{RATED}", select="select row_key, round("
       + " + ".join(f"ug{j} * vg{j}" for j in range(DIM)) + ", 6) as gmf_dot, round(" + " + ".join(f"um{j} * vm{j}" for j in range(DIM))
       + ", 6) as mlp_dot from rated join uf using (user_idx) join vf using (game_idx)"))
def factor_join(spark, sf_dir):
    from relish.functions.vectors import dot
    users, items, uf, vf = factors(spark, sf_dir)
    rows = rated_factors(spark, sf_dir, users, items, uf, vf)
    return rows.select("row_key", F.round(dot(F.col("ug"), F.col("vg")), 6).alias("gmf_dot"), F.round(dot(F.col("um"), F.col("vm")), 6).alias("mlp_dot"))


@query("ncf_forward", oracle("ratings", "catalog", ctes=f"{FACTORS},\n{RATED},\n"
       + _scored("scored", "rated join uf using (user_idx) join vf using (game_idx)", "row_key, user_idx, game_idx"),
       select="select row_key, user_idx, game_idx, round(score, 6) as score from scored"))
def ncf_forward(spark, sf_dir):
    users, items, uf, vf = factors(spark, sf_dir)
    scored = ncf.score_pairs(rated_factors(spark, sf_dir, users, items, uf, vf), uf, vf, DENSE)
    return scored.select("row_key", "user_idx", "game_idx", F.round("score", 6).alias("score"))


def _both(spark, sf_dir):
    users, items, uf, vf = factors(spark, sf_dir)
    drawn = sampling.random_negative(F.col("row_key"), 0, items.count())  # drawn at the source: the key then stays there
    return ncf.score_both(rated_factors(spark, sf_dir, users, items, uf, vf, drawn.alias("neg_idx")), uf, vf, DENSE)


BPR = "case when pos >= neg then ln(1 + exp(neg - pos)) else ln(1 + exp(pos - neg)) + neg - pos end"


@query("loss_mse", oracle("ratings", "catalog", ctes=f"{FACTORS},\n{RATED},\n{NEGS}",
                          select="select count(*) as n_rows, round(avg((pos - rating) ** 2), 6) as mse from both_s"))
def loss_mse(spark, sf_dir):
    return ncf.losses(_both(spark, sf_dir), 1.0).select("n_rows", F.round("hybrid", 6).alias("mse"))


@query("loss_bpr", oracle("ratings", "catalog", ctes=f"{FACTORS},\n{RATED},\n{NEGS}",
                          select=f"select count(*) as n_rows, round(avg({BPR}), 6) as bpr from both_s"))
def loss_bpr(spark, sf_dir):
    return ncf.losses(_both(spark, sf_dir), 0.0).select("n_rows", F.round("hybrid", 6).alias("bpr"))


@query("loss_hybrid", oracle("ratings", "catalog", ctes=f"{FACTORS},\n{RATED},\n{NEGS}",
                             select=f"select count(*) as n_rows, round(0.6::double * avg((pos - rating) ** 2) + 0.4::double * avg({BPR}), 6) as hybrid from both_s"))
def loss_hybrid(spark, sf_dir):
    return ncf.losses(_both(spark, sf_dir)).select("n_rows", F.round("hybrid", 6).alias("hybrid"))


@query("loss_eval", oracle("ratings", "catalog", ctes=f"{FACTORS},\n{RATED},\n"
       + _scored("scored", "rated join uf using (user_idx) join vf using (game_idx)", "row_key, rating") + """,
batches as (select (rn - 1) // 64 as batch, avg((score - rating) ** 2) as loss from (select *, row_number() over (order by row_key) as rn from scored) group by 1)""",
       select="select count(*) as n_batches, round(sum(loss), 4) as loss_sum, round(avg(loss), 6) as loss_mean from batches"))
def loss_eval(spark, sf_dir):
    users, items, uf, vf = factors(spark, sf_dir)
    scored = ncf.score_pairs(rated_factors(spark, sf_dir, users, items, uf, vf), uf, vf, DENSE)
    placed = dense_positions(scored.select("row_key", "score", "rating"), [F.col("row_key").asc()], "pos")
    return ncf.batch_loss(placed, "pos").select("n_batches", F.round("loss_sum", 4).alias("loss_sum"), F.round("loss_mean", 6).alias("loss_mean"))


@query("ncf_topn", oracle("ratings", "catalog", ctes=f"{FACTORS},\n" + _scored("scored", "uf cross join vf", "user_idx, game_idx") + """,
best as (select *, row_number() over (partition by user_idx order by score desc, game_idx) as rank from scored)""",
       select="select user_id, rank, game_title, round(score, 6) as score from best join users using (user_idx) join items using (game_idx) where rank <= 5"))
def ncf_topn(spark, sf_dir):
    users, items, uf, vf = factors(spark, sf_dir)
    top = ncf.top_items(uf, vf, DENSE, 5)
    return top.join(users, "user_idx").join(items, "game_idx").select("user_id", "rank", "game_title", F.round("score", 6).alias("score"))


@query("sampled_rank_eval", oracle("ratings", "catalog", ctes=f"{NEG_CTES},\n{_factors('uf', 'users', 'user_idx', 'u')},\n{_factors('vf', 'items', 'game_idx', 'v')},\n"
       + "cand as (select user_idx, game_idx, 1 as relevant from pos union all select user_idx, game_idx, 0 as relevant from neg),\n"
       + _scored("scored", "cand join uf using (user_idx) join vf using (game_idx)", "user_idx, game_idx, relevant") + ",\n"
       + "rated_test as (select user_idx, game_idx, rating from test join users using (user_id) join items using (game_title) where rating is not null),\n"
       + _scored("fit", "rated_test join uf using (user_idx) join vf using (game_idx)", "rating") + """,
top as (select * from (select *, row_number() over (partition by user_idx order by score desc, game_idx desc) as rank from scored) where rank <= 10),
cum as (select *, sum(relevant) over (partition by user_idx order by rank) as c from top),
sizes as (select user_idx, count(*) as n_actual from pos group by user_idx),
graded as (select user_idx, sum(relevant * c / rank) / any_value(least(n_actual, 10)) as ap, sum(relevant / log2(rank + 1)) as dcg, sum(relevant) as n_hits
           from cum join sizes using (user_idx) group by user_idx)""", select="""
select (select count(*) from fit) as n_rows, round((select avg((score - rating) ** 2) from fit), 6) as mse, round(sqrt((select avg((score - rating) ** 2) from fit)), 6) as rmse,
       round((select 1 - avg((score - rating) ** 2) / var_pop(rating) from fit), 6) as r2, count(*) as n_users, cast(sum(n_hits) as bigint) as n_hits, round(avg(ap), 6) as map_k,
       round(avg(case when n_hits = 0 then 0 else dcg / list_sum(list_transform(range(1, cast(n_hits + 1 as bigint)), lambda i: 1 / log2(i + 1))) end), 6) as ndcg_k from graded"""))
def sampled_rank_eval(spark, sf_dir):
    from relish.plans import sampled
    users, items, uf, vf = factors(spark, sf_dir)
    rows = warehouse.ratings(spark, sf_dir)
    test = materialize(lookup.interactions(rows.where(split.tenths_test(F.col("row_key"))), users, items), "test")
    row = sampled.evaluate(test, uf, vf, DENSE, items.count(), k=10, negatives=100)
    return row.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes])


TRAINED = ncf_train.Settings(dim=8, hidden=(16, 8), rounds=2, local_epochs=2, rate=0.01, dropout=0.0, init_scale=0.3, rows_per_bucket=10_000)


def train_small(spark, sf_dir):
    """A small model on the train split of the given ratings."""
    users, items = user_ids(spark, sf_dir), item_ids(spark, sf_dir)
    rows = warehouse.ratings(spark, sf_dir)
    train = lookup.interactions(rows.where(~split.tenths_test(F.col("row_key"))), users, items)
    return ncf_train.train(materialize(train, "train"), users.select("user_idx"), items.select("game_idx"), TRAINED)


@query("ncf_train", oracle("ratings", "catalog", ctes=f"{USERS},\n{ITEMS}", select="""
select (select count(*) from users) as n_users, (select count(*) from items) as n_items, 16 as width, 2 as n_rounds, true as loss_fell,
       (select count(*) from users) + (select count(*) from items) as n_finite"""))
def ncf_train_query(spark, sf_dir):
    """Two rounds of distributed training: full factor tables, finite numbers, falling loss."""
    model = train_small(spark, sf_dir)
    both = (model.users.select(F.lit("u").alias("side"), F.concat("gmf", "mlp").alias("v"))
            .unionByName(model.items.select(F.lit("v").alias("side"), F.concat("gmf", "mlp").alias("v"))))
    finite = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(1e6)))
    return both.agg(F.count_if(F.col("side") == "u").alias("n_users"), F.count_if(F.col("side") == "v").alias("n_items"),
                    F.max(F.size("v")).alias("width"), F.lit(len(model.losses)).alias("n_rounds"),
                    F.lit(bool(model.losses[-1] < model.losses[0])).alias("loss_fell"), F.count_if(finite).alias("n_finite"))


def _mse(rows, users, items):
    return metrics.regression(ncf.score_pairs(rows, users, items, DENSE, name="predicted")).first()["mse"]


@query("ncf_fold_in", oracle("ratings", "catalog", ctes=f"{USERS},\n{ITEMS},\n{SPLIT},\n"
       "cold as (select user_idx, game_idx from test join users using (user_id) join items using (game_title) where rating is not null)",
       select="select count(distinct user_idx) as n_users, count(*) as n_ratings, 5 * count(distinct user_idx) as n_recs, true as error_fell from cold"))
def ncf_fold_in(spark, sf_dir):
    """Users with only their test ratings as cold-start users: fit their vectors, recommend five items each."""
    users, items, _, vf = factors(spark, sf_dir)
    rows = warehouse.ratings(spark, sf_dir)
    cold = materialize(lookup.interactions(rows.where(split.tenths_test(F.col("row_key"))), users, items), "cold")
    start = ncf_train.new_vectors(cold.select("user_idx").distinct(), DIM)
    fitted = materialize(ncf_train.fit_users(cold, start, vf, DENSE, dropout=0.0), "fitted")
    recs = ncf.top_items(fitted, vf, DENSE, 5)
    counts = cold.groupBy("user_idx").agg(F.count("*").alias("n"))
    fell = _mse(cold, fitted, vf) < _mse(cold, start, vf)
    return (recs.groupBy("user_idx").agg(F.count("*").alias("r")).join(counts, "user_idx")
                .agg(F.count("*").alias("n_users"), F.sum("n").alias("n_ratings"), F.sum("r").alias("n_recs"), F.lit(bool(fell)).alias("error_fell")))


@query("ncf_refresh", oracle("ratings", "catalog", ctes=f"{USERS},\n{ITEMS},\n{SPLIT},\n"
       "fresh as (select distinct user_idx from test join users using (user_id) join items using (game_title) where rating >= 9)", select="""
select count(*) as n_users, count(f.user_idx) as n_refreshed, count(*) - count(f.user_idx) as n_unchanged, true as error_fell
from users u left join fresh f on f.user_idx = u.user_idx"""))
def ncf_refresh(spark, sf_dir):
    """High test ratings update their own users' stored vectors and nobody else's."""
    users, items, uf, vf = factors(spark, sf_dir)
    rows = warehouse.ratings(spark, sf_dir)
    liked = rows.where(split.tenths_test(F.col("row_key")) & (F.col("rating") >= 9))
    fresh = materialize(lookup.interactions(liked, users, items), "fresh")
    after = materialize(ncf_train.refresh(uf, fresh, vf, DENSE, dropout=0.0), "refreshed")
    old = uf.select("user_idx", F.col("gmf").alias("old_gmf"), F.col("mlp").alias("old_mlp"))
    same = (F.col("gmf") == F.col("old_gmf")) & (F.col("mlp") == F.col("old_mlp"))
    fell = _mse(fresh, after, vf) < _mse(fresh, uf, vf)
    return after.join(old, "user_idx").agg(F.count("*").alias("n_users"), F.count_if("refreshed").alias("n_refreshed"),
                                           F.count_if(same).alias("n_unchanged"), F.lit(bool(fell)).alias("error_fell"))


LEFT_OUT = 5  # one user in so many, by hash, is left out of training and so unknown to the model
ROUTES = f"""{SPLIT},
known as (select distinct user_id from train where ('0x'||substr(md5(user_id),1,8))::bigint % {LEFT_OUT} > 0),
asks as (select event_id, json_extract_string(body, '$.username') as username, cast(json_extract(body, '$.gameRatings') as map(varchar, integer)) as given from fx_requests),
routes as (select event_id, username, case when username in (select user_id from known) then 'known'
  when cardinality(given) > 0 then 'new' else 'none' end as route from asks)"""


def routed(spark, sf_dir):
    from relish.plans import requests as R
    from relish.plans import routing
    rows = warehouse.ratings(spark, sf_dir)
    train = rows.where(~split.tenths_test(F.col("row_key")))
    known = train.where(bucket(F.col("user_id"), LEFT_OUT) > 0).select("user_id").distinct()
    return routing.route(R.parse(warehouse.requests(spark, sf_dir)), known)


@query("route_known_or_new", oracle("ratings", "requests", ctes=ROUTES, select="select event_id, username, route from routes"))
def route_known_or_new(spark, sf_dir):
    return routed(spark, sf_dir).select("event_id", "username", "route")


@query("route_recommend", oracle("ratings", "catalog", "requests", ctes=f"{ROUTES},\n{FACTORS},\n" + _scored("scored", "uf cross join vf", "user_idx, game_idx") + """,
best as (select *, row_number() over (partition by user_idx order by score desc, game_idx) as rank from scored),
top as (select user_id, rank, game_title from best join users using (user_idx) join items using (game_idx) where rank <= 5)""", select="""
select event_id, route, rank, game_title from routes join top on user_id = username where route = 'known'
union all select event_id, route, unnest(range(1, 6)) as rank, null from routes where route = 'new'"""))
def route_recommend(spark, sf_dir):
    """Known users get their stored vectors' top items; new ones are fitted first, their learned titles are not compared."""
    from relish.plans import routing
    users, items, uf, vf = factors(spark, sf_dir)
    recs = routing.recommend(routed(spark, sf_dir), users.join(uf, "user_idx"), items.join(vf, "game_idx"), DENSE, 5,
                             catalog=warehouse.catalog(spark, sf_dir), dropout=0.0)
    shown = F.when(F.col("route").isin("known", "popular"), F.col("game_title"))
    return recs.select("event_id", "route", "rank", shown.alias("game_title"))


# --- random forest -------------------------------------------------------------------

SMALL_FOREST = {"numTrees": 10, "maxDepth": 5}
SMALL_SPACE = {"numTrees": [5, 10], "maxDepth": [3, 5], "minInstancesPerNode": [1, 2], "featureSubsetStrategy": ["auto", "sqrt", "0.5"], "minRowsToSplit": [2, 5, 10]}
TITLE_BUCKET = "('0x'||substr(md5(title),1,8))::bigint"


def prepared(spark, sf_dir):
    rows = materialize(cleaning.prepare_catalog(warehouse.catalog(spark, sf_dir)), "prepared")
    test = split.tenths_test(F.col("title"))
    return rows, rows.where(~test), rows.where(test)


@query("rf_fit_eval", oracle("catalog", ctes=PREP_CTE, select=f"""
select count(*) filter (where {TITLE_BUCKET} % 10 >= 2) as n_train, count(*) filter (where {TITLE_BUCKET} % 10 < 2) as n_test, true as in_range, true as has_error from prep"""))
def rf_fit_eval(spark, sf_dir):
    """Forest fitted on the train titles; test predictions stay within the train scores."""
    _, train, test = prepared(spark, sf_dir)
    scored = forest.fit(train, **SMALL_FOREST).transform(test)
    edges = train.agg(F.min("user_score").alias("lo"), F.max("user_score").alias("hi"), F.count("*").alias("n")).first()
    inside = F.col("predicted_score").between(edges["lo"] - 1e-9, edges["hi"] + 1e-9)
    rmse = metrics.regression(scored, "user_score", "predicted_score").first()["rmse"]
    return scored.agg(F.lit(edges["n"]).cast("bigint").alias("n_train"), F.count("*").alias("n_test"), F.bool_and(inside).alias("in_range"),
                      F.lit(bool(rmse > 0)).alias("has_error"))


@query("rf_random_search", oracle("catalog", ctes=PREP_CTE, select=f"""
select 2 as n_draws, true as errors_positive, count(*) as n_scored from prep where {TITLE_BUCKET} % 10 < 2"""))
def rf_random_search(spark, sf_dir):
    """Two random draws, three folds each; the best forest scores the test titles."""
    _, train, test = prepared(spark, sf_dir)
    model, errors = forest.random_search(train, SMALL_SPACE, draws=2, folds=3)
    return forest.score(model, test).agg(F.lit(len(errors)).alias("n_draws"), F.lit(all(e > 0 for e in errors)).alias("errors_positive"),
                                         F.count("predicted_score").alias("n_scored"))


@query("rf_min_split", oracle("catalog", ctes=PREP_CTE, select=f"""
select least, 0 as n_small_inner, true as is_smaller, count(*) as n_scored, 0 as n_different
from prep, (select unnest([5, 40]) as least) where {TITLE_BUCKET} % 10 < 2 group by least"""))
def rf_min_split(spark, sf_dir):
    """Forests with a least number of rows for a split; their scores are worked out once more on the table of nodes."""
    _, train, test = prepared(spark, sf_dir)
    encoder = features.sparse_encoder(train)
    rows, held = encoder.transform(train), encoder.transform(test)
    whole, out = forest.forest(numTrees=5, maxDepth=8).fit(rows), None
    for least in (5, 40):
        model, path = forest.forest(numTrees=5, maxDepth=8, minRowsToSplit=least).fit(rows), scratch_dir(spark, "cut")
        model.write().save(path)
        nodes = forest.nodes_of(spark, path)
        small = nodes.where((F.col("left") >= 0) & (F.col("rows") < least)).count()
        both = model.transform(held).select("title", "predicted_score").join(forest.scores_by_nodes(held, nodes).toDF("title", "again"), "title")
        row = both.agg(F.lit(least).alias("least"), F.lit(small).alias("n_small_inner"), F.lit(model.totalNumNodes < whole.totalNumNodes).alias("is_smaller"),
                       F.count("*").alias("n_scored"), F.count_if(F.abs(F.col("predicted_score") - F.col("again")) > 1e-9).cast("int").alias("n_different"))
        out = row if out is None else out.unionByName(row)
    return out


@query("rf_recommend", oracle("requests", ctes="asks as (select event_id, cast(json_extract(body, '$.games') as varchar[]) as games from fx_requests)",
                              select="select event_id, 5 as n_recs, 0 as n_liked, true as in_order, true as well_formed from asks"))
def rf_recommend(spark, sf_dir):
    """Five best-scored titles per request, none of them liked, scores falling, text as shown to the user."""
    from relish.plans import requests as R
    rows, train, _ = prepared(spark, sf_dir)
    scores = forest.score(forest.fit(train, **SMALL_FOREST), rows)
    asks = R.parse(warehouse.requests(spark, sf_dir)).select("event_id", "games")
    recs = forest.recommend(asks, scores).join(asks, "event_id")
    shown = F.regexp_extract("description", r"^Predicted Score: (\d+\.\d\d)$", 1)
    rec = F.struct("rank", F.col("title"), shown.try_cast("double").alias("shown"))
    lists = recs.groupBy("event_id").agg(F.array_sort(F.collect_list(rec)).alias("r"), F.first("games").alias("games"))
    liked = F.size(F.array_intersect(F.transform("r", lambda s: s["title"]), F.col("games")))
    falls = F.forall(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.get("r", i)["shown"] <= F.get("r", i - 1)["shown"])
    return lists.select("event_id", F.size("r").alias("n_recs"), liked.alias("n_liked"), falls.alias("in_order"),
                        F.forall("r", lambda s: s["shown"].isNotNull()).alias("well_formed"))


@query("model_roundtrip", oracle("catalog", "ratings", ctes=f"{PREP_CTE},\n{USERS},\n{ITEMS}", select=f"""
select 'forest' as model, count(*) as n_rows, 0 as n_different from prep where {TITLE_BUCKET} % 10 < 2
union all select 'neural', (select count(*) from users) + (select count(*) from items), 0"""))
def model_roundtrip(spark, sf_dir):
    """Saved and loaded models give what the originals give."""
    from pyspark.ml import PipelineModel
    _, train, test = prepared(spark, sf_dir)
    model, path = forest.fit(train, **SMALL_FOREST), scratch_dir(spark, "forest")
    model.write().overwrite().save(path)
    both = forest.score(model, test).join(forest.score(PipelineModel.load(path), test).toDF("title", "again"), "title")
    tree = both.agg(F.lit("forest").alias("model"), F.count("*").alias("n_rows"),
                    F.count_if(F.col("predicted_score") != F.col("again")).cast("int").alias("n_different"))
    _, _, uf, vf = factors(spark, sf_dir)
    saved, where = ncf_train.Model(uf, vf, DENSE, []), scratch_dir(spark, "neural")
    saved.save(where)
    back = ncf_train.Model.load(spark, where)
    same_layers = bool((flatten(back.dense) == flatten(DENSE)).all())

    def gone(a, b, key):
        return a.join(b.toDF(key, "g2", "m2"), key).select(((F.col("gmf") != F.col("g2")) | (F.col("mlp") != F.col("m2"))).alias("differs"))
    rows = gone(uf, back.users, "user_idx").unionByName(gone(vf, back.items, "game_idx"))
    net = rows.agg(F.lit("neural").alias("model"), F.count("*").alias("n_rows"),
                   (F.count_if("differs") + F.lit(0 if same_layers else 1)).cast("int").alias("n_different"))
    return tree.unionByName(net)


@query("model_compare", oracle("ratings", "catalog", ctes=f"{RANK_CTES},\n{PREP_CTE},\nnaive_row as ({NAIVE_EVAL_SELECT}),\n"
       "known_test as (select rating from test where rating is not null and game_title in (select title from fx_catalog))", select=f"""
select 'naive' as model, n_rows, mse, rmse, r2, map_k, ndcg_k, true as in_range from naive_row
union all select 'neural', (select count(*) from known_test), null, null, null, null, null, true
union all select 'traditional', (select count(*) from prep where {TITLE_BUCKET} % 10 < 2), null, null, null, null, null, true"""))
def model_compare(spark, sf_dir):
    """One metrics row per recommender; learned numbers are checked for range and not shown."""
    from relish.plans import compare, naive, sampled
    rows = warehouse.ratings(spark, sf_dir)
    table = materialize(rows.select("row_key", "user_id", "game_title", "rating", split.tenths_test(F.col("row_key")).alias("is_test")), "ratings")
    users, items = user_ids(spark, sf_dir), item_ids(spark, sf_dir)
    model = train_small(spark, sf_dir)
    test = materialize(lookup.interactions(table.where("is_test"), users, items), "test")
    _, train, held = prepared(spark, sf_dir)
    scored = forest.fit(train, **SMALL_FOREST).transform(held)
    report = compare.report({
        "naive": naive.evaluate(table, F.col("is_test")),
        "neural": sampled.evaluate(test, model.users, model.items, model.dense, items.count()),
        "traditional": metrics.regression(scored, "user_score", "predicted_score")})
    ranked = F.col("map_k").between(0, 1) & F.col("ndcg_k").between(0, 1)
    in_range = (F.col("mse") > 0) & (F.col("r2") <= 1) & F.when(F.col("model") == "traditional", F.col("map_k").isNull()).otherwise(ranked)
    shown = [F.when(F.col("model") == "naive", F.round(c, 6)).alias(c) for c in ("mse", "rmse", "r2", "map_k", "ndcg_k")]
    return report.select("model", "n_rows", *shown, in_range.alias("in_range"))
