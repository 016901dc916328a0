"""Request parsing, formatting and batch serving."""

from pyspark.sql import functions as F

from relish import schemas
from relish.functions import wording
from relish.operators import cleaning, popularity
from relish.plans import requests as R
from relish.queries import oracle, query, vectors
from relish.queries.cleaning import PREP_CTE
from relish.queries.ranking import MEANS
from relish.session import materialize
from relish.sources import warehouse


def _lit(text):
    return "'" + text.replace("'", "''") + "'"


def _list(rows):
    return "[" + ", ".join(_lit(r) for r in rows) + "]"


def _texts(rows):
    return "[" + ", ".join("{'title': " + _lit(t) + ", 'description': " + _lit(d) + "}" for t, d in rows) + "]"


def _h(*parts):
    return f"('0x'||substr(md5(concat_ws('|', {', '.join(parts)})),1,8))::bigint"


def title_case_sql(t):
    return (f"array_to_string(list_transform(range(1, length({t}) + 1), lambda i: case when i > 1 and regexp_matches({t}[i - 1], '\\p{{L}}') "
            f"then lower({t}[i]) else upper({t}[i]) end), '')")


# Bodies that name a made-up recommender arrive broken, so the parser's fallback is exercised.
DIRTY = """
sent as (select event_id, ts, case when contains(body, '"modelType":"Bogus"') then concat('{broken', body) else body end as body from fx_requests),
parsed as (select event_id, ts, case when json_valid(body) then body else '{}' end as j from sent),
req as (select event_id, ts, coalesce(json_extract_string(j, '$.username'), 'anonymous') as username,
        case when json_extract_string(j, '$.modelType') in ('Naive', 'Deep Learning', 'Traditional') then json_extract_string(j, '$.modelType') else 'Traditional' end as model_type,
        coalesce(cast(json_extract(j, '$.games') as varchar[]), []) as games,
        coalesce(cast(json_extract(j, '$.gameRatings') as map(varchar, integer)), map {}) as given,
        coalesce(cast(json_extract(j, '$._retryCount') as integer), 0) as retry_count from parsed)"""


def sent(spark, sf_dir):
    bogus = F.col("body").contains('"modelType":"Bogus"')
    body = F.when(bogus, F.concat(F.lit("{broken"), "body")).otherwise(F.col("body"))
    return warehouse.requests(spark, sf_dir).select("event_id", "ts", body.alias("body"))


def parsed(spark, sf_dir):
    return R.parse(sent(spark, sf_dir))


@query("req_parse_json", oracle("requests", ctes=DIRTY, select="""
select event_id, username, model_type, array_to_string(games, '|') as games, cast(len(games) as integer) as n_games,
       cast(cardinality(given) as integer) as n_ratings, retry_count from req"""))
def req_parse_json(spark, sf_dir):
    return parsed(spark, sf_dir).select("event_id", "username", "model_type", F.array_join("games", "|").alias("games"),
                                        F.size("games").alias("n_games"), F.size("gameRatings").alias("n_ratings"), "retry_count")


@query("req_validate_model", oracle("requests", select="""
select event_id, json_extract_string(body, '$.modelType') as asked,
       case when json_extract_string(body, '$.modelType') in ('Naive', 'Deep Learning', 'Traditional') then json_extract_string(body, '$.modelType') else 'Traditional' end as model_type
from fx_requests"""))
def req_validate_model(spark, sf_dir):
    asked = F.from_json("body", schemas.REQUEST)["modelType"]
    return warehouse.requests(spark, sf_dir).select("event_id", asked.alias("asked"), R.valid_model(asked).alias("model_type"))


@query("req_defaults", oracle("requests", ctes=DIRTY, select="""
select event_id, username, coalesce(given[games[1]], 5) as first_rating, retry_count from req"""))
def req_defaults(spark, sf_dir):
    rating = F.coalesce(F.try_element_at("gameRatings", F.get("games", 0)), F.lit(5))
    return parsed(spark, sf_dir).select("event_id", "username", rating.alias("first_rating"), "retry_count")


@query("req_clamp_slice", f"""
with asked as (select event_id, case when event_type = 'signup' then null else cast(floor(value) as integer) end as n from events),
clamped as (select event_id, greatest(1, least(coalesce(n, 9), 20)) as count from asked)
select event_id, count, array_to_string(list_slice({_list(wording.GAME_OPTIONS)}, 1, count), '|') as games, cast(least(count, 9) as integer) as offered from clamped""")
def req_clamp_slice(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    asked = F.when(F.col("event_type") != "signup", F.floor("value").cast("int"))
    options = F.array(*[F.lit(g) for g in wording.GAME_OPTIONS])
    return (events.select("event_id", R.option_count(asked).alias("count"))
            .withColumn("_g", F.slice(options, F.lit(1), F.col("count")))
            .select("event_id", "count", F.array_join("_g", "|").alias("games"), F.size("_g").alias("offered")))


SEED = "(((('0x'||substr(h,1,8))::bigint % 10000 * 7296 + ('0x'||substr(h,9,8))::bigint) % 10000 * 7296 + ('0x'||substr(h,17,8))::bigint) % 10000 * 7296 + ('0x'||substr(h,25,8))::bigint) % 10000"
# Five varied picks for every target named in a request.
PICKS = MEANS + f""",
targets as (select target, {SEED} as seed from (select distinct games[1] as target, md5(games[1]) as h from req where len(games) > 0)),
ranked as (select game_title, row_number() over (order by mean_rating desc nulls last, game_title) as g from means),
cand as (select s.target, s.seed, r.game_title, row_number() over (partition by s.target order by r.g) as pos
         from targets s join ranked r on r.game_title <> lower(s.target) and r.g <= 31),
band as (select *, case when pos <= 10 then 'top' else 'mid' end as band from cand where pos <= 30),
drawn as (select *, row_number() over (partition by target, band order by {_h('seed', 'band', 'game_title')}, game_title) as d from band),
picked as (select target, seed, game_title from drawn where (band = 'top' and d <= 4) or (band = 'mid' and d <= 1)),
picks as (select target, game_title, row_number() over (partition by target order by {_h('seed', "'order'", 'game_title')}, game_title) as rank from picked),
worded as (select target, rank, game_title, {_h("'genre1'", 'game_title')} % 17 as g1, {_h("'genre2'", 'game_title')} % 16 as g2 from picks),
naive_rows as (select target, rank as id, {title_case_sql('game_title')} as title,
  concat(replace({_list(wording.REASONS)}[{_h("'reason'", 'target', 'game_title')} % 8 + 1], '{{game}}', target), ': A ',
         {_list(wording.GENRES)}[g1 + 1], ' ', {_list(wording.GENRES)}[(case when g2 >= g1 then g2 + 1 else g2 end) + 1], ' experience with unique gameplay elements') as description from worded)"""


@query("rec_format", oracle("ratings", "requests", ctes=DIRTY + "," + PICKS, select="""
select event_id, id as rank, title, description from req join naive_rows on target = games[1]"""))
def rec_format(spark, sf_dir):
    means = popularity.item_means(warehouse.ratings(spark, sf_dir))
    asked = parsed(spark, sf_dir).where(F.size("games") > 0).select("event_id", F.get("games", 0).alias("target"))
    lists = asked.join(R.naive_lists(asked, means), "target")
    return R.numbered(lists, "event_id", "recs").withColumnRenamed("id", "rank")


NAIVE_ANSWER = f"""
naive_answer as (select event_id, id, title, description from req join naive_rows on target = games[1]
  union all select event_id, unnest(range(1, 6)) as id, unnest(list_transform({_texts(wording.NO_GAMES)}, lambda x: x.title)),
                   unnest(list_transform({_texts(wording.NO_GAMES)}, lambda x: x.description)) from req where len(games) = 0)"""


@query("naive_request", oracle("ratings", "requests", ctes=DIRTY + "," + PICKS + "," + NAIVE_ANSWER,
                               select="select event_id, id, title, description from naive_answer"))
def naive_request(spark, sf_dir):
    means = popularity.item_means(warehouse.ratings(spark, sf_dir))
    return R.answer_naive(parsed(spark, sf_dir), means)


@query("rec_pad_defaults", oracle("requests", ctes=DIRTY + f""",
lists as (select event_id, list_concat(list_transform(list_distinct(games), lambda t: {{'title': t, 'description': 'Owned'}}), {_texts(wording.GENERIC)}) as r,
          len(list_distinct(games)) as n from req),
long as (select event_id, unnest(r) as s, generate_subscripts(r, 1) as id, n from lists)""", select="""
select event_id, id, case when id <= n then 'Owned' else s.title end as title, s.description as description from long where id <= 5"""))
def rec_pad_defaults(spark, sf_dir):
    """Short lists, here a request's own games, filled up to five with the generic rows."""
    rows = parsed(spark, sf_dir).withColumn("own", F.transform(F.array_distinct("games"), lambda t: F.struct(
        F.lit("Owned").alias("title"), F.lit("Owned").alias("description"))))
    return R.numbered(rows.select("event_id", R.padded(F.col("own"), R.texts(wording.GENERIC), 5).alias("a")), "event_id", "a")


@query("resp_to_json", oracle("ratings", "requests", ctes=DIRTY + "," + PICKS + "," + NAIVE_ANSWER, select="""
select event_id, to_json({'statusCode': 200, 'recommendations': list({'id': id, 'title': title, 'description': description} order by id),
       'ec2_processed': true, 'model_used': any_value(model_type)})::varchar as body
from naive_answer join req using (event_id) group by event_id"""))
def resp_to_json(spark, sf_dir):
    means = popularity.item_means(warehouse.ratings(spark, sf_dir))
    requests = parsed(spark, sf_dir)
    answers = R.answer_naive(requests, means).join(requests.select("event_id", F.col("model_type").alias("model_used")), "event_id")
    return R.responses(answers)


VECTOR_CTES = vectors.ITEMS + "," + vectors.OWNED.replace(
    "asked as (select event_id, cast(json_extract(body, '$.games') as varchar[]) as games,\n          cast(json_extract(body, '$.gameRatings') as map(varchar, integer)) as given from fx_requests)",
    "asked as (select event_id, games, given from req where model_type = 'Deep Learning')") + "," + vectors.PROFILE + "," + vectors.TOP + "," + vectors.MATCH
DISPATCH = f"""
vector_rows as (select event_id, rank as id, title,
  case when sim > 0.8 then concat('Based on your ', match_rating, '/10 rating of ', match, ': Group ', label)
       else concat('AI model recommendation (', printf('%.2f', score), ' similarity): Group ', label) end as description
  from recs left join best using (event_id, rank)),
vector_defaults as (select event_id, unnest(range(1, 6)) as id, unnest(list_transform({_texts(wording.VECTOR_DEFAULTS)}, lambda x: x.title)) as title,
  unnest(list_transform({_texts(wording.VECTOR_DEFAULTS)}, lambda x: x.description)) as description
  from req where model_type = 'Deep Learning' and len(games) > 0 and event_id not in (select event_id from profile)),
scores as (select title, user_score as predicted_score, lower(trim(title)) as k from prep),
trad as (select event_id, title, predicted_score, row_number() over (partition by event_id order by predicted_score desc, title) as id
  from (select event_id, games from req where model_type = 'Traditional' and len(games) > 0) r join scores s on not list_contains(list_transform(games, lambda g: lower(trim(g))), s.k)),
no_games as (select event_id, unnest(range(1, 4)) as id, unnest(list_transform({_texts(wording.DISPATCH_DEFAULTS)}, lambda x: x.title)) as title,
  unnest(list_transform({_texts(wording.DISPATCH_DEFAULTS)}, lambda x: x.description)) as description from req where len(games) = 0),
answers as (select a.event_id, id, title, description from naive_answer a join req using (event_id) where model_type = 'Naive' and len(games) > 0
  union all select event_id, id, title, description from vector_rows union all select * from vector_defaults
  union all select event_id, id, title, concat('Predicted Score: ', printf('%.2f', predicted_score)) from trad where id <= 5
  union all select * from no_games)"""


def answers_oracle(more, last, select):
    """SQL over ``answers``, with further CTEs before and behind them."""
    return oracle("ratings", "requests", "catalog", "item_vectors", select=select,
                  ctes=",".join(c for c in (DIRTY, more, PICKS, NAIVE_ANSWER, VECTOR_CTES, PREP_CTE, DISPATCH, last) if c))


DISPATCH_SQL = answers_oracle("", "", "select event_id, model_type as model_used, id, title, description from answers join req using (event_id)")


def serving_tables(spark, sf_dir):
    """Item means, catalog scores and item vectors; the cleaned user score stands in for the forest's."""
    means = popularity.item_means(warehouse.ratings(spark, sf_dir))
    scores = cleaning.prepare_catalog(warehouse.catalog(spark, sf_dir)).select("title", F.col("user_score").alias("predicted_score"))
    return means, scores, vectors.items(spark, sf_dir)


@query("dispatch_batch", DISPATCH_SQL)
def dispatch_batch(spark, sf_dir):
    tables = [materialize(t, "serving") for t in serving_tables(spark, sf_dir)]  # the branches pass over them several times
    return R.dispatch(parsed(spark, sf_dir), *tables).select("event_id", "model_used", "id", "title", "description")
