"""Feature encodings of the prepared catalog."""

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from relish import schemas
from relish.functions import hashing, text
from relish.operators import cleaning, dictionary, features
from relish.queries import oracle, query
from relish.queries.cleaning import GENRE_LIST, GENRES, PREP_CTE, YEAR
from relish.sources import warehouse

RATING_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
TRAIN = "('0x'||substr(md5(title),1,8))::bigint % 10 >= 8"


def prepared(spark, sf_dir):
    return cleaning.prepare_catalog(warehouse.catalog(spark, sf_dir))


@query("multi_hot", oracle("catalog", select="select title, "
       + ", ".join(f"cast(list_contains({GENRE_LIST}, '{g}') as integer) as \"genre_{g}\"" for g in GENRES) + " from fx_catalog"))
def multi_hot(spark, sf_dir):
    rows = warehouse.catalog(spark, sf_dir).select("title", text.clean_genres(F.col("genres")).alias("g"))
    return cleaning.widen_list(rows, "g", "genre_", dictionary.listed(dictionary.build(rows, F.col("g")))).drop("g")


@query("one_hot", oracle("catalog", ctes=PREP_CTE, select="select title, "
       + ", ".join(f"cast(product_rating = '{r}' as integer) as \"product_rating_{r}\"" for r in RATING_TYPES) + " from prep"))
def one_hot(spark, sf_dir):
    rows = prepared(spark, sf_dir).select("title", F.array("product_rating").alias("r"))
    return cleaning.widen_list(rows, "r", "product_rating_", dictionary.listed(dictionary.build(rows, F.col("r")))).drop("r")


@query("one_hot_unknown", oracle("catalog", ctes=PREP_CTE + f""",
seen_pub as (select distinct publisher from prep where {TRAIN}), seen_dev as (select distinct developer from prep where {TRAIN})""", select="""
select title, publisher, developer, cast(publisher in (select publisher from seen_pub) as integer) as publisher_ones,
       cast(developer in (select developer from seen_dev) as integer) as developer_ones,
       (select count(*) from seen_pub) as publisher_slots, (select count(*) from seen_dev) as developer_slots from prep"""))
def one_hot_unknown(spark, sf_dir):
    """Encoders fitted on one split; a value they have not seen becomes all zeros."""
    rows = prepared(spark, sf_dir)
    encoded = Pipeline(stages=features.indexers()[1::2]).fit(rows.where(hashing.bucket(F.col("title"), 10) >= 8)).transform(rows)

    def ones(c):
        return F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x).cast("int")

    def slots(c):
        return F.size(vector_to_array(c)).cast("bigint")

    return encoded.select("title", "publisher", "developer", ones("publisher_v").alias("publisher_ones"), ones("developer_v").alias("developer_ones"),
                          slots("publisher_v").alias("publisher_slots"), slots("developer_v").alias("developer_slots"))


@query("feature_matrix", oracle("catalog", ctes=PREP_CTE, select="""
select title, 3 + (select count(distinct g) from (select unnest(genres) as g from prep)) + (select count(distinct product_rating) from prep)
         + (select count(distinct publisher) from prep) + (select count(distinct developer) from prep) as n_features,
       round(release_year + log_ratings_count + game_age + len(list_distinct(genres)) + 3, 6) as feature_sum, user_score as target from prep"""))
def feature_matrix(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    matrix = features.feature_pipeline().fit(rows).transform(rows).select("title", vector_to_array("features").alias("f"), "user_score")
    return matrix.select("title", F.size("f").cast("bigint").alias("n_features"),
                         F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 6).alias("feature_sum"), F.col("user_score").alias("target"))


@query("feature_matrix_sparse", oracle("catalog", ctes=PREP_CTE + """,
entries as (select distinct 0 as kind, title, unnest(genres) as value from prep union select 1, title, product_rating from prep
            union select 2, title, publisher from prep union select 3, title, developer from prep),
places as (select kind, value, 2 + row_number() over (order by kind, value) as place from (select distinct kind, value from entries)),
ones as (select title, string_agg(place, '|' order by place) as ones from entries join places using (kind, value) group by title)""", select="""
select title, 3 + (select count(*) from places) as n_features, round(release_year + log_ratings_count + game_age, 6) as numeric_sum, ones from prep join ones using (title)"""))
def feature_matrix_sparse(spark, sf_dir):
    """The matrix as sparse vectors whose places are fixed by value, built without the driver."""
    rows = prepared(spark, sf_dir)
    matrix = features.sparse_encoder(rows).transform(rows).select("title", vector_to_array("features").alias("f"))
    ones = F.filter(F.sequence(F.lit(3), F.size("f") - 1), lambda i: F.get("f", i) == 1.0)
    return matrix.select("title", F.size("f").cast("bigint").alias("n_features"), F.round(F.get("f", 0) + F.get("f", 1) + F.get("f", 2), 6).alias("numeric_sum"),
                         F.array_join(ones, "|").alias("ones"))


@query("title_features", oracle("requests", "catalog", ctes="asked as (select event_id, json_extract_string(body, '$.games[0]') as asked from fx_requests)", select=f"""
select event_id, title, {YEAR} as release_year, round(ln(1 + user_ratings_count), 6) as log_ratings_count, cast(2025 - {YEAR} as integer) as game_age,
       coalesce(len(regexp_split_to_array(lower(genres), ',\\s*')), 0) as n_genres
from asked join fx_catalog on lower(asked) = lower(title)"""))
def title_features(spark, sf_dir):
    """Features of every requested title, found in any case."""
    asked = warehouse.requests(spark, sf_dir).select("event_id", F.get(F.from_json("body", schemas.REQUEST)["games"], 0).alias("asked"))
    rows = warehouse.catalog(spark, sf_dir)
    year = text.parse_year(F.col("release_date"))
    return asked.join(rows, F.lower("asked") == F.lower("title")).select(
        "event_id", "title", year.alias("release_year"), F.round(F.log1p(F.col("user_ratings_count").cast("double")), 6).alias("log_ratings_count"),
        (F.lit(2025) - year).alias("game_age"), F.size(text.split_genres(F.col("genres"))).cast("bigint").alias("n_genres"))


@query("feature_title_join", oracle("catalog", ctes=PREP_CTE, select="""
select title, release_year, cast(game_age as integer) as game_age, round(log_ratings_count, 6) as log_ratings_count from prep join (select title from fx_catalog) using (title)"""))
def feature_title_join(spark, sf_dir):
    """Features meet titles by key; row order means nothing in a distributed table."""
    titles = warehouse.catalog(spark, sf_dir).select("title")
    return prepared(spark, sf_dir).join(titles, "title").select(
        "title", "release_year", "game_age", F.round("log_ratings_count", 6).alias("log_ratings_count"))
