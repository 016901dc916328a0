"""Projection, filter, coercion and catalog cleaning queries."""

from pyspark.sql import functions as F

from relish import schemas
from relish.functions import hashing, text
from relish.operators import cleaning, dictionary
from relish.queries import oracle, query
from relish.sources import warehouse

# Genre and platform names of the catalog view, the columns the wide oracles list.
GENRES = ("anvil", "blue", "bolt", "cold", "economy", "gear", "gizmo", "hot", "large", "medium", "new", "old",
          "plate", "promo", "red", "ring", "rod", "small", "standard", "widget")
PLATFORMS = ("PC", "Xbox")

YEAR = "cast(extract(year from try_strptime(release_date, '%Y-%m-%d')) as integer)"
GENRE_LIST = ("coalesce(list_sort(list_distinct(list_filter(list_transform(string_split(genres, ','), "
              "lambda g: replace(replace(lower(trim(g)), chr(8217), chr(39)), chr(8211), '-')), lambda g: g <> ''))), [])")
PLATFORM_ROWS = """
plat as (select title, case when json_valid(j) then coalesce(from_json(j, '[{"Platform":"VARCHAR","Platform Metascore":"VARCHAR"}]'), []) else [] end as entries
         from (select title, replace(replace(platforms_info, chr(39), '"'), ': None', ': null') as j from fx_catalog)),
plat_long as (select title, unnest(entries) as e, generate_subscripts(entries, 1) as i from plat),
plat_scores as (select title, e."Platform" as platform,
       max_by(case when regexp_full_match(e."Platform Metascore", '[0-9]+') then try_cast(e."Platform Metascore" as integer) else 0 end, i) as score
       from plat_long group by all)"""


@query("proj_ratings", oracle("reviews", select="select reviewer as user_id, game_title, round(rating_raw / 10, 6) as rating from fx_reviews"))
def proj_ratings(spark, sf_dir):
    dump = warehouse.reviews(spark, sf_dir).select(
        F.col("reviewer").alias("Reviewer Name"), F.col("game_title").alias("Game Title"),
        F.col("rating_raw").alias("Rating Given By The Reviewer"), "review")
    return cleaning.to_ratings(dump).withColumn("rating", F.round("rating", 6))


@query("proj_catalog", oracle("catalog", select="select title, release_date, genres, product_rating, publisher, developer, user_score, user_ratings_count from fx_catalog"))
def proj_catalog(spark, sf_dir):
    return warehouse.catalog(spark, sf_dir).select(
        "title", "release_date", "genres", "product_rating", "publisher", "developer", "user_score", "user_ratings_count")


@query("rating_normalize", oracle("ratings", select="select row_key, rating_raw, round(rating_raw / 10, 6) as rating from fx_ratings"))
def rating_normalize(spark, sf_dir):
    return warehouse.ratings(spark, sf_dir).select("row_key", "rating_raw", F.round(F.col("rating_raw") / 10, 6).alias("rating"))


@query("dropna_subset", oracle("catalog", select="""
select title, user_score, product_rating, user_ratings_count from fx_catalog
where user_score is not null and release_date is not null and genres is not null and product_rating is not null and user_ratings_count is not null"""))
def dropna_subset(spark, sf_dir):
    return (warehouse.catalog(spark, sf_dir)
            .na.drop(subset=["user_score", "release_date", "genres", "product_rating", "user_ratings_count"])
            .select("title", "user_score", "product_rating", "user_ratings_count"))


@query("dropna_any", oracle("ratings", select="select row_key, user_id, game_title, rating from fx_ratings where user_id is not null and game_title is not null and rating is not null"))
def dropna_any(spark, sf_dir):
    return warehouse.ratings(spark, sf_dir).select("row_key", "user_id", "game_title", "rating").na.drop("any")


@query("coerce_numeric", oracle("catalog", select="select title, user_score as raw_score, try_cast(user_score as double) as user_score from fx_catalog"))
def coerce_numeric(spark, sf_dir):
    return warehouse.catalog(spark, sf_dir).select(
        "title", F.col("user_score").alias("raw_score"), cleaning.coerce_number(F.col("user_score")).alias("user_score"))


@query("coerce_date_year", oracle("catalog", select=f"select title, release_date, {YEAR} as release_year from fx_catalog"))
def coerce_date_year(spark, sf_dir):
    return warehouse.catalog(spark, sf_dir).select("title", "release_date", text.parse_year(F.col("release_date")).alias("release_year"))


@query("fill_const", oracle("catalog", select="""
select title, coalesce(developer, 'unknown') as developer, coalesce(publisher, 'unknown') as publisher,
       coalesce(product_rating, 'unknown') as product_rating, coalesce(genres, '') as genres,
       coalesce(user_ratings_count, 0) as user_ratings_count from fx_catalog"""))
def fill_const(spark, sf_dir):
    return cleaning.fill_catalog(warehouse.catalog(spark, sf_dir)).select(
        "title", "developer", "publisher", "product_rating", "genres", "user_ratings_count")


@query("impute_median", oracle("catalog", ctes="n as (select title, try_cast(user_score as double) as s from fx_catalog)",
                               select="select title, round(coalesce(s, (select median(s) from n)), 6) as user_score from n"))
def impute_median(spark, sf_dir):
    scores = warehouse.catalog(spark, sf_dir).select("title", cleaning.coerce_number(F.col("user_score")).alias("user_score"))
    return cleaning.impute_median(scores, "user_score").withColumn("user_score", F.round("user_score", 6))


@query("user_history", oracle("ratings", select="""
select user_id, count(*) as n_ratings, count(distinct game_title) as n_items, round(avg(rating), 6) as mean_rating
from fx_ratings group by user_id"""))
def user_history(spark, sf_dir):
    pairs = (warehouse.ratings(spark, sf_dir).groupBy("user_id", "game_title")
             .agg(F.count("*").alias("n"), F.sum("rating").alias("s"), F.count("rating").alias("c")))
    return pairs.groupBy("user_id").agg(
        F.sum("n").alias("n_ratings"), F.count("*").alias("n_items"),
        F.round(F.try_divide(F.sum("s"), F.sum("c")), 6).alias("mean_rating"))


@query("title_lookup_ci", oracle("requests", "catalog", ctes="asked as (select event_id, upper(json_extract_string(body, '$.games[0]')) as asked from fx_requests)",
                                 select="select event_id, asked, title, release_date from asked join fx_catalog on lower(asked) = lower(title)"))
def title_lookup_ci(spark, sf_dir):
    asked = warehouse.requests(spark, sf_dir).select(
        "event_id", F.upper(F.get(F.from_json("body", schemas.REQUEST)["games"], 0)).alias("asked"))
    titles = warehouse.catalog(spark, sf_dir).select("title", "release_date")
    return asked.join(titles, F.lower("asked") == F.lower("title")).select("event_id", "asked", "title", "release_date")


@query("genre_clean", oracle("catalog", select=f"select title, array_to_string(g, '|') as genres, len(g) as n_genres from (select title, {GENRE_LIST} as g from fx_catalog)"))
def genre_clean(spark, sf_dir):
    return (warehouse.catalog(spark, sf_dir).select("title", text.clean_genres(F.col("genres")).alias("g"))
            .select("title", F.array_join("g", "|").alias("genres"), F.size("g").cast("bigint").alias("n_genres")))


@query("genre_regex_split", oracle("catalog", select="""
select title, coalesce(array_to_string(g, '|'), '') as genres, coalesce(len(g), 0) as n_genres
from (select title, regexp_split_to_array(lower(genres), ',\\s*') as g from fx_catalog)"""))
def genre_regex_split(spark, sf_dir):
    return (warehouse.catalog(spark, sf_dir).select("title", text.split_genres(F.col("genres")).alias("g"))
            .select("title", F.array_join("g", "|").alias("genres"), F.size("g").cast("bigint").alias("n_genres")))


@query("platform_parse", oracle("catalog", ctes=PLATFORM_ROWS, select="""
select title, array_to_string(list_transform(entries, lambda e: e."Platform"), '|') as names,
       array_to_string(list_transform(entries, lambda e: coalesce(e."Platform Metascore", '?')), '|') as scores, len(entries) as n_platforms from plat"""))
def platform_parse(spark, sf_dir):
    parsed = warehouse.catalog(spark, sf_dir).select("title", text.parse_platforms(F.col("platforms_info")).alias("p"))
    return parsed.select("title", F.array_join(F.transform("p", lambda e: e["platform"]), "|").alias("names"),
                         F.array_join(F.transform("p", lambda e: F.coalesce(e["metascore"], F.lit("?"))), "|").alias("scores"),
                         F.size("p").cast("bigint").alias("n_platforms"))


@query("platform_map", oracle("catalog", ctes=PLATFORM_ROWS, select="select title, platform, score from plat_scores"))
def platform_map(spark, sf_dir):
    rows = cleaning.with_platform_scores(warehouse.catalog(spark, sf_dir), "platforms_info", "m")
    # explode of the column itself would make Spark ask first whether it is empty, and parse once more for every entry
    return rows.select("title", F.inline(F.map_entries("m")).alias("platform", "score"))


@query("platform_pivot", oracle("catalog", ctes=PLATFORM_ROWS, select="select c.title, "
       + ", ".join(f"cast(coalesce(max(score) filter (where platform = '{p}'), 0) as integer) as \"platform_{p}\"" for p in PLATFORMS)
       + " from fx_catalog c left join plat_scores p on p.title = c.title group by c.title"))
def platform_pivot(spark, sf_dir):
    rows = cleaning.with_platform_scores(warehouse.catalog(spark, sf_dir), "platforms_info", "m").select("title", "m")
    names = dictionary.listed(dictionary.build(rows, F.map_keys("m")))
    return cleaning.widen_map(rows, "m", "platform_", names).drop("m")


@query("bucket_other", oracle("catalog", ctes="top as (select publisher from fx_catalog where publisher is not null group by publisher order by count(*) desc, publisher limit 20)",
                              select="select title, case when publisher in (select publisher from top) then publisher else 'Other' end as publisher from fx_catalog"))
def bucket_other(spark, sf_dir):
    return cleaning.bucket_other(warehouse.catalog(spark, sf_dir).select("title", "publisher"), "publisher")


@query("value_counts_top", oracle("catalog", select="select publisher, count(*) as n_rows from fx_catalog where publisher is not null group by publisher order by count(*) desc, publisher limit 20"))
def value_counts_top(spark, sf_dir):
    return cleaning.top_values(warehouse.catalog(spark, sf_dir), "publisher")


CLEAN_SELECT = (f"select c.title, release_date, coalesce(product_rating, 'unknown') as product_rating, coalesce(publisher, 'unknown') as publisher, "
                f"coalesce(developer, 'unknown') as developer, coalesce({YEAR}, 0) as release_year, "
                "round(coalesce(try_cast(user_score as double), (select median(try_cast(user_score as double)) from fx_catalog)), 6) as user_score, "
                "coalesce(user_ratings_count, 0) as user_ratings_count, "
                + ", ".join(f"cast(list_contains({GENRE_LIST}, '{g}') as integer) as \"genre_{g}\"" for g in GENRES) + ", "
                + ", ".join(f"cast(coalesce((select score from plat_scores p where p.title = c.title and platform = '{p}'), 0) as integer) as \"platform_{p}\"" for p in PLATFORMS)
                + " from fx_catalog c")


@query("catalog_clean", oracle("catalog", ctes=PLATFORM_ROWS, select=CLEAN_SELECT))
def catalog_clean(spark, sf_dir):
    rows = cleaning.clean_catalog(warehouse.catalog(spark, sf_dir))
    genres, platforms = (dictionary.listed(dictionary.build(rows, c)) for c in (F.col("genres"), F.map_keys("platforms")))
    return cleaning.widen_catalog(rows, genres, platforms).withColumn("user_score", F.round("user_score", 6))


@query("catalog_sparse", oracle("catalog", ctes=PLATFORM_ROWS + f""",
listed as (select title, unnest({GENRE_LIST}) as g from fx_catalog),
codes as (select g, row_number() over (order by g) - 1 as code from (select distinct g from listed)),
pcodes as (select platform, row_number() over (order by platform) - 1 as code from (select distinct platform from plat_scores))""", select="""
select c.title, coalesce((select string_agg(code, '|' order by code) from (select distinct title, g from listed) l join codes using (g) where l.title = c.title), '') as genre_codes,
       coalesce((select string_agg(concat(code, ':', score), '|' order by code) from plat_scores p join pcodes using (platform) where p.title = c.title), '') as platform_scores from fx_catalog c"""))
def catalog_sparse(spark, sf_dir):
    """Genres and platform scores of the cleaned catalog by code, for any number of them."""
    rows = cleaning.clean_catalog(warehouse.catalog(spark, sf_dir))
    genres = dictionary.encode(rows, "title", "genres", dictionary.build(rows, F.col("genres")))
    scores = rows.select("title", F.explode("platforms").alias("value", "score"))
    scores = scores.join(dictionary.build(rows, F.map_keys("platforms")), "value").groupBy("title").agg(F.array_sort(F.collect_list(F.struct("code", "score"))).alias("p"))
    return rows.select("title").join(genres, "title").join(scores, "title", "left").select(
        "title", F.array_join("codes", "|").alias("genre_codes"),
        F.coalesce(F.array_join(F.transform("p", lambda s: F.concat_ws(":", s["code"], s["score"])), "|"), F.lit("")).alias("platform_scores"))


PREP_CTE = f"""
rows0 as (select title, genres, product_rating, publisher, developer, user_ratings_count,
          try_cast(user_score as double) as user_score, {YEAR} as release_year from fx_catalog
          where user_score is not null and release_date is not null and genres is not null and product_rating is not null and user_ratings_count is not null),
rows1 as (select * from rows0 where user_score is not null and release_year is not null),
top_pub as (select publisher from rows1 where publisher is not null group by publisher order by count(*) desc, publisher limit 20),
top_dev as (select developer from rows1 where developer is not null group by developer order by count(*) desc, developer limit 20),
prep as (select title, release_year, ln(1 + user_ratings_count) as log_ratings_count, 2025 - release_year as game_age, product_rating,
         regexp_split_to_array(lower(genres), ',\\s*') as genres, user_score,
         case when publisher in (select publisher from top_pub) then publisher else 'Other' end as publisher,
         case when developer in (select developer from top_dev) then developer else 'Other' end as developer from rows1)"""


@query("catalog_prep", oracle("catalog", ctes=PREP_CTE, select="""
select title, release_year, round(log_ratings_count, 6) as log_ratings_count, cast(game_age as integer) as game_age, product_rating,
       array_to_string(genres, '|') as genres, user_score, publisher, developer from prep"""))
def catalog_prep(spark, sf_dir):
    return cleaning.prepare_catalog(warehouse.catalog(spark, sf_dir)).select(
        "title", "release_year", F.round("log_ratings_count", 6).alias("log_ratings_count"), "game_age", "product_rating",
        F.array_join("genres", "|").alias("genres"), "user_score", "publisher", "developer")


@query("md5_seed", oracle("catalog", ctes="d as (select title, md5(title) as h from fx_catalog)", select="""
select title, (((('0x'||substr(h,1,8))::bigint % 10000 * 7296 + ('0x'||substr(h,9,8))::bigint) % 10000 * 7296
       + ('0x'||substr(h,17,8))::bigint) % 10000 * 7296 + ('0x'||substr(h,25,8))::bigint) % 10000 as seed from d"""))
def md5_seed(spark, sf_dir):
    return warehouse.catalog(spark, sf_dir).select("title", hashing.md5_mod(F.col("title"), 10000).alias("seed"))


LONG_TITLES = "select concat('The ', title, ' (', developer, ') edition') as long_title from fx_catalog union all select title from fx_catalog"


@query("title_shorten", oracle("catalog", ctes=f"t as ({LONG_TITLES}), s as (select long_title, "
       "regexp_replace(trim(regexp_replace(long_title, '\\s*\\([^)]*\\)\\s*', ' ', 'g')), '^[Tt][Hh][Ee]\\s+', '') as short from t)",
       select="select long_title, case when length(long_title) > 25 and length(short) < length(long_title) then short else long_title end as title from s"))
def title_shorten(spark, sf_dir):
    return _long_titles(spark, sf_dir).select("long_title", text.shorten_title(F.col("long_title")).alias("title"))


@query("title_slug", oracle("catalog", ctes=f"t as ({LONG_TITLES})", select="select long_title, regexp_replace(lower(long_title), '[^a-z0-9]', '', 'g') as slug from t"))
def title_slug(spark, sf_dir):
    return _long_titles(spark, sf_dir).select("long_title", text.slug(F.col("long_title")).alias("slug"))


def _long_titles(spark, sf_dir):
    both = F.array(F.concat(F.lit("The "), "title", F.lit(" ("), "developer", F.lit(") edition")), F.col("title"))
    return warehouse.catalog(spark, sf_dir).select(F.explode(both).alias("long_title"))
