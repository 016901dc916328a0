"""Rating, catalog, request and item-vector views over the warehouse tables.

The view texts run unchanged on Spark and on any ANSI engine with the same tables, so
the oracle side reads exactly the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RATINGS_VIEW = """
select concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) as row_key,
       concat('user', o_custkey) as user_id,
       concat(p_name, ' ', p_partkey) as game_title,
       case when l_linenumber = 7 and l_quantity > 45 then null else l_quantity * 2 end as rating_raw,
       case when l_linenumber = 7 and l_quantity > 45 then null else l_quantity * 2 / 10 end as rating,
       l_shipdate as rated_at
from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
"""

CATALOG_VIEW = """
select concat(p_name, ' ', p_partkey) as title,
       case when p_partkey % 17 = 0 then 'TBA'
            else concat_ws('-', 1995 + p_partkey % 29, lpad(concat('', 1 + p_partkey % 12), 2, '0'), lpad(concat('', 1 + p_partkey % 28), 2, '0')) end as release_date,
       case when p_partkey % 23 = 0 then null
            else concat(split_part(p_name, ' ', 1), ' , ', upper(split_part(p_name, ' ', 2)), ',', split_part(p_name, ' ', 1), ', ,', lower(p_type)) end as genres,
       case when p_partkey % 19 = 0 then null else p_type end as product_rating,
       case when p_partkey % 13 = 0 then null else p_brand end as publisher,
       concat('Studio ', p_partkey % 40) as developer,
       case when p_partkey % 29 = 0 then null when p_partkey % 11 = 0 then 'tbd'
            else concat('', cast(p_size as double) / 5) end as user_score,
       case when p_partkey % 31 = 0 then null else p_partkey * 37 % 1000 end as user_ratings_count,
       case when p_partkey % 37 = 0 then null when p_partkey % 41 = 0 then 'garbage['
            else replace(concat('[{{"Platform": "PC", "Platform Metascore": "', 40 + p_size, '"}}, {{"Platform": "Xbox", "Platform Metascore": ',
                 case when p_partkey % 3 = 0 then 'None' else concat('"', 30 + p_size, '"') end,
                 '}}, {{"Platform": "PC", "Platform Metascore": "', case when p_partkey % 5 = 0 then 'tbd' else concat('', 45 + p_size) end, '"}}]'), '"', chr(39)) end as platforms_info
from {part}
"""

REQUESTS_VIEW = """
select event_id, ts, props,
       concat('{{"action":"sendUserData","username":"user', user_id, '","modelType":"',
              case event_type when 'click' then 'Naive' when 'view' then 'Deep Learning' when 'purchase' then 'Traditional' when 'signup' then '' else 'Bogus' end,
              '","games":["', a.title, '","', b.title, '"],"gameRatings":{{"', a.title, '":', 1 + event_id % 10, '}},"_retryCount":', event_id % 6, '}}') as body
from (select *, (select count(*) from {part}) as n_parts, cast(replace(split_part(props, ':', 2), '}}', '') as bigint) as k from {events}) e
join (select p_partkey, concat(p_name, ' ', p_partkey) as title from {part}) a on a.p_partkey = e.k
join (select p_partkey, concat(p_name, ' ', p_partkey) as title from {part}) b on b.p_partkey = (e.k + event_id) % e.n_parts
"""

ITEM_VECTORS_VIEW = """
select case when p_partkey is null then concat('Vector ', vec_id) else concat(p_name, ' ', p_partkey) end as title, v.embedding, v.label
from {embeddings} v left join {part} on p_partkey = vec_id
"""

REVIEWS_VIEW = """
select concat('user', o_custkey) as reviewer, concat(p_name, ' ', p_partkey) as game_title,
       case when l_linenumber = 7 and l_quantity > 45 then null else l_quantity * 2 end as rating_raw,
       concat('Line "', l_linenumber, '",', chr(10), 'shipped as ', l_linestatus) as review
from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
"""

VIEWS = {
    "ratings": RATINGS_VIEW,
    "catalog": CATALOG_VIEW,
    "requests": REQUESTS_VIEW,
    "item_vectors": ITEM_VECTORS_VIEW,
    "reviews": REVIEWS_VIEW,
}
_MAIN_TABLE = {"ratings": "lineitem", "reviews": "lineitem", "catalog": "part", "requests": "events", "item_vectors": "embeddings"}
_TABLES = ("lineitem", "orders", "part", "events", "embeddings")


def view_sql(name: str) -> str:
    """The view's text over plain table names."""
    return VIEWS[name].format(**{t: t for t in _TABLES}).strip()


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that comes as one small file; leave any other as it is.

    A large table has more splits than the session has cores, so it is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in text}
    main = _MAIN_TABLE[name]
    tables[main] = spread(tables[main])
    return spark.sql(text, **tables)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "ratings")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "catalog")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "requests")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "item_vectors")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "reviews")
