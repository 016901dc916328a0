"""Sources and sinks: every table is written in full, read back and compared."""

from pyspark.sql import functions as F

from relish import schemas
from relish.functions import wording
from relish.operators import lookup
from relish.queries import oracle, query
from relish.queries.joins import ITEMS, SPLIT, USERS, item_ids, user_ids
from relish.session import materialize, scratch_dir
from relish.sources import artifacts, files, probe, warehouse
from relish.operators import split


def _ratings(spark, sf_dir):
    return warehouse.ratings(spark, sf_dir).select("user_id", "game_title", "rating")


def _dump(spark, sf_dir):
    return warehouse.reviews(spark, sf_dir).select(
        F.col("reviewer").alias("Reviewer Name"), F.col("game_title").alias("Game Title"),
        F.col("rating_raw").alias("Rating Given By The Reviewer"), F.col("review").alias("Review Text"))


RATING_ROWS = "select user_id, game_title, round(rating, 6) as rating from fx_ratings"


def _round(df):
    return df.withColumn("rating", F.round("rating", 6))


@query("src_ratings_csv", oracle("ratings", select=RATING_ROWS))
def src_ratings_csv(spark, sf_dir):
    path = files.write_csv(_ratings(spark, sf_dir), scratch_dir(spark, "ratings"))
    return _round(files.read_ratings(spark, path))


@query("src_catalog_csv", oracle("catalog", select="select * from fx_catalog"))
def src_catalog_csv(spark, sf_dir):
    path = files.write_csv(warehouse.catalog(spark, sf_dir), scratch_dir(spark, "catalog"))
    return files.read_catalog(spark, path)


@query("src_reviews_csv", oracle("reviews", select='select reviewer as "Reviewer Name", game_title as "Game Title", rating_raw as "Rating Given By The Reviewer", review as "Review Text" from fx_reviews'))
def src_reviews_csv(spark, sf_dir):
    """Quoted review texts with quotes, commas and line breaks survive."""
    return files.read_reviews(spark, files.write_csv(_dump(spark, sf_dir), scratch_dir(spark, "reviews")))


@query("src_bulk_csv", oracle("ratings", ctes=SPLIT, select="""
select folder, count(*) as n_rows, count(rating) as n_rated, round(sum(rating), 4) as total
from (select *, 'train' as folder from train union all select *, 'test' as folder from test) group by folder"""))
def src_bulk_csv(spark, sf_dir):
    """Two datasets and a text file below one location; only the CSV files are taken."""
    base = scratch_dir(spark, "bulk")
    rows = warehouse.ratings(spark, sf_dir)
    test = split.tenths_test(F.col("row_key"))
    for folder, part in (("train", ~test), ("test", test)):
        files.write_csv(rows.where(part).select("user_id", "game_title", "rating"), f"{base}/{folder}")
    rows.select("row_key").write.text(f"{base}/notes")
    found = files.read_all_csv(spark, base, schemas.RATINGS)
    folder = F.element_at(F.split("source", "/"), -2).alias("folder")
    return found.groupBy(folder).agg(F.count("*").alias("n_rows"), F.count("rating").alias("n_rated"), F.round(F.sum("rating"), 4).alias("total"))


@query("src_single_csv", oracle("catalog", select="select title, release_date, publisher from fx_catalog"))
def src_single_csv(spark, sf_dir):
    base = scratch_dir(spark, "objects")
    files.push(warehouse.catalog(spark, sf_dir), base, "catalog.csv", key="raw/catalog.csv")
    return files.read_key(spark, base, "raw/catalog.csv", schemas.CATALOG).select("title", "release_date", "publisher")


@query("src_titles_json", oracle("catalog", select="select distinct title from fx_catalog"))
def src_titles_json(spark, sf_dir):
    path = files.write_titles(warehouse.catalog(spark, sf_dir).select("title"), scratch_dir(spark, "titles"))
    return files.read_titles(spark, path, whole_file=False)


@query("src_mapping_json", oracle("catalog", ctes=ITEMS, select="select game_title as key, game_idx as idx from items"))
def src_mapping_json(spark, sf_dir):
    mapping = item_ids(spark, sf_dir).select(F.col("game_title").alias("key"), F.col("game_idx").alias("idx"))
    return files.read_mapping(spark, files.write_mapping(mapping, scratch_dir(spark, "items")))


@query("sink_csv_roundtrip", oracle("ratings", ctes=SPLIT, select="""
select 'train' as part, user_id, game_title, round(rating, 6) as rating from train union all
select 'test', user_id, game_title, round(rating, 6) from test where user_id in (select user_id from train)"""))
def sink_csv_roundtrip(spark, sf_dir):
    """The two split files, test users limited to train users, written and read back."""
    rows = warehouse.ratings(spark, sf_dir)
    test = split.tenths_test(F.col("row_key"))
    train = rows.where(~test)
    held = lookup.only_keys(rows.where(test), train, "user_id")
    parts = {name: files.write_csv(part.select("user_id", "game_title", "rating"), scratch_dir(spark, name)) for name, part in (("train", train), ("test", held))}
    back = [_round(files.read_ratings(spark, p)).select(F.lit(name).alias("part"), "*") for name, p in parts.items()]
    return back[0].unionByName(back[1])


@query("sink_mapping_roundtrip", oracle("ratings", ctes=USERS, select="select user_id as key, user_idx as idx from users"))
def sink_mapping_roundtrip(spark, sf_dir):
    mapping = user_ids(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("user_idx").alias("idx"))
    return files.read_mapping(spark, files.write_mapping(mapping, scratch_dir(spark, "users")))


@query("sink_push_keyed", oracle("ratings", select="""
select key, user_id, game_title, round(rating, 6) as rating from fx_ratings, (select unnest(['ratings.csv', 'archive/ratings.csv']) as key)"""))
def sink_push_keyed(spark, sf_dir):
    """One dataset under its own name and under a chosen key."""
    base = scratch_dir(spark, "store")
    rows = _ratings(spark, sf_dir)
    for key in (None, "archive/ratings.csv"):
        files.push(rows, base, "ratings.csv", key)
    keys = ["ratings.csv", "archive/ratings.csv"]
    back = [_round(files.read_key(spark, base, k, schemas.RATINGS)).select(F.lit(k).alias("key"), "*") for k in keys]
    return back[0].unionByName(back[1])


@query("src_fallback", oracle("catalog", select=f"""
select 'second' as used, title from fx_catalog union all select 'inline', unnest([{", ".join("'" + t.replace("'", "''") + "'" for t in wording.FALLBACK_TITLES)}])"""))
def src_fallback(spark, sf_dir):
    """A missing first source falls back to the second, two missing ones to inline rows."""
    base = scratch_dir(spark, "fallback")
    files.write_csv(warehouse.catalog(spark, sf_dir), f"{base}/second")

    def read(name):
        return lambda: files.read_catalog(spark, f"{base}/{name}").select("title")

    def inline():
        return spark.createDataFrame([(t,) for t in wording.FALLBACK_TITLES], "title string")
    found = files.first_available([read("first"), read("second")], inline).select(F.lit("second").alias("used"), "title")
    none = files.first_available([read("first"), read("third")], inline).select(F.lit("inline").alias("used"), "title")
    return found.unionByName(none)


@query("sink_if_missing", oracle("ratings", ctes=SPLIT, select="select user_id, count(*) as n_rows from train group by user_id"))
def sink_if_missing(spark, sf_dir):
    """The second write finds the artifact and leaves it alone."""
    path = scratch_dir(spark, "artifact")
    rows = warehouse.ratings(spark, sf_dir)
    test = split.tenths_test(F.col("row_key"))

    def counts(part):
        return rows.where(part).groupBy("user_id").agg(F.count("*").alias("n_rows"))
    files.materialize_if_missing(counts(~test), path)
    return files.materialize_if_missing(counts(test), path)


@query("sink_versions", oracle("ratings", ctes=SPLIT, select="""
select user_id, count(*) as n_rows, 1 as version, 2 as n_versions from test group by user_id"""))
def sink_versions(spark, sf_dir):
    """Two published versions with a failing writer between and behind them: the second is what a reader finds."""
    path = scratch_dir(spark, "counts")
    rows = warehouse.ratings(spark, sf_dir)
    test = split.tenths_test(F.col("row_key"))

    def fail(folder):
        rows.select("user_id").write.parquet(folder)
        raise RuntimeError("lost before it published")
    table = artifacts.Artifact(spark, path)
    for part in (~test, test):
        artifacts.publish(rows.where(part).groupBy("user_id").agg(F.count("*").alias("n_rows")), path)
        try:
            table.publish(fail)
        except RuntimeError:
            pass
    version, folder = table.newest()
    return spark.read.parquet(folder).select("user_id", "n_rows", F.lit(version).alias("version"), F.lit(len(table.versions())).alias("n_versions"))


@query("sink_mappings_pair", oracle("ratings", "catalog", ctes=f"{USERS},\n{ITEMS}", select="""
select 'user' as kind, user_id as key, user_idx as idx from users union all select 'item', game_title, game_idx from items"""))
def sink_mappings_pair(spark, sf_dir):
    """User and item indexes published together, first of half the keys and then of all."""
    path = scratch_dir(spark, "mappings")
    users = user_ids(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("user_idx").alias("idx"))
    items = item_ids(spark, sf_dir).select(F.col("game_title").alias("key"), F.col("game_idx").alias("idx"))
    files.publish_mappings(users.where("idx % 2 = 0"), items.where("idx % 2 = 0"), path)
    files.publish_mappings(users, items, path)
    return_users, return_items = files.newest_mappings(spark, path)
    return return_users.select(F.lit("user").alias("kind"), "*").unionByName(return_items.select(F.lit("item").alias("kind"), "*"))


def _probed(spark, sf_dir):
    """Six sources: none, another format, no rows, mostly broken rows, few broken rows, and one that is not needed."""
    base = scratch_dir(spark, "probe")
    rows = materialize(_ratings(spark, sf_dir), "ratings")  # written four times below

    def broken(beyond):
        return rows.withColumn("rating", F.when(F.col("rating") > beyond, F.lit("n/a")).otherwise(F.col("rating").cast("string")))
    rows.write.parquet(f"{base}/junk")
    files.write_csv(rows.where("false"), f"{base}/empty")
    files.write_csv(broken(2.0), f"{base}/dirty")
    files.write_csv(broken(9.0), f"{base}/good")
    files.write_csv(rows, f"{base}/spare")
    names = ("gone", "junk", "empty", "dirty", "good", "spare")
    return probe.first_good(spark, {n: f"{base}/{n}" for n in names}, schemas.RATINGS, lambda: rows.where("false"), required=("user_id", "game_title"))


@query("src_probe", oracle("ratings", ctes="""
n as (select count(*) as total, count(*) filter (where rating > 2.0) as beyond_2, count(*) filter (where rating > 9.0) as beyond_9 from fx_ratings)""", select="""
select 0 as place, 'gone' as source, 'missing' as verdict, null::bigint as n_good, null::bigint as n_bad from n
union all select 1, 'junk', 'unreadable', null, null from n union all select 2, 'empty', 'empty', 0, 0 from n
union all select 3, 'dirty', 'dirty', total - beyond_2, beyond_2 from n union all select 4, 'good', 'used', total - beyond_9, beyond_9 from n
union all select 5, 'spare', 'untried', null, null from n"""))
def src_probe(spark, sf_dir):
    """What is found out about each of several sources before one is used."""
    return _probed(spark, sf_dir).report


@query("src_probe_rows", oracle("ratings", select="""
select 'good' as source, user_id, game_title, round(rating, 6) as rating, 'kept' as kind from fx_ratings where rating is null or rating <= 9.0
union all select 'good', user_id, game_title, null, 'apart' from fx_ratings where rating > 9.0
union all select 'dirty', user_id, game_title, null, 'apart' from fx_ratings where rating > 2.0"""))
def src_probe_rows(spark, sf_dir):
    """The rows of the source that is used, and the broken rows of those that were parsed, kept apart."""
    found = _probed(spark, sf_dir)
    kept = _round(found.rows).select(F.lit("good").alias("source"), "user_id", "game_title", "rating", F.lit("kept").alias("kind"))
    record = F.from_csv("record", "user_id string, game_title string, rating string", {"escape": '"'})
    apart = found.bad.select("source", record.alias("r")).select("source", "r.user_id", "r.game_title", F.lit(None).cast("double").alias("rating"), F.lit("apart").alias("kind"))
    return kept.unionByName(apart)
