"""CSV, JSON and Parquet sources and sinks with declared schemas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from relish import schemas
from relish.operators.lookup import dense_ids
from relish.sources import artifacts

MAPPING_CHUNK = 1000  # entries per written JSON object


def read_csv(spark: SparkSession, path: str, schema: StructType, multiline: bool = False) -> DataFrame:
    """Headed CSV. ``multiline`` allows quoted line breaks, at the price of one task per file."""
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", multiline).csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.RATINGS)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CATALOG)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """The full review dump; its texts may hold line breaks."""
    return read_csv(spark, path, schemas.REVIEWS, multiline=True)


def read_all_csv(spark: SparkSession, location: str, schema: StructType) -> DataFrame:
    """Every ``.csv`` file below a location, the ending in any case, with its path as ``source``."""
    rows = (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", True).csv(location))
    return rows.select("*", F.col("_metadata.file_path").alias("source"))


def read_key(spark: SparkSession, base: str, key: str, schema: StructType) -> DataFrame:
    return read_csv(spark, f"{base.rstrip('/')}/{key}", schema)


def push(df: DataFrame, base: str, name: str, key: str | None = None) -> str:
    """Write under a chosen key, by default the dataset's name; the URI scheme picks the store."""
    path = f"{base.rstrip('/')}/{key or name}"
    write_csv(df, path)
    return path


def read_titles(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Titles of every ``{"gameTitles": [...]}`` object: one a file, over many lines, or one a line."""
    objects = spark.read.schema(schemas.TITLE_LIST).option("multiLine", whole_file).json(path)
    return objects.select(F.explode("gameTitles").alias("title"))


def write_titles(titles: DataFrame, path: str, column: str = "title") -> str:
    """Title objects of bounded length, one per line."""
    ids = dense_ids(titles.select(column), column, "_idx")
    chunks = ids.groupBy(F.floor(F.col("_idx") / MAPPING_CHUNK)).agg(F.collect_list(column).alias("gameTitles"))
    chunks.select("gameTitles").write.mode("overwrite").json(path)
    return path


def read_mapping(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Key-to-index objects as ``(key, idx)`` rows; ``whole_file`` for one object over many lines."""
    text = spark.read.text(path, wholetext=whole_file)
    return text.select(F.explode(F.from_json("value", schemas.MAPPING)).alias("key", "idx"))


def write_mapping(mapping: DataFrame, path: str) -> str:
    """``(key, idx)`` with dense indexes as JSON objects of bounded size, one per line."""
    chunks = mapping.groupBy(F.floor(F.col("idx") / MAPPING_CHUNK)).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "idx"))).alias("m"))
    chunks.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)
    return path


def publish_mappings(users: DataFrame, items: DataFrame, path: str) -> int:
    """Publish both ``(key, idx)`` tables together, so that no reader pairs users of one state with items of another."""
    def write(folder: str) -> None:
        write_mapping(users, f"{folder}/users")
        write_mapping(items, f"{folder}/items")
    return artifacts.Artifact(users.sparkSession, path).publish(write)


def newest_mappings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Users and items of the newest published pair."""
    found = artifacts.Artifact(spark, path).newest()
    if found is None:
        raise FileNotFoundError(f"no mappings are published at {path}")
    return read_mapping(spark, f"{found[1]}/users"), read_mapping(spark, f"{found[1]}/items")


def first_available(candidates: Sequence[Callable[[], DataFrame]], inline: Callable[[], DataFrame]) -> DataFrame:
    """The first source whose path exists, else the inline rows."""
    for read in candidates:
        try:
            return read()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return inline()


def materialize_if_missing(df: DataFrame, path: str) -> DataFrame:
    """Write once; an artifact that was published is read and not rebuilt, a half-written one does not count."""
    return artifacts.once(df, path)
