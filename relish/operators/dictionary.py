"""Categories of any number: a dictionary is a table, rows are encoded by a join, vectors are sparse.

Nothing here is collected, and a wide table is made only of the names a caller hands over (``cleaning.widen_list``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from relish.operators.lookup import dense_ids
from relish.operators.order import dense_positions
from relish.session import materialize, scratch_dir


def build(rows: DataFrame, values: Column) -> DataFrame:
    """``(value, code)``: the distinct values, numbered 0.. in their order; a list column counts member by member."""
    kind = rows.select(values.alias("v")).schema["v"].dataType.typeName()
    found = rows.select((F.explode(values) if kind == "array" else values).alias("value"))
    return materialize(dense_ids(found, "value", "code"), "dictionary")


def listed(dictionary: DataFrame) -> list:
    """All values in order, for a caller who wants a column of each."""
    return [r["value"] for r in dictionary.orderBy("code").collect()]


def encode(rows: DataFrame, key: str, values: str, dictionary: DataFrame) -> DataFrame:
    """``(key, codes)``: the codes of each row's list, ascending, each once; values without a code are left out.

    Rows of one key are one row; a key without a known value has an empty list.
    """
    entries = rows.select(key, F.explode(values).alias("value")).distinct().join(dictionary, "value")
    codes = entries.groupBy(key).agg(F.array_sort(F.collect_list("code")).alias("codes"))
    empty = F.array().cast("array<bigint>")
    return rows.select(key).distinct().join(codes, key, "left").select(key, F.coalesce("codes", empty).alias("codes"))


@dataclass(frozen=True)
class Encoder:
    """Numeric columns first, then one place for each value of each category: by category, then by value.

    ``places`` is the table ``(kind, value, place)``. A value that was not there when the encoder was made has no place,
    so it adds nothing to a row.
    """

    numeric: tuple[str, ...]
    lists: Mapping[str, Column]
    places: DataFrame
    width: int

    @staticmethod
    def fit(rows: DataFrame, numeric: Sequence[str], lists: Mapping[str, Column]) -> "Encoder":
        """``lists`` names each category's list column, in the order their places take."""
        values = _entries(rows, lists).select("kind", "value").distinct()
        places = dense_positions(values, [F.col("kind").asc(), F.col("value").asc()], "place")
        places = materialize(places.select("kind", "value", (F.col("place") + len(numeric)).cast("int").alias("place")), "places")
        return Encoder(tuple(numeric), dict(lists), places, len(numeric) + places.count())

    def transform(self, rows: DataFrame, name: str = "features") -> DataFrame:
        """``rows`` with a sparse vector column; numeric columns may not be NULL."""
        spark, row = rows.sparkSession, "_row"
        numbered = materialize(rows.withColumn(row, F.monotonically_increasing_id()), "numbered")
        found = _entries(numbered, self.lists, row).distinct().join(self.places, ["kind", "value"])
        ones = found.groupBy(F.col(row).alias("_of")).agg(F.array_sort(F.collect_list("place")).alias("_ones"))
        joined = numbered.join(ones, F.col(row) == F.col("_of"), "left").withColumn("_ones", F.coalesce("_ones", F.array().cast("array<int>")))
        places = F.concat(F.array(*[F.lit(i) for i in range(len(self.numeric))]).cast("array<int>"), "_ones")
        numbers = F.array(*[F.col(c).cast("double") for c in self.numeric]).cast("array<double>")
        vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(self.width).alias("size"), places.alias("indices"),
                          F.concat(numbers, F.transform("_ones", lambda _: F.lit(1.0))).alias("values"))
        # a sparse vector is stored as this struct, so the written table can be read as one
        path = scratch_dir(spark, "sparse")
        joined.select(*rows.columns, vector.alias(name)).write.parquet(path)
        return spark.read.schema(StructType([*rows.schema.fields, StructField(name, VectorUDT())])).parquet(path)


def _entries(rows: DataFrame, lists: Mapping[str, Column], *keep: str) -> DataFrame:
    """``(*keep, kind, value)`` of every list member."""
    def members_of(kind: int, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value")))
    each = [members_of(kind, values) for kind, values in enumerate(lists.values())]
    none = F.array().cast("array<struct<kind:int,value:string>>")
    members = F.concat(none, *[F.coalesce(e, none) for e in each])
    return rows.select(*keep, F.inline(members)).where("value is not null")
