"""Sources that are tried before they are used: missing, unreadable, empty and dirty ones are passed over."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from relish.session import materialize

#: what a text reader keeps of a row that does not fit the schema
BROKEN = "_broken_row"
REPORT = "place int, source string, verdict string, n_good bigint, n_bad bigint"


@dataclass(frozen=True)
class Found:
    """The rows that are used, the rows kept apart as ``(source, record)``, and one line of ``REPORT`` a source."""

    rows: DataFrame
    bad: DataFrame
    report: DataFrame


def _parsed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Every row of a source in the schema; a row that does not fit keeps its text in ``BROKEN``.

    Text is parsed once and kept, so it is not parsed again by what follows.  CSV headers have to name the columns.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        found = spark.read.parquet(path)
        return materialize(found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(None).cast("string").alias(BROKEN)), "probed")
    whole = StructType([*schema.fields, StructField(BROKEN, StringType())])
    reader = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
    if kind == "json":
        return materialize(reader.json(path), "probed")
    return materialize(reader.option("header", True).option("escape", '"').option("enforceSchema", False).csv(path), "probed")


def first_good(spark: SparkSession, sources: Mapping[str, str], schema: StructType, inline: Callable[[], DataFrame], most_bad: float = 0.5,
               required: tuple[str, ...] = ()) -> Found:
    """The good rows of the first source that can be used, else the inline rows.

    A source is ``missing`` if its path is not there, ``unreadable`` if reading it raises anything (another format, other
    columns, a broken file), ``empty`` without a good row, ``dirty`` if more than ``most_bad`` of its rows are bad, and
    otherwise ``used``; those behind it are ``untried``.  A row is bad if it does not fit the schema or lacks a value in a
    ``required`` column.  The ending of a path (csv, json, parquet) names its format; CSV is the default.
    """
    lines, used = [], None
    bad = spark.createDataFrame([], "source string, record string")
    for place, (name, path) in enumerate(sources.items()):
        if used is not None:
            lines.append((place, name, "untried", None, None))
            continue
        try:
            rows = _parsed(spark, path, schema)
        except (PySparkException, Py4JJavaError) as e:
            gone = isinstance(e, PySparkException) and e.getCondition() == "PATH_NOT_FOUND"
            lines.append((place, name, "missing" if gone else "unreadable", None, None))
            continue
        lacks = F.lit(False)
        for column in required:
            lacks = lacks | F.col(f"`{column}`").isNull()
        wrong = F.col(BROKEN).isNotNull() | lacks
        n_good, n_bad = rows.agg(F.count_if(~wrong), F.count_if(wrong)).first()
        verdict = "empty" if not n_good else "dirty" if n_bad > most_bad * (n_good + n_bad) else "used"
        lines.append((place, name, verdict, n_good, n_bad))
        record = F.coalesce(F.col(BROKEN), F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])))
        bad = bad.unionByName(rows.where(wrong).select(F.lit(name).alias("source"), record.alias("record")))
        if verdict == "used":
            used = rows.where(~wrong).drop(BROKEN)
    report = spark.createDataFrame(lines, REPORT)
    return Found(inline() if used is None else used, bad, report)
