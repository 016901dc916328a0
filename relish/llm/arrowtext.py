"""Reading texts out of Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.types import DataType, StructField, StructType

#: what frees the things that a worker keeps from task to task
KEPT: list[Callable[[], None]] = []


def free_kept() -> None:
    """Free what tasks of other kinds left in this worker; tasks that need much memory of their own call it."""
    for free in KEPT:
        free()


@contextmanager
def batches(spark: SparkSession, rows: int, decoded: int | None = None) -> Iterator[None]:
    """While jobs run in here, ``rows`` rows go to a worker at a time and ``decoded`` are read from Parquet, for rows that are large.

    Each task holds a batch outside the heap, in buffers of up to twice its size that the executor keeps, and once more in its worker.
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.parquet.columnarReaderBatchSize": decoded}
    before = {name: spark.conf.get(name) for name, n in wanted.items() if n}
    for name in before:
        spark.conf.set(name, str(wanted[name]))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def texts(batch: pa.RecordBatch, column: str) -> Iterator[memoryview]:
    """UTF-8 bytes of each row without a copy; NULL gives no bytes."""
    for value in batch.column(batch.schema.get_field_index(column)):
        yield memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")


def extended(schema: StructType, added: dict[str, DataType]) -> StructType:
    """The schema with further columns; columns of the same name make room."""
    return StructType([f for f in schema.fields if f.name not in added] + [StructField(n, t) for n, t in added.items()])


def append(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns; columns of the same name make room."""
    names = [n for n in batch.schema.names if n not in added]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + list(added.values()), names=names + list(added))
