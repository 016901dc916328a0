"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import pathlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_local_base: str | None = None
_shipped: set[str] = set()


def build_session(app: str = "relish", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # one thread per Python worker: Spark already runs a worker per core
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once a session.

    Functions are pickled by name, so a worker has to import the package wherever the driver was started.  The
    archive lies with the driver, which serves it to the executors; it goes when the driver ends.
    """
    if spark.sparkContext.applicationId not in _shipped:
        package = pathlib.Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="relish-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = f"{folder}/{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for module in sorted(package.rglob("*.py")):
                out.write(module, module.relative_to(package.parent))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(spark.sparkContext.applicationId)
    return spark


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package on the workers of whichever session it is given."""
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(ship(spark), sf_dir)
    return run


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="relish-")
        base = _local_base
    return f"{base.rstrip('/')}/relish/{uuid.uuid4().hex}/{label}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no plan reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Files of the shuffles of a job begun here go as soon as it is done, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, label: str, *by: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder, in a folder for each value of ``by``, and where it lies."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, label)
    with _shuffles_removed(spark):
        df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a committed table, so a lost executor costs one task and not
    the whole history, and later passes read only the columns they need. Its shuffles are not kept.
    """
    return stored(df, label)[0]
