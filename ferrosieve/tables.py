"""Reading test tables, and cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores where its files are fewer than the cores; larger inputs stay as they are read.

    Stages that spend their time in Python on few small files would otherwise run in a task or two.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent (tests, single machine) a private temporary folder is made once and
    removed when the driver ends. On a cluster the setting is required, since a machine-local folder
    would not survive the loss of an executor.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "at" not in _OWN_DIR:
        _OWN_DIR["at"] = tempfile.mkdtemp(prefix="ferrosieve-")
        atexit.register(shutil.rmtree, _OWN_DIR["at"], ignore_errors=True)
    return "file://" + _OWN_DIR["at"]


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    """The file system removes the table when the driver's JVM ends; until then results may read it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that is new and removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


@contextmanager
def short_plans(spark: SparkSession, characters: int = 2000) -> Iterator[None]:
    """Keep the driver from storing long descriptions of plans: it holds those of the last thousand jobs, which adds up in a run of many loads."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, str(characters))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM free the broadcasts and plans of finished steps.

    A driver that runs batch after batch would otherwise let its heap grow to the limit before it collects them.
    """
    spark.sparkContext._jvm.System.gc()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: whatever is built on the result restarts from the files, also after the
    loss of an executor, and the plan before it is computed once.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """``settle``, with ``rows`` and other aggregates that are gathered while the table is written."""
    seen = Observation()
    out = settle(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in figures.items()]), name)
    return out, seen.get


def delete(spark: SparkSession, *folders: str) -> None:
    """Delete folders, also where they are not there."""
    for folder in folders:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete the folder of a settled table that nothing will read again; a run of many steps would else hold all of them until its end."""
    delete(df.sparkSession, *{f.rpartition("/")[0] for f in df.inputFiles()})
