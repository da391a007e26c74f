"""State that lasts from batch to batch: bucketed runs of rows, named by numbered manifests.

A ``Versions`` folder holds ``manifest-<number>.json`` files; the newest is the state. A manifest is
written aside and renamed, after all data it names are complete, so a reader sees the old state or the new
one, and a crash before the rename leaves the old one with some files that nothing names.
One writer at a time is assumed; a second one is refused when its number is taken.

A ``Run`` is a Parquet folder with one sub-folder a bucket. Readers name the buckets they need, so others are
neither listed nor opened.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_NAME = "manifest-{:012d}.json"


class Versions:
    """Numbered manifests in a folder of any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, below: str = "") -> list[str]:
        """Names in a sub-folder; none where it is absent."""
        at = self._path(below)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[9:21]) for n in self.names() if n.startswith("manifest-") and n.endswith(".json"))

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(_NAME.format(number)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict | None]:
        """Number and content of the newest manifest; (0, None) where none is."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def publish(self, number: int, state: dict) -> None:
        aside = self._path(f".{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        at = self._path(_NAME.format(number))
        if self._fs.exists(at) or not self._fs.rename(aside, at):
            self._fs.delete(aside, False)
            raise RuntimeError(f"another writer has published manifest {number} of {self.folder}")

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Run:
    """One written table: its folder, number of rows, number of buckets, and the buckets that hold rows."""

    name: str
    rows: int
    of: int
    buckets: tuple[int, ...]

    @staticmethod
    def load(state: dict) -> Run:
        return Run(state["name"], state["rows"], state["of"], tuple(state["buckets"]))

    def save(self) -> dict:
        return asdict(self)


def write_run(versions: Versions, df: DataFrame, kind: str, bucket: Column, of: int, order: str, tasks: int | None = None) -> Run:
    """Write ``df`` by buckets, in ``tasks`` (else ``of``) ranges of (bucket, ``order``), so that a full bucket is split among tasks.

    ``of`` tells how the bucket was computed, in most cases its number of values.
    """
    tasks = tasks or of
    name, seen = f"{kind}-{uuid.uuid4().hex}", Observation()
    rows = df.withColumn("bucket", bucket.cast("int"))
    rows = rows.coalesce(1) if tasks == 1 else rows.repartitionByRange(tasks, "bucket", order)
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy("bucket").parquet(f"{versions.folder}/{name}")
    found = sorted(int(n[7:]) for n in versions.names(name) if n.startswith("bucket="))
    return Run(name, seen.get["rows"], of, tuple(found))


def read_runs(versions: Versions, schema: str, runs: list[Run], touched: dict[int, set[int]] | None = None) -> DataFrame:
    """Rows of the runs; ``touched`` gives, by number of buckets, those that are needed."""
    spark = versions.spark
    paths = [f"{versions.folder}/{r.name}/bucket={b}" for r in runs for b in r.buckets if touched is None or b in touched[r.of]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def touched_buckets(rows: DataFrame, runs: list[Run], bucket_of) -> dict[int, set[int]]:
    """By number of buckets, the buckets that any of ``rows`` falls into; at most that many numbers reach the driver."""
    sizes = sorted({r.of for r in runs})
    out = {n: {0} for n in sizes if n == 1}
    larger = [n for n in sizes if n > 1]
    if larger:
        each = reduce(DataFrame.union, [rows.select(F.lit(n).alias("of"), bucket_of(n).cast("int").alias("b")) for n in larger]).distinct()
        for n in larger:
            out[n] = set()
        for r in each.collect():
            out[r.of].add(r.b)
    return out
