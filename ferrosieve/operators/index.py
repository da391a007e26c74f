"""A vector index as a Parquet table of chunks in buckets of documents, partitioned by source."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrosieve.schemas import CHUNK_METADATA
from ferrosieve.store import Versions


def merge(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of ``existing`` with the same key; others are added."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def sanitized(metadata: str, schema: T.StructType) -> Column:
    """A metadata struct with scalars only: nulls become empty strings, nested values JSON."""

    def field(f: T.StructField) -> Column:
        c = F.col(f"{metadata}.{f.name}")
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(c, F.lit(""))
        return F.coalesce(F.to_json(c), F.lit("")) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else c

    return F.struct(*[field(f).alias(f.name) for f in schema.fields])


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce("parent_id", "id")), F.lit(buckets)).cast("int")


class VectorIndex:
    """Open, upsert, reset, count.

    Chunks lie in buckets of their document; an upsert reads and rewrites the buckets of the documents that it brings, no others, and
    names them in a numbered manifest, which is published by one rename: readers see the old state or the new one, also after
    a crash in between. An id belongs to one document.
    """

    SCHEMA = T.StructType(
        [T.StructField("id", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("metadata", CHUNK_METADATA)]
        + [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("source", T.StringType())]
    )

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, self.path)
        self.new_buckets = buckets

    def _state(self) -> tuple[int, dict]:
        number, state = self.versions.newest()
        return number, state or {"buckets": self.new_buckets, "owner": {}, "schema": None, "old": []}

    def _rows(self, state: dict, buckets: set[int] | None = None) -> DataFrame:
        """Rows of some buckets, else of all; the folders of others are not listed."""
        schema = T.StructType.fromJson(state["schema"]) if state["schema"] else self.SCHEMA
        paths = [f"{self.path}/segment={seg}/bucket={b}" for b, seg in sorted(state["owner"].items()) if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths).select(*schema.names)

    def read(self) -> DataFrame:
        """All records; an empty table where nothing was written yet."""
        return self._rows(self._state()[1])

    def _publish(self, number: int, state: dict, rows: DataFrame, touched: set[int], owner: dict[str, str]) -> None:
        segment = uuid.uuid4().hex
        rows.withColumn("bucket", bucket_of(state["buckets"])).write.partitionBy("bucket", "source").parquet(f"{self.path}/segment={segment}")
        held = {n[7:] for n in self.versions.names(f"segment={segment}") if n.startswith("bucket=")}
        owner = {b: s for b, s in owner.items() if int(b) not in touched} | dict.fromkeys(held, segment)
        gone = sorted(set(state["owner"].values()) - set(owner.values()))
        self.versions.publish(number + 1, {"buckets": state["buckets"], "owner": owner, "schema": json.loads(rows.schema.json()), "old": gone})
        for name in state["old"]:  # superseded one version ago
            self.versions.drop(f"segment={name}")

    def upsert(self, records: DataFrame, replace_parents: bool = False) -> None:
        """Last write wins by id; equal ids within one batch are refused.

        With ``replace_parents`` every earlier chunk of a document goes when the document comes again.
        """
        number, state = self._state()
        touched = {r.b for r in records.select(bucket_of(state["buckets"]).alias("b")).distinct().collect()}  # at most `buckets` numbers
        if not touched:
            return
        twice = records.groupBy("id").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"id {twice[0].id!r} comes more than once in a batch")
        if "source" not in records.columns:
            records = records.withColumn("source", F.coalesce("metadata.source", F.lit("")))
        old = self._rows(state, touched)
        self._publish(number, state, merge(old, records, "parent_id") if replace_parents else merge(old, records), touched, state["owner"])

    def reset(self) -> None:
        number, state = self._state()
        self.versions.publish(number + 1, {**state, "owner": {}, "old": sorted(set(state["owner"].values()))})

    def count(self) -> int:
        return self.read().count()
