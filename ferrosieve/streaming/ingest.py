"""Extension: documents that keep arriving in a folder, ingested by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ferrosieve.config import DEFAULT, EngineConfig
from ferrosieve.operators.index import VectorIndex
from ferrosieve.plans.pipeline import prepare


def document_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_ingest(docs: DataFrame, index: VectorIndex, checkpoint: str, time_col: str = "ingested_at", late: str = "30 days", config: EngineConfig = DEFAULT) -> StreamingQuery:
    """Each document once within the watermark; each micro-batch is upserted as a snapshot, so a repeated batch changes nothing."""
    fresh = docs.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).dropDuplicatesWithinWatermark(["id"])

    def write(batch: DataFrame, _: int) -> None:
        index.upsert(prepare(batch.dropDuplicates(["id"]), config), replace_parents=True)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(docs: DataFrame, time_col: str = "ingested_at", late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Documents per source and time window; runs on streams and tables alike."""
    if docs.isStreaming:  # watermarks need instants
        docs = docs.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return docs.withWatermark(time_col, late).groupBy(F.window(time_col, width), "source").agg(F.count("*").alias("documents")).select(F.col("window.start").alias("start"), "source", "documents")
