"""Local and tabular sources."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import ArrowUDFType

from ferrosieve.functions.headings import mark_headings
from ferrosieve.functions.scalars import normalise_ligatures, title_case
from ferrosieve.schemas import CHECKPOINT, DOCUMENT, QUESTIONS
from ferrosieve.sources.pdf import text_of


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return bool(found)


def mark_pages(text: Column) -> Column:
    """Text of pages with its ligatures spelled out and its headings marked."""
    marked = F.arrow_udf(lambda c: pa.array([mark_headings(x) for x in c.to_pylist()], pa.string()), "string", ArrowUDFType.SCALAR)
    return marked(normalise_ligatures(text))


def title_of(stem: Column) -> Column:
    """A title out of a file name: underscores become spaces, every run of letters starts with a capital."""
    return title_case(F.translate(stem, "_", " "))


def local_documents(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files of ``papers`` and ``patents`` below a folder as documents with their placeholders and, where it can be read, their text."""
    parts = []
    for sub, source in (("papers", "arxiv"), ("patents", "patent")):
        if not exists(spark, f"{folder}/{sub}/*.pdf"):
            continue
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(f"{folder}/{sub}").select("path", text_of(F.col("content")).alias("full_text"))
        stem = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
        parts.append(files.select(F.lit(source).alias("source"), stem.alias("id"), title_of(stem).alias("title"), F.col("path").alias("local_path"), mark_pages(F.col("full_text")).alias("full_text")))
    if not parts:
        return spark.createDataFrame([], DOCUMENT)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.withColumn("authors", F.array(F.lit("Manual Upload"))).withColumn("abstract", F.lit("[No abstract provided. See full text.]")).withColumn("published_date", F.lit("Unknown"))
    have = set(rows.columns)
    return rows.select([F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = QUESTIONS, required: tuple[str, ...] = ("question", "ground_truth")) -> DataFrame:
    """A CSV with a header; required columns must be there, others follow the schema by name."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return raw.select([F.col(f.name).cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_checkpoint(spark: SparkSession, path: str, schema: T.StructType = CHECKPOINT) -> DataFrame:
    """A checkpoint as JSON array, JSON lines or Parquet folder; an empty table where there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if path.endswith(".json"):
        return spark.read.schema(schema).json(path, multiLine=True)
    return spark.read.schema(schema).json(path) if path.endswith(".jsonl") else spark.read.schema(schema).parquet(path)


def newest(docs: DataFrame, time_col: str, id_col: str, n: int) -> DataFrame:
    """The ``n`` newest documents, as a service answers a limited request; ties go by id. Spark keeps n rows a task."""
    return docs.orderBy(F.col(time_col).desc(), id_col).limit(n)


def all_sources(*tables: DataFrame) -> DataFrame:
    """Documents of several sources in one table, by column name; what one lacks is null."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first
