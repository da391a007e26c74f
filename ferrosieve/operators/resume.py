"""Joins that let a stage go on where it stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrosieve.functions.scalars import usable_question
from ferrosieve.tables import settle


def new_documents(fetched: DataFrame, ingested: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Fetched rows whose key is not ingested yet, the first of each key."""
    first = fetched.groupBy(key).agg(F.min(order).alias(order))
    return fetched.join(first, [key, order]).join(ingested.select(key).distinct(), key, "left_anti")


def pending_questions(questions: DataFrame, done: DataFrame, distinct: bool = False) -> DataFrame:
    """Usable questions that no checkpoint holds; repeated questions stay unless ``distinct``."""
    asked = questions.where(usable_question(F.col("question")))
    left = asked.join(done.select("question").distinct(), "question", "left_anti")
    return left.dropDuplicates(["question"]) if distinct else left


def fully_scored(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def scored_and_open(generated: DataFrame, scores: DataFrame, key: str, a: str, b: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores that are complete for generated rows, and generated rows still to score with what they have so far.

    Of several rows with a key the last one by ``order`` wins, for each score by itself; without an order the largest score.
    """
    of = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order or c))).alias(c)
    scores = scores.groupBy(key).agg(of(a), of(b))
    complete = scores.where(fully_scored(F.col(a), F.col(b)))
    done = complete.join(generated.select(key).distinct(), key, "left_semi")
    return done, generated.join(complete.select(key), key, "left_anti").join(scores, key, "left")


def keyed_merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two score tables side by side, by key."""
    return left.join(right, key, "left")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with the place of each row in a total order, from 1.

    Rows are range-partitioned by the order and numbered within their partition; the offsets are counts of
    partitions, of which there are few. No partition sees all rows.
    """
    parted = settle(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = parted.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))  # a row per partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parted.withColumn("_local", local).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_local") + F.col("_offset")).drop("_part", "_local", "_offset")


def zip_merge(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Two tables side by side by position, as positional tools do; use ``keyed_merge`` where there is a key."""
    return numbered(left, left_order, "_n").join(numbered(right, right_order, "_n"), "_n").drop("_n")


def lookup(df: DataFrame, key: str, table: dict[str, str], name: str, default: Column) -> DataFrame:
    """A value from a small fixed table, or the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return df.withColumn(name, F.coalesce(F.try_element_at(pairs, F.col(key)), default))


def known_only(rows: DataFrame, known: DataFrame, key: str, known_key: str) -> DataFrame:
    """Rows whose key another table holds; repeated keys there do not repeat a row."""
    return rows.join(known.select(F.col(known_key).alias(key)), key, "left_semi")


def first_copies(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """The smallest id of each distinct text and its number of ``copies``; null texts are left out.

    Grouped by a digest: the shuffle moves 32 bytes a row instead of the text.
    """
    keyed = df.where(F.col(text).isNotNull()).select(id_col, F.sha2(text, 256).alias("_key"))
    return keyed.groupBy("_key").agg(F.min(id_col).alias(id_col), F.count("*").alias("copies")).drop("_key")
