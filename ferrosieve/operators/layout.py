"""Reading order of blocks on two-column pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reading_order(blocks: DataFrame, page: str = "page", width: float = 612.0) -> DataFrame:
    """Text blocks with ``band``, ``side`` and ``position`` on their page.

    A block across the middle parts a page into bands; within a band the left column comes before the right, each from
    top to bottom. Blocks arrive in order of ``block_no``; only text blocks with letters count.
    """
    text = blocks.where((F.col("block_type") == 0) & F.col("text").rlike(r"\S"))
    across = (F.col("x0") < 0.45 * width) & (F.col("x1") > 0.55 * width)
    arrival = Window.partitionBy(page).orderBy("block_no")
    parted = text.withColumn("spans", across.cast("int"))
    # a spanning block is a band of its own; those after it start the next one
    before = F.coalesce(F.sum("spans").over(arrival.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parted = parted.withColumn("band", 2 * before + F.col("spans")).withColumn("side", F.when((F.col("spans") == 1) | ((F.col("x0") + F.col("x1")) / 2 < 0.5 * width), 0).otherwise(1))
    order = Window.partitionBy(page).orderBy("band", "side", F.round("y0", 1), "x0", "block_no")
    return parted.withColumn("position", F.row_number().over(order)).drop("spans")


def page_text(blocks: DataFrame, page: str = "page", width: float = 612.0) -> DataFrame:
    """``page`` and ``text``: the blocks of a page in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    return reading_order(blocks, page, width).groupBy(page).agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text"))
