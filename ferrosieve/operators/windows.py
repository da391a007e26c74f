"""Ordered groups: values carried forward, flags that stay set, lists in order, spellings of one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _so_far(group: str, order: list[str]) -> WindowSpec:
    return Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def carry_forward(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the last value that was not null up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_so_far(group, order)))


def stays_set(df: DataFrame, group: str, order: list[str], flag: Column, name: str) -> DataFrame:
    """``df`` with 1 from the first row of a group on that has the flag, 0 before; null flags are unset."""
    return df.withColumn(name, F.max(F.coalesce(flag, F.lit(False)).cast("int")).over(_so_far(group, order)))


def joined_in_order(df: DataFrame, group: str, order: list[str], value: str, separator: str, name: str) -> DataFrame:
    """One row a group with its values, joined in order. A group is one row of the result, so it must fit into one."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return df.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["_value"]), separator).alias(name))


def spellings(names: DataFrame, column: str) -> DataFrame:
    """``key`` (lower case) and the number of different ``spellings``; nulls are no names."""
    return names.where(F.col(column).isNotNull()).select(column).distinct().groupBy(F.lower(column).alias("key")).agg(F.count("*").alias("spellings"))
