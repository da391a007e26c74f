"""Where results go: folders of Parquet, CSV, JSON and text, and Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrosieve.functions.scalars import safe_id


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Raw documents, checkpoints and scores: rows are only added; stages resume by anti-join."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for reports, which are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_texts(docs: DataFrame, path: str) -> None:
    """Standardized texts as rows (id, text), a file a task: folders of one document each do not scale."""
    docs.select(safe_id(F.col("id")).alias("id"), "text").write.mode("overwrite").parquet(path)


def pretty_json(*columns: str) -> Column:
    """A JSON document of columns with indents; nulls are written."""
    return F.to_json(F.struct(*columns), {"pretty": "true", "ignoreNullFields": "false"})


def markdown_report(title: str, lines: DataFrame, header: str, order: str) -> str:
    """A report with one table; its rows are one per group of a report, a few dozen at most."""
    body = [r.line for r in lines.orderBy(order).limit(1000).collect()]
    rule = "|" + " --- |" * (header.count("|") - 1)
    return "\n".join([f"# {title}", "", header, rule, *body, ""])


def write_bytes(files: DataFrame, path: str) -> None:
    """Fetched files as rows (id, content)."""
    files.select(safe_id(F.col("id")).alias("id"), F.col("content").cast("binary")).write.mode("append").parquet(path)
