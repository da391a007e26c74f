"""Scores over verdicts, audits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrosieve.functions import scalars as S


def context_precision(verdicts: DataFrame, query: str = "query_id", rank: str = "rank", verdict: str = "verdict") -> DataFrame:
    """Mean of precision at k over the relevant places of a ranking; null where nothing is relevant."""
    to_here = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    at_k = verdicts.withColumn("p", F.sum(verdict).over(to_here) / F.count("*").over(to_here))
    return at_k.groupBy(query).agg(F.try_divide(F.sum(F.col("p") * F.col(verdict)), F.nullif(F.sum(verdict), F.lit(0))).alias("context_precision"))


def share(verdicts: DataFrame, name: str, query: str = "query_id", verdict: str = "verdict") -> DataFrame:
    """Share of positive verdicts: faithfulness over statements, context recall over sentences of the truth."""
    return verdicts.groupBy(query).agg(F.avg(F.col(verdict).cast("double")).alias(name))


def answer_relevancy(pairs: DataFrame, query: str = "query_id", a: str = "question_vector", b: str = "generated_vector") -> DataFrame:
    """Mean cosine between a question and the questions that its answer suggests."""
    return pairs.groupBy(query).agg(F.avg(1 - S.cosine_distance(F.col(a), F.col(b))).alias("answer_relevancy"))


def target_hit(hits: DataFrame, target: Column) -> DataFrame:
    """Whether the target document is among the documents of a query's hits."""
    return hits.groupBy("query_id").agg(F.max((F.col("parent_id") == target).cast("int")).cast("boolean").alias("target_retrieved"))


def finding_count(findings: Column) -> Column:
    return F.size(F.coalesce(findings, F.array()))


def ingestion_stats(fetched: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents fetched (before any join) and chunks added."""
    return fetched.agg(F.count("*").alias("fetched")).crossJoin(chunks.agg(F.count("*").alias("chunks_added")))


def audit(docs: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """What ingestion got out of each document."""
    patent = S.is_patent(F.col("source"))
    claims = S.joined(F.col("independent_claims"), "\n")
    rows = docs.join(chunk_counts.withColumnRenamed("parent_id", "id"), "id", "left")
    return rows.select(
        "source", F.col("id").alias("doc_id"), "title", "published_date", F.coalesce(F.length("full_text"), F.lit(0)).alias("full_text_chars"),
        S.full_text_success(F.col("source"), F.length("full_text")).alias("full_text_success"), S.valid_abstract(F.col("abstract")).alias("abstract_extracted"),
        S.joined(F.col("affiliated_institutions")).alias("affiliated_institutions"),
        F.when(patent, S.joined(F.col("patent_classifications"))).otherwise(F.lit("N/A (Paper)")).alias("patent_classifications"),
        F.when(patent, F.when(F.length(claims) > 20, "True").otherwise("False")).otherwise(F.lit("N/A (Paper)")).alias("independent_claims_extracted"),
        F.coalesce("num_chunks", F.lit(0)).cast("int").alias("num_chunks"),
    )


def audit_summary(audits: DataFrame, *keys: str) -> DataFrame:
    """Means and rates of an audit by keys; repeated audit rows count once."""
    once = audits.dropDuplicates()
    return once.groupBy(*keys).agg(
        F.count("*").alias("documents"), F.avg("num_chunks").alias("mean_chunks"), S.percent(F.col("full_text_success")).alias("full_text_rate"),
        S.percent(F.col("abstract_extracted")).alias("abstract_rate"),
    )


def existing_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select([c for c in wanted if c in df.columns])


def report_rows(summary: DataFrame, key: str) -> DataFrame:
    """Lines of a Markdown table out of ``audit_summary``."""
    line = F.format_string("| %s | %d | %.1f | %.1f%% | %.1f%% |", F.coalesce(F.col(key), F.lit("-")), F.col("documents"), F.col("mean_chunks"), F.col("full_text_rate"), F.col("abstract_rate"))
    return summary.select(F.coalesce(F.col(key), F.lit("-")).alias(key), line.alias("line"))
