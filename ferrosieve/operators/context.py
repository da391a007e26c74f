"""Prompt and context blocks out of ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrosieve.config import DEFAULT, EngineConfig
from ferrosieve.functions import scalars as S

INSTRUCTIONS = (
    "Extract technical entities from the context below.\n\nRULES:\n"
    "1. State only what the context supports.\n"
    "2. Take id, title, abstract and institutions of the document that answers the query from its header.\n"
    "3. Read every block before filling the lists of a finding; shared tools and platforms belong to each finding they serve.\n"
    '4. A list that no block mentions is ["None"].\n'
    "5. A paper has no patent metadata.\n"
    "6. A patent lists all its independent claims with their numbers.\n"
)


def normalise_hits(hits: DataFrame) -> DataFrame:
    """Hits with ``parent_id`` and ``pub_no`` at the top level; delivered twice they count once."""
    once = hits.dropDuplicates(["query_id", "hit_rank", "id"])
    parent = S.parent_id(F.col("metadata.parent_id"), F.col("id"))
    return once.withColumn("parent_id", parent).withColumn("pub_no", S.publication_number(F.col("metadata.publication_number"), parent))


def first_of_parent(hits: DataFrame, order: str = "hit_rank") -> DataFrame:
    """``is_first`` marks the best hit of each document in each query, ``ordinal`` counts the hits from 1."""
    per_query = Window.partitionBy("query_id").orderBy(order, "id")
    per_parent = Window.partitionBy("query_id", "parent_id").orderBy(order, "id")
    return hits.withColumn("ordinal", F.row_number().over(per_query)).withColumn("is_first", F.row_number().over(per_parent) == 1)


def _line(label: str, value: Column, when: Column) -> Column:
    return F.when(when & (F.coalesce(value, F.lit("")) != ""), F.concat(F.lit(label), value))


def _field(hits: DataFrame, name: str) -> Column:
    known = {f.name for f in hits.schema["metadata"].dataType.fields}
    return F.col(f"metadata.{name}") if name in known else F.lit(None).cast("string")


def _document_lines(hits: DataFrame) -> list[Column]:
    first = F.col("is_first")
    patent = first & S.is_patent(_field(hits, "source"))
    abstract = _field(hits, "abstract")
    return [
        _line("Affiliated Institutions / Assignee: ", _field(hits, "affiliated_institutions"), first),
        _line("Document Abstract: ", F.when(abstract != "N/A", abstract), first),
        _line("Patent Classifications (IPC/CPC): ", _field(hits, "patent_classifications"), patent),
        _line("Patent Priority / Grant Date: ", _field(hits, "priority_or_grant_date"), patent),
        _line("Independent Claims Scope:\n", _field(hits, "independent_claims"), patent),
    ]


def prompt_blocks(hits: DataFrame) -> DataFrame:
    """Hits with ``block``: ordinal, id, title in each; facts of the document in its first block of a query."""
    marked = first_of_parent(hits)
    head = [
        F.concat(F.lit("--- [Context Chunk "), F.col("ordinal").cast("string"), F.lit("] ---")), F.concat(F.lit("Source ID: "), "pub_no"),
        F.concat(F.lit("Document Title: "), F.coalesce(_field(hits, "title"), F.lit("N/A"))),
    ]
    body = F.concat(F.lit("Content:\n"), F.coalesce("text", F.lit("")))
    return marked.withColumn("block", F.concat_ws("\n", *head, *_document_lines(hits), body))


def evaluation_blocks(hits: DataFrame) -> DataFrame:
    """Hits with ``block`` as the judges read it: without ordinal and title."""
    marked = first_of_parent(hits)
    return marked.withColumn("block", F.concat_ws("\n", F.concat(F.lit("Source ID: "), "pub_no"), *_document_lines(hits), F.coalesce("text", F.lit(""))))


def assemble(blocks: DataFrame, name: str = "context") -> DataFrame:
    """The blocks of each query in order as one text. A query has as many blocks as hits, a bounded number."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "block")))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias(name))


def prompts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """``query_id`` and ``prompt`` for questions (query_id, question)."""
    context = assemble(prompt_blocks(hits))
    text = F.concat(F.lit(INSTRUCTIONS), F.lit("\nUser Query:\n"), F.coalesce("question", F.lit("")), F.lit("\n\nContext:\n"), F.coalesce("context", F.lit("")), F.lit("\n"))
    return questions.join(context, "query_id", "left").select("query_id", text.alias("prompt"))


def capped_contexts(hits: DataFrame, primary: Column, config: EngineConfig = DEFAULT) -> DataFrame:
    """At most ``context_limit`` hits a query, those of the primary document first, texts cut to head and tail; ``pos`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.when(primary, 0).otherwise(1), "hit_rank", "id")
    kept = hits.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= config.context_limit)
    return kept.withColumn("context", S.truncate_context(F.col("text"), config.context_chars, config.context_keep))
