"""Section-aware chunks of standardized documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from ferrosieve.config import DEFAULT, EngineConfig
from ferrosieve.functions import headings as H
from ferrosieve.functions.sanitize import sanitize

_PIECES = "array<struct<section:string,body:string>>"


def pieces_of(text: str | None, source: str | None, config: EngineConfig = DEFAULT) -> list[tuple[str, str]]:
    """(section, piece) of a text in order."""
    clean = sanitize(text, source)
    sections = H.split_sections(clean, config.block_join) or ([(H.GENERAL, clean.strip())] if clean.strip() else [])
    sections = H.coalesce(H.qualify(sections), config.section_minimum)
    return [(name, piece) for name, body in sections for piece in H.split_body(body, config)]


def _pieces(config: EngineConfig) -> Column:
    kind = pa.list_(pa.struct([("section", pa.string()), ("body", pa.string())]))

    def run(text: pa.Array, source: pa.Array) -> pa.Array:
        rows = [[{"section": s, "body": b} for s, b in pieces_of(t, k, config)] for t, k in zip(text.to_pylist(), source.to_pylist())]
        return pa.array(rows, type=kind)

    return F.arrow_udf(run, _PIECES, ArrowUDFType.SCALAR)


def chunk(docs: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks of ``docs`` (id, text, metadata): id, parent_id, text with its header, metadata with place. Narrow.

    A null or empty text gives no chunk. Numbers run through all sections of a document from 0.
    """
    cut = docs.select("id", "metadata", F.posexplode(_pieces(config)("text", "metadata.source")).alias("chunk_index", "piece"))
    default = lambda c, d: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(d))
    text = F.concat(
        F.lit("Document Title: "), default("metadata.title", "Unknown Title"), F.lit("\nPublication Date: "), default("metadata.published_date", "Unknown Date"),
        F.lit("\nSection: "), F.col("piece.section"), F.lit("\n---\n"), F.col("piece.body"),
    )
    fields = [F.col(f"metadata.{f.name}") for f in docs.schema["metadata"].dataType.fields]
    meta = F.struct(*fields, F.col("id").alias("parent_id"), F.col("piece.section").alias("section"), F.col("chunk_index"))
    return cut.select(F.concat("id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("id"), F.col("id").alias("parent_id"), text.alias("text"), meta.alias("metadata"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("parent_id").agg(F.count("*").alias("num_chunks"))


def chunk_listing(chunks: DataFrame) -> DataFrame:
    """``parent_id`` and ``listing``: all chunks of a document in order, each under a line with its number and length."""
    banner = F.concat(F.lit("=== Chunk "), F.col("metadata.chunk_index").cast("string"), F.lit(" ("), F.length("text").cast("string"), F.lit(" chars) ===\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("metadata.chunk_index").alias("i"), banner.alias("b"))))
    listed = chunks.groupBy("parent_id").agg(ordered.alias("parts"), F.first("metadata.title").alias("title"))
    return listed.select("parent_id", F.concat(F.lit("Document: "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.array_join(F.transform("parts", lambda x: x["b"]), "\n\n")).alias("listing"))
