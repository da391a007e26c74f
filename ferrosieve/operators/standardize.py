"""Standardizing documents: missing fields are filled from the full text, and the text gets its common frame."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from ferrosieve.config import DEFAULT, PAPER_SOURCES, UNKNOWN, UPLOADED_AUTHORS, EngineConfig
from ferrosieve.functions import metadata as M
from ferrosieve.functions import scalars as S
from ferrosieve.functions.headings import mark_headings
from ferrosieve.schemas import EXTRACTED_PATENT

_FOUND = f"struct<abstract:string,affiliations:array<string>,patent:{EXTRACTED_PATENT.simpleString()}>"


def _scan(config: EngineConfig) -> Column:
    """One Arrow UDF over what a text has to give; each scanner runs only where its result is wanted."""
    kind = pa.struct([("abstract", pa.string()), ("affiliations", pa.list_(pa.string())), ("patent", pa.struct([
        ("publication_number", pa.string()), ("title", pa.string()), ("affiliated_institutions", pa.list_(pa.string())), ("priority_or_grant_date", pa.string()),
        ("patent_classifications", pa.list_(pa.string())), ("independent_claims", pa.list_(pa.string()))]))])

    def run(text: pa.Array, title: pa.Array, abstract: pa.Array, patent: pa.Array, paper: pa.Array) -> pa.Array:
        rows = []
        for t, n, a, p, q in zip(text.to_pylist(), title.to_pylist(), abstract.to_pylist(), patent.to_pylist(), paper.to_pylist()):
            rows.append({
                "abstract": M.extract_abstract(t, n, config) if a else None,
                "affiliations": M.paper_affiliations(t, config) if q else None,
                "patent": M.patent_metadata(t, config) if p else None,
            })
        return pa.array(rows, type=kind)

    return F.arrow_udf(run, _FOUND, ArrowUDFType.SCALAR)


def _full(c: Column) -> Column:
    """The list where it holds anything, else null."""
    return F.when(F.size(c) > 0, c)


def standardize(docs: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``id``, ``text`` and ``metadata`` of every document; one narrow select.

    Only fields that are missing or hold a placeholder are filled. Documents without full text keep their abstract
    as text. Null fields give empty strings, lists are joined.
    """
    has_text = F.coalesce(F.col("full_text"), F.lit("")) != ""
    patent = S.is_patent(F.col("source"))
    paper = F.col("source").isin(*PAPER_SOURCES)
    uploaded = F.col("authors") == F.array(*[F.lit(a) for a in UPLOADED_AUTHORS])
    wants_abstract = has_text & S.missing_abstract(F.col("abstract"))
    wants_affiliations = has_text & paper & (F.coalesce(F.size("affiliated_institutions"), F.lit(0)) <= 0)
    scanned = docs.withColumn("_f", _scan(config)(F.when(has_text, F.col("full_text")), "title", wants_abstract, has_text & patent, wants_affiliations))

    p = lambda name: F.when(patent, F.col(f"_f.patent.{name}"))
    abstract = F.coalesce(F.col("_f.abstract"), F.col("abstract"))
    title_free = F.coalesce(uploaded, F.lit(False)) | (F.coalesce(F.col("title"), F.lit("")) == "") | F.col("title").isin("Untitled Patent", UNKNOWN)
    institutions = F.coalesce(_full(F.col("affiliated_institutions")), _full(p("affiliated_institutions")), _full(F.col("_f.affiliations")))
    date = F.coalesce(F.when(F.col("priority_or_grant_date") != "", F.col("priority_or_grant_date")), F.when(p("priority_or_grant_date") != UNKNOWN, p("priority_or_grant_date")))
    number = F.coalesce(
        F.when(F.col("publication_number") != "", F.col("publication_number")), p("publication_number"),
        F.when(paper & has_text, S.extract_doi(F.col("full_text"), config.abstract_search)), F.when((F.col("source") == "arxiv") & has_text, F.col("id")),
    )
    no_date = F.col("published_date").isNull() | F.col("published_date").isin("", UNKNOWN)
    full = scanned.select(
        "id", "source", "pdf_url", "full_text", has_text.alias("_has_text"), abstract.alias("abstract"),
        F.when(patent & title_free, F.coalesce(p("title"), F.col("title"))).otherwise(F.col("title")).alias("title"),
        F.when(patent & uploaded & institutions.isNotNull(), institutions).otherwise(F.col("authors")).alias("authors"),
        F.when(patent & no_date, F.coalesce(date, F.col("published_date"))).otherwise(F.col("published_date")).alias("published_date"),
        number.alias("publication_number"), institutions.alias("affiliated_institutions"),
        F.coalesce(_full(F.col("patent_classifications")), _full(p("patent_classifications"))).alias("patent_classifications"),
        date.alias("priority_or_grant_date"), F.coalesce(_full(F.col("independent_claims")), _full(p("independent_claims"))).alias("independent_claims"),
    )
    shown = lambda name: F.coalesce(F.col(name), F.lit(""))
    head = F.concat(F.lit("# Abstract\n"), shown("abstract"))
    framed = F.concat(F.lit("Full Text:\n"), F.col("full_text"))
    body = F.when(~F.col("_has_text"), head).when(S.valid_abstract(F.col("abstract")), F.concat(head, F.lit("\n\n"), framed)).otherwise(framed)
    text = F.concat(F.lit("Title: "), shown("title"), F.lit("\nAuthors: "), S.joined(F.col("authors"), ", "), F.lit("\nPublished Date: "), shown("published_date"), F.lit("\n\n"), body)
    meta = F.struct(
        shown("source").alias("source"), shown("title").alias("title"), shown("abstract").alias("abstract"), shown("published_date").alias("published_date"), F.col("pdf_url"),
        shown("publication_number").alias("publication_number"), S.joined(F.col("affiliated_institutions")).alias("affiliated_institutions"),
        S.joined(F.col("patent_classifications")).alias("patent_classifications"), shown("priority_or_grant_date").alias("priority_or_grant_date"),
        S.joined(F.col("independent_claims"), "\n").alias("independent_claims"),
    )
    return full.select("id", text.alias("text"), meta.alias("metadata"))


def with_headings(texts: Column) -> Column:
    """Arrow UDF over ``mark_headings``."""

    def run(text: pa.Array) -> pa.Array:
        return pa.array([mark_headings(t) for t in text.to_pylist()], pa.string())

    return F.arrow_udf(run, "string", ArrowUDFType.SCALAR)(texts)


def bibliographic(docs: DataFrame, text_col: str = "full_text", id_col: str = "id", config: EngineConfig = DEFAULT) -> DataFrame:
    """``id`` and the struct of bibliographic data of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [M.patent_metadata(t, config) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(x or {}).get("publication_number") for x in found], pa.string()), pa.array([(x or {}).get("priority_or_grant_date") for x in found], pa.string()), pa.array([(x or {}).get("independent_claims") or [] for x in found], pa.list_(pa.string()))], names=["id", "publication_number", "priority_or_grant_date", "independent_claims"])

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, "id string, publication_number string, priority_or_grant_date string, independent_claims array<string>")
