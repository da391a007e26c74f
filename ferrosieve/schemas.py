"""Schemas of the tables that pass between the stages."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _SS = T.StringType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DOCUMENT = T.StructType(
    [T.StructField("source", _S, False), T.StructField("id", _S, False)]
    + _struct(
        title=_S, authors=_SS, abstract=_S, published_date=_S, pdf_url=_S, local_path=_S, full_text=_S, publication_number=_S,
        affiliated_institutions=_SS, patent_classifications=_SS, priority_or_grant_date=_S, independent_claims=_SS,
    ).fields
)

METADATA_FIELDS = (
    "source", "title", "abstract", "published_date", "pdf_url", "publication_number", "affiliated_institutions",
    "patent_classifications", "priority_or_grant_date", "independent_claims",
)
METADATA = _struct(**dict.fromkeys(METADATA_FIELDS, _S))
STANDARD_DOC = _struct(id=_S, text=_S, metadata=METADATA)
CHUNK_METADATA = T.StructType(METADATA.fields + _struct(parent_id=_S, section=_S, chunk_index=T.IntegerType()).fields)
CHUNK = _struct(id=_S, parent_id=_S, text=_S, metadata=CHUNK_METADATA)
SECTION = _struct(section=_S, body=_S)

FINDING_LISTS = (
    "target_use_cases", "core_technologies_and_buzzwords", "sensor_types", "simulation_tools_or_solvers", "hardware_target_or_deployment_platform",
    "weather_and_environmental_parameters", "tested_scenarios", "evaluated_kpis", "operational_constraints_or_assumptions",
)
FINDING = _struct(technology_or_algorithm_name=_S, **dict.fromkeys(FINDING_LISTS, _SS))
PATENT_METADATA = _struct(patent_classifications=_SS, priority_or_grant_date=_S, independent_claims_scope=_SS)
EXTRACTION = _struct(
    source_document_id=_S, document_title=_S, document_abstract=_S, affiliated_companies_or_institutions=_SS, summary_of_technical_relevance=_S,
    key_claims_or_methodologies=_SS, perception_findings=T.ArrayType(FINDING), patent_metadata=PATENT_METADATA,
)
EXTRACTED_PATENT = _struct(
    publication_number=_S, title=_S, affiliated_institutions=_SS, priority_or_grant_date=_S, patent_classifications=_SS, independent_claims=_SS
)
CHECKPOINT = _struct(question=_S, answer=_S, contexts=_SS, ground_truth=_S)
QUESTIONS = _struct(question=_S, ground_truth=_S)
AUDIT = _struct(
    domain=_S, source=_S, doc_id=_S, title=_S, published_date=_S, full_text_chars=T.IntegerType(), full_text_success=T.BooleanType(),
    abstract_extracted=T.BooleanType(), affiliated_institutions=_S, patent_classifications=_S, independent_claims_extracted=_S, num_chunks=T.IntegerType(),
)
PAGE_BLOCK = _struct(
    page=T.IntegerType(), x0=T.DoubleType(), y0=T.DoubleType(), x1=T.DoubleType(), y1=T.DoubleType(), text=_S, block_no=T.IntegerType(), block_type=T.IntegerType()
)
