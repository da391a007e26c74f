"""The registered queries of the core, each over its whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrosieve.config import DEFAULT
from ferrosieve.functions import scalars as S
from ferrosieve.operators import chunking, context, evaluate, index, layout, models, resume, retrieve, windows
from ferrosieve.operators import standardize as std
from ferrosieve.plans import pipeline
from ferrosieve.sources import files
from ferrosieve.sources.html import html_parts
from ferrosieve.streaming.ingest import arrivals
from ferrosieve.tables import fresh_path, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = DEFAULT.top_k


def query(sql: str | None = None) -> Callable:
    """Register a function by its name, with the SQL that must give the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(c: object) -> object:
    return F.round(c, 6) + F.lit(0.0)


def _vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


# scans, filters, search


@query("SELECT doc_id, lang, source, coalesce(n_chars, -1) AS n_chars FROM documents")
def scan_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))


@query("SELECT doc_id, coalesce(n_chars, -1) AS n_chars FROM documents WHERE source = 'crawl01'")
def filter_source_eq(spark, d):
    return table(spark, d, "documents").where(retrieve.compile_filter({"source": "crawl01"})).select("doc_id", F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))


@query("SELECT row_id FROM doc_records WHERE (source = 'arxiv' OR source = 'patent') AND batch_no >= 5 AND source <> 'epo_ops'")
def filter_grammar(spark, d):
    where = {"$and": [{"$or": [{"source": "arxiv"}, {"source": {"$in": ["patent"]}}]}, {"batch_no": {"$gte": 5}}, {"source": {"$ne": "epo_ops"}}]}
    return table(spark, d, "doc_records").where(retrieve.compile_filter(where)).select("row_id")


_DIST = "round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) + 0.0"


@query(f"""WITH r AS (SELECT e.vec_id, {_DIST} AS distance, row_number() OVER (ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id)::INT AS rank
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) SELECT * FROM r WHERE rank <= {K}""")
def topk_cosine(spark, d):
    return retrieve.top_k(table(spark, d, "embeddings"), _vector(spark, d), K, id_col="vec_id").withColumn("distance", _round("distance"))


@query(f"""WITH r AS (SELECT e.vec_id, {_DIST} AS distance, row_number() OVER (ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id)::INT AS rank
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 5) SELECT * FROM r WHERE rank <= {K}""")
def topk_cosine_filtered(spark, d):
    return retrieve.top_k(table(spark, d, "embeddings"), _vector(spark, d), K, {"label": 5}, id_col="vec_id").withColumn("distance", _round("distance"))


@query(f"""WITH r AS (SELECT q.vec_id AS query_id, e.vec_id, {_DIST} AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id)::INT AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) SELECT * FROM r WHERE rank <= {K}""")
def topk_cosine_batch(spark, d):
    emb = table(spark, d, "embeddings")
    asked = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieve.top_k_batch(emb, asked, K, id_col="vec_id").withColumn("distance", _round("distance"))


@query(f"""WITH r AS (SELECT e.vec_id, {_DIST} AS distance, row_number() OVER (ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id)::INT AS rank
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 5 AND e.vec_id IN (SELECT doc_id FROM documents))
SELECT r.vec_id AS doc_id, rank, distance, coalesce(length(text), -1) AS chars FROM r JOIN documents ON doc_id = vec_id WHERE rank <= {K}""")
def hits_with_text(spark, d):
    docs = table(spark, d, "documents")
    emb = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    hits = retrieve.top_k(emb, _vector(spark, d), K, {"label": 5}, id_col="doc_id").withColumn("distance", _round("distance"))
    found = retrieve.with_payload(hits, docs, ["text"], "doc_id")
    return found.select("doc_id", "rank", "distance", F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("chars"))


@query("SELECT row_id, id FROM doc_records ORDER BY ingested_at DESC, row_id LIMIT 5")
def source_limit(spark, d):
    return files.newest(table(spark, d, "doc_records"), "ingested_at", "row_id", 5).select("row_id", "id")


# joins and merges


@query("""WITH last AS (SELECT max(batch_no) AS b FROM doc_records)
SELECT id, min(row_id) AS row_id FROM doc_records, last WHERE batch_no = b AND id NOT IN (SELECT id FROM doc_records, last WHERE batch_no < b AND id IS NOT NULL) GROUP BY id""")
def anti_join_ingested(spark, d):
    docs = table(spark, d, "doc_records").select("row_id", "id", "batch_no")
    last = docs.agg(F.max("batch_no")).first()[0]
    return resume.new_documents(docs.where(F.col("batch_no") == last), docs.where(F.col("batch_no") < last), "row_id").select("id", "row_id")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def batch_dedup_first(spark, d):
    return resume.first_copies(table(spark, d, "documents"), "text", "doc_id")


_BLANK = r"'^[\t-\r\x1c-\x20\x{85}\p{Z}]*$'"


@query(f"""SELECT pair_id, question FROM gen_checkpoint WHERE question IS NOT NULL AND NOT regexp_matches(question, {_BLANK}) AND trim(question) <> 'nan'
AND question NOT IN (SELECT question FROM gen_checkpoint WHERE question IS NOT NULL AND json_valid(answer) AND json_type(answer) = 'OBJECT')""")
def resume_pending(spark, d):
    rows = table(spark, d, "gen_checkpoint")
    done = rows.where(F.try_parse_json("answer").isNotNull() & F.ltrim("answer").startswith("{"))
    return resume.pending_questions(rows, done).select("pair_id", "question")


@query("SELECT doc_id, count(*) AS audits FROM ingest_audit WHERE doc_id IN (SELECT id FROM doc_records) GROUP BY doc_id")
def resume_semi(spark, d):
    return resume.known_only(table(spark, d, "ingest_audit"), table(spark, d, "doc_records"), "doc_id", "id").groupBy("doc_id").agg(F.count("*").alias("audits"))


@query("""SELECT r.row_id, coalesce(a.num_chunks, -1)::INT AS num_chunks, a.full_text_chars IS NOT NULL AND a.num_chunks IS NOT NULL AS complete
FROM doc_records r LEFT JOIN (SELECT doc_id, max(num_chunks) AS num_chunks, max(full_text_chars) AS full_text_chars FROM ingest_audit GROUP BY doc_id) a ON a.doc_id = r.id""")
def partial_scores_left(spark, d):
    audits = table(spark, d, "ingest_audit").groupBy(F.col("doc_id").alias("id")).agg(F.max("num_chunks").alias("num_chunks"), F.max("full_text_chars").alias("full_text_chars"))
    rows = table(spark, d, "doc_records").select("row_id", "id").join(audits, "id", "left")
    return rows.select("row_id", F.coalesce("num_chunks", F.lit(-1)).alias("num_chunks"), resume.fully_scored(F.col("full_text_chars"), F.col("num_chunks")).alias("complete"))


@query("""SELECT a.row_id, b.pair_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS n FROM doc_records) a
JOIN (SELECT pair_id, row_number() OVER (ORDER BY pair_id) AS n FROM gen_checkpoint) b USING (n)""")
def zip_join(spark, d):
    return resume.zip_merge(table(spark, d, "doc_records").select("row_id"), table(spark, d, "gen_checkpoint").select("pair_id"), "row_id", "pair_id")


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE concat('other: ', coalesce(lang, '?')) END AS language FROM documents""")
def key_lookup_default(spark, d):
    names = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}
    return resume.lookup(table(spark, d, "documents"), "lang", names, "language", F.concat(F.lit("other: "), F.coalesce("lang", F.lit("?")))).select("doc_id", "language")


@query("""WITH h AS (SELECT max(batch_no) // 2 AS b FROM doc_records), o AS (SELECT id, min(row_id) AS row_id FROM doc_records, h WHERE batch_no <= b GROUP BY id),
n AS (SELECT id, max(row_id) AS row_id FROM doc_records, h WHERE batch_no > b GROUP BY id)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)""")
def upsert_merge(spark, d):
    docs = table(spark, d, "doc_records").select("row_id", "id", "batch_no")
    half = docs.agg(F.max("batch_no")).first()[0] // 2
    old = docs.where(F.col("batch_no") <= half).groupBy("id").agg(F.min("row_id").alias("row_id"))
    new = docs.where(F.col("batch_no") > half).groupBy("id").agg(F.max("row_id").alias("row_id"))
    ix = index.VectorIndex(spark, fresh_path(spark, "upsert"))
    for batch in (old, new):
        ix.upsert(batch.withColumn("parent_id", F.col("id")).withColumn("source", F.lit("x")))
    return ix.read().select("id", "row_id")


@query("SELECT source, id FROM doc_records WHERE source = 'arxiv' UNION ALL SELECT source, id FROM doc_records WHERE source IN ('patent', 'epo_ops')")
def union_sources(spark, d):
    docs = table(spark, d, "doc_records").select("source", "id")
    return files.all_sources(docs.where("source = 'arxiv'"), docs.where(S.is_patent(F.col("source"))))


# groups and windows over hits

_HITS = """h AS (SELECT DISTINCT ON (query_id, hit_rank, id) query_id, hit_rank, id, text, metadata, similarity_distance,
CASE WHEN trim(metadata.parent_id) <> '' THEN metadata.parent_id WHEN contains(id, '_chunk_') THEN regexp_extract(id, '(?s)^(.*)_chunk_', 1) ELSE id END AS parent_id FROM retrieval_hits)"""


def _hits(spark, d):
    return context.normalise_hits(table(spark, d, "retrieval_hits"))


@query("SELECT metadata.parent_id AS parent_id, count(*) AS num_chunks FROM retrieval_hits GROUP BY 1")
def group_count_parent(spark, d):
    return chunking.chunk_counts(table(spark, d, "retrieval_hits").withColumn("parent_id", F.col("metadata.parent_id")))


@query(f"WITH {_HITS} SELECT query_id, string_agg(id, ',' ORDER BY hit_rank, id) AS ids FROM h GROUP BY query_id")
def ordered_collect(spark, d):
    return windows.joined_in_order(_hits(spark, d), "query_id", ["hit_rank", "id"], "id", ",", "ids")


@query("SELECT query_id, round(avg(similarity_distance) FILTER (NOT isnan(similarity_distance)), 9) + 0.0 AS mean_distance FROM retrieval_hits GROUP BY query_id")
def mean_skip_null(spark, d):
    return table(spark, d, "retrieval_hits").groupBy("query_id").agg(F.round(S.mean_of_numbers(F.col("similarity_distance")), 9).alias("mean_distance"))


@query(f"WITH {_HITS}, t AS (SELECT query_id, bool_or(metadata.source = 'arxiv') AS hit FROM h GROUP BY query_id) SELECT count(*) AS queries, round(100 * avg(hit::INT), 6) + 0.0 AS hit_rate FROM t")
def hit_rate(spark, d):
    per_query = _hits(spark, d).groupBy("query_id").agg(F.max((F.col("metadata.source") == "arxiv").cast("int")).cast("boolean").alias("hit"))
    return per_query.agg(F.count("*").alias("queries"), _round(S.percent(F.col("hit"))).alias("hit_rate"))


@query(f"""WITH {_HITS} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, id)::INT AS ordinal,
row_number() OVER (PARTITION BY query_id, parent_id ORDER BY hit_rank, id) = 1 AS is_first FROM h""")
def first_per_parent(spark, d):
    return context.first_of_parent(_hits(spark, d)).select("query_id", "id", "ordinal", "is_first")


@query(f"""WITH {_HITS}, b AS (SELECT query_id, hit_rank, id, 'Source ID: ' || coalesce(nullif(metadata.publication_number, ''), parent_id) || chr(10) || coalesce(text, '') AS block FROM h)
SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY hit_rank, id)) AS digest FROM b GROUP BY query_id""")
def context_blocks(spark, d):
    return context.assemble(context.evaluation_blocks(_hits(spark, d))).select("query_id", F.md5("context").alias("digest"))


@query(f"""WITH {_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, id) AS ordinal FROM h),
b AS (SELECT query_id, ordinal, '--- [Context Chunk ' || ordinal || '] ---' || chr(10) || 'Source ID: ' || coalesce(nullif(metadata.publication_number, ''), parent_id) || chr(10)
|| 'Document Title: ' || coalesce(metadata.title, 'N/A') || chr(10) || 'Content:' || chr(10) || coalesce(text, '') AS block FROM n)
SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY ordinal)) AS digest FROM b GROUP BY query_id""")
def prompt_context(spark, d):
    return context.assemble(context.prompt_blocks(_hits(spark, d))).select("query_id", F.md5("context").alias("digest"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) > 5500 THEN left(text, 2500) || chr(10) || '...' || chr(10) || right(text, 2500) ELSE text END) AS digest FROM documents""")
def context_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.truncate_context(F.col("text"))).alias("digest"))


@query(f"""WITH {_HITS}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN metadata.source = 'arxiv' THEN 0 ELSE 1 END, hit_rank, id)::INT AS pos FROM h)
SELECT * FROM r WHERE pos <= 6""")
def primary_context_cap(spark, d):
    return context.capped_contexts(_hits(spark, d), F.col("metadata.source") == "arxiv").select("query_id", "id", "pos")


@query(f"""WITH {_HITS} SELECT query_id, id, round(last_value(similarity_distance IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY hit_rank, id ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS carried FROM h""")
def carry_forward_header(spark, d):
    rows = windows.carry_forward(_hits(spark, d), "query_id", ["hit_rank", "id"], "similarity_distance", "carried")
    return rows.select("query_id", "id", _round(F.col("carried")).alias("carried"))


@query(f"""WITH {_HITS} SELECT query_id, id, max(coalesce(metadata.source IN ('patent', 'epo_ops'), false)::INT) OVER (PARTITION BY query_id ORDER BY hit_rank, id ROWS UNBOUNDED PRECEDING) AS seen_patent FROM h""")
def sticky_flag(spark, d):
    rows = windows.stays_set(_hits(spark, d), "query_id", ["hit_rank", "id"], S.is_patent(F.col("metadata.source")), "seen_patent")
    return rows.select("query_id", "id", "seen_patent")


_BLOCKS = """b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS block_no,
l_quantity * 10 AS x0, l_quantity * 10 + l_tax * 5000 AS x1, round(l_extendedprice, 2) AS y0 FROM lineitem)"""


@query(f"""WITH {_BLOCKS}, s AS (SELECT *, (x0 < 0.45 * 612 AND x1 > 0.55 * 612)::INT AS spans FROM b),
p AS (SELECT *, coalesce(sum(spans) OVER (PARTITION BY page ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT page, block_no, row_number() OVER (PARTITION BY page ORDER BY 2 * before + spans, CASE WHEN spans = 1 OR (x0 + x1) / 2 < 306 THEN 0 ELSE 1 END, round(y0, 1), x0, block_no)::INT AS position FROM p""")
def two_column_order(spark, d):
    line = table(spark, d, "lineitem")
    arrival = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    blocks = line.select(
        F.col("l_orderkey").alias("page"), F.row_number().over(arrival).cast("long").alias("block_no"), (F.col("l_quantity") * 10).alias("x0"),
        (F.col("l_quantity") * 10 + F.col("l_tax") * 5000).alias("x1"), F.round("l_extendedprice", 2).alias("y0"), F.lit("x").alias("text"), F.lit(0).alias("block_type"),
    )
    return layout.reading_order(blocks).select("page", "block_no", "position")


# scalars


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl')) AS digest FROM documents""")
def ligature_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.normalise_ligatures(F.replace("text", F.lit("fi"), F.lit("ﬁ")))).alias("digest"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS shown FROM orders")
def date_parse(spark, d):
    o = table(spark, d, "orders")
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.date_format("o_orderdate", "MMM. d, yyyy"))
    parsed = S.parse_date(written)
    return o.select("o_orderkey", parsed.cast("string").alias("day"), S.long_date(parsed).alias("shown"))


@query("""WITH c AS (SELECT DISTINCT unnest(patent_classifications) AS code FROM doc_records), s AS (SELECT code, split_part(code, ' ', 1) AS p, split_part(code, ' ', 2) AS g FROM c WHERE code IS NOT NULL),
f AS (SELECT code, CASE WHEN length(p) = 4 THEN left(p, 1) || translate(substr(p, 2, 2), 'OQDEILGBSAZ', '00061166542') || right(p, 1) ELSE p END AS p, g FROM s)
SELECT code, CASE p WHEN 'G060' THEN 'G06Q' WHEN 'G06Y' THEN 'G06V' WHEN 'B25I' THEN 'B25J' ELSE p END || ' ' || g AS normal FROM f""")
def ipc_normalise(spark, d):
    codes = table(spark, d, "doc_records").select(F.explode("patent_classifications").alias("code")).distinct().where("code IS NOT NULL")
    return codes.select("code", S.normalise_ipc(F.split_part("code", F.lit(" "), F.lit(1)), F.split_part("code", F.lit(" "), F.lit(2))).alias("normal"))


@query(r"SELECT doc_id, nullif(rtrim(regexp_extract(left(text, 15000), '\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b', 1), '.'), '') AS doi FROM documents")
def doi_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", S.extract_doi(F.col("text")).alias("doi"))


@query("""SELECT DISTINCT replace(id, '/', '_') AS safe, CASE WHEN contains(id, '_chunk_') THEN regexp_extract(id, '(?s)^(.*)_chunk_', 1) ELSE id END AS parent,
coalesce(nullif(metadata.publication_number, ''), CASE WHEN contains(id, '_chunk_') THEN regexp_extract(id, '(?s)^(.*)_chunk_', 1) ELSE id END) AS pub_no FROM retrieval_hits""")
def id_forms(spark, d):
    hits = table(spark, d, "retrieval_hits")
    parent = S.parent_id(F.lit(None).cast("string"), F.col("id"))
    return hits.select(S.safe_id(F.col("id")).alias("safe"), parent.alias("parent"), S.publication_number(F.col("metadata.publication_number"), parent).alias("pub_no")).distinct()


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def json_path_default(spark, d):
    return table(spark, d, "events").select("event_id", S.json_path(F.col("props"), "$.k", "long", -1).alias("k"))


@query("""SELECT event_id, round(greatest(0.0, least(1.0, CASE WHEN value > 1 AND value <= 10 THEN value / 10 WHEN value > 10 THEN value / 100 ELSE value END)), 6) + 0.0 AS score,
greatest(0, least(10, round_even(value, 0)::INT)) AS points FROM events""")
def score_normalise(spark, d):
    return table(spark, d, "events").select("event_id", _round(S.normalise_score(F.col("value"))).alias("score"), S.judge_points(F.col("value")).alias("points"))


@query(r"""SELECT row_id, coalesce(abstract, '') = '' OR contains(lower(abstract), 'no abstract') OR length(regexp_replace(abstract, '^[\t-\r\x1c-\x20\x{85}\p{Z}]+|[\t-\r\x1c-\x20\x{85}\p{Z}]+$', '', 'g')) < 50 AS missing,
coalesce(abstract, '') <> '' AND NOT contains(lower(abstract), 'no abstract') AS valid, source IN ('patent', 'epo_ops') AS patent,
coalesce(length(full_text), 0) > CASE WHEN source IN ('patent', 'epo_ops') THEN 1000 ELSE 1500 END AS success FROM doc_records""")
def record_flags(spark, d):
    return table(spark, d, "doc_records").select(
        "row_id", S.missing_abstract(F.col("abstract")).alias("missing"), S.valid_abstract(F.col("abstract")).alias("valid"), S.is_patent(F.col("source")).alias("patent"),
        S.full_text_success(F.col("source"), F.length("full_text")).alias("success"),
    )


@query("""SELECT row_id, coalesce(array_to_string(affiliated_institutions, '; '), '') AS institutions, coalesce(array_to_string(patent_classifications, '; '), '') AS classes,
coalesce(array_to_string(independent_claims, chr(10)), '') AS claims, coalesce(publication_number, '') AS number FROM doc_records""")
def metadata_flatten(spark, d):
    return table(spark, d, "doc_records").select(
        "row_id", S.joined(F.col("affiliated_institutions")).alias("institutions"), S.joined(F.col("patent_classifications")).alias("classes"),
        S.joined(F.col("independent_claims"), "\n").alias("claims"), F.coalesce("publication_number", F.lit("")).alias("number"),
    )


@query("SELECT lower(n) AS key, count(DISTINCT n) AS spellings FROM (SELECT unnest(affiliated_institutions) AS n FROM doc_records) WHERE n IS NOT NULL GROUP BY 1")
def distinct_ignoring_case(spark, d):
    return windows.spellings(table(spark, d, "doc_records").select(F.explode("affiliated_institutions").alias("n")), "n")


@query("SELECT finding_id, len(list_filter(coalesce(sensor_types, []), lambda x: x IS NOT NULL AND x <> 'None' AND trim(x, ' ') <> ''))::INT AS sensors FROM perception_findings")
def finding_counts(spark, d):
    return table(spark, d, "perception_findings").select("finding_id", evaluate.finding_count(models.mentioned(F.col("sensor_types"))).alias("sensors"))


@query("""SELECT pair_id, json_extract_string(answer, '$.source_document_id') AS doc, coalesce(json_array_length(json_extract(answer, '$.perception_findings')), 0)::INT AS findings
FROM gen_checkpoint WHERE json_valid(answer) AND json_type(answer) = 'OBJECT' AND json_extract_string(answer, '$.source_document_id') IS NOT NULL""")
def extraction_parse(spark, d):
    parsed = table(spark, d, "gen_checkpoint").where(F.try_parse_json("answer").isNotNull()).withColumn("x", models.parse_extraction(F.col("answer")))
    return parsed.where("x.source_document_id IS NOT NULL").select("pair_id", F.col("x.source_document_id").alias("doc"), F.size(F.coalesce("x.perception_findings", F.array())).alias("findings"))


# evaluation


@query(f"""WITH {_HITS}, v AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, id) AS rank, coalesce(metadata.source = 'arxiv', false)::INT AS verdict FROM h),
p AS (SELECT *, sum(verdict) OVER (PARTITION BY query_id ORDER BY rank) / rank AS p FROM v)
SELECT query_id, round(sum(p * verdict) / nullif(sum(verdict), 0), 6) + 0.0 AS context_precision FROM p GROUP BY query_id""")
def context_precision(spark, d):
    ranked = context.first_of_parent(_hits(spark, d)).select("query_id", F.col("ordinal").alias("rank"), F.coalesce(F.col("metadata.source") == "arxiv", F.lit(False)).cast("int").alias("verdict"))
    return evaluate.context_precision(ranked).withColumn("context_precision", _round("context_precision"))


@query("""SELECT e.label AS query_id, round(avg(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) + 0.0 AS answer_relevancy
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q GROUP BY e.label""")
def answer_relevancy_core(spark, d):
    q = F.array(*[F.lit(x) for x in _vector(spark, d)])
    pairs = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), q.alias("question_vector"), F.col("embedding").alias("generated_vector"))
    return evaluate.answer_relevancy(pairs).withColumn("answer_relevancy", _round("answer_relevancy"))


_AUDIT = """a AS (SELECT DISTINCT * FROM ingest_audit), s AS (SELECT {0}, count(*) AS documents, round(avg(num_chunks), 6) + 0.0 AS mean_chunks, round(coalesce(100 * avg(full_text_success::INT), 0), 6) + 0.0 AS full_text_rate,
round(coalesce(100 * avg(abstract_extracted::INT), 0), 6) + 0.0 AS abstract_rate FROM a GROUP BY {0})"""


@query(f"WITH {_AUDIT.format('domain, source')} SELECT * FROM s")
def ingestion_audit(spark, d):
    s = evaluate.audit_summary(table(spark, d, "ingest_audit"), "domain", "source")
    return s.select("domain", "source", "documents", *[_round(c).alias(c) for c in ("mean_chunks", "full_text_rate", "abstract_rate")])


@query(f"WITH {_AUDIT.format('source')} SELECT coalesce(source, '-') AS source, printf('| %s | %d | %.1f | %.1f%% | %.1f%% |', coalesce(source, '-'), documents, mean_chunks, full_text_rate, abstract_rate) AS line FROM s")
def report_rows(spark, d):
    return evaluate.report_rows(evaluate.audit_summary(table(spark, d, "ingest_audit"), "source"), "source")


@query("SELECT DISTINCT d.domain, s.source FROM (SELECT DISTINCT domain FROM ingest_audit WHERE domain IS NOT NULL) d, (VALUES ('arxiv'), ('epo_ops')) s(source)")
def domain_cross(spark, d):
    return pipeline.runs_of(table(spark, d, "ingest_audit"))


@query("SELECT time_bucket(INTERVAL '1 day', ingested_at) AS start, source, count(*) AS documents FROM doc_records WHERE ingested_at IS NOT NULL GROUP BY 1, 2")
def arrivals_by_day(spark, d):
    return arrivals(table(spark, d, "doc_records"))


# texts: no SQL; tests hold them against fixtures


def _records(spark, d):
    return spread(table(spark, d, "doc_records"), "row_id")


@query()
def standard_documents(spark, d):
    return std.standardize(_records(spark, d))


@query()
def chunk_documents(spark, d):
    return chunking.chunk(std.standardize(_records(spark, d)))


@query()
def chunk_listings(spark, d):
    return chunking.chunk_listing(chunk_documents(spark, d))


@query()
def marked_headings(spark, d):
    return spread(table(spark, d, "doc_records").where("full_text IS NOT NULL"), "row_id").select("row_id", std.with_headings(F.col("full_text")).alias("text"))


@query()
def bibliographic_data(spark, d):
    return std.bibliographic(_records(spark, d).where(S.is_patent(F.col("source"))))


@query()
def embedded_chunks(spark, d):
    return pipeline.prepare(_records(spark, d))


@query()
def generated_answers(spark, d):
    asked = table(spark, d, "gen_checkpoint").select(F.col("pair_id").alias("query_id"), "question").where(S.usable_question(F.col("question")))
    made = models.generate(context.prompts(_hits(spark, d), asked))
    return made.select("query_id", models.parse_extraction(F.col("answer")).getField("source_document_id").alias("doc"), "error")


_TRIM = r"regexp_replace({0}, '^[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+|[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+$', '', 'g')"


@query(f"""SELECT row_id, {_TRIM.format("coalesce(title, '')")} AS title, {_TRIM.format("coalesce(abstract, '')")} AS abstract FROM doc_records""")
def html_text(spark, d):
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit("<html><head><title>"), escaped(F.col("title")), F.lit("</title></head><body><section itemprop='abstract'><h2>Abstract</h2><p>"), escaped(F.col("abstract")),
        F.lit("</p></section><script>var x = '<p>';</script></body></html>"),
    )
    parts = table(spark, d, "doc_records").select("row_id", html_parts(page).alias("p"))
    return parts.select("row_id", F.col("p.title").alias("title"), F.col("p.abstract").alias("abstract"))
