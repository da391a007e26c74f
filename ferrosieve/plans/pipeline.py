"""Whole runs: ingesting documents, answering a query, evaluating a set of questions."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrosieve.config import DEFAULT, EngineConfig
from ferrosieve.operators import context, models, resume, retrieve
from ferrosieve.operators.chunking import chunk
from ferrosieve.operators.index import VectorIndex
from ferrosieve.operators.standardize import standardize
from ferrosieve.sources.files import all_sources, exists, read_checkpoint
from ferrosieve.sources.service import DocumentService
from ferrosieve.sources.sinks import append_rows
from ferrosieve.tables import settle

log = logging.getLogger("ferrosieve")
SOURCES = ("arxiv", "epo_ops")


def set_up_logging(path: str | None = None) -> None:
    """Console from INFO, and a rotating file from DEBUG."""
    log.setLevel(logging.DEBUG)
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s")
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    handlers[0].setLevel(logging.INFO)
    if path:
        handlers.append(RotatingFileHandler(path, maxBytes=5_000_000, backupCount=3))
    for h in handlers:
        h.setFormatter(form)
        log.addHandler(h)


def prepare(docs: DataFrame, config: EngineConfig = DEFAULT, embedder: Callable[[], models.Embedder] = models.HashEmbedder) -> DataFrame:
    """Documents to embedded chunks: one narrow plan up to the write."""
    return models.embed(chunk(standardize(docs, config), config), "text", embedder)


def ingest(fetched: DataFrame, index: VectorIndex, raw_path: str, order: str, config: EngineConfig = DEFAULT, embedder: Callable[[], models.Embedder] = models.HashEmbedder) -> tuple[int, int]:
    """New documents into the index; (fetched, chunks added). The raw documents, which mark what is done, are written last."""
    spark = fetched.sparkSession
    known = spark.read.parquet(raw_path) if exists(spark, raw_path) else spark.createDataFrame([], fetched.schema)
    new = settle(resume.new_documents(fetched, known, order), "new-documents")
    chunks = settle(prepare(new, config, embedder), "new-chunks")
    index.upsert(chunks)
    append_rows(new, raw_path)
    out = (fetched.count(), chunks.count())
    log.info("fetched %d documents, added %d chunks", *out)
    return out


def fetch(spark: SparkSession, query: str, limit: int, **options: str) -> DataFrame:
    """Documents that a service gives for a query, through the registered data source."""
    spark.dataSource.register(DocumentService)
    return spark.read.format("document_service").options(**options).option("query", query).option("limit", str(limit)).load()


def ingest_domains(spark: SparkSession, index: VectorIndex, raw_path: str, build: Callable[[list[str]], str], limit: int, config: EngineConfig = DEFAULT, embedder: Callable[[], models.Embedder] = models.HashEmbedder, **options: str) -> dict[str, int]:
    """Up to ``limit`` documents of each domain into the index; a document of several domains counts for the first. Figures of the run.

    The domains are few and fixed, so their requests are one union and everything after it one plan.
    """
    parts = [fetch(spark, build([domain]), limit, **options).withColumn("_domain", F.lit(i)) for i, domain in enumerate(config.domains)]
    fetched = settle(all_sources(*parts), "fetched")
    numbered = fetched.withColumn("_order", F.struct("_domain", "id").cast("string"))
    once = numbered.groupBy("id").agg(F.min("_order").alias("_order"))
    documents = settle(numbered.join(once, ["id", "_order"]).dropDuplicates(["id"]).drop("_domain"), "domains")
    found, chunks = ingest(documents, index, raw_path, "_order", config, embedder)
    return {"fetched": fetched.count(), "documents": found, "chunks": chunks}


def reload(docs: DataFrame, index: VectorIndex, config: EngineConfig = DEFAULT) -> int:
    """A local folder's documents in place of what the index holds."""
    index.reset()
    chunks = settle(prepare(docs, config), "reload")
    index.upsert(chunks)
    return chunks.count()


def answer(spark: SparkSession, index: DataFrame, question: str, k: int | None = None, where: Mapping | None = None, embedder: models.Embedder | None = None, generator: Callable[[], models.Generator] = models.EchoGenerator, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(the parsed answer, the hits) for one question."""
    vector = (embedder or models.HashEmbedder(config.embedding_dim)).embed([question])[0].tolist()
    near = retrieve.top_k(index, vector, k or config.top_k, where)
    hits = retrieve.with_payload(near, index, ["text", "metadata"]).withColumn("query_id", F.lit(0)).withColumnRenamed("rank", "hit_rank")
    hits = settle(context.normalise_hits(hits), "hits")
    asked = spark.createDataFrame([(0, question)], "query_id int, question string")
    made = models.generate(context.prompts(hits, asked), generator)
    return made.select("answer", models.parse_extraction(F.col("answer")).alias("extraction"), "error"), hits


def evaluate_questions(questions: DataFrame, index: DataFrame, checkpoint_path: str, k: int = DEFAULT.top_k, generator: Callable[[], models.Generator] = models.EchoGenerator, embedder: Callable[[], models.Embedder] = models.HashEmbedder) -> DataFrame:
    """Answers for all questions without a checkpoint; each stage is materialised, finished questions are never asked again."""
    spark = questions.sparkSession
    done = read_checkpoint(spark, checkpoint_path)
    open_ = resume.pending_questions(questions, done, distinct=True).withColumn("query_id", F.xxhash64("question"))
    vectors = settle(models.embed(open_.select("query_id", "question"), "question", embedder, "query_vector"), "question-vectors")
    near = retrieve.top_k_batch(index, vectors, k)
    hits = near.join(index.select("id", "text", "metadata"), "id").withColumnRenamed("rank", "hit_rank")
    hits = settle(context.normalise_hits(hits), "question-hits")
    answers = settle(models.generate(context.prompts(hits, open_), generator), "answers").where("error IS NULL")
    blocks = context.evaluation_blocks(hits)
    lists = blocks.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "block"))), lambda x: x["block"]).alias("contexts"))
    out = open_.join(answers, "query_id").join(lists, "query_id", "left").select("question", "answer", "contexts", "ground_truth")
    append_rows(out, checkpoint_path)
    return spark.read.parquet(checkpoint_path)


def runs_of(domains: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """Every ``domain`` of a table with every kind of source, each once; the few sources are exploded, nothing is joined."""
    named = domains.where("domain IS NOT NULL").select("domain").distinct()
    return named.select("domain", F.explode(F.array(*map(F.lit, sources))).alias("source"))


def domain_runs(config: EngineConfig = DEFAULT) -> list[tuple[str, str]]:
    """Every domain with every kind of source."""
    return [(domain, source) for domain in config.domains for source in SOURCES]
