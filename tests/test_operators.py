import json

import pytest
from pyspark.sql import functions as F

from ferrosieve.functions import scalars as S
from ferrosieve.operators import context, evaluate, models, resume, retrieve
from ferrosieve.operators.chunking import chunk, chunk_listing
from ferrosieve.operators.index import VectorIndex, sanitized
from ferrosieve.sources.queries import paper_query
from ferrosieve.operators.layout import page_text
from ferrosieve.operators.select_first import first_unseen
from ferrosieve.operators.standardize import standardize
from ferrosieve.plans import pipeline
from ferrosieve.schemas import CHUNK_METADATA, DOCUMENT, METADATA, PAGE_BLOCK, STANDARD_DOC
from ferrosieve.sources import files, service, sinks
from ferrosieve.sources.patents import parse_biblio
from ferrosieve.streaming.ingest import document_stream, stream_ingest


def doc(**fields):
    row = dict.fromkeys(f.name for f in DOCUMENT.fields) | {"source": "arxiv", "id": "a"} | fields
    return tuple(row[f.name] for f in DOCUMENT.fields)


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, S.collapse_spaced_header(F.lit(" A R T I C L E   I N F O "))) == "ARTICLE INFO"
    assert one(spark, S.collapse_spaced_header(F.lit(" A B C "))) == "A B C"
    assert str(one(spark, S.parse_date(F.lit("filed on 30 May 2024")))) == "2024-05-30"
    assert one(spark, S.parse_date(F.lit("31.02.2024"))) is None
    assert one(spark, S.normalise_ipc(F.lit("GOGT"), F.lit("1520"))) == "G06T 15/20"
    assert one(spark, S.hyphen_join(F.array(F.lit("real-"), F.lit("time sys-"), F.lit("tem"), F.lit("ok")), ["real"])) == "real-time system ok"
    assert one(spark, S.restore_case(F.lit("The Lidar And (Adas) Test"), {"adas": "ADAS"}, True)) == "The lidar and (ADAS) test"
    assert one(spark, S.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, S.parent_id(F.lit(None).cast("string"), F.lit("a_chunk_b_chunk_3"))) == "a_chunk_b"


def test_standardize_fills_only_what_is_missing(spark):
    text = "Abstract\n" + "We measure the error of sensors in rain and snow and report it here. " * 3 + "\nIntroduction\nSee 10.1234/abc.5."
    docs = spark.createDataFrame([doc(abstract="No abstract available.", full_text=text, title="T", authors=["A", "B"]), doc(id="b", abstract="short"), doc(id="c")], DOCUMENT)
    rows = {r.id: r for r in standardize(docs).collect()}
    assert rows["a"].metadata.abstract.startswith("We measure") and rows["a"].metadata.publication_number == "10.1234/abc.5"
    assert rows["a"].text.startswith("Title: T\nAuthors: A, B\nPublished Date: \n\n# Abstract\nWe measure") and "\n\nFull Text:\n" in rows["a"].text
    assert rows["b"].text.endswith("# Abstract\nshort") and rows["c"].metadata.title == ""


def test_standardize_of_nothing(spark):
    assert standardize(spark.createDataFrame([], DOCUMENT)).count() == 0


def test_chunks_are_dense_and_headed(spark):
    meta = tuple("arxiv" if f.name == "source" else "" for f in METADATA.fields)
    docs = spark.createDataFrame([("d", "# A\n" + "word " * 1200 + "\n# B\n" + "text " * 400, meta), ("e", None, meta), ("f", "", meta)], STANDARD_DOC)
    rows = chunk(docs).orderBy("metadata.chunk_index").collect()
    assert [r.metadata.chunk_index for r in rows] == list(range(len(rows))) and len(rows) >= 4
    assert all(r.text.startswith("Document Title: Unknown Title\nPublication Date: Unknown Date\nSection: ") for r in rows)
    assert rows[0].id == "d_chunk_0" and {r.parent_id for r in rows} == {"d"}
    assert "=== Chunk 1 (" in chunk_listing(chunk(docs)).first().listing


def test_chunking_does_not_shuffle(spark, capsys):
    meta = tuple("" for _ in METADATA.fields)
    chunk(spark.createDataFrame([("d", "# A\ntext", meta)], STANDARD_DOC)).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_index_upserts_and_resets(spark, tmp_path):
    meta = tuple("arxiv" if f.name == "source" else 0 if f.name == "chunk_index" else "" for f in CHUNK_METADATA.fields)
    make = lambda rows: spark.createDataFrame([(i, p, t, meta, [1.0]) for i, p, t in rows], "id string, parent_id string, text string, metadata struct<" + CHUNK_METADATA.simpleString()[7:-1] + ">, embedding array<float>")
    ix = VectorIndex(spark, f"file://{tmp_path}/ix")
    assert ix.count() == 0
    ix.upsert(make([("a_chunk_0", "a", "x"), ("a_chunk_1", "a", "y"), ("b_chunk_0", "b", "z")]))
    ix.upsert(make([("a_chunk_0", "a", "new")]))
    assert ix.count() == 3 and ix.read().where("id = 'a_chunk_0'").first().text == "new"
    ix.upsert(make([("a_chunk_0", "a", "only")]), replace_parents=True)
    assert ix.count() == 2
    with pytest.raises(ValueError):
        ix.upsert(make([("q", "q", "1"), ("q", "q", "2")]))
    ix.upsert(make([]))
    ix.reset()
    assert ix.count() == 0


def test_index_survives_a_crash_and_rewrites_touched_buckets_only(spark, tmp_path, monkeypatch):
    make = lambda rows: spark.createDataFrame([(i, p, t, "arxiv") for i, p, t in rows], "id string, parent_id string, text string, source string")
    ix = VectorIndex(spark, f"file://{tmp_path}/ix", buckets=8)
    ix.upsert(make([(f"d{i}_chunk_0", f"d{i}", "old") for i in range(40)]))
    before = ix._state()[1]["owner"]
    monkeypatch.setattr(type(ix.versions), "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ix.upsert(make([("d0_chunk_0", "d0", "new")]))
    monkeypatch.undo()
    assert ix.count() == 40 and ix.read().where("text = 'new'").count() == 0
    ix.upsert(make([("d0_chunk_0", "d0", "new")]))
    after = VectorIndex(spark, f"file://{tmp_path}/ix")._state()[1]["owner"]
    assert sum(before[b] != after[b] for b in before) == 1 and ix.count() == 40 and ix.read().where("text = 'new'").count() == 1


def test_last_score_wins(spark):
    gen = spark.createDataFrame([("x",), ("y",)], "k string")
    scores = spark.createDataFrame([("x", 1.0, None, 1), ("x", None, 0.5, 2), ("y", 0.9, None, 1), ("y", 0.2, None, 2)], "k string, a double, b double, t int")
    done, left = resume.scored_and_open(gen, scores, "k", "a", "b", "t")
    assert [(r.k, r.a, r.b) for r in done.collect()] == [("x", 1.0, 0.5)] and [(r.k, r.a) for r in left.collect()] == [("y", 0.2)]


def test_title_case(spark):
    df = spark.createDataFrame([("jean-pierre O'NEIL 3d",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(S.title_case(F.col("t"))).collect()] == ["Jean-Pierre O'Neil 3D", "", None]


def test_metadata_is_sanitized(spark):
    df = spark.sql("SELECT struct(cast(null AS string) AS a, array('x', 'y') AS b, 3 AS c) AS m")
    assert df.select(sanitized("m", df.schema["m"].dataType).alias("m")).first().m == ("", '["x","y"]', 3)


def test_search_with_ties_filters_and_zero_vectors(spark):
    rows = [("a", [1.0, 0.0], 1), ("b", [1.0, 0.0], 2), ("c", [0.0, 0.0], 1), ("d", [0.0, 1.0], 1)]
    ix = spark.createDataFrame(rows, "id string, embedding array<float>, n int")
    assert [r.id for r in retrieve.top_k(ix, [1.0, 0.0], 3).orderBy("rank").collect()] == ["a", "b", "d"]
    assert [r.id for r in retrieve.top_k(ix, [1.0, 0.0], 3, {"n": {"$lt": 2}}).collect()] == ["a", "d"]
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id int, query_vector array<float>")
    got = {(r.query_id, r["rank"]): r.id for r in retrieve.top_k_batch(ix, asked, 2, block=1).collect()}
    assert got == {(7, 1): "a", (7, 2): "b", (8, 1): "d", (8, 2): "a"}
    assert retrieve.top_k(ix.limit(0), [1.0, 0.0], 3).count() == 0


def test_prompt_has_facts_once(spark):
    hit = "query_id int, hit_rank int, id string, text string, metadata struct<source:string,title:string,abstract:string,publication_number:string,parent_id:string>"
    hits = spark.createDataFrame([(1, 1, "p_chunk_0", "t0", ("patent", "T", "Abs", "", "")), (1, 2, "p_chunk_1", "t1", ("patent", "T", "Abs", "", ""))], hit)
    asked = spark.createDataFrame([(1, "why?"), (2, "nothing")], "query_id int, question string")
    rows = {r.query_id: r.prompt for r in context.prompts(context.normalise_hits(hits), asked).collect()}
    assert rows[1].count("Document Abstract: Abs") == 1 and rows[1].count("Source ID: p\n") == 2 and "[Context Chunk 2]" in rows[1]
    assert "why?" in rows[1] and "nothing" in rows[2]


def test_resume(spark):
    q = spark.createDataFrame([("a",), ("a",), ("nan",), (" ",), (None,), ("b",)], "question string")
    done = spark.createDataFrame([("b",)], "question string")
    assert [r.question for r in resume.pending_questions(q, done).collect()] == ["a", "a"]
    assert resume.pending_questions(q, done, distinct=True).count() == 1
    gen = spark.createDataFrame([("x",), ("y",)], "k string")
    scores = spark.createDataFrame([("x", 1.0, 2.0), ("y", 1.0, None), ("z", 1.0, 1.0)], "k string, a double, b double")
    finished, left = resume.scored_and_open(gen, scores, "k", "a", "b")
    assert [r.k for r in finished.collect()] == ["x"] and left.first().k == "y" and left.first().a == 1.0


def test_reading_order(spark):
    blocks = [(1, 320.0, 10.0, 500.0, 20.0, "right", 0, 0), (1, 10.0, 12.0, 200.0, 20.0, "left", 1, 0), (1, 10.0, 50.0, 600.0, 60.0, "wide", 2, 0), (1, 10.0, 70.0, 200.0, 80.0, "below", 3, 0), (1, 0.0, 0.0, 1.0, 1.0, " ", 4, 0)]
    assert page_text(spark.createDataFrame(blocks, PAGE_BLOCK)).first().text == "left\nright\nwide\nbelow"


def test_first_unseen(spark):
    rows = spark.createDataFrame([("A", "x", 1), ("A", "y", 2), ("B", "x", 1), ("B", "z", 2)], "domain string, doc_id string, n int")
    assert first_unseen(rows, ["A", "B", "C"], "n") == [("A", "x"), ("B", "z")]


def test_models(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None)], "id string, text string")
    rows = {r.id: r.embedding for r in models.embed(df).collect()}
    assert abs(sum(x * x for x in rows["a"]) - 1) < 1e-5 and not any(rows["b"]) and "embedding" not in df.columns
    judged = models.judge(spark.createDataFrame([("q", "a"), ("q", "")], "question string, answer string"), lambda q, a: 7 if a else 1 / 0)
    assert [r.score for r in judged.collect()] == [0.7, None] and judged.collect()[1].score_reason.startswith("Error")


def test_evaluation(spark):
    v = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0)], "query_id int, rank int, verdict int")
    got = {r.query_id: r.context_precision for r in evaluate.context_precision(v).collect()}
    assert abs(got[1] - (1 + 2 / 3) / 2) < 1e-9 and got[2] is None
    assert evaluate.share(v, "recall").where("query_id = 2").first().recall == 0.0


def test_biblio_json(spark):
    record = {"exchange-document": {"bibliographic-data": {
        "publication-reference": {"document-id": [{"country": {"$": "US"}, "doc-number": {"$": "123"}, "kind": {"$": "B2"}, "date": {"$": "20240102"}}]},
        "invention-title": {"@lang": "en", "$": "Test"}, "priority-claims": {"priority-claim": [{"document-id": {"date": {"$": "20230203"}}}, {"document-id": [{"date": {"$": "20220304"}}]}]},
        "parties": {"applicants": {"applicant": [{"applicant-name": {"name": {"$": "Example"}}}, {"applicant-name": {"name": {"$": "Example"}}}]}},
        "patent-classifications": {"patent-classification": {"section": {"$": "G"}, "class": {"$": "01"}, "subclass": {"$": "S"}, "main-group": {"$": "7"}, "subgroup": {"$": "40"}}}},
        "abstract": {"@lang": "en", "p": [{"$": "One."}, "Two."]}}}
    r = parse_biblio(spark.createDataFrame([(json.dumps(record),), ("{}",)], "json string")).collect()
    assert r[0].id == "US123B2" and r[0].title == "Test" and r[0].published_date == "2024-01-02" and r[0].affiliated_institutions == ["Example"]
    assert r[0].priority_or_grant_date == "Grant Date: 2024-01-02 (Priority Date: 2022-03-04)" and r[0].patent_classifications == ["G01S 7/40"] and r[0].abstract == "One. Two."
    assert r[1].title == "Untitled Patent" and r[1].published_date == "Unknown" and r[1].authors == ["Unknown Inventor"]


def test_files(spark, tmp_path):
    (tmp_path / "papers").mkdir()
    (tmp_path / "papers" / "a_new_paper.pdf").write_bytes(b"%PDF")
    r = files.local_documents(spark, str(tmp_path)).first()
    assert (r.id, r.title, r.source, r.authors) == ("a_new_paper", "A New Paper", "arxiv", ["Manual Upload"])
    assert files.local_documents(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "q.csv").write_text("question,ground_truth\nwhy?,because\n")
    assert files.read_csv(spark, str(tmp_path / "q.csv")).first().ground_truth == "because"
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "q.csv"), required=("other",))
    assert files.read_checkpoint(spark, str(tmp_path / "c.json")).count() == 0


def test_service_source(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"source": "arxiv", "id": str(i), "published_date": f"2024-01-0{i}", "abstract": "a\nb"}) for i in range(1, 5)))
    spark.dataSource.register(service.DocumentService)
    rows = spark.read.format("document_service").option("path", str(tmp_path)).option("limit", "2").load().collect()
    assert [r.id for r in rows] == ["4", "3"] and rows[0].abstract == "a b"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "text", None)], "id string, text string, n int")
    sinks.write_texts(df, str(tmp_path / "t"))
    assert tuple(spark.read.parquet(str(tmp_path / "t")).first()) == ("a_b", "text")
    sinks.write_bytes(spark.createDataFrame([("x/y", bytearray(b"%PDF"))], "id string, content binary"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).first().content == b"%PDF"
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().id == "a/b"
    assert '"n" : null' in df.select(sinks.pretty_json("id", "n").alias("j")).first().j


def test_whole_runs(spark, tmp_path):
    text = "# Introduction\n" + "The radar sees the road in rain. " * 60
    docs = spark.createDataFrame([doc(id="a", title="Radar", full_text=text, abstract="A radar in rain and snow for many drives, tested at length."), doc(id="a", title="again"), doc(id="b", abstract="Another one about lidar that is long enough to be an abstract.")], DOCUMENT).withColumn("n", F.monotonically_increasing_id())
    ix = VectorIndex(spark, f"file://{tmp_path}/ix")
    fetched, added = pipeline.ingest(docs, ix, f"{tmp_path}/raw", "n")
    assert fetched == 3 and added == ix.count() >= 2
    assert pipeline.ingest(docs, ix, f"{tmp_path}/raw", "n")[1] == 0
    made, hits = pipeline.answer(spark, ix.read(), "radar in rain", k=2)
    assert made.first().extraction.source_document_id == "a" and hits.count() == 2
    asked = spark.createDataFrame([("radar?", "yes"), ("nan", "")], "question string, ground_truth string")
    assert pipeline.evaluate_questions(asked, ix.read(), f"{tmp_path}/cp", 2).count() == 1
    assert pipeline.evaluate_questions(asked, ix.read(), f"{tmp_path}/cp", 2).count() == 1
    assert len(pipeline.domain_runs()) == 12


def test_streaming(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/doc_records.parquet").schema
    ix = VectorIndex(spark, f"file://{tmp_path}/ix")
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/doc_records.parquet").write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream_ingest(document_stream(spark, f"{tmp_path}/in", schema), ix, f"{tmp_path}/cp").awaitTermination()
    assert ix.count() > 0


def test_domains_are_ingested_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"source": "arxiv", "id": f"p{i}", "title": f"Radar {i}", "published_date": f"2024-01-0{i}", "abstract": "A radar in rain and snow for many drives, tested at length."} for i in range(1, 6)]
    (tmp_path / "in" / "d.jsonl").write_text("\n".join(map(json.dumps, rows)))
    ix = VectorIndex(spark, f"file://{tmp_path}/ix")
    run = lambda n: pipeline.ingest_domains(spark, ix, f"{tmp_path}/raw", paper_query, n, path=str(tmp_path / "in"))
    first = run(3)
    assert first["fetched"] == 18 and first["documents"] == 3 and first["chunks"] == ix.count() == 3
    assert run(3)["chunks"] == 0 and run(5)["chunks"] == 2 and ix.count() == 5
