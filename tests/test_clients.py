import json

import pytest

from ferrosieve.operators import models, services
from ferrosieve.operators.index import VectorIndex
from ferrosieve.plans import pipeline
from ferrosieve.sources.clients import PaperClient, PatentOfficeClient, patent_page, pdf_bytes
from ferrosieve.sources.files import local_documents
from ferrosieve.sources.pdf import pdf_text


def test_papers():
    atom = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/2401.1v2</id><title>T</title><summary>a
b</summary><published>2024-01-02T00:00:00Z</published><author><name>A B</name></author><link title="pdf" href="http://x/p"/></entry></feed>"""
    rows = list(PaperClient({"base": "http://x"}, lambda *a: (200, "application/atom+xml", atom)).search("q", 1))
    assert rows == [{"source": "arxiv", "id": "2401.1v2", "title": "T", "authors": ["A B"], "abstract": "a b", "published_date": "2024-01-02", "pdf_url": "http://x/p"}]
    with pytest.raises(OSError):
        list(PaperClient({}, lambda *a: (500, "", b"")).search("q", 1))


def test_patents_renew_the_token():
    calls = []

    def transport(url, headers, body, timeout):
        calls.append(url)
        if body:
            return 200, "application/json", json.dumps({"access_token": f"t{len(calls)}"}).encode()
        return (400, "text/xml", b"Token Invalid") if headers["Authorization"] == "Bearer t1" else (200, "application/json", json.dumps({"a": {"b": {"exchange-document": 1}}}).encode())

    options = {"key": "k", "secret": "s", "auth": "http://auth", "base": "http://base", "path": "a/b"}
    assert PatentOfficeClient(options, transport).records("q", 2) == ['{"exchange-document": 1}'] and calls.count("http://auth") == 2
    client = PatentOfficeClient(options, lambda u, h, b, t: (200, "", b'{"access_token": "x"}') if b else (404, "", b""))
    assert client.records("q", 2) == []


def test_pages_and_files():
    assert patent_page("US20240123456A1", "http://p/", lambda u, *a: (200, "text/html", f"<div itemprop='abstract'>{u}</div>".encode())) == ("http://p/US2024123456A1", "")
    assert patent_page("x", "", lambda *a: (_ for _ in ()).throw(OSError())) == ("", "")
    assert pdf_bytes("u", lambda *a: (200, "text/html", b"x")) is None and pdf_bytes("u", lambda *a: (200, "application/pdf", b"%PDF")) == b"%PDF"


def pdf(*lines, deflate=False):
    import zlib

    body = b"BT /F1 10 Tf 12 TL " + b" ".join(b"1 0 0 1 %d %d Tm (%s) Tj" % line for line in lines) + b" ET"
    body = zlib.compress(body) if deflate else body
    return b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(body)).encode() + (b" /Filter /FlateDecode" if deflate else b"") + b" >>\nstream\n" + body + b"\nendstream\nendobj"


def test_pdf_text_in_two_columns():
    page = pdf((60, 700, b"A title that spans the whole width of the page and goes on and on until it ends here"), (60, 650, b"left one"), (60, 638, b"left \\(two\\)"), (340, 650, b"right one"), deflate=True)
    assert pdf_text(page).split("\n") == ["A title that spans the whole width of the page and goes on and on until it ends here", "left one", "left (two)", "right one"]
    assert pdf_text(b"%PDF-1.4 no text") is None and pdf_text(b"<html>") is None and pdf_text(None) is None
    array = b"%PDF\n<< /Length 9 >>\nstream\nBT /F1 9 Tf 50 700 Td [(Ra) 20 (dar) -300 <6C69646172>] TJ T* (next) ' ET\nendstream"
    assert pdf_text(array).split("\n")[0] == "Radar lidar"


def test_folder_of_pdfs_gives_chunks_of_their_text(spark, tmp_path):
    (tmp_path / "papers").mkdir()
    lines = [(60, 700 - 12 * i, b"The radar sees the road in the rain and nobody knows why.") for i in range(50)]
    (tmp_path / "papers" / "radar_test.pdf").write_bytes(pdf((60, 740, b"ABSTRACT"), *lines))
    docs = local_documents(spark, str(tmp_path))
    assert docs.first().title == "Radar Test" and docs.first().full_text.count("radar") == 50
    ix = VectorIndex(spark, f"file://{tmp_path}/ix")
    assert pipeline.reload(docs, ix) == ix.count() >= 1 and ix.read().where("contains(text, 'The radar sees')").count() >= 1


def test_model_services():
    asked = []

    def transport(url, headers, body, timeout):
        payload = json.loads(body)
        asked.append(payload.get("format"))
        if "embed" in url:
            return 200, "application/json", json.dumps({"embedding": [float(len(payload["prompt"])), 1.0]}).encode()
        if isinstance(payload.get("format"), dict):
            return 400, "text/plain", b"unknown format"
        answer = "no idea" if payload.get("format") == "json" else 'Sure:\n```json\n{"score": 7, "reason": "ok"}\n```'
        return 200, "application/json", json.dumps({"response": answer}).encode()

    assert services.HttpEmbedder("http://x/embed", "m", transport=transport).embed(["ab", None]).tolist() == [[2.0, 1.0], [0.0, 1.0]]
    generator = services.HttpGenerator("http://x/generate", "m", transport=transport)
    asked.clear()
    assert services.Judge(generator, services.GRADED)("q", "a") == 7.0 and [type(f).__name__ for f in asked] == ["dict", "str", "NoneType"]
    with pytest.raises(ValueError):
        services.ExtractionGenerator("http://x/generate", "m", transport=transport).generate("x")
    with pytest.raises(OSError):
        services.HttpEmbedder("http://x/embed", "m", transport=lambda *a: (500, "", b"")).embed(["a"])
    assert services.wanted_keys("Say it plainly") is None and services.first_json("{bad} {\"a\": 1}") == {"a": 1}


def test_judgements_of_a_table(spark):
    rows = spark.createDataFrame([("q", "a", None)], "question string, answer string, expected string")
    class Fixed:
        def generate(self, prompt):
            return '{"score": 7, "reason": "ok"}' if "QUESTION: q" in prompt else "nothing"
    got = models.judge(rows, services.Judge(Fixed(), services.RELEVANCE)).first()
    assert got.score == 0.7 and rows.select(services.graded_payload("question", "answer", "expected").alias("p")).first().p == "QUESTION:\nq\n\nEXPECTED:\n\n\nANSWER:\na"
