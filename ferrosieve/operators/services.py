"""Models behind HTTP: embedder, generator and judge over the same transport as the sources, so they run offline in tests."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrosieve.schemas import EXTRACTION
from ferrosieve.sources.clients import Transport, http


def _post(transport: Transport, url: str, payload: Mapping, timeout: float) -> dict:
    status, _, body = transport(url, {"Content-Type": "application/json"}, json.dumps(payload).encode(), timeout)
    if status != 200:
        raise OSError(f"status {status}")
    return json.loads(body)


class HttpEmbedder:
    """``embed(texts)`` by one request a text; a vector of another length than the first is refused."""

    def __init__(self, url: str, model: str, timeout: float = 60, transport: Transport = http):
        self.url, self.model, self.timeout, self.transport = url, model, timeout, transport

    def embed(self, texts: list[str]) -> np.ndarray:
        vectors = [_post(self.transport, self.url, {"model": self.model, "prompt": t or ""}, self.timeout)["embedding"] for t in texts]
        if len({len(v) for v in vectors}) > 1:
            raise ValueError("vectors of different lengths")
        return np.array(vectors, dtype=np.float32).reshape(len(texts), -1)


def wanted_keys(prompt: str) -> list[str] | None:
    """The keys of the JSON object that a prompt describes, as a schema or by an example; None where it asks for plain text."""
    if not re.search(r"json", prompt, re.I):
        return None
    schema = re.search(r'"properties"\s*:\s*\{(.*)', prompt, re.S)
    keys = re.findall(r'"(\w+)"\s*:\s*\{', schema[1]) if schema else re.findall(r'"(\w+)"\s*:', prompt)
    return list(dict.fromkeys(keys)) or None


def first_json(text: str) -> dict | None:
    """The first JSON object inside a text, also in a code fence."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            value, _ = decoder.raw_decode(text[m.start() :])
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


class HttpGenerator:
    """``generate(prompt)`` with a JSON schema, else in JSON mode, else as plain text.

    Each step is taken only where the one before gave no object with the wanted keys; without keys the text is the answer.
    """

    def __init__(self, url: str, model: str, keys: list[str] | None = None, timeout: float = 600, context: int = 16_384, transport: Transport = http):
        self.url, self.model, self.keys, self.timeout, self.context, self.transport = url, model, keys, timeout, context, transport

    def _ask(self, prompt: str, form: object) -> str:
        payload = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0, "num_ctx": self.context}}
        return _post(self.transport, self.url, payload | ({"format": form} if form else {}), self.timeout)["response"]

    def generate(self, prompt: str) -> str:
        keys = self.keys or wanted_keys(prompt)
        if not keys:
            return self._ask(prompt, None)
        schema = {"type": "object", "properties": {k: {} for k in keys}, "required": keys}
        last: Exception | None = None
        for form in (schema, "json", None):
            try:
                found = first_json(self._ask(prompt, form))
            except OSError as e:  # a service may not know a form
                last = e
                continue
            if found is not None and set(keys) <= set(found):
                return json.dumps(found)
        raise ValueError(f"no answer with the keys {', '.join(keys)}") from last


class ExtractionGenerator(HttpGenerator):
    """Answers that have the fields of the extraction record."""

    def __init__(self, url: str, model: str, **options: object):
        super().__init__(url, model, EXTRACTION.names, **options)


class Judge:
    """A score in [0, 1] and its reason for a question and an answer, by a generator that answers ``score`` and ``reason``."""

    def __init__(self, generator: object, task: str):
        self.generator, self.task = generator, task

    def __call__(self, question: str, answer: str) -> float:
        got = first_json(self.generator.generate(f'{self.task}\n\nQUESTION: {question}\nANSWER: {answer}\n\nReply in JSON: {{"score": 0.0, "reason": ""}}'))
        if got is None or not isinstance(got.get("score"), (int, float)):
            raise ValueError("no score")
        return float(got["score"])


RELEVANCE = "Judge how far the answer addresses the question, from 0 to 1."
GRADED = "Judge the answer against the expected one: relevance 40 %, technical accuracy 40 %, completeness 20 %; from 0 to 10."


def graded_payload(question: str, answer: str, expected: str) -> Column:
    """What a graded judgement sees of a row: the question, the expected and the given answer; nulls are written as nothing."""
    part = lambda label, c: F.concat(F.lit(f"{label}:\n"), F.coalesce(F.col(c), F.lit("")))
    return F.concat_ws("\n\n", part("QUESTION", question), part("EXPECTED", expected), part("ANSWER", answer))
