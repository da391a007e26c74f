"""Model calls behind small protocols; deterministic stand-ins work offline."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrosieve.config import DEFAULT, NOT_MENTIONED
from ferrosieve.schemas import EXTRACTION, FINDING_LISTS


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class HashEmbedder:
    """Feature hashing of words and word pairs into a unit vector; no words give the zero vector."""

    def __init__(self, dim: int = DEFAULT.embedding_dim):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            words = re.findall(r"\w+", (t or "").lower())
            for w in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = xxhash.xxh64_intdigest(w)
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
            size = np.linalg.norm(out[i])
            if size:
                out[i] /= size
        return out


class EchoGenerator:
    """An extraction with the source of the first context block and no findings, as valid JSON."""

    def generate(self, prompt: str) -> str:
        get = lambda label: (m.group(1) if (m := re.search(label + r": (.*)", prompt)) else "")
        finding = {"technology_or_algorithm_name": get("User Query") or "unknown"} | {f: [NOT_MENTIONED] for f in FINDING_LISTS}
        return json.dumps({
            "source_document_id": get("Source ID"), "document_title": get("Document Title"), "document_abstract": get("Document Abstract"),
            "affiliated_companies_or_institutions": [], "summary_of_technical_relevance": get("Document Abstract")[:200], "key_claims_or_methodologies": [],
            "perception_findings": [finding], "patent_metadata": None,
        })


def embed(df: DataFrame, text_col: str = "text", make: Callable[[], Embedder] = HashEmbedder, out: str = "embedding", batch: int = 256) -> DataFrame:
    """``df`` with vectors; the model is made once a task and fed in batches."""
    names = df.columns
    at = names.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            texts = b.column(at).to_pylist()
            parts = [model.embed(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, 1), dtype=np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*names, out])

    return df.mapInArrow(run, schema)


def generate(prompts: DataFrame, make: Callable[[], Generator] = EchoGenerator, key: str = "query_id") -> DataFrame:
    """``key``, ``answer`` (JSON) and ``error``; a failed call leaves its message and does not end the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            answers, errors = [], []
            for p in b.column(1).to_pylist():
                try:
                    answers.append(model.generate(p or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(f"Error: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[key, "answer", "error"])

    return prompts.select(key, "prompt").mapInArrow(run, f"{key} {prompts.schema[key].dataType.simpleString()}, answer string, error string")


def parse_extraction(answer: Column) -> Column:
    """An answer as the nested record; null where it is no JSON object of that form."""
    return F.from_json(answer, EXTRACTION, {"mode": "PERMISSIVE"})


def mentioned(values: Column) -> Column:
    """The values of a finding's list without the marker for "not mentioned"."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: (x != NOT_MENTIONED) & (F.trim(x) != ""))


def judge(df: DataFrame, score: Callable[[str, str], float], question: str = "question", answer: str = "answer", name: str = "score") -> DataFrame:
    """``df`` with ``name`` in [0, 1] and ``name_reason``; a failed judgement gives null and its message."""
    names = df.columns
    q_at, a_at = names.index(question), names.index(answer)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType()), T.StructField(f"{name}_reason", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, reasons = [], []
            for q, a in zip(b.column(q_at).to_pylist(), b.column(a_at).to_pylist()):
                try:
                    v = float(score(q or "", a or ""))
                    v = v / 10 if 1 < v <= 10 else v / 100 if v > 10 else v
                    scores.append(round(min(1.0, max(0.0, v)), 4))
                    reasons.append("ok")
                except Exception as e:  # noqa: BLE001
                    scores.append(None)
                    reasons.append(f"Error: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(reasons, pa.string())], names=[*names, name, f"{name}_reason"])

    return df.mapInArrow(run, schema)
