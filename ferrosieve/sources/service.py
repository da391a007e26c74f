"""A Python data source for document services. The client is pluggable; offline a folder of JSON lines stands in."""

from __future__ import annotations

import glob
import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ferrosieve.schemas import DOCUMENT


class FolderClient:
    """Documents of ``<path>/*.jsonl``, newest first, as a service would answer."""

    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")

    def search(self, query: str, limit: int) -> Iterator[dict]:
        rows = []
        for name in sorted(glob.glob(f"{self.path}/*.jsonl")):
            with open(name, encoding="utf-8") as f:
                rows += [json.loads(line) for line in f if line.strip()]
        rows.sort(key=lambda r: r.get("published_date") or "", reverse=True)
        yield from rows[:limit]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # one request stream: services limit the rate

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.options.get("client", "ferrosieve.sources.service:FolderClient").partition(":")
        client = getattr(importlib.import_module(module), name)(self.options)
        for row in client.search(self.options.get("query", ""), int(self.options.get("limit", "5"))):
            yield tuple((row.get(f.name) or "").replace("\n", " ") if f.name == "abstract" and row.get(f.name) else row.get(f.name) for f in DOCUMENT.fields)


class DocumentService(DataSource):
    """``spark.read.format("document_service").option("client", "module:Class").option("query", q).option("limit", n)``."""

    @classmethod
    def name(cls) -> str:
        return "document_service"

    def schema(self) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DOCUMENT.fields)

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()} | dict(self.options))
