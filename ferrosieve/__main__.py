"""``python -m ferrosieve reload --index PATH --folder PATH`` and ``python -m ferrosieve ask --index PATH``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ferrosieve.operators.index import VectorIndex
from ferrosieve.plans import pipeline
from ferrosieve.sources.files import local_documents


def main() -> None:
    parser = argparse.ArgumentParser(prog="ferrosieve")
    parser.add_argument("command", choices=("reload", "ask"))
    parser.add_argument("--index", required=True)
    parser.add_argument("--folder")
    parser.add_argument("--top-k", type=int)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("ferrosieve").getOrCreate()
    pipeline.set_up_logging()
    index = VectorIndex(spark, args.index)
    if args.command == "reload":
        print(pipeline.reload(local_documents(spark, args.folder), index), "chunks")
        return
    while (question := input("question (exit ends)> ").strip()).lower() not in ("exit", "quit"):
        if not question:
            continue
        if not index.count():
            print("the index is empty")
            continue
        made, hits = pipeline.answer(spark, index.read(), question, args.top_k)
        print(made.first().answer)
        for h in hits.orderBy("hit_rank").select("hit_rank", "id", "distance").collect():
            print(f"{h.hit_rank}. {h.id} ({h.distance:.4f})")


if __name__ == "__main__":
    main()
