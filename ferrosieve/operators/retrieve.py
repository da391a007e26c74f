"""Nearest records by cosine distance, with filters on metadata before ranking."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ferrosieve.config import DEFAULT
from ferrosieve.functions.scalars import cosine_distance

_COMPARE = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
}


def compile_filter(where: Mapping | None) -> Column | None:
    """A filter document as a column; None for no filter."""
    if not where:
        return None
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            cols = [c for c in map(compile_filter, value) if c is not None]
            if cols:
                parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), cols))
        elif isinstance(value, Mapping):
            parts += [_COMPARE[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts) if parts else None


def top_k(index: DataFrame, query: list[float], k: int = DEFAULT.top_k, where: Mapping | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest records of one query: ``id_col``, ``distance``, ``rank``.

    Only id, vector and filter columns are read; ties go by id; zero vectors are left out. Spark keeps k rows a task
    (TakeOrderedAndProject), so nothing is sorted as a whole.
    """
    condition = compile_filter(where)
    rows = index if condition is None else index.where(condition)
    vector = F.array(*[F.lit(float(x)) for x in query])
    near = rows.select(id_col, cosine_distance(F.col(vector_col), vector).alias("distance")).where("distance IS NOT NULL").orderBy("distance", id_col).limit(k)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))


def top_k_batch(index: DataFrame, queries: DataFrame, k: int = DEFAULT.top_k, id_col: str = "id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", block: int = 2_000, most_bytes: int = 256_000_000) -> DataFrame:
    """The k nearest records of each query: ``query_id``, ``id_col``, ``distance``, ``rank``; exact.

    All queries whose vectors fit into ``most_bytes`` are broadcast at once and the index is scanned once; more of them take as many
    scans as that needs. Each Arrow batch of the index is compared with ``block`` queries in one matrix product and keeps its best
    k a query, so what is shuffled is k rows a query and batch, not all pairs.
    """
    spark = index.sparkSession
    numbered = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"))
    total, size = numbered.agg(F.count("*"), F.max(F.size("v"))).first()
    id_type = index.schema[id_col].dataType.simpleString()
    query_type = queries.schema[query_id].dataType.simpleString()
    arrow_type = to_arrow_type(queries.schema[query_id].dataType)
    scans = -(-total * (size or 1) * 8 // most_bytes)
    parts = []
    for i in range(scans):
        mine = numbered if scans == 1 else numbered.where(F.pmod(F.xxhash64("q"), F.lit(scans)) == i)
        held = mine.toArrow()  # about most_bytes
        if not held.num_rows:
            continue
        matrix = held.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(held.num_rows, -1)
        norms = np.linalg.norm(matrix, axis=1)
        shared = spark.sparkContext.broadcast((held.column("q").to_pylist(), matrix / np.where(norms == 0, np.nan, norms)[:, None]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, unit = shared.value
            names = pa.array(ids, arrow_type)
            for b in batches:
                vectors = b.column(1)
                if not len(vectors):
                    continue
                rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
                size = np.linalg.norm(rows, axis=1)
                rows = rows / np.where(size == 0, np.nan, size)[:, None]
                for start in range(0, len(ids), block):
                    distance = 1.0 - rows @ unit[start : start + block].T
                    near = np.where(np.isnan(distance), np.inf, distance)
                    # all ties of the last place stay
                    edge = np.partition(near, k - 1, axis=0)[k - 1] if len(near) > k else np.full(near.shape[1], np.inf)
                    at, q = np.nonzero((near <= edge) & np.isfinite(near))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q + start)), b.column(0).take(pa.array(at)), pa.array(distance[at, q])], names=[query_id, id_col, "distance"])

        parts.append(index.select(id_col, vector_col).where(F.col(vector_col).isNotNull()).mapInArrow(run, f"{query_id} {query_type}, {id_col} {id_type}, distance double"))
    if not parts:
        return spark.createDataFrame([], f"{query_id} {query_type}, {id_col} {id_type}, distance double, rank int")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("distance", id_col)))
    return ranked.where(F.col("rank") <= k)


def with_payload(hits: DataFrame, index: DataFrame, columns: list[str], id_col: str = "id", most: int = 10_000) -> DataFrame:
    """Hits with columns of the index. Up to ``most`` hits are broadcast, so text is read where it lies; more are joined as the planner sees fit."""
    few = hits.limit(most + 1).count() <= most
    return index.select(id_col, *columns).join(F.broadcast(hits) if few else hits, id_col)
