"""Problem 9: filling containers of fixed capacity.

Method: bulk-synchronous best fit. Documents and gaps are kept in order of size; in each step all
documents of one size look up their successor gap (the smallest that holds them), conflicts over
containers are resolved by rank, the gaps are updated, and the next step follows with the next smaller
size. Documents of equal size are interchangeable, so the sweep runs on size classes: its state is a
histogram of at most ``capacity`` rows and a table of rank intervals, whatever the number of documents.
Only the histogram reaches the driver. The documents themselves are ranked within their size on the
executors (sizes with many documents are split by salts from their counts, offsets come from counts) and find their container through a
join with the interval table.

Defined results: a text above the capacity is cut into full containers and one rest; no other item is
split. Null and empty texts have n_tokens 0 and no container (null). Repeated rows are items of their
own. An empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrosieve.llm.p8_encode import token_counts
from ferrosieve.tables import settle

#: Interval tables up to so many rows are broadcast (40 bytes a row); longer ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (size, first rank, end rank, first container, items per container), and the containers used.

    Sizes are swept from the largest; of each, every gap takes as many as fit, tightest gaps first, which
    is what best fit does with a run of equal items.
    """
    groups: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    used = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((first, count))

    def place(size: int, rank: int, left: int, gap: int, first: int, count: int) -> tuple[int, int]:
        """Fill up to ``count`` containers from ``first``; returns the items placed and containers touched."""
        each = gap // size
        whole = min(count, left // each)
        if whole:
            out.append((size, rank, rank + whole * each, first, each))
            put(gap - each * size, first, whole)
        placed, rest = whole * each, left - whole * each
        if whole < count and 0 < rest < each:
            out.append((size, rank + placed, rank + placed + rest, first + whole, rest))
            put(gap - rest * size, first + whole, 1)
            return placed + rest, whole + 1
        return placed, whole

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left and (i := bisect_left(gaps, size)) < len(gaps):
            gap = gaps[i]
            first, count = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                del gaps[i]
            placed, touched = place(size, rank, left, gap, first, count)
            put(gap, first + touched, count - touched)
            rank, left = rank + placed, left - placed
        if left:
            fresh = -(-left // (capacity // size))
            place(size, rank, left, capacity, used, fresh)
            used += fresh
    return out, used


def pack(sizes: DataFrame, capacity: int = 2048, id_col: str = "doc_id", size_col: str = "n_tokens", rows_per_task: int = 500_000) -> DataFrame:
    """Containers of a table of ids and sizes.

    One row per piece: ``id_col``, ``piece_no`` from 0, ``first_unit`` (offset in the item), ``n_units``,
    ``container_id``. A size of more than ``rows_per_task`` pieces is ranked in as many parts as that takes.
    """
    spark = sizes.sparkSession
    n = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    cut = F.when(n <= capacity, F.array(n)).otherwise(
        F.concat(F.array_repeat(F.lit(capacity).cast("long"), (n / capacity).cast("int")), F.filter(F.array(n % capacity), lambda x: x > 0))
    )
    pieces = sizes.select(F.col(id_col), F.posexplode(cut).alias("piece_no", "n_units"))
    pieces = settle(pieces.select(id_col, "piece_no", (F.col("piece_no") * F.lit(capacity).cast("long")).alias("first_unit"), "n_units"), "p9-pieces")
    histogram = {r.n_units: r.n for r in pieces.where("n_units > 0").groupBy("n_units").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    salts = {size: -(-n // rows_per_task) for size, n in histogram.items()}
    crowded = [F.struct(F.lit(size).cast("long").alias("size"), F.lit(k).alias("k")) for size, k in sorted(salts.items()) if k > 1]  # at most `capacity` entries
    parts_of = F.coalesce(F.element_at(F.map_from_entries(F.array(*crowded)), F.col("n_units")), F.lit(1)) if crowded else F.lit(1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece_no"), parts_of.cast("long")))
    intervals, _ = best_fit(histogram, capacity)
    plan = spark.createDataFrame(intervals or [(0, 0, 0, 0, 1)], "n_units long, lo long, hi long, base long, each long")
    offsets = salted.where("n_units > 0").groupBy("n_units", "salt").agg(F.count("*").alias("n"))
    offsets = offsets.withColumn("offset", F.sum("n").over(Window.partitionBy("n_units").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("n_units", "salt", F.coalesce("offset", F.lit(0)).alias("offset"))  # one row a size and salt
    local = F.row_number().over(Window.partitionBy("n_units", "salt").orderBy(id_col, "piece_no")) - 1
    few = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    ranked = salted.withColumn("local", local).join(few(offsets, sum(salts.values())), ["n_units", "salt"], "left").withColumn("rank", F.col("local") + F.col("offset"))
    p, r = few(plan, len(intervals)).alias("p"), ranked.alias("r")
    at = (F.col("r.n_units") == F.col("p.n_units")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    container = F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))
    return r.join(p, at, "left").select(f"r.{id_col}", "piece_no", "first_unit", F.col("r.n_units").alias("n_units"), container.cast("long").alias("container_id"))


def pack_texts(df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Containers of texts measured in tokens of a public tokenizer."""
    sizes = df.select(F.col(id_col), token_counts(F.col(text_col), vocabulary).alias("n_tokens"))
    return pack(sizes, capacity, id_col, "n_tokens")
