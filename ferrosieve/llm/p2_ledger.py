"""Problem 2: records that differ only in whitespace, letter case, punctuation or field order.

Method: an incremental ledger. Each record is reduced to a canonical key of 16 bytes. The ledger holds, in
buckets of the key, how many copies each key has had and its earliest row. It lies in a folder as a few runs of falling
size. A batch is aggregated by key first, then full-outer-joined with the smallest runs, those of at most twice the rows that are
to be written; counts are added and the earliest representative stays. Larger runs are neither read nor written, so a key is
written anew about once for each doubling of the ledger, not once a batch. A reader adds the runs up by key, or looks keys
up in the buckets into which they fall. Records of earlier batches are never read again.

Because a batch is aggregated before the join, a key that holds a third of all rows is one row in it.
The members of repeated keys are found by an equality join with the ledger, whose side has one row a key,
so a hot key only makes one side skewed, which adaptive execution splits.

Defined results: null and empty fields are the same; a record with both fields blank is a record like
any other; repeated rows count; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrosieve.llm.loads import consecutive
from ferrosieve.store import Run, Versions, read_runs, touched_buckets, write_run
from ferrosieve.tables import fresh_path, measured, settle

# All punctuation, separators, control and format characters; a point or comma between digits stays.
IGNORED = r"(?<!\p{Nd})[.,]|[.,](?!\p{Nd})|[\p{P}\p{Z}\p{Cc}\p{Cf}&&[^.,]]"


def canonical(text: Column) -> Column:
    """Upper-cased text without whitespace and punctuation; null gives the empty string."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), IGNORED, "")


def key(*fields: Column) -> Column:
    """16-byte key of the canonical fields in any order."""
    parts = F.array_sort(F.array(*[canonical(c) for c in fields]))
    return F.unhex(F.md5(F.array_join(parts, "\u0000").cast("binary")))


class Ledger:
    """Counts and earliest rows of canonical keys, in a folder that lasts."""

    SCHEMA = "key binary, n long, first_row_id long"

    def __init__(self, spark: SparkSession, folder: str, bucket_rows: int = 1_000_000):
        self.versions = Versions(spark, folder)
        self.number, state = self.versions.newest()
        self.state = state or {"bucket_rows": bucket_rows, "runs": [], "old": [], "rewritten": 0}

    @staticmethod
    def open(spark: SparkSession, folder: str, **sizes: int) -> Ledger:
        """The ledger of a folder; an empty one where there is none."""
        return Ledger(spark, folder, **sizes)

    @property
    def runs(self) -> list[Run]:
        return [Run.load(r) for r in self.state["runs"]]

    def read(self) -> DataFrame:
        """key, n, first_row_id of every key; each is one row."""
        return self._put_together(read_runs(self.versions, self.SCHEMA, self.runs))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The same for the column ``key`` of ``keys``; only buckets into which a key falls are opened."""
        touched = touched_buckets(keys, self.runs, lambda n: _bucket(n))
        return self._put_together(read_runs(self.versions, self.SCHEMA, self.runs, touched).join(keys.select("key").distinct(), "key", "left_semi"))

    def _put_together(self, rows: DataFrame) -> DataFrame:
        return rows if len(self.runs) < 2 else rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("first_row_id").alias("first_row_id"))

    def update(self, keyed: DataFrame) -> None:
        """Add a batch of (row_id, key): aggregated by key, then full-outer-joined with the runs that are no larger than twice what is to be written."""
        batch, figures = measured(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row_id")), "p2-batch")
        runs, rows, merged, taken = sorted(self.runs, key=lambda r: -r.rows), figures["rows"], batch, []
        if rows == 0:
            return
        while runs and runs[-1].rows <= 2 * rows:
            run = runs.pop()
            taken.append(run)
            rows += run.rows
            o, b = read_runs(self.versions, self.SCHEMA, [run]).alias("o"), merged.alias("b")
            merged = o.join(b, F.col("o.key") == F.col("b.key"), "full_outer").select(
                F.coalesce("o.key", "b.key").alias("key"),
                (F.coalesce("o.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"),
                F.least("o.first_row_id", "b.first_row_id").alias("first_row_id"),
            )
        of = -(-rows // self.state["bucket_rows"])
        new = write_run(self.versions, merged, "ledger", _bucket(of), of, "key")
        rewritten = self.state["rewritten"] + sum(r.rows for r in taken)
        state = {**self.state, "runs": [r.save() for r in [*runs, new]], "old": [r.name for r in taken], "rewritten": rewritten}
        self.versions.publish(self.number + 1, state)
        for name in self.state["old"]:  # superseded one batch ago
            self.versions.drop(name)
        self.number, self.state = self.number + 1, state


def _bucket(of: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(of))


def keyed_records(df: DataFrame, fields: tuple[str, ...] = ("title", "abstract"), id_col: str = "row_id", batch_col: str = "batch_no") -> DataFrame:
    """(row_id, batch_no, key), written once: 28 bytes a record is all that later steps read."""
    return settle(df.select(F.col(id_col).alias("row_id"), F.col(batch_col).alias("batch_no"), key(*[F.col(f) for f in fields]).alias("key")), "p2-keys")


def build(keyed: DataFrame, folder: str | None = None, bucket_rows: int = 1_000_000, least_rows: int = 1000) -> Ledger:
    """The ledger after all batches, each added in its turn (neighbours of fewer than ``least_rows`` rows together as one).

    Without a ``folder`` it is kept until the driver ends.
    """
    spark = keyed.sparkSession
    ledger = Ledger.open(spark, folder or fresh_path(spark, "p2-ledger"), bucket_rows=bucket_rows)
    for first, last in consecutive(keyed, "batch_no", least_rows):
        ledger.update(keyed.where(F.col("batch_no").between(first, last)).select("row_id", "key"))
    return ledger


def found(df: DataFrame) -> DataFrame:
    """``first_row_id`` and ``copy_row_id`` of every copy of an earlier record."""
    keyed = keyed_records(df)
    repeated = build(keyed).read().where("n > 1").select("key", "first_row_id")
    return keyed.join(repeated, "key").where("row_id > first_row_id").select("first_row_id", F.col("row_id").alias("copy_row_id"))


def counts(df: DataFrame) -> DataFrame:
    """``first_row_id`` of every distinct record and its number of copies."""
    return build(keyed_records(df)).read().select("first_row_id", F.col("n").alias("copies"))
