"""Which batches of a table are taken together when its history is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame


def consecutive(df: DataFrame, batch_col: str, least_rows: int) -> list[tuple[int, int]]:
    """(first, last) batch number of each load: one batch, or neighbours that have fewer than ``least_rows`` rows together.

    A load has fixed costs, and what it gives does not depend on how the batches are put together. One row a batch reaches the driver.
    """
    loads: list[list[int]] = []
    held = least_rows
    for batch, n in sorted(map(tuple, df.groupBy(batch_col).count().collect())):
        if held >= least_rows:
            loads.append([batch, batch])
            held = 0
        loads[-1][1] = batch
        held += n
    return [(a, b) for a, b in loads]
