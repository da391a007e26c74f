"""One document for each domain, none twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_unseen(candidates: DataFrame, domains: list[str], order: str, prefer: str | None = None, key: str = "doc_id", domain: str = "domain") -> list[tuple[str, str]]:
    """(domain, key) of the first candidate of each domain that no earlier domain took; preferred rows come first.

    Only the best ``len(domains)`` candidates of a domain can be needed, so no more reach the driver.
    """
    rank = Window.partitionBy(domain).orderBy(*([F.col(prefer).desc_nulls_last()] if prefer else []), order, key)
    best = candidates.where(F.col(domain).isin(domains)).withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= len(domains))
    rows = best.select(domain, key, "_n").orderBy("_n").collect()
    taken: dict[str, str] = {}
    for d in domains:
        pick = next((r[key] for r in rows if r[domain] == d and r[key] not in taken.values()), None)
        if pick is not None:
            taken[d] = pick
    return list(taken.items())
