"""Queries pN_... of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrosieve.llm import p1_repair, p2_ledger, p3_split, p4_history, p5_names, p6_pairs, p7_canon, p8_encode, p9_pack, p10_stuffing
from ferrosieve.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_repair.found(spread(table(spark, d, "doc_records"), "row_id"))


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    return p1_repair.repaired(spread(table(spark, d, "doc_records"), "row_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_ledger.found(table(spark, d, "doc_records"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return p2_ledger.counts(table(spark, d, "doc_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_split.found(spread(table(spark, d, "doc_records"), "row_id"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return p3_split.split_documents(spread(table(spark, d, "doc_records"), "row_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_history.found(table(spark, d, "doc_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_names.found(table(spark, d, "doc_records"))


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    return p5_names.members(table(spark, d, "doc_records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs.found(spread(table(spark, d, "gen_checkpoint"), "pair_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_canon.match(table(spark, d, "perception_findings"), table(spark, d, "canon_terms"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return p8_encode.encode(spread(table(spark, d, "documents"), "doc_id"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return p9_pack.pack_texts(spread(table(spark, d, "documents"), "doc_id"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_stuffing.found(table(spark, d, "documents"))


def p10_evidence(spark: SparkSession, d: str) -> DataFrame:
    return p10_stuffing.evidence(spread(table(spark, d, "documents"), "doc_id"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_text, p2_found, p2_counts, p3_found, p3_pieces, p4_found, p5_found, p5_members, p6_found, p7_found, p8_ids, p9_containers, p10_found, p10_evidence)}

# The canonical form of a field: points and commas between digits are kept under two private letters.
_CANON = r"""replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  upper(coalesce({0}, '')), '([0-9])\.([0-9])', '\1\x{{E000}}\2', 'g'), '([0-9])\.([0-9])', '\1\x{{E000}}\2', 'g'),
  '([0-9]),([0-9])', '\1\x{{E001}}\2', 'g'), '([0-9]),([0-9])', '\1\x{{E001}}\2', 'g'),
  '[\p{{P}}\p{{Z}}\p{{Cc}}\p{{Cf}}]', '', 'g'), chr(57344), '.'), chr(57345), ',')""".replace(r"\x{{E000}}", "").replace(r"\x{{E001}}", "")

_P2_KEYS = f"""WITH c AS (SELECT row_id, {_CANON.format("title")} AS t, {_CANON.format("abstract")} AS a FROM doc_records),
k AS (SELECT row_id, least(t, a) AS x, greatest(t, a) AS y FROM c)"""

ORACLES: dict[str, str] = {
    "p2_found": f"""{_P2_KEYS}, g AS (SELECT row_id, min(row_id) OVER (PARTITION BY x, y) AS first_row_id FROM k)
SELECT first_row_id, row_id AS copy_row_id FROM g WHERE row_id > first_row_id""",
    "p2_counts": f"""{_P2_KEYS} SELECT min(row_id) AS first_row_id, count(*) AS copies FROM k GROUP BY x, y""",
    "p3_found": r"""WITH big AS (SELECT row_id, full_text FROM doc_records WHERE length(full_text) > 2500),
l AS (SELECT row_id, unnest(string_split(full_text, chr(10))) AS line, generate_subscripts(string_split(full_text, chr(10)), 1) AS n FROM big),
b AS (SELECT *, regexp_full_match(line, '[\t-\r\x1c-\x20\x{85}\p{Z}]*') AS blank FROM l),
s AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY n) AS part FROM b),
t AS (SELECT row_id, part, sum(length(line) + 1) - 1 AS len FROM s WHERE NOT blank GROUP BY row_id, part),
m AS (SELECT row_id, max(len) AS stretch FROM t GROUP BY row_id),
w AS (SELECT row_id, max(length(line)) AS line FROM l GROUP BY row_id),
r AS (SELECT row_id, list_max(list_transform(string_split_regex(full_text, '[\t-\r\x1c-\x20\x{85}\p{Z}]+'), lambda x: length(x))) AS run FROM big)
SELECT big.row_id, CASE WHEN coalesce(stretch, 0) <= 2500 THEN 'blank_line' WHEN line <= 2500 THEN 'line' WHEN run <= 2500 THEN 'space' ELSE 'none' END AS cut_at
FROM big LEFT JOIN m ON m.row_id = big.row_id JOIN w ON w.row_id = big.row_id JOIN r ON r.row_id = big.row_id""",
}
