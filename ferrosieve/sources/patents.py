"""Patent records out of the bibliographic JSON of a patent office: every node may be an object or a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAF = "struct<`$`:string>"

from ferrosieve.functions.scalars import title_cases


def _node(v: Column, path: str, kind: str) -> Column:
    """The node at a path as a list of ``kind``, whether it is an object, a list or absent."""
    as_list = F.from_json(F.try_variant_get(v, path, "string"), f"array<{kind}>")
    single = F.from_json(F.concat(F.lit("["), F.try_variant_get(v, path, "string"), F.lit("]")), f"array<{kind}>")
    raw = F.ltrim(F.try_variant_get(v, path, "string"))
    return F.coalesce(F.when(raw.startswith("["), as_list).otherwise(single), F.expr(f"cast(array() as array<{kind}>)"))


def _leaf(c: Column) -> Column:
    return c.getField("$")


def _dashed(d: Column) -> Column:
    return F.when(d.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def parse_biblio(records: DataFrame, json_col: str = "json") -> DataFrame:
    """Documents out of one exchange document per row, by expressions only."""
    v = F.parse_json(F.col(json_col))
    quoted = "$['exchange-document']['bibliographic-data']"
    ids = _node(v, f"{quoted}['publication-reference']['document-id']", f"struct<country:{_LEAF},`doc-number`:{_LEAF},kind:{_LEAF},date:{_LEAF}>")
    titles = _node(v, f"{quoted}['invention-title']", "struct<`@lang`:string,`$`:string>")
    claims = _node(v, f"{quoted}['priority-claims']['priority-claim']", "struct<`document-id`:string>")
    applicants = _node(v, f"{quoted}.parties.applicants.applicant", f"struct<`applicant-name`:struct<name:{_LEAF}>>")
    inventors = _node(v, f"{quoted}.parties.inventors.inventor", f"struct<`inventor-name`:struct<name:{_LEAF}>>")
    ipcr = _node(v, f"{quoted}['classifications-ipcr']['classification-ipcr']", f"struct<text:{_LEAF}>")
    cpc = _node(v, f"{quoted}['patent-classifications']['patent-classification']", f"struct<section:{_LEAF},class:{_LEAF},subclass:{_LEAF},`main-group`:{_LEAF},subgroup:{_LEAF}>")
    abstracts = _node(v, "$['exchange-document'].abstract", "struct<`@lang`:string,p:string>")
    raw = records.select(
        F.try_element_at(ids, F.lit(1)).alias("ref"), titles.alias("titles"), claims.alias("claims"), applicants.alias("applicants"),
        inventors.alias("inventors"), ipcr.alias("ipcr"), cpc.alias("cpc"), abstracts.alias("abstracts"),
    )
    part = lambda name, default: F.coalesce(_leaf(F.col("ref").getField(name)), F.lit(default))
    number = F.concat(part("country", "US"), part("doc-number", "unknown"), part("kind", "A1"))
    date = F.coalesce(_dashed(part("date", "")), F.lit("Unknown"))
    prio_dates = F.flatten(F.transform("claims", lambda c: F.regexp_extract_all(c.getField("document-id"), F.lit(r'"date"\s*:\s*\{\s*"\$"\s*:\s*"(\d{8})"'), F.lit(1))))
    first_prio = _dashed(F.array_min(prio_dates))
    english = lambda nodes: F.try_element_at(F.filter(nodes, lambda n: n.getField("@lang") == "en"), F.lit(1))
    names = lambda nodes, a: F.filter(F.transform(nodes, lambda n: F.trim(n.getField(a).getField("name").getField("$"))), lambda x: x.isNotNull() & (x != ""))
    ipcr_codes = F.transform("ipcr", lambda n: F.concat_ws(" ", F.nullif(F.regexp_extract(_leaf(n.getField("text")), r"([A-H]\d{2}[A-Z])\s+(\d{1,4}/\d{2,6})", 1), F.lit("")), F.nullif(F.regexp_extract(_leaf(n.getField("text")), r"([A-H]\d{2}[A-Z])\s+(\d{1,4}/\d{2,6})", 2), F.lit(""))))
    g = lambda n, k: _leaf(n.getField(k))
    cpc_codes = F.transform("cpc", lambda n: F.concat(g(n, "section"), g(n, "class"), g(n, "subclass"), F.lit(" "), g(n, "main-group"), F.lit("/"), g(n, "subgroup")))
    codes = F.array_distinct(F.filter(F.concat(ipcr_codes, cpc_codes), lambda x: x.isNotNull() & (x != "")))
    p = english(F.col("abstracts")).getField("p")
    text = F.when(p.startswith("{"), F.get_json_object(p, "$['$']")).when(
        p.startswith("["), F.array_join(F.transform(F.from_json(p, "array<string>"), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$['$']")).otherwise(x)), " ")
    ).otherwise(p)
    label = F.when(F.upper(part("kind", "A1")).startswith("B"), "Grant Date").otherwise("Publication Date")
    dates = F.concat(label, F.lit(": "), date, F.coalesce(F.concat(F.lit(" (Priority Date: "), first_prio, F.lit(")")), F.lit("")))
    filled = lambda c: F.when(F.size(c) > 0, c)
    people = title_cases(names(F.col("inventors"), "inventor-name"))
    return raw.select(
        F.lit("epo_ops").alias("source"), number.alias("id"), F.coalesce(_leaf(english(F.col("titles"))), F.lit("Untitled Patent")).alias("title"),
        F.coalesce(filled(people), F.array(F.lit("Unknown Inventor"))).alias("authors"), F.coalesce(text, F.lit("No abstract available.")).alias("abstract"),
        date.alias("published_date"), number.alias("publication_number"), filled(F.array_distinct(names(F.col("applicants"), "applicant-name"))).alias("affiliated_institutions"),
        filled(codes).alias("patent_classifications"), F.when(date != "Unknown", dates).alias("priority_or_grant_date"),
    )
