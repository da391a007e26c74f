"""Text of patent pages: abstract, claims and description by their ``itemprop``."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style"))


class _Parts(HTMLParser):
    """Text nodes of the first element with each wanted ``itemprop``, and of ``title``."""

    def __init__(self, wanted: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.wanted = wanted
        self.nodes: dict[str, list[str]] = {}
        self.open: list[tuple[str, str | None]] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        prop = dict(attrs).get("itemprop")
        name = "title" if tag == "title" else prop if prop in self.wanted else None
        if name in self.nodes:
            name = None
        if name:
            self.nodes[name] = []
        if tag in _VOID:
            return
        self.silent += tag in _SILENT
        self.open.append((tag, name))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.silent -= sum(t in _SILENT for t, _ in self.open[i:])
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.silent and (s := data.strip()):
            for name in {n for _, n in self.open if n}:
                self.nodes[name].append(s)


def page_parts(html: str | None) -> dict[str, str]:
    """``title``, ``abstract`` and ``full_text`` of a page; missing parts are empty."""
    if not html:
        return {"title": "", "abstract": "", "full_text": ""}
    parser = _Parts(("abstract", "claims", "description"))
    try:
        parser.feed(html)
        parser.close()
    except Exception:  # noqa: BLE001  a broken page has no parts
        return {"title": "", "abstract": "", "full_text": ""}
    get = lambda name, by: by.join(parser.nodes.get(name, []))
    abstract = re.sub(r"(?i)^abstract\s*[:\-]*\s*", "", get("abstract", " "))
    claims, description = get("claims", "\n"), get("description", "\n")
    text = (f"# Claims\n{claims}\n\n" if claims else "") + (f"# Detailed Description\n{description}\n" if description else "")
    return {"title": get("title", " "), "abstract": abstract, "full_text": text}


def html_parts(html: Column) -> Column:
    """Arrow UDF over ``page_parts``."""

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([page_parts(p) for p in pages.to_pylist()], pa.struct([("title", pa.string()), ("abstract", pa.string()), ("full_text", pa.string())]))

    return F.arrow_udf(run, "struct<title:string,abstract:string,full_text:string>", ArrowUDFType.SCALAR)(html)


def page_id(number: Column) -> Column:
    """A US application number without the zero that the page service leaves out."""
    return F.regexp_replace(number, r"^(US\d{4})0(\d+.*)$", "$1$2")
