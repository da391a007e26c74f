"""Clients of document services for ``DocumentService``. The transport is a function, so they run offline in tests."""

from __future__ import annotations

import base64
import json
import re
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Mapping

from ferrosieve.sources.html import page_parts

Transport = Callable[[str, Mapping[str, str], bytes | None, float], tuple[int, str, bytes]]
_ATOM = "{http://www.w3.org/2005/Atom}"


def http(url: str, headers: Mapping[str, str], body: bytes | None, timeout: float) -> tuple[int, str, bytes]:
    """(status, content type, body) of a request; HTTP errors are answers too."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, dict(headers)), timeout=timeout) as r:
            return r.status, r.headers.get_content_type(), r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get_content_type(), e.read()


class PaperClient:
    """Papers of an Atom service, newest submission first."""

    def __init__(self, options: Mapping[str, str], transport: Transport = http):
        self.base, self.transport = options.get("base", ""), transport

    def search(self, query: str, limit: int) -> Iterator[dict]:
        params = urllib.parse.urlencode({"search_query": query, "max_results": limit, "sortBy": "submittedDate", "sortOrder": "descending"})
        status, _, body = self.transport(f"{self.base}?{params}", {}, None, 20)
        if status != 200:
            raise OSError(f"status {status}")
        for e in ET.fromstring(body).iter(f"{_ATOM}entry"):
            get = lambda tag, e=e: (e.findtext(_ATOM + tag) or "").strip()
            pdf = next((x.get("href") for x in e.iter(f"{_ATOM}link") if x.get("title") == "pdf"), None)
            yield {
                "source": "arxiv", "id": get("id").split("/")[-1], "title": get("title"), "authors": [a.findtext(f"{_ATOM}name") for a in e.iter(f"{_ATOM}author")],
                "abstract": get("summary").replace("\n", " "), "published_date": get("published")[:10], "pdf_url": pdf,
            }


class PatentOfficeClient:
    """Exchange documents of a patent office as JSON texts for ``parse_biblio``; the token is renewed once when it is refused."""

    def __init__(self, options: Mapping[str, str], transport: Transport = http):
        self.options, self.transport, self.token = options, transport, ""

    def _sign_in(self) -> None:
        pair = base64.b64encode(f"{self.options['key']}:{self.options['secret']}".encode()).decode()
        headers = {"Authorization": f"Basic {pair}", "Content-Type": "application/x-www-form-urlencoded"}
        status, _, body = self.transport(self.options["auth"], headers, b"grant_type=client_credentials", 10)
        if status != 200:
            raise OSError(f"sign-in failed with status {status}")
        self.token = json.loads(body)["access_token"]

    def records(self, query: str, limit: int) -> list[str]:
        if not self.token:
            self._sign_in()
        url = f"{self.options['base']}?{urllib.parse.urlencode({'q': query})}"
        for again in (True, False):
            headers = {"Authorization": f"Bearer {self.token}", "Accept": "application/json", "Range": f"1-{limit}"}
            status, _, body = self.transport(url, headers, None, 20)
            if status == 400 and b"oken" in body and again:
                self._sign_in()
                continue
            break
        if status == 404:
            return []
        if status != 200:
            raise OSError(f"status {status}")
        node = json.loads(body)
        for name in self.options.get("path", "ops:world-patent-data/ops:biblio-search/ops:search-result/exchange-documents").split("/"):
            node = node.get(name, {}) if isinstance(node, dict) else {}
        found = node if isinstance(node, list) else [node] if node else []
        return [json.dumps(x) for x in found]


class PatentService(PatentOfficeClient):
    """The same behind ``DocumentService``: each record as a row with its JSON in ``full_text``, for ``parse_biblio`` to read."""

    def search(self, query: str, limit: int) -> Iterator[dict]:
        for text in self.records(query, limit):
            yield {"source": "epo_ops", "full_text": text}


def patent_page(number: str, base: str, transport: Transport = http) -> tuple[str, str]:
    """(abstract, full text) of a patent's page; empty where there is none."""
    try:
        status, _, body = transport(base + re.sub(r"^(US\d{4})0(\d+.*)$", r"\1\2", number), {"User-Agent": "Mozilla/5.0"}, None, 10)
    except OSError:
        return "", ""
    if status != 200:
        return "", ""
    parts = page_parts(body.decode("utf-8", "replace"))
    return parts["abstract"], parts["full_text"]


def pdf_bytes(url: str, transport: Transport = http) -> bytes | None:
    """A PDF's bytes; None for failures and for pages that come instead."""
    try:
        status, kind, body = transport(url, {"User-Agent": "Mozilla/5.0"}, None, 15)
    except OSError:
        return None
    return body if status == 200 and kind != "text/html" and body else None
