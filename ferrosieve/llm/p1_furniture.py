"""Running headers and page numbers in text read from scanned pages, by their position on the pages.

Pages may be parted by form feeds or not at all. Page numbers are short lines, or ends of header lines, whose
numbers rise by one from page to page. Running headers are short lines that recur although their neighbours
do not, at places where they part a sentence or stand at the edge of a page. Table rows, captions, headings and
repeated passages meet none of this.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

_PURE = re.compile(r"^(\W*(?:page|pag\.?|p\.?|seite|s\.|sheet|blatt|folio)?\s*)(\d{1,4})((?:\s*(?:/|of|von|de)\s*\d{1,4})?\W*)$", re.I)
_LEFT = re.compile(r"^(\d{1,4})\s{2,}(\S.*)$")
_RIGHT = re.compile(r"^(\S.*?)\s{2,}(\d{1,4})$")
_TABLE_ROW = re.compile(r"\s{2,}[-+]?\d+[.,]\d+\s{2,}[-+]?\d+[.,]\d+|\s{2,}\d+\s{2,}\d+|\t")
_CAPTION = re.compile(r"^\W*(table|figure|fig\.|tab\.|algorithm|equation)\s*\d", re.I)
_NUMBERED = re.compile(r"^\W*(\d+[.)]|\[\d+\]|#+)\s")
# Usual headings of papers and patents, which may recur.
_HEADINGS = frozenset(
    """abstract; introduction; background; summary; claims; method; methods; results; conclusion; conclusions; discussion; experiments; evaluation;
references; acknowledgements; appendix; limitations; technical field; related work; sensor model; prior art; brief description of the drawings;
detailed description; experimental setup; future work; state of the art; industrial applicability; description of embodiments; data; approach;
field of the invention; general context; implementation; system overview; ablation study; problem statement; overview""".replace("\n", " ").split("; ")
)
_DIGITS = re.compile(r"\d+")
_ENDS = (".", ":", ";", "!", "?", "。")


@dataclass
class Furniture:
    """Indices of furniture lines, and what the header lines look like."""

    numbers: set[int] = field(default_factory=set)
    headers: set[int] = field(default_factory=set)
    numbered_headers: bool = False

    @property
    def lines(self) -> set[int]:
        return self.numbers | self.headers


def _key(text: str) -> str:
    return " ".join(_DIGITS.sub("#", text.lower()).split())


def _chain(found: list[tuple[int, int]], least_gap: int = 3) -> list[int]:
    """Places of the longest run of (place, number) whose numbers rise by one; a page may be missing."""
    best: dict[int, tuple[int, int]] = {}
    back: dict[int, int] = {}
    top, top_len = -1, 0
    ends: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # number -> (place, index, length)
    for i, (place, number) in enumerate(found):
        length, prev = 1, -1
        for step in (1, 2):
            for p, j, n in ends.get(number - step, ()):
                if place - p >= least_gap and n + (step == 1) >= length:
                    length, prev = n + (1 if step == 1 else 0), j
        back[i] = prev
        ends[number].append((place, i, max(1, length)))
        if length > top_len:
            top, top_len = i, length
    out = []
    while top >= 0:
        out.append(found[top][0])
        top = back[top]
    return out if top_len >= 2 else []


def find_furniture(text: str) -> Furniture:
    out = Furniture()
    lines = text.split("\n")
    bare = [x.strip().strip("\x0c").strip() for x in lines]
    shown = [i for i, x in enumerate(bare) if x]
    pure: dict[str, list[tuple[int, int]]] = defaultdict(list)
    mixed: list[tuple[int, int]] = []
    rest: dict[int, str] = {}
    short = [i for i in shown if len(bare[i]) <= 90]
    for i in short:
        x = bare[i]
        if len(x) <= 24 and x[-1:] != "." and (m := _PURE.match(x)):
            pure[re.sub(r"\s+|\d+", "", m.group(1) + "#" + m.group(3)).lower()].append((i, int(m.group(2))))
        elif (x[0].isdigit() or x[-1].isdigit()) and "  " in x and not _TABLE_ROW.search(x) and (m := _LEFT.match(x) or _RIGHT.match(x)):
            number, head = (m.group(1), m.group(2)) if m.re is _LEFT else (m.group(2), m.group(1))
            mixed.append((i, int(number)))
            rest[i] = head
    for places in pure.values():
        out.numbers.update(_chain(places))
    chain = _chain(mixed)
    if chain:
        keys = defaultdict(int)
        for i in chain:
            keys[re.sub(r"[^a-z]", "", rest[i].lower())] += 1
        if len(keys) <= max(2, len(chain) // 2) or len(chain) >= 3:
            out.numbers.update(chain)
            out.numbered_headers = True
            if len(chain) >= 2:
                out.headers.update(chain)

    order = {i: n for n, i in enumerate(shown)}

    def neighbour(i: int, step: int) -> int:
        n = order[i] + step
        while 0 <= n < len(shown) and shown[n] in out.numbers:
            n += step
        return shown[n] if 0 <= n < len(shown) else -1

    groups: dict[str, list[int]] = defaultdict(list)
    for i in short:
        x = bare[i]
        if x[0].islower() or len(x) < 4 or x[-1] in ".,;:-\xad¬‐" and not x.endswith(("...", "et al.")):
            continue
        if i not in out.headers and i not in out.numbers:
            groups[_DIGITS.sub("#", x.lower())].append(i)
    for places in groups.values():
        if len(places) < 2:
            continue
        x = bare[places[0]]
        if _TABLE_ROW.search(x) or _CAPTION.match(x) or _NUMBERED.match(x) or _PURE.match(x) or re.sub(r"[^a-z ]", "", x.lower()).strip() in _HEADINGS:
            continue
        before = [bare[j] if (j := neighbour(i, -1)) >= 0 else "" for i in places]
        after = [bare[j] if (j := neighbour(i, 1)) >= 0 else "" for i in places]
        n = len(places)
        steps = [b - a for a, b in zip(places, places[1:])]
        if n >= 3 and min(steps) >= 8 and max(steps) - min(steps) <= 3:  # once a page of even length
            out.headers.update(places)
            continue
        if len({_key(x) for x in before}) < 0.6 * n or len({_key(x) for x in after}) < 0.6 * n:
            continue  # a passage that comes again
        parts = sum(bool(b) and not b.endswith(_ENDS) and (len(b) > 25 or bool(a) and a[0].islower()) for b, a in zip(before, after))
        edge = 0
        for i in places:
            here = order[i]
            near = [shown[k] for k in (here - 1, here + 1) if 0 <= k < len(shown)]
            edge += lines[i].startswith("\x0c") or any(j in out.numbers for j in near) or (here + 1 < len(shown) and lines[shown[here + 1]].startswith("\x0c")) or any(lines[j].startswith("\x0c") for j in range(i, min(i + 2, len(lines))))
        if parts >= 0.4 * n or edge >= 0.5 * n:
            out.headers.update(places)
    if out.headers:  # the same header, misread somewhere
        letters = {re.sub(r"[^a-z]", "", _key(rest.get(i, bare[i]))) for i in out.headers}
        for i in short:
            if i not in out.headers and i not in out.numbers and len(bare[i]) >= 6:
                mine = re.sub(r"[^a-z]", "", _key(rest.get(i, bare[i])))
                if len(mine) >= 6 and any(abs(len(mine) - len(x)) <= 2 and sum(a == b for a, b in zip(mine, x)) >= 0.85 * max(len(mine), len(x)) for x in letters):
                    out.headers.add(i)
    return out
