"""Problem 3: splitting oversized texts at natural boundaries.

Method: agglomerative merging. A text is cut into atomic segments: the stretches between blank lines;
where a stretch is too long its lines; where a line is too long its sentences and words; where a word
is too long equal parts. Adjacent segments stand in a heap by the strength of the boundary between them;
the weakest boundary is merged first, smaller unions before larger ones, as long as the union and the
overlap to come fit the limit. The pieces cover the text without a gap; each but the first also repeats up to
``overlap`` characters of the piece before it, from a word start where there is one.

All of a text is handled in one row-local function, so the operator is narrow and has no shuffle.

Defined results: null texts and texts within the limit are one piece (null: no piece) of level ``whole``;
lengths count code points; whitespace is what ``str.isspace`` says; only LF ends a line.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

# Strength of boundaries; the weakest are merged first.
GLUE, RUN, WORD, SENTENCE, LINE, BLANK = range(6)
LEVELS = ("whole", "blank_line", "line", "space", "none")
_WORD = re.compile(r"\S+\s*|\s+")
_SENTENCE_END = re.compile(r"[.!?。！？][\"'”’)\]]*$")


def _atoms(text: str, limit: int, step: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Index in LEVELS of the finest cut needed, and the segments (start, end, strength of the boundary at the end)."""
    atoms: list[tuple[int, int, int]] = []
    level = 1

    def blanks(s: int, e: int, strength: int) -> None:
        while s < e:
            m = min(e, s + step)
            atoms.append((s, m, strength if m == e else RUN))
            s = m

    def words(s: int, e: int, strength: int) -> None:
        nonlocal level
        for m in _WORD.finditer(text, s, e):
            a, b = m.span()
            core = a + len(m.group().rstrip())
            last = strength if b == e else SENTENCE if _SENTENCE_END.search(text, max(a, core - 8), core) else WORD
            if core - a > limit:
                level = 4
                while core - a > step:
                    atoms.append((a, a + step, RUN))
                    a += step
                atoms.append((a, core, GLUE if core < b else last))
                blanks(core, b, last)
            elif b - a > limit:
                atoms.append((a, core, GLUE))
                blanks(core, b, last)
            else:
                atoms.append((a, b, last))

    def lines(s: int, e: int) -> None:
        nonlocal level
        while s < e:
            at = text.find("\n", s, e)
            core = e if at < 0 else at
            nxt = e if at < 0 else at + 1
            strength = BLANK if nxt == e else LINE
            if core - s > limit:
                level = max(level, 3)
                words(s, nxt, strength)
            elif nxt - s > limit:
                atoms.append((s, core, GLUE))
                atoms.append((core, nxt, strength))
            else:
                atoms.append((s, nxt, strength))
            s = nxt

    start, pos, n, core = 0, 0, len(text), -1  # core: the end of the present stretch's last line
    stretches: list[tuple[int, int, int]] = []
    while pos <= n:
        at = text.find("\n", pos)
        end = n if at < 0 else at
        blank = pos == end or text[pos:end].isspace()
        if not blank:
            if core >= 0 and pos > core + 1:  # blank lines came between
                stretches.append((start, core, pos))
                start = pos
            core = end
        pos = end + 1
    stretches.append((start, core, n))
    for s, core, e in stretches:
        first = s
        if core < 0:
            blanks(s, e, BLANK)
            continue
        if s == 0:  # blank lines before the first stretch
            lead = 0
            while (at := text.find("\n", lead)) >= 0 and at < core and (lead == at or text[lead:at].isspace()):
                lead = at + 1
            blanks(0, lead, BLANK)
            first = lead
        if core - first > limit:
            level = max(level, 2)
            lines(first, core)
            s_, e_, _ = atoms.pop()
            atoms.append((s_, e_, GLUE if core < e else BLANK))
            blanks(core, e, BLANK)
        elif e - first > limit:
            atoms.append((first, core, GLUE))
            blanks(core, e, BLANK)
        else:
            atoms.append((first, e, BLANK))
    return level, atoms


def split_text(text: str | None, limit: int = 2500, overlap: int = 250) -> tuple[str, list[tuple[int, int]]]:
    """The finest cut that the text needs (a member of LEVELS), and the pieces as (start, end)."""
    if text is None:
        return LEVELS[0], []
    if len(text) <= limit:
        return LEVELS[0], [(0, len(text))]
    level, atoms = _atoms(text, limit, limit - overlap)
    n = len(atoms)
    start, end = [a[0] for a in atoms], [a[1] for a in atoms]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(atoms[i][2], end[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        strength, size, i, j = heapq.heappop(heap)
        if not alive[i] or not alive[j] or end[j] - start[i] != size:
            continue
        if size + (overlap if start[i] else 0) > limit:
            continue
        end[i], alive[j] = end[j], False
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            heapq.heappush(heap, (atoms[k - 1][2], end[k] - start[i], i, k))
        if prv[i] >= 0:
            heapq.heappush(heap, (atoms[i - 1][2], end[i] - start[prv[i]], prv[i], i))
    pieces: list[tuple[int, int]] = []
    before = 0
    for i in range(n):
        if alive[i]:
            s = start[i]
            if pieces:
                s = max(before, s - max(0, min(overlap, limit - (end[i] - start[i]))))
                if 0 < s < start[i] and not text[s - 1].isspace():
                    m = re.compile(r"\s+").search(text, s, start[i])
                    s = m.end() if m else s
            pieces.append((s, end[i]))
            before = start[i]
    return LEVELS[level], pieces


_CUT = "struct<cut_at:string,pieces:array<struct<start:int,end:int>>>"


def cuts(texts: Column, limit: int = 2500, overlap: int = 250) -> Column:
    """Arrow UDF over ``split_text``: struct of cut_at and pieces."""

    def run(col: pa.Array) -> pa.Array:
        levels, starts, ends, offsets = [], [], [], [0]
        for t in col.to_pylist():
            level, pieces = split_text(t, limit, overlap)
            levels.append(level)
            starts.extend(p[0] for p in pieces)
            ends.extend(p[1] for p in pieces)
            offsets.append(len(starts))
        spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
        return pa.StructArray.from_arrays([pa.array(levels, pa.string()), lists], names=["cut_at", "pieces"])

    return F.arrow_udf(run, _CUT, ArrowUDFType.SCALAR)(texts)


def split_documents(df: DataFrame, id_col: str = "row_id", text_col: str = "full_text", limit: int = 2500, overlap: int = 250) -> DataFrame:
    """One row per piece: ``id_col``, ``piece_no``, ``start``, ``end``, ``cut_at``, ``piece``."""
    cut = df.select(F.col(id_col), F.col(text_col).alias("_text"), cuts(F.col(text_col), limit, overlap).alias("_cut"))
    rows = cut.select(id_col, "_text", F.col("_cut.cut_at").alias("cut_at"), F.posexplode("_cut.pieces").alias("piece_no", "_p"))
    piece = F.substring(F.col("_text"), F.col("_p.start") + 1, F.col("_p.end") - F.col("_p.start"))
    return rows.select(id_col, "piece_no", F.col("_p.start").alias("start"), F.col("_p.end").alias("end"), "cut_at", piece.alias("piece"))


def found(df: DataFrame, id_col: str = "row_id", text_col: str = "full_text", limit: int = 2500, overlap: int = 250) -> DataFrame:
    """``id_col`` and ``cut_at`` of every text above the limit, from the same cuts as the pieces."""
    long = df.where(F.length(text_col) > limit)
    return long.select(F.col(id_col), cuts(F.col(text_col), limit, overlap).alias("_cut")).select(id_col, F.col("_cut.cut_at").alias("cut_at"))
