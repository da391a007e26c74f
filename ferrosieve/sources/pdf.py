"""Text of PDF files: positioned blocks out of the content streams, put in reading order.

Handles what the standard library can: plain and deflated streams, literal and hexadecimal strings, text matrices and line moves,
with the single-byte encodings of simple fonts. A file without such text (scans, encrypted files, composite fonts) gives None, as a
failed parse does.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

#: Lines nearer than this many line heights belong to one block.
BLOCK_GAP = 1.6
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b"", b"\n": b""}


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S).decode("cp1252", "replace")


def _streams(data: bytes) -> Iterator[bytes]:
    for m in re.finditer(rb"<<(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*>>\s*stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        body = m[1]
        if b"FlateDecode" in m[0][:400]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" in body and b"ET" in body:
            yield body


def _lines(stream: bytes) -> Iterator[tuple[float, float, float, str]]:
    """(x, y from the top, size, text) of each shown run."""
    x = y = line_x = line_y = lead = 0.0
    size, operands, inside = 12.0, [], False
    for m in _TOKEN.finditer(stream):
        t = m.group()
        if t in (b"[", b"]"):
            inside = t == b"["
            operands = [] if inside else operands
        elif t[:1] in b"(<" or t[:1] == b"/" or re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            operands.append(t)
        else:
            numbers = [float(o) for o in operands if re.fullmatch(rb"[-+]?\d*\.?\d+", o)]
            if t == b"BT":
                x = y = line_x = line_y = 0.0
            elif t == b"Tf" and numbers:
                size = abs(numbers[-1]) or size
            elif t == b"TL" and numbers:
                lead = numbers[-1]
            elif t in (b"Td", b"TD") and len(numbers) >= 2:
                lead = -numbers[-1] if t == b"TD" else lead
                line_x, line_y = line_x + numbers[-2], line_y + numbers[-1]
                x, y = line_x, line_y
            elif t == b"Tm" and len(numbers) >= 6:
                line_x, line_y = numbers[-2:]
                size = abs(numbers[-3]) * size if abs(numbers[-3]) > 1 and size <= 1 else size
                x, y = line_x, line_y
            elif t in (b"T*", b"'", b'"'):
                line_y -= lead or size
                x, y = line_x, line_y
            if t in (b"Tj", b"TJ", b"'", b'"'):
                out = ""
                for o in operands:
                    if o[:1] in b"(<":
                        out += _string(o)
                    elif t == b"TJ" and float(o) < -200 and out and not out.endswith(" "):
                        out += " "  # a wide step between letters is a blank
                if out.strip():
                    yield x, -y, size, out
                    x += 0.5 * size * len(out)
            operands = []


def page_blocks(stream: bytes) -> list[tuple[float, float, float, float, str]]:
    """(x0, y0, x1, y1, text) of each block: lines that follow each other at one left edge."""
    rows: list[list] = []
    for x, y, size, text in _lines(stream):
        if rows and abs(rows[-1][1] - y) < 0.3 * size:
            rows[-1][3] += text if rows[-1][3].endswith(" ") or text.startswith(" ") else text if x <= rows[-1][4] + 0.3 * size else " " + text
            rows[-1][4] = x + 0.5 * size * len(text)
        else:
            rows.append([x, y, size, text, x + 0.5 * size * len(text)])
    blocks: list[list] = []
    for x, y, size, text, right in rows:
        if blocks and abs(blocks[-1][0] - x) < 3 * size and 0 < y - blocks[-1][3] < BLOCK_GAP * size:
            blocks[-1][2], blocks[-1][3] = max(blocks[-1][2], right), y
            blocks[-1][4] += "\n" + text.strip()
        else:
            blocks.append([x, y, right, y, text.strip()])
    return [tuple(b) for b in blocks]


def in_reading_order(blocks: list[tuple[float, float, float, float, str]], width: float = 612.0) -> list[str]:
    """Block texts by bands between blocks that span the page, in each band the left column first."""
    bands: list[list] = [[]]
    for b in blocks:
        if b[0] < 0.45 * width and b[2] > 0.55 * width:
            bands += [[b], []]
        else:
            bands[-1].append(b)
    key = lambda b: ((b[0] + b[2]) / 2 >= width / 2, round(b[1], 1), b[0])
    return [b[4] for band in bands for b in sorted(band, key=key)]


def pdf_text(data: bytes | None) -> str | None:
    """The text of a PDF file, a block a paragraph; None where there is none."""
    if not data or not data.startswith(b"%PDF"):
        return None
    try:
        pages = ["\n".join(in_reading_order(page_blocks(s))) for s in _streams(data)]
    except (ValueError, IndexError):
        return None
    return "\n".join(p for p in pages if p) or None


def text_of(content: Column) -> Column:
    """``pdf_text`` of a column of file contents."""
    return F.arrow_udf(lambda c: pa.array([pdf_text(x) for x in c.to_pylist()], pa.string()), "string", ArrowUDFType.SCALAR)(content)
