"""Byte-pair vocabularies of public tokenizers, read from the JSON file named by a parameter."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

#: Where the vocabulary files lie; the environment or an argument may name another folder.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

# Fixed value: the published pattern that cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for pure ASCII texts, which the faster standard module can run.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\v\f\rA-Za-z0-9]+|[ \t\n\v\f\r]+(?![^ \t\n\v\f\r])|[ \t\n\v\f\r]+"""


@dataclass(frozen=True)
class Merges:
    """``of_byte[b]`` is the id of byte b; ``rules[(left, right)]`` is (rank, id of the union)."""

    of_byte: tuple[int, ...]
    rules: dict[tuple[int, int], tuple[int, int]]


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def read_merges(path: str) -> Merges:
    """Load merges and ids from a ``tokenizers`` JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    rules = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        rules[ids[left], ids[right]] = (rank, ids[left + right])
    return Merges(tuple(ids[c] for c in _byte_letters()), rules)
