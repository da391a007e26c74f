"""Problem 8: encoding a whole corpus with a byte-pair vocabulary.

Method: corpus-level merge replay. The pre-tokens that a task meets for the first time form one
symbol sequence. An inverted index leads from each adjacent pair of symbols to the positions where it
stands. The merges are replayed in rank order from a heap of the ranks that occur; each merge touches
only the positions in its posting list and enters the pairs that arise at their two neighbours. The
ids of a pre-token are kept, so each is replayed once per worker, and whole batches are put together
with array arithmetic. The operator is narrow: no shuffle, no join, one pass over the text.

Defined results: null and empty texts give an empty list; strings that look like special tokens are
ordinary text; other columns do not matter; repeated rows each give a row.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql import types as T

from ferrosieve.llm.vocabulary import ASCII_PATTERN, PATTERN, TOKENIZER_DIR, Merges, read_merges

#: Pre-tokens that a worker keeps; beyond it the table is emptied and filled anew.
KEPT_WORDS = 400_000


def replay(words: list[bytes], merges: Merges) -> list[list[int]]:
    """Ids of each word, by replaying the merges in rank order over all words at once."""
    rules, of_byte = merges.rules, merges.of_byte
    sym: list[int] = []
    bounds = [0]
    for w in words:
        sym.extend([of_byte[b] for b in w])
        bounds.append(len(sym))
    n = len(sym)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    for s, e in zip(bounds, bounds[1:]):
        if e > s:
            prv[s], nxt[e - 1] = -1, -1
    index: dict[tuple[int, int], list[int]] = {}
    for p in range(n):
        q = nxt[p]
        if q >= 0:
            pair = (sym[p], sym[q])
            if pair in rules:
                index.setdefault(pair, []).append(p)
    heap = [(rules[pair][0], pair) for pair in index]
    heapq.heapify(heap)
    while heap:
        _, pair = heapq.heappop(heap)
        left, right = pair
        new = rules[pair][1]
        places = index.pop(pair)
        if left == right:
            places.sort()  # overlapping runs merge from the left
        for p in places:
            q = nxt[p]
            if sym[p] != left or q < 0 or sym[q] != right:
                continue
            sym[p], sym[q] = new, -1
            after = nxt[q]
            nxt[p] = after
            nxt[q] = -1
            if after >= 0:
                prv[after] = p
                fresh = (new, sym[after])
                if fresh in rules:
                    at = index.get(fresh)
                    if at is None:
                        index[fresh] = at = []
                        heapq.heappush(heap, (rules[fresh][0], fresh))
                    at.append(p)
            before = prv[p]
            if before >= 0:
                fresh = (sym[before], new)
                if fresh in rules:
                    at = index.get(fresh)
                    if at is None:
                        index[fresh] = at = []
                        heapq.heappush(heap, (rules[fresh][0], fresh))
                    at.append(before)
    return [[x for x in sym[s:e] if x >= 0] for s, e in zip(bounds, bounds[1:])]


class Encoder:
    """Encodes batches of texts; keeps the ids of the pre-tokens met so far."""

    def __init__(self, merges: Merges, kept_words: int = KEPT_WORDS):
        self.merges, self.kept_words = merges, kept_words
        self.full, self.fast = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.at = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        ids = replay([w.encode("utf-8", "surrogatepass") for w in new], self.merges)
        lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        total, first = int(lens.sum()), len(self.number)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(new) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=total)
        self.size[first : first + len(new)] = lens
        self.at[first : first + len(new)] = self.used + np.cumsum(lens) - lens
        self.used += total
        self.number.update(zip(new, range(first, first + len(new))))

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The pre-token numbers of all texts, and how many each text has."""
        if len(self.number) > self.kept_words:
            self.clear()
        words, counts = [], np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                got = self.fast.findall(t) if t.isascii() else self.full.findall(t)
                words += got
                counts[i] = len(got)
        number = self.number
        new = list(dict.fromkeys(w for w in set(words) if w not in number))
        if new:
            self._learn(new)
        return np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the len(texts) + 1 offsets."""
        wid, counts = self.numbers(texts)
        lens = self.size[wid]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.at[wid] - (ends - lens), lens) + np.arange(total)]
        word_ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.concatenate([[0], ends])[word_ends]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(read_merges(path))
    return _ENCODERS[path]


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, name)


def _slices(texts: list[str | None], most_chars: int = 4_000_000) -> Iterator[list[str | None]]:
    """Consecutive parts of a batch of a bounded number of characters, so memory does not follow the batch."""
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t or "")
        if chars >= most_chars:
            yield part
            part, chars = [], 0
    yield part


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) for every row of ``df``."""
    path = vocabulary or vocabulary_path()
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            done = 0
            for part in _slices(batch.column(1).to_pylist()):
                ids, offsets = enc.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), lists], names=[id_col, "ids"])
                done += len(part)

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def token_counts(texts: Column, vocabulary: str | None = None) -> Column:
    """Number of tokens of each text; 0 for null and empty texts."""
    path = vocabulary or vocabulary_path()

    def count(col: pa.Array) -> pa.Array:
        enc, out = encoder(path), []
        for part in _slices(col.to_pylist()):
            wid, counts = enc.numbers(part)
            ends = np.concatenate([[0], np.cumsum(enc.size[wid])])
            out.append(np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]))
        return pa.array(np.concatenate(out).astype(np.int32) if out else [], type=pa.int32())

    return F.arrow_udf(count, "int", ArrowUDFType.SCALAR)(texts)
