"""Problem 10: pages made of stuffed keywords, link lists or product tags.

Method: phrase shingles and the hosts that share them, joined with list density. A page is cut into items at
separators, line ends, sentence ends and links. Three signs, none of which asks for a language, make an item list material:

* it belongs to a run of items of a few words each (tags, keywords, part lists);
* it is a link, or stands in a run with links;
* a good part of it consists of words that items of the page repeat over and over (stuffed sentences, keywords without separators).

The share of the page in such items is its list density. The phrase shingles of the whole page, prose and lists alike, are the runs of ``WIDTH``
words of its items (an item of fewer words is one), and the pair that a stuffed item repeats most; numbers are masked. The distinct hosts
of each shingle are counted over the whole corpus, and an item is replicated as far as its shingles stand on another host too. The share
of the page stitched from such phrases is joined with the density, item by item: links and replicated phrases of list material count
wholly, the rest of list material with ``own_weight``. A page is flagged when that exceeds half.

Replicated prose is shown (``stitched``) but speaks against no page: sentences of papers and patents are replicated across hosts far more
than spam is (figures in the README).

The text passes are row-local, and a host is told from others by the smallest and the largest one. ``found`` asks only for the shingles that
list material has: one pass on the JVM (``p10_kernel``) keeps the items of list material, a second one reads all text again and gives those
shingles wherever they stand. ``evidence`` shows all text, in Python; items recur much more than once, so there keys of items are shuffled,
and the shingles of an item are sent once a task.

Defined results: null, empty, blank and very short texts (under ``least_chars`` characters of words) are never
flagged; pages without list material have replication 0; a null host is a host of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrosieve.llm.p10_kernel import asked_file, listing
from ferrosieve.llm.p10_kernel import shingles as page_shingles
from ferrosieve.tables import measured, settle

#: Items of at most so many words are short; so many short ones in a row are a list.
SHORT_ITEM, LEAST_RUN = 5, 4
#: A word is stuffed if it makes up the first share of an item, or with others ``STUFFED_LONG`` of an item above ``LONG_ITEM`` words, each
#: the second share at least; and ``PAGE_PART`` of the page.
PART, PART_LONG, PAGE_PART, LONG_ITEM = 0.2, 0.025, 0.02, 40
#: An item is stuffed if stuffed words make up this share of it; the second holds for long items.
STUFFED, STUFFED_LONG = 0.3, 0.45
#: Words of a phrase shingle; items of which a task remembers that their shingles are sent (more are sent again).
WIDTH, REMEMBERED = 5, 1_000_000
#: At most so many keys of items (16 bytes each) are broadcast.
BROADCAST_KEYS = 1_000_000
#: Odd factors of the words of a shingle by their place, and of its width.
_ODD = [np.uint64(xxhash.xxh64_intdigest(f"place {j}") | 1) for j in range(WIDTH + 1)]
_TOKEN = re.compile(
    r"(?P<link>(?:https?://|www\.)\S+)|(?P<cjk>[぀-ヿ㐀-鿿]+)|(?P<word>[^\W_぀-ヿ㐀-鿿]+(?:[-'’][^\W_]+)*)"
    r"|(?P<end>[.!?。！？](?=\s|$)|。)|(?P<cut>[,;|·•#»>/\n、…]|(?<=\s)[-–—](?=\s))"
)
_DIGIT = re.compile(r"\d")


def _items(text: str) -> Iterator[tuple[list[str], bool, int]]:
    """(words, whether a link, characters) of each item. Two CJK characters count as a word; a blank cuts between CJK runs."""
    words: list[str] = []
    chars, last_cjk = 0, -2
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            w = m.group()
            chars += len(w) + 1
            words.append("0" if _DIGIT.search(w) else w)
            continue
        if kind == "cjk":
            w = m.group()
            if words and m.start() > last_cjk:
                yield words, False, chars
                words, chars = [], 0
            words += [w[i : i + 2] for i in range(0, len(w), 2)]
            chars += len(w) + 1
            last_cjk = m.end()
            continue
        if words:
            yield words, False, chars
            words, chars = [], 0
        if kind == "link":
            yield [], True, m.end() - m.start()
    if words:
        yield words, False, chars


def list_material(text: str | None) -> tuple[int, int, list[tuple[list[str], int, bool, tuple[str, str] | None]]]:
    """Characters of all items, characters of links, and of each item but links its words, characters, whether it is list material, and the pair a stuffed one repeats most."""
    if not text:
        return 0, 0, []
    items = list(_items(text.lower()))
    counts = [Counter(words) if len(words) > 5 else {} for words, _, _ in items]
    total = sum(chars for _, _, chars in items)
    links = sum(chars for _, link, chars in items if link)
    stuffed = _stuffed_words([words for words, _, _ in items], counts)
    listed = _short_runs(items)
    out = []
    for k, (words, link, chars) in enumerate(items):
        if link or not words:
            continue
        pair = None
        if stuffed and not listed[k]:
            n = len(words)
            if sum(map(stuffed.__contains__, words)) >= (STUFFED_LONG if n > LONG_ITEM else STUFFED) * n:
                listed[k] = True
                pair = max(Counter(zip(words, words[1:])).items(), key=lambda x: (x[1], x[0]))[0] if n > 5 else None
        out.append((words, chars, listed[k], pair))
    return total, links, out


def _hash(words: list[str] | tuple[str, ...]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def shingles(items: list[list[str]], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each item, and where those of each end. ``known`` remembers the hashes of words."""
    for w in {w for words in items for w in words}.difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    sizes = np.array([len(words) for words in items], np.int64)
    hashes = np.array([*map(known.__getitem__, chain.from_iterable(items)), *[0] * WIDTH], np.uint64)
    windows = np.maximum(1, sizes - WIDTH + 1)
    item = np.repeat(np.arange(len(items)), windows)
    at = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(windows) + windows, windows) + np.arange(len(item))
    width = np.minimum(sizes, WIDTH)[item].astype(np.uint64)
    h = width * _ODD[WIDTH]
    for j in range(WIDTH):
        h += np.where(width > j, hashes[at + j] * _ODD[j], np.uint64(0))
    order = np.lexsort((h, item))
    h, item = h[order], item[order]
    kept = np.r_[True, (h[1:] != h[:-1]) | (item[1:] != item[:-1])] if len(h) else np.zeros(0, bool)
    return h[kept].view(np.int64), np.cumsum(np.bincount(item[kept], minlength=len(items)))


def _stuffed_words(items: list[list[str]], counts: list[dict[str, int]]) -> set[str]:
    """Words that some item repeats over and over, and that make up a good part of the page."""
    repeated: set[str] = set()
    for words, c in zip(items, counts):
        n = len(words)
        if n > LONG_ITEM:
            often = {w for w, k in c.items() if k >= max(4, PART_LONG * n)}
            if sum(c[w] for w in often) >= STUFFED_LONG * n:
                repeated |= often
        elif n > 5:
            repeated |= {w for w, k in c.items() if k >= max(3, PART * n)}
    if not repeated:
        return repeated
    n_words = sum(map(len, items))
    on_page = Counter(w for words in items for w in words if w in repeated)
    return {w for w, k in on_page.items() if w != "0" and k >= max(4, PAGE_PART * n_words)}


def _short_runs(items: list[tuple[list[str], bool, int]]) -> list[bool]:
    """Whether each item belongs to a run of short ones that is long enough or has a link."""
    listed = [False] * len(items)
    i = 0
    while i < len(items):
        j, linked = i, False
        while j < len(items) and len(items[j][0]) <= SHORT_ITEM:
            linked |= items[j][1]
            j += 1
        if j - i >= LEAST_RUN or linked and j - i > 1:
            listed[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    return listed


def _host(host_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit("\u0000"))).alias("host")


def _shares(rows: DataFrame, id_col: str, *stitched: str) -> DataFrame:
    """Shares of the page of what was counted in characters."""
    part = lambda c: F.coalesce(c / F.nullif(F.col("chars"), F.lit(0)), F.lit(0.0))
    shares = [(F.col("links") + F.col("listed"), "list_share"), (F.col("links"), "link_share"), (F.col("shared"), "replicated"), *((F.col(c), c) for c in stitched)]
    return rows.select(F.col("id").alias(id_col), "chars", *(part(c).alias(n) for c, n in shares))


def evidence(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Of every page ``id_col``, ``chars``, ``list_share``, ``link_share``, ``replicated`` (share in list material whose phrases stand on other hosts too) and ``stitched`` (the same of all text)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, known = set(), {}
        for batch in batches:
            totals, links, listed, ends = [], [], [], [0]
            keys, sizes, owns, pairs = [], [], [], []
            new, new_words, new_ends = [], [], [0]
            if len(sent) > REMEMBERED:
                sent.clear()
            if len(known) > REMEMBERED:
                known.clear()
            for t in batch.column(2):
                total, linked, items = list_material(t.as_py())
                seen: dict[tuple[int, bool, tuple[str, str] | None], int] = {}
                for words, chars, own, pair in items:
                    k = _hash(words)
                    of = k, own, pair
                    seen[of] = seen.get(of, 0) + chars
                    if k not in sent:
                        sent.add(k)
                        new.append(k)
                        new_words.append(words)
                totals.append(total)
                links.append(linked)
                listed.append(sum(n for (_, own, _), n in seen.items() if own))
                keys += [k for k, _, _ in seen]
                owns += [own for _, own, _ in seen]
                pairs += [p for _, _, p in seen]
                sizes += seen.values()
                ends.append(len(keys))
                new_ends.append(len(new))
            phrases, phrase_ends = shingles(new_words, known)
            of_pair = dict(zip(some := sorted({p for p in pairs if p}), shingles([list(p) for p in some], known)[0].tolist()))  # one of each
            pairs = [of_pair[p] if p else None for p in pairs]
            long = lambda x: pa.array(x, pa.int64())
            parts = pa.StructArray.from_arrays([long(keys), pa.array(sizes, pa.int32()), pa.array(owns, pa.bool_()), long(pairs)], names=["k", "n", "own", "p"])
            sent_now = pa.StructArray.from_arrays([long(new), pa.ListArray.from_arrays(pa.array(np.r_[0, phrase_ends], pa.int32()), long(phrases))], names=["k", "h"])
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), x) for e, x in ((ends, parts), (new_ends, sent_now))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), long(totals), long(links), long(listed), *lists], names=["id", "host", "chars", "links", "listed", "items", "new"])

    pages = df.select(F.col(id_col).alias("id"), _host(host_col), F.col(text_col))
    schema = f"id {id_type}, host long, chars long, links long, listed long, items array<struct<k:long,n:int,own:boolean,p:long>>, new array<struct<k:long,h:array<long>>>"
    pages = settle(pages.mapInArrow(run, schema), "p10-pages")
    each = pages.select("id", "host", F.explode("items").alias("i")).select("id", "host", "i.*")
    every = pages.select(F.explode("new").alias("i")).select("i.k", F.size("i.h").alias("of"), "i.h")
    phrases = every.groupBy("k").agg(F.first("of").alias("of"), F.first("h").alias("h")).select("k", "of", F.explode("h").alias("h"))
    holders = each.groupBy("k").agg(F.min("host").alias("lo"), F.max("host").alias("hi"))
    phrases = phrases.join(holders, "k")
    pairs = each.where("p IS NOT NULL").select(F.col("p").alias("h"), F.col("host").alias("lo"), F.col("host").alias("hi"))
    elsewhere = phrases.select("h", "lo", "hi").unionByName(pairs).groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("h")
    share = phrases.join(elsewhere, "h").groupBy("k").agg((F.count("*") / F.first("of")).alias("part"))
    paired = each.select("p").where("p IS NOT NULL").distinct().join(elsewhere, F.col("p") == F.col("h"), "left_semi").select("p", F.lit(1.0).alias("whole"))
    met = each.join(share, "k", "left").join(paired, "p", "left").select("id", "own", (F.col("n") * F.coalesce("whole", "part", F.lit(0.0))).alias("n"))
    met = met.groupBy("id").agg(F.sum(F.when(F.col("own"), F.col("n"))).alias("shared"), F.sum("n").alias("stitched"))
    return _shares(pages.select("id", "chars", "links", "listed").join(met, "id", "left"), id_col, "stitched")


def list_evidence(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``evidence`` without ``stitched``: only shingles that list material has are counted, in all text as there. The text is read twice."""
    spark = df.sparkSession
    few = lambda x: F.broadcast(x[0]) if x[1]["rows"] <= BROADCAST_KEYS else x[0]
    text = F.col(text_col).cast("string")
    pages = df.select(F.col(id_col).alias("id"), _host(host_col), listing(spark, text).alias("l")).select("id", "host", "l.*")
    pages = settle(pages, "p10-pages")
    items = pages.select("id", "host", F.explode(F.arrays_zip("k", "n", "p")).alias("i")).select("id", "host", "i.*")
    phrases = pages.select(F.explode(F.arrays_zip("of", "h")).alias("i")).select(F.col("i.of").alias("k"), "i.h").distinct()  # a pair is its own shingle
    phrases, figures = measured(phrases, "p10-phrases")
    asked = asked_file(phrases, "h", figures["rows"])
    everywhere = df.select(_host(host_col), F.explode(page_shingles(spark, text, asked)).alias("h")).groupBy("h").agg(F.min("host").alias("lo"), F.max("host").alias("hi"))
    pairs = items.where("p IS NOT NULL").groupBy(F.col("p").alias("h")).agg(F.min("host").alias("lo"), F.max("host").alias("hi"))
    elsewhere = everywhere.unionByName(pairs).groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("h", F.lit(1.0).alias("met"))
    share = phrases.join(elsewhere, "h", "left").groupBy("k").agg((F.count("met") / F.count("*")).alias("part")).where("part > 0")
    share = few(measured(share, "p10-share"))
    paired = items.where("p IS NOT NULL").join(share.select(F.col("k").alias("p"), F.col("part").alias("whole")), "p", "left")
    met = items.where("p IS NULL").join(share, "k").select("id", (F.col("n") * F.col("part")).alias("n"))
    met = met.unionByName(paired.join(share, "k", "left").select("id", (F.col("n") * F.coalesce("whole", "part", F.lit(0.0))).alias("n")))
    met = met.groupBy("id").agg(F.sum("n").alias("shared"))
    return _shares(pages.select("id", "chars", "links", "listed").join(met, "id", "left"), id_col)


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_chars: int = 200, own_weight: float = 0.7, replication: bool = True) -> DataFrame:
    """``id_col`` of the flagged pages. With a unique id as in the corpus, one row a page.

    ``replication=False`` takes every phrase for one of its own host.
    """
    seen = list_evidence(df, id_col, text_col, host_col)
    elsewhere = F.col("replicated") if replication else F.lit(0.0)
    share = F.col("link_share") + elsewhere + own_weight * (F.col("list_share") - F.col("link_share") - elsewhere)
    return seen.where((F.col("chars") >= least_chars) & (share > 0.5)).select(id_col)
