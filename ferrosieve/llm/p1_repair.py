"""Problem 1: noise in text from scanned pages.

Method. An averaged-perceptron character editor decides for every suspicious place of a word between keep, replace,
delete and insert, and for every hyphen-like mark at a line end between keep and line-join. Its features are
the characters around the place, the confusion at hand, and how often the word as it stands and the word after the operation
occur in the corpus. It is trained on words of the corpus that are corrupted and broken artificially. Headers and
page numbers are removed by their position on the pages (``p1_furniture``).

The word frequencies are counted over all texts and kept as their base-two logarithm in a hash table that is sized to the words and
tells them apart by 64 bits; it is all that is broadcast besides the weights of the editor. Above ``MOST_WORDS`` it is parted by the hash and
sent as a file that the workers map into memory instead, with every word in it. Only the training sample (``TRAINING_WORDS``) is bounded.
After that the pass over the texts is narrow. Words are judged once per worker and remembered.

Defined results: null and empty texts have no noise and come out as they are; texts without noise come out
unchanged; words that the corpus does not explain are kept.
"""

from __future__ import annotations

import atexit
import random
import re
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrosieve.llm.p1_furniture import Furniture, find_furniture
from ferrosieve.llm.perceptron import AveragedPerceptron
from ferrosieve.tables import fresh_path, measured

#: Words from which the editor is trained, taken in order of a hash.
TRAINING_WORDS = 2000
#: Words of the frequency table that are broadcast and built at once; it is sized to the words that at least two texts have, nine bytes for
#: each of at most four places a word. A corpus with more such words has its table in parts of this size, in a file.
MOST_WORDS = 8_000_000

# What scanners read for what stands there, as "read true".
CONFUSIONS = """
c e, á a, à a, â a, v r, f t, ri n, 0 o, l i, 5 s, 1 l, 1 i, cl d, li h, ii u, q g, rn m, l t, m in, h li, 6 b, vv w, m rn, d cl,
é e, è e, í i, ì i, ó o, ò o, ú u, 8 b, 9 g, 2 z, u n, n u, h b, b h, o c, e c, y v, v y, j i, i j, i l, t l, t f, s 5, 3 e, 4 a, 7 t
"""
_RULES = [tuple(pair.split()) for pair in CONFUSIONS.replace("\n", " ").split(",")]
_RARE_DIGITS = frozenset("234789")
_MARKS = "~!(|^·$%&*@#<>{}[]\\"  # fixed value: signs that stand for a letter inside a word
_LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
HYPHENS = "-‐¬­"  # fixed value: hyphen-like marks
_BREAK = re.compile(rf"([^\W\d_](?:[\w-]*[^\W\d_])?)([{HYPHENS}])[ \t]*$")
_TOKEN = re.compile(rf"[^\W_]+(?:[{re.escape(_MARKS)}]+[^\W_]+)*(?:-[^\W_]+)*")
_PLAIN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_HYPHEN_SET = frozenset(HYPHENS)
_LINE_BREAK = re.compile(rf"[{HYPHENS}][ \t]*\n\s*\S*")
_READ = re.compile(rf"(?=.*[a-zà-ÿ])[a-zà-ÿ0-9{re.escape(_MARKS)}-]+")
_MIXED = re.compile(r"[a-zà-ÿ0-9][A-Z]|^\d+[a-z]{1,2}$|^\d\d|\d\d\d")
_CODE = re.compile(r"(?=.*\d)(?=.*[A-Z])")
_LATIN = re.compile(r"[a-zà-ÿ]{2,24}(?:-[a-zà-ÿ]{2,24})*")


def whole_words(text: str) -> str:
    """The text without the words that a hyphen-like mark breaks at a line end."""
    parts, done = [], 0
    for m in _LINE_BREAK.finditer(text):
        cut = m.start()
        while cut > done and not text[cut - 1].isspace():
            cut -= 1
        parts.append(text[done:cut])
        done = m.end()
    if not parts:
        return text
    parts.append(text[done:])
    return " ".join(parts)


def words_of(text: str) -> set[str]:
    """Distinct words of a text in lower case, compounds and their parts; words broken at line ends do not count."""
    out = set()
    for w in set(_PLAIN.findall(whole_words(text).lower())):
        if len(w) <= 40 and _LATIN.fullmatch(w):
            out.add(w)
            if "-" in w:
                out.update(w.split("-"))
    return out


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """word, n: the number of texts with the word. Partial counts are put together before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                if t.as_py():
                    seen.update(words_of(t.as_py()))
            if len(seen) > 300_000:
                yield flush()
        yield flush()

    return df.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


Table = tuple[np.ndarray, np.ndarray]


class Lexicon:
    """Levels of words: 0 for words of fewer than two texts, else 1 + log2 of their number of texts.

    Each of ``tables`` (keys, levels) is a hash table with open addressing; words are told apart by 64 bits, none is left out. With several, high
    bits of the hash choose one; they lie in ``file`` then, a file of the Spark application, with ``sizes`` places each.
    """

    def __init__(self, tables: list[Table], texts: int, file: str | None = None):
        self.tables, self.texts, self.file, self.sizes = tables, texts, file, [len(keys) for keys, _ in tables]
        self.known = max(2, int(np.log2(max(3.0, 0.003 * texts))) + 1)
        #: Words up to this level are rare beside the most frequent one, whatever the size of the corpus.
        self.rare = max(0, max(int(levels.max(initial=0)) for _, levels in tables) - 5)

    @staticmethod
    def build(hashes: np.ndarray, levels: np.ndarray, texts: int) -> Lexicon:
        return Lexicon([_hash_table(hashes, levels)], texts)

    @staticmethod
    def mapped(file: str, sizes: list[int], texts: int) -> Lexicon:
        """The tables of a file of the application: the keys of each, then its levels."""
        data, tables, at = np.memmap(SparkFiles.get(file), np.uint8, "r"), [], 0
        for n in sizes:
            tables.append((data[at : at + 8 * n].view(np.uint64), data[at + 8 * n : at + 9 * n]))
            at += 9 * n
        return Lexicon(tables, texts, file)

    def level(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        keys, levels = self.tables[0] if self.file is None else self.tables[_part(h, len(self.tables))]
        mask = len(keys) - 1
        at = h & mask
        while level := levels[at]:
            if keys[at] == h:
                return int(level)
            at = (at + 1) & mask
        return 0


def _part(h: int, parts: int) -> int:
    return (h >> 40) % parts


def _hash_table(hashes: np.ndarray, levels: np.ndarray) -> Table:
    size = 1 << max(4, int(2 * len(hashes)).bit_length())
    keys, out = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
    at, left = (hashes & np.uint64(size - 1)).astype(np.int64), np.arange(len(hashes))
    while len(left):
        free = out[at] == 0
        _, first = np.unique(at[free], return_index=True)
        chosen = np.flatnonzero(free)[first]
        keys[at[chosen]], out[at[chosen]] = hashes[left[chosen]], levels[left[chosen]]
        rest = np.ones(len(left), bool)
        rest[chosen] = False
        left, at = left[rest], (at[rest] + 1) & (size - 1)
    return keys, out


def build_lexicon(df: DataFrame, text_col: str, training_words: int = TRAINING_WORDS, most_words: int = MOST_WORDS) -> tuple[Lexicon, list[str]]:
    """The frequency table of all texts, and a bounded sample of frequent words."""
    level = F.least(F.floor(F.log2("n")) + 1, F.lit(60)).cast("byte").alias("level")
    counts, figures = measured(count_words(df, text_col).where("n >= 2").select("word", level), "p1-words")
    texts = df.where(F.length(text_col) > 0).count()
    parts = max(1, -(-figures["rows"] // most_words))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in b.column(0).to_pylist()], dtype=np.uint64)
            part = ((hashes >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(hashes.view(np.int64), pa.int64()), b.column(1)], names=["part", "h", "level"])

    placed = counts.mapInArrow(place, "part int, h long, level byte")
    if parts == 1:
        lexicon = Lexicon([_held(placed)], texts)
    else:
        path = fresh_path(df.sparkSession, "p1-places")
        placed.write.partitionBy("part").parquet(path)
        placed = df.sparkSession.read.schema(placed.schema).parquet(path)
        lexicon = _in_file(df, (_held(placed.where(F.col("part") == i)) for i in range(parts)), texts)
    frequent = counts.where(F.col("level") >= lexicon.known).orderBy(F.xxhash64("word"), "word").limit(training_words)
    return lexicon, [r.word for r in frequent.select("word").collect()]


def _held(placed: DataFrame) -> Table:
    held = placed.select("h", "level").toArrow()  # about MOST_WORDS rows of 9 bytes at most
    return _hash_table(held.column("h").to_numpy().astype(np.int64).view(np.uint64), held.column("level").to_numpy().astype(np.uint8))


def _in_file(df: DataFrame, tables: Iterator[Table], texts: int) -> Lexicon:
    """Write the tables one after the other, so the driver holds one of them, and let Spark bring the file to every executor."""
    folder = tempfile.mkdtemp(prefix="ferrosieve-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name, sizes = f"p1-lexicon-{uuid.uuid4().hex}", []
    with open(f"{folder}/{name}", "wb") as f:
        for keys, levels in tables:
            f.write(keys.tobytes())
            f.write(levels.tobytes())
            sizes.append(len(keys))
    df.sparkSession.sparkContext.addFile(f"{folder}/{name}")
    return Lexicon.mapped(name, sizes, texts)


def _operation(read: str, true: str) -> str:
    return "replace" if len(read) == len(true) else "delete" if len(read) > len(true) else "insert"


class Editor:
    """Judges words and line ends with a lexicon and a trained perceptron."""

    def __init__(self, lexicon: Lexicon, model: AveragedPerceptron | None = None):
        self.lexicon = lexicon
        self.model = model or AveragedPerceptron(["keep", "replace", "delete", "insert", "join"])
        self.words: dict[str, str | None] = {}
        self.parts: dict[str, str | None] = {}

    # words

    def _features(self, word: str, at: int, read: str, true: str, new: str) -> list[str]:
        have, get, known = self.lexicon.level(word), self.lexicon.level(new), self.lexicon.known
        op, rule = _operation(read, true), f"{read}>{true}"
        before, after = word[at - 1 : at] or "^", word[at + len(read) : at + len(read) + 1] or "$"
        gain = f"{min(get - have, 9)}"
        return [
            "op=" + op, "rule=" + rule, f"op+gain={op}{gain}", f"op+known={op}{get >= known}{have >= known and get - have < 4}",
            f"ctx={rule}{before}{after}", f"new+op={min(9, get)}{op}", f"len={min(len(word), 8)}{op}", f"digit={op}{before.isdigit() or after.isdigit()}",
        ]

    def _edits(self, word: str) -> Iterator[tuple[int, str, str, str]]:
        """(place, read, true, word afterwards) of every operation that the confusions allow."""
        for read, true in _RULES:
            if len(word) < 5 and read in _RARE_DIGITS:
                continue  # codes such as b3
            at = word.find(read)
            while at >= 0:
                yield at, read, true, word[:at] + true + word[at + len(read) :]
                at = word.find(read, at + 1)
        for at, c in enumerate(word):
            if c in _MARKS and 0 < at < len(word) - 1:
                for letter in _LETTERS:
                    yield at, c, letter, word[:at] + letter + word[at + 1 :]

    def _judge(self, word: str) -> str | None:
        """What a misread part of a word in lower case stands for, or None; remembered."""
        if word not in self.parts:
            if len(self.parts) > 400_000:
                self.parts.clear()
            self.parts[word] = self._search(word)
        return self.parts[word]

    def _search(self, word: str) -> str | None:
        level, known = self.lexicon.level, self.lexicon.known
        have = level(word)
        if have >= known and have + 5 > level("the"):
            return None
        # of short words only the most frequent ones are made
        if len(word) == 2 and word.isascii() and word.isalpha():
            return None
        least = known if len(word) > 3 else max(known, level("the") - 3)
        best = None
        once = list(self._edits(word))
        for at, read, true, new in once:
            get = level(new)
            if get >= least and get - have >= 4 and new.isalpha():
                s = self.model.scores(self._features(word, at, read, true, new))
                margin = s[_operation(read, true)] - s["keep"]
                if margin > 0 and (best is None or margin > best[0]):
                    best = (margin, new)
        if best is None and have <= self.lexicon.rare and 6 <= len(word) <= 20:
            for _, _, _, half in once:
                for at, read, true, new in self._edits(half):
                    get = level(new)
                    if get >= known + 1 and get - have >= 4 and new != word and new.isalpha():
                        s = self.model.scores(self._features(half, at, read, true, new))
                        margin = s[_operation(read, true)] - s["keep"]
                        if margin > 0 and (best is None or margin > best[0]):
                            best = (margin, new)
        return best[1] if best else None

    def correct(self, token: str) -> str | None:
        """The word that a misread token stands for; None where the token is kept."""
        if token in self.words:
            return self.words[token]
        if len(self.words) > 400_000:
            self.words.clear()
        out = None
        low = token.lower()
        if 2 <= len(low) <= 40 and _READ.fullmatch(low) and not _MIXED.search(token) and not (_CODE.search(token) and len(token) < 5):
            parts = low.split("-")
            name = token[0].isupper() and any(p.isdigit() for p in parts[1:])  # a name with a number
            fixed = [self._judge(p) if len(p) > 1 and not p.isdigit() and not name else None for p in parts]
            if any(fixed):
                out = "-".join(f or p for f, p in zip(fixed, parts))
                out = out.upper() if token.isupper() else out[:1].upper() + out[1:] if token[:1].isupper() else out
        self.words[token] = out
        return out

    # line ends

    def _join_features(self, left: str, mark: str, right: str) -> list[str]:
        level, known = self.lexicon.level, self.lexicon.known
        tail = left.rsplit("-", 1)[-1].lower()
        head = right.split("-", 1)[0].lower()
        whole, compound = level(tail + head), level(f"{tail}-{head}")
        if whole < known and compound < known and (fixed := self._judge(tail + head)):
            whole = level(fixed)  # broken and misread
        soft = mark in "¬­"
        parts = level(tail) >= known and level(head) >= known
        return [
            f"soft={soft}", f"whole={whole >= known}", f"compound={compound >= known}", f"more={whole > compound}{compound > whole}",
            f"upper={right[:1].isupper()}", f"parts={parts}{whole > 0}", f"soft+parts={soft}{parts}", f"none={whole == 0}{compound == 0}{parts}{soft}",
        ]

    def joins(self, left: str, mark: str, right: str) -> bool:
        """Whether a word is broken between left and right."""
        if not right[:1].isalpha() or not left or right[:1].isupper() and not left.isupper():
            return False
        s = self.model.scores(self._join_features(left, mark, right))
        return s["join"] > s["keep"]

    # training

    def train(self, words: list[str], seed: int = 5) -> Editor:
        """Corrupt and break sample words, and fit the perceptron on what was done."""
        rng, rows = random.Random(seed), []
        plain = [w for w in words if w.isalpha() and len(w) > 3]
        for w in plain:
            options = [(true, read) for read, true in _RULES if true in w]
            for _ in range(8):
                if rng.random() < 0.15 or not options:
                    at = rng.randrange(1, len(w) - 1)
                    true, read = w[at], rng.choice(_MARKS)
                else:
                    true, read = rng.choice(options)
                    at = rng.choice([i for i in range(len(w)) if w.startswith(true, i)])
                bad = w[:at] + read + w[at + len(true) :]
                if self.lexicon.level(bad) <= self.lexicon.level(w) - 4:  # else a word of its own, though misreadings of frequent words recur too
                    rows.append((self._features(bad, at, read, true, w), _operation(read, true)))
                    for p, r, t, new in self._edits(bad):
                        if new != w and self.lexicon.level(new) < self.lexicon.known and rng.random() < 0.3:
                            rows.append((self._features(bad, p, r, t, new), "keep"))
            for p, r, t, new in self._edits(w):
                if rng.random() < 0.5:
                    rows.append((self._features(w, p, r, t, new), "keep"))
            if len(w) >= 5:
                cut = rng.randrange(2, len(w) - 1)
                rows.append((self._join_features(w[:cut], rng.choice(HYPHENS), w[cut:]), "join"))
                other = rng.choice(plain)
                rows.append((self._join_features(w, rng.choice("-‐"), other), "keep"))
                rows.append((self._join_features(w, rng.choice("-‐"), str(rng.randrange(1, 999))), "keep"))
        for w in words:
            if "-" in w:
                left, right = w.split("-", 1)
                rows += [(self._join_features(left, m, right), "keep") for m in "-‐"] * 3
        self.model.train(rows, passes=4)
        return self


def _gaps(lines: list[str], furniture: Furniture) -> Iterator[tuple[int, re.Match, int]]:
    """(line, its broken end, the line that goes on) for each line that ends with a hyphen-like mark."""
    skip = furniture.lines
    for i, line in enumerate(lines):
        end = line.rstrip(" \t")
        if end[-1:] not in _HYPHEN_SET or i in skip:
            continue
        m = _BREAK.search(line, max(0, len(end) - 60))
        if m is None:
            continue
        j = i + 1
        while j < len(lines) and (j in skip or not lines[j].strip(" \t\x0c")):
            j += 1
        if j < len(lines):
            yield i, m, j


def _tokens(lines: list[str], furniture: Furniture) -> set[str]:
    skip = furniture.lines
    body = "\n".join(x for i, x in enumerate(lines) if i not in skip) if skip else "\n".join(lines)
    return set(_TOKEN.findall(whole_words(body)))


KINDS = ("hyphenation", "misrecognition", "running_header", "page_number")


def diagnose(text: str, editor: Editor) -> tuple[list[str], Furniture, dict[str, str]]:
    """Kinds of noise, the furniture, and the misread tokens with what they stand for."""
    lines = text.split("\n")
    furniture = find_furniture(text)
    kinds = []
    if any(c in text for c in HYPHENS):
        for i, m, j in _gaps(lines, furniture):
            right = re.match(r"\s*([^\W_]+(?:-[^\W_]+)*)", lines[j].lstrip(" \t\x0c"))
            if right and editor.joins(m.group(1), m.group(2), right.group(1)):
                kinds.append("hyphenation")
                break
    fixed = {t: c for t in _tokens(lines, furniture) if (c := editor.correct(t)) is not None}
    if len(fixed) > 1 or any(len(t) > 3 for t in fixed):  # a lone short one may be the rest of a broken word
        kinds.append("misrecognition")
    if furniture.headers:
        kinds.append("running_header")
    if furniture.numbers:
        kinds.append("page_number")
    return kinds, furniture, fixed


def repair(text: str | None, editor: Editor) -> str | None:
    """The text in continuous paragraphs; a text without noise as it is."""
    if not text:
        return text
    kinds, furniture, _ = diagnose(text, editor)
    if not kinds:
        return text
    lines = text.split("\n")
    joined: dict[int, int] = {}
    for i, m, j in _gaps(lines, furniture):
        right = re.match(r"([^\W_]+(?:-[^\W_]+)*)", lines[j].lstrip(" \t\x0c"))
        if right:
            if editor.joins(m.group(1), m.group(2), right.group(1)):
                lines[i] = lines[i][: m.start(2)]
            else:
                lines[i] = lines[i].rstrip()
            joined[i] = j
    paragraphs: list[str] = []
    glue = False
    widths = sorted(len(x.strip()) for i, x in enumerate(lines) if x.strip() and i not in furniture.lines)
    width = widths[int(0.8 * (len(widths) - 1))] if widths else 0
    current = ""
    for i, raw in enumerate(lines):
        if i in furniture.lines:
            continue
        line = raw.strip(" \t\x0c\r")
        if not line:
            if not glue and current.rstrip().endswith((".", ":", "!", "?", "。")) or not current or len(current) < 0.6 * width:
                if current:
                    paragraphs.append(current)
                current = ""
            elif current and not glue and "\x0c" not in raw and not any(k in furniture.lines for k in (i - 1, i + 1)):
                paragraphs.append(current)
                current = ""
            continue
        starts = re.match(r"(\[?\d+[\].]|#|Table |Figure )", line)
        if current and not glue and starts:
            paragraphs.append(current)
            current = ""
        current = current + line if glue or not current else current + " " + line
        glue = i in joined
        if not glue and len(line) < 0.6 * width:
            paragraphs.append(current)
            current = ""
    if current:
        paragraphs.append(current)
    # words put together at line ends count too, so the corrections are looked up anew
    return _TOKEN.sub(lambda m: editor.correct(m.group()) or m.group(), "\n\n".join(paragraphs))


def fit(df: DataFrame, text_col: str = "full_text", training_words: int = TRAINING_WORDS, most_words: int = MOST_WORDS) -> Editor:
    lexicon, sample = build_lexicon(df, text_col, training_words, most_words)
    return Editor(lexicon).train(sample)


_WORKER: dict[str, Editor] = {}


def _worker_editor(shared: object, name: str) -> Editor:
    """The editor of this worker process; what it has judged is kept from task to task."""
    if name not in _WORKER:
        _WORKER.clear()
        tables, file, sizes, texts, labels, weights = shared.value
        model = AveragedPerceptron(labels)
        model.weights = weights
        _WORKER[name] = Editor(Lexicon(tables, texts) if file is None else Lexicon.mapped(file, sizes, texts), model)
    return _WORKER[name]


def _shared(df: DataFrame, editor: Editor) -> tuple[object, str]:
    lexicon = editor.lexicon
    tables = lexicon.tables if lexicon.file is None else None
    value = (tables, lexicon.file, lexicon.sizes, lexicon.texts, editor.model.labels, editor.model.weights)
    return df.sparkSession.sparkContext.broadcast(value), lexicon.file or xxhash.xxh64_hexdigest(lexicon.tables[0][0].tobytes())


def found(df: DataFrame, id_col: str = "row_id", text_col: str = "full_text", most_words: int = MOST_WORDS) -> DataFrame:
    """``row_id`` and ``noise_kind``: one row per text and kind of noise."""
    shared, name = _shared(df, fit(df, text_col, most_words=most_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = _worker_editor(shared, name)
        for b in batches:
            ids, kinds = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    got = diagnose(t, editor)[0]
                    ids += [i] * len(got)
                    kinds += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=["row_id", "noise_kind"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "row_id long, noise_kind string")


def repaired(df: DataFrame, id_col: str = "row_id", text_col: str = "full_text") -> DataFrame:
    """``row_id`` and ``text``: every text as continuous paragraphs."""
    shared, name = _shared(df, fit(df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = _worker_editor(shared, name)
        for b in batches:
            texts = [repair(t, editor) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row_id", "text"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "row_id long, text string")
