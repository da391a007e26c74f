"""Problem 6: defective question and answer pairs.

Method. Copies: the answer is compressed with its question as a zstandard dictionary; an answer that adds
only a few bytes to it and has about its length or a multiple gives back the question. Language and refusals: by
dictionaries of function words and of the phrases people and models decline with. Truncation: JSON that
ends inside itself, or a text whose end a terminal-context model takes for a cut. The model is an averaged perceptron
over the last words and signs, trained on a bounded sample of the answers themselves: prefixes that end with a
sentence against prefixes cut anywhere else.

Each pair is judged by itself: one narrow pass after the model is fitted.

Defined results: a pair has at most one defect, the first of empty, refusal, copies_question, truncated,
wrong_language; a pair whose question is null, blank or ``nan`` has none, nor has an answer of a few words. Repeated rows
are judged alike; tables without rows give no rows.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrosieve.llm.perceptron import AveragedPerceptron

#: Rows from which the terminal-context model is fitted, taken in order of a hash of the id.
TRAINING_ROWS = 1500
#: Answers of so many words say too little of their end and language to be judged by them.
SHORT_ANSWER = 5
#: An answer declines if the sentences that decline make up this share of it, or more.
DECLINED_SHARE = 0.3
FIELD = "summary_of_technical_relevance"

# Answers that stand for no answer.
PLACEHOLDERS = frozenset("- -- --- . .. ... … n/a na none null nil nan tbd todo ? ?? [] {} () \"\" '' unknown empty undefined".split() + ["not available", "no answer", "not applicable", "n. a.", "not mentioned"])

# Phrases of declining, by language.
REFUSALS = {
    "en": [
        r"\b(i|we)\b[^.!?]{0,30}\b(can ?not|can[’']t|won[’']t|will not|am unable|are unable|am not able|must decline|have to decline|decline to|do not feel comfortable|don[’']t feel comfortable|refuse to|regret)",
        r"\bi[’']m (sorry|unable|afraid|not able)\b", r"\bi am (sorry|afraid|not allowed|not permitted|unable)\b",
        r"\b(i|we)([’']d| would) rather not\b", r"\bas an? (ai|artificial|language)\b", r"\blanguage model\b",
        r"\bmy (guidelines|instructions|policy|policies|rules)\b", r"\bcan ?not comply\b", r"\bunable to comply\b",
        r"\bnot be appropriate for me\b", r"\b(what|anything) i am (allowed|permitted)\b", r"\bnot something i (can|may|could)\b",
        r"\bagainst my\b", r"\bi (may|must) not\b", r"^sorry\b", r"\bhave to pass on\b",
    ],
    "de": [r"\bals (ki|sprachmodell|künstliche)", r"\btut mir (sehr )?leid\b", r"\b(kann|darf|möchte|will|werde) ich [^.!?]{0,30}\b(nicht|keine)\b", r"\bich (kann|darf|möchte|will|werde)\b[^.!?]{0,40}\b(nicht|keine)\b", r"\bmeine richtlinien\b", r"\bmir (ist|wurde) [^.!?]{0,20}nicht (erlaubt|gestattet)"],
    "fr": [r"\bje ne (peux|puis|suis|souhaite|veux|saurais)\b[^.!?]{0,20}", r"\bdésolée?\b", r"\ben tant qu[e’'] ?(modèle|ia|intelligence)", r"\bm[’']est pas (permis|possible)\b", r"\bje (refuse|préfère ne pas|regrette)\b", r"\bmes (consignes|directives)\b"],
    "es": [r"\blo (siento|lamento)\b", r"\bno (puedo|debo|deseo|quiero)\b", r"\bcomo (modelo|ia|inteligencia)\b", r"\bno me está permitido\b", r"\bno se me permite\b", r"\bprefiero no\b", r"\bmis (directrices|normas|instrucciones)\b"],
    "ja": [r"申し訳", r"お答え(でき|することはでき)", r"(回答|お手伝い|対応)(は|を)?(でき|いたし)(ません|かね)", r"言語モデル", r"お断り", r"控えさせて"],
}
_REFUSAL = re.compile("|".join(p for ps in REFUSALS.values() for p in ps))

# Frequent function words of each language.
LANGUAGE_WORDS = {
    "en": "the of and to in is was by with that which are for on as at it be from this has have after under between under despite",
    "de": "der die das und in den dem des ein eine einen mit von bei wird wurde ist auf für zu nicht sich dass wenn dadurch ferner um im wir haben dabei muss müssen",
    "fr": "le la les de des du un une et en dans est sur pour par que qui ne pas ce cette nous avons mais car bien se à au aux avec dont il",
    "es": "el la los las de del un una y en es por para con que se no al su pero como hay lo este esta aunque además",
    "it": "il lo la gli le di del della un una e in è per con che non si al sono nel come anche questo questa",
    "pt": "o a os as de do da um uma e em é por para com que não se ao são no na mas como este esta",
    "nl": "de het een en van in is op voor met dat niet te zijn wordt werd bij aan door ook als deze",
}
_LANGUAGE = {lang: frozenset(words.split()) for lang, words in LANGUAGE_WORDS.items()}
# How questions name languages.
LANGUAGE_NAMES = {
    "en": "english englisch englischer anglais inglés inglesa ingles 英語",
    "de": "german deutsch deutscher allemand alemán alemana aleman ドイツ語",
    "fr": "french französisch französischer français francais francés francesa frances フランス語",
    "es": "spanish spanisch spanischer espagnol español española espanol castellano スペイン語",
    "ja": "japanese japanisch japanischer japonais japonés japonesa japones 日本語",
    "it": "italian italienisch italien italiano",
    "pt": "portuguese portugiesisch portugais portugués",
    "nl": "dutch niederländisch néerlandais neerlandés holandés",
}
_NAMED = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names.split()}
_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[぀-ヿ]")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")
_BULLET = re.compile(r"^\s*([-*•–]|\d+[.)])\s+\S")


def language(text: str) -> str | None:
    """The language whose function words dominate; None where too few words tell."""
    letters = sum(map(str.isalpha, text))
    if letters and len(_CJK.findall(text)) > 0.2 * letters:
        return "ja" if _KANA.search(text) else "zh"
    words = _WORD.findall(text.lower())
    if len(words) < 6:
        return None
    hits = sorted(((sum(w in known for w in words), lang) for lang, known in _LANGUAGE.items()), reverse=True)
    (best, lang), (second, _) = hits[0], hits[1]
    return lang if best >= 0.12 * len(words) and best > 1.15 * second else None


def asked_languages(question: str) -> set[str]:
    """The language of a question and those that it asks for."""
    out = {_NAMED[w] for w in re.findall(r"[^\W\d_]+", question.lower()) if w in _NAMED}
    own = language(question)
    return out | ({own} if own else set())


def parse_answer(answer: str) -> tuple[str | None, bool, bool]:
    """(the text that counts, whether it is JSON without content, whether the JSON breaks off)."""
    s = answer.strip()
    s = re.sub(r"^```(?:json)?\s*|\s*```$", "", s)
    if s[:1] not in ("{", "["):
        return answer, False, False
    try:
        value = json.loads(s)
    except ValueError:
        m = re.search(rf"[\"']{FIELD}[\"']\s*:\s*([\"'])", s)
        if not m:
            return None, False, not s.endswith(("}", "]"))
        body = re.match(r"(?:[^\\%s]|\\.)*" % re.escape(m.group(1)), s[m.end() :], re.S).group()
        closed = m.end() + len(body) < len(s)
        text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda x: chr(int(x.group(1), 16)), body).replace("\\n", "\n").replace('\\"', '"')
        return text, False, not closed or not s.endswith(("}", "]"))

    def blank(x: object) -> bool:
        if isinstance(x, dict):
            return all(map(blank, x.values()))
        if isinstance(x, list):
            return all(map(blank, x))
        return x is None or isinstance(x, str) and (not x.strip() or x.strip().lower() in PLACEHOLDERS)

    if blank(value):
        return None, True, False
    if isinstance(value, dict):
        text = value.get(FIELD)
        return (text if isinstance(text, str) else None), False, False
    return None, False, False


def _plain(text: str) -> str:
    return " ".join(re.findall(r"\w+", text.lower()))


def copies(question: str, answer: str) -> bool:
    """Whether the answer holds nothing that the question does not give, by dictionary compression."""
    q, a = _plain(question), _plain(answer)
    if not q or len(a) < 0.8 * len(q):
        return False
    words, asked = a.split(), set(q.split())
    if sum(w in asked for w in words) < 0.6 * len(words) and len(words) > 8:
        return False  # compression cannot hide that many new words
    packer = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(q.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
    least = len(packer.compress(q.encode()))
    return len(packer.compress(a.encode())) - least <= 18 and len(_plain(answer).replace(q, "")) <= 0.35 * len(q) + 8


# Abbreviations with a point after which a sentence goes on, by language.
ABBREVIATIONS = {
    "en": "e.g. i.e. cf. fig. figs. eq. eqs. sec. no. vs. approx. resp. incl. dr. prof.",
    "de": "z.b. d.h. vgl. bzw. ca. abb. tab. nr. sog. evtl. inkl.",
    "fr": "p.ex. c.-à-d. fig. env. éq. n°.",
    "es": "p.ej. núm. aprox. fig. ec.",
}
_ABBREVIATIONS = frozenset(w for ws in ABBREVIATIONS.values() for w in ws.split())


def end_features(text: str) -> list[str]:
    """What the end of a text looks like."""
    t = text.rstrip()
    core = t.rstrip("\"'”’»)]*_ ")
    words = t[-80:].split()
    last, before = (words[-1] if words else ""), (words[-2] if len(words) > 1 else "")
    line = t.rsplit("\n", 1)[-1]
    if _BULLET.match(line):
        return ["bullet", "bullet+" + ("open" if core[-1:] in ",;:-" else "closed")]
    sign = core[-1:] if not core[-1:].isalnum() else "a" if core[-1:].isalpha() else "0"
    opened = t.rfind("(") > t.rfind(")")
    return [
        "sign=" + sign, "line", "last=" + re.sub(r"\d", "0", last.lower())[-12:],
        f"sign+short={sign}{len(last.strip('.()')) <= 4}", "opened=" + sign if opened else "even", f"dots={last.count('.')}{sign}",
        "sign+before=" + sign + before.lower()[-8:], f"open={opened}", f"short={last.lower().lstrip('(') in _ABBREVIATIONS}",
    ]


def training_rows(texts: list[str], seed: int = 11) -> list[tuple[list[str], str]]:
    """Prefixes of texts that end with a sentence or a list item, and prefixes cut elsewhere, also behind the point of an abbreviation."""
    rng, rows = random.Random(seed), []
    for t in texts:
        ends = [m.start() for m in re.finditer(r"(?<=[.!?。！？])(?=\s+[A-ZÄÖÜÉÀ¿¡\u3040-\u30ff\u4e00-\u9fff]|[\u3040-\u30ff\u4e00-\u9fff])", t)]
        inner = [m.start() for m in re.finditer(r"(?<=[a-z]\.)(?=\s+[a-z(\d])", t)]
        rows += [(end_features(t[:e]), "whole") for e in rng.sample(ends, min(4, len(ends)))]
        rows += [(end_features(t[:e]), "cut") for e in rng.sample(inner, min(4, len(inner)))] * 3
        lines = t.split("\n")
        items = [k for k in range(1, len(lines)) if _BULLET.match(lines[k]) and _BULLET.match(lines[k - 1])]
        rows += [(end_features("\n".join(lines[: k + 1])), "whole") for k in items[-3:]]
        if t.rstrip()[-1:] in ".!?。！？":
            rows.append((end_features(t), "whole"))
        for _ in range(3):
            cut = rng.randrange(len(t) // 3, len(t)) if len(t) > 30 else 0
            if cut and not re.search(r"[.!?。！？\n]\s*$", t[:cut]) and not _BULLET.match(t[:cut].rsplit("\n", 1)[-1] + " x"):
                rows.append((end_features(t[:cut]), "cut"))
                if rng.random() < 0.5:
                    opened = rng.choice(("", "("))
                    rows.append((end_features(f"{t[:cut].rsplit(' ', 1)[0]} {opened}{rng.choice(sorted(_ABBREVIATIONS))}"), "cut"))
    return rows


def fit_terminal_model(df: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "pair_id") -> AveragedPerceptron:
    """Terminal-context model from at most ``rows`` answers.

    A bound on the hash of the id, from the number of pairs, keeps little more than that before anything is sorted, so what
    reaches the driver does not grow with the table or its partitions.
    """
    span, total = 1 << 30, df.count()
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(span))
    near = df.where(place < F.lit(min(span, span * 2 * rows // max(total, 1) + 1))).select("answer", place.alias("place"))
    sample = near.where(F.length("answer") > 60).orderBy("place", "answer").limit(rows).collect()
    texts = [t for a, _ in sample if (t := parse_answer(a)[0]) and len(t) > 60]
    return AveragedPerceptron(["whole", "cut"]).train(training_rows(texts))


def defect(question: str | None, answer: str | None, terminal: AveragedPerceptron, short_answer: int = SHORT_ANSWER) -> str | None:
    """The defect of a pair, or None. Answers of up to ``short_answer`` words (five characters each in CJK) are neither truncated nor in a wrong language."""
    if question is None or not question.strip() or question.strip().lower() == "nan":
        return None
    if answer is None or not answer.strip() or answer.strip().lower() in PLACEHOLDERS:
        return "empty"
    text, without_content, breaks_off = parse_answer(answer)
    if without_content:
        return "empty"
    if breaks_off:
        return "truncated"
    if text is None or not text.strip():
        return None
    if text.strip().lower() in PLACEHOLDERS:
        return None
    sentences = [s for s in _SENTENCE.split(text.strip()) if s.strip()]
    declined = [s for s in sentences if _REFUSAL.search(s.lower())]
    if declined and (len(sentences) - len(declined) <= 2 or 2 * len(declined) >= len(sentences)) and sum(map(len, declined)) >= DECLINED_SHARE * len(text):
        return "refusal"
    if copies(question, text):
        return "copies_question"
    if len(text.split()) > short_answer or _CJK.search(text) and len(text) > 5 * short_answer:
        if terminal.predict(end_features(text)) == "cut":
            return "truncated"
        got = language(text)
        allowed = asked_languages(question)
        if got and allowed and got not in allowed:
            return "wrong_language"
    return None


def found(df: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``pair_id`` and ``defect`` of each defective pair."""
    pairs = df.select("pair_id", "question", "answer")
    terminal = fit_terminal_model(pairs, training_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judged = [defect(q, a, terminal) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(judged, pa.string())], names=["pair_id", "defect"])

    return pairs.mapInArrow(run, "pair_id long, defect string").where("defect IS NOT NULL")
