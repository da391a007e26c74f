"""Column expressions that stay on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrosieve.config import NO_ABSTRACT, PATENT_SOURCES

# Typographic ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}

# Repairs of misread class codes.
IPC_WHOLE = {"BOQ": "B60Q", "GO5SD": "G05D", "BEOW": "B60W", "BGOW": "B60W", "B6OW": "B60W", "CO6N": "G06N", "C06N": "G06N"}
IPC_DIGITS = {"O": "0", "Q": "0", "D": "0", "E": "6", "I": "1", "L": "1", "G": "6", "B": "6", "S": "5", "A": "4", "Z": "2"}
IPC_LETTERS = {"G060": "G06Q", "G06Y": "G06V", "B25I": "B25J"}
IPC_SLASHES = {
    "G01M 17007": "17/007", "G06F 162457": "16/2457", "G06N 308": "3/08", "G06T 1520": "15/20", "G06T 1700": "17/00", "G06V 10125": "10/25", "B60R 104": "1/04",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def strip(c: Column) -> Column:
    """Without whitespace of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_patent(source: Column) -> Column:
    return source.isin(*PATENT_SOURCES)


def missing_abstract(abstract: Column) -> Column:
    """Null, empty, a sentinel, or shorter than 50 characters."""
    a = F.coalesce(abstract, F.lit(""))
    return (a == "") | F.lower(a).contains(NO_ABSTRACT) | (F.length(strip(a)) < 50)


def valid_abstract(abstract: Column) -> Column:
    """Neither empty nor a sentinel, whatever its length."""
    a = F.coalesce(abstract, F.lit(""))
    return (a != "") & ~F.lower(a).contains(NO_ABSTRACT)


def full_text_success(source: Column, chars: Column) -> Column:
    return F.coalesce(chars, F.lit(0)) > F.when(is_patent(source), 1000).otherwise(1500)


def usable_question(question: Column) -> Column:
    q = strip(F.coalesce(question, F.lit("")))
    return (q != "") & (q != "nan")


def safe_id(c: Column) -> Column:
    return F.translate(c, "/", "_")


def parent_id(explicit: Column, chunk_id: Column) -> Column:
    """The explicit parent, else the id up to the last ``_chunk_``, else the id."""
    head = F.regexp_extract(chunk_id, r"(?s)^(.*)_chunk_", 1)
    return F.coalesce(blank_to_null(explicit), blank_to_null(head), chunk_id)


def publication_number(number: Column, parent: Column) -> Column:
    return F.coalesce(F.when(number != "", number), parent)


def joined(c: Column, by: str = "; ") -> Column:
    """A list as one string; null gives the empty string."""
    return F.coalesce(F.array_join(c, by), F.lit(""))


def normalise_ligatures(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), LIGATURES.items(), c)


def collapse_spaced_header(line: Column) -> Column:
    """``A B S T R A C T`` as ``ABSTRACT``; words are told apart by two or more spaces. Always stripped."""
    s = strip(line)
    words = F.array_join(F.transform(F.split(s, r"\s{2,}"), lambda w: F.regexp_replace(w, r"\s+", "")), " ")
    return F.when(s.rlike(r"^[A-Z](\s+[A-Z]){4,}$"), F.when(words == "ARTICLEINFO", "ARTICLE INFO").otherwise(words)).otherwise(s)


def parse_date(c: Column) -> Column:
    """``dd.mm.yyyy``, else ``d Month yyyy``, else ``Month d, yyyy``; impossible dates give way to the next form."""
    s = F.regexp_replace(c, r"(?U)\s+", " ")
    dotted = F.try_to_date(F.regexp_extract(s, r"\b(\d{2}\.\d{2}\.\d{4})\b", 1), "dd.MM.yyyy")
    sept = lambda x: F.regexp_replace(x, r"(?i)\bsept\b", "Sep")
    title = lambda x: F.initcap(F.substring(x, 1, 3))
    day_first = F.concat_ws(" ", F.regexp_extract(s, r"\b(\d{1,2}) ([A-Za-z]{3,9})\.? (\d{4})\b", 1), title(sept(F.regexp_extract(s, r"\b(\d{1,2}) ([A-Za-z]{3,9})\.? (\d{4})\b", 2))), F.regexp_extract(s, r"\b(\d{1,2}) ([A-Za-z]{3,9})\.? (\d{4})\b", 3))
    month = r"\b([A-Za-z]{3,9})\.? (\d{1,2}) ?[,.] ?(\d{4})\b"
    month_first = F.concat_ws(" ", F.regexp_extract(s, month, 2), title(sept(F.regexp_extract(s, month, 1))), F.regexp_extract(s, month, 3))
    return F.coalesce(dotted, F.try_to_date(day_first, "d MMM yyyy"), F.try_to_date(month_first, "d MMM yyyy"))


def long_date(d: Column) -> Column:
    """``Month d, yyyy``."""
    return F.date_format(d, "MMMM d, yyyy")


def normalise_ipc(prefix: Column, group: Column) -> Column:
    """A class code with its usual misreadings set right, such as ``GOGT 1520`` as ``G06T 15/20``."""
    p = F.replace(F.upper(prefix), F.lit(" "), F.lit(""))
    p = F.when(p.rlike("[É,]"), F.lit("G06N")).otherwise(F.coalesce(F.try_element_at(_map(IPC_WHOLE), p), p))
    digits = F.translate(F.substring(p, 2, 2), "".join(IPC_DIGITS), "".join(IPC_DIGITS.values()))
    fixed = F.concat(F.substring(p, 1, 1), digits, F.substring(p, 4, 1))
    p = F.when(F.length(p) == 4, F.coalesce(F.try_element_at(_map(IPC_LETTERS), fixed), fixed)).otherwise(p)
    g = strip(group)
    g = F.when(g.contains("/"), g).otherwise(F.coalesce(F.try_element_at(_map(IPC_SLASHES), F.concat_ws(" ", p, g)), g))
    return F.concat_ws(" ", p, g)


def extract_doi(text: Column, window: int = 15_000) -> Column:
    """The first DOI of the opening window without closing points; null without one."""
    found = F.regexp_extract(F.substring(text, 1, window), r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b", 1)
    return F.when(found != "", F.rtrim(found, F.lit(".")))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine in double precision; null where a vector is zero or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), 1 - F.try_divide(dot(a, b), F.nullif(norm, F.lit(0.0))))


def normalise_score(v: Column) -> Column:
    """A score of any usual scale in [0, 1]: up to 10 counts in tenths, above in hundredths."""
    scaled = F.when((v > 1) & (v <= 10), v / 10).when(v > 10, v / 100).otherwise(v)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))


def judge_points(v: Column) -> Column:
    """Whole points in [0, 10], halves to even."""
    return F.greatest(F.lit(0), F.least(F.lit(10), F.bround(v, 0).cast("int")))


def truncate_context(text: Column, most: int = 5_500, keep: int = 2_500) -> Column:
    """Long contexts keep their head and tail."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("\n...\n"), F.substring(text, -keep, keep))).otherwise(text)


def percent(flag: Column) -> Column:
    """Share of true in per cent; 0 over no rows."""
    return F.coalesce(F.avg(flag.cast("int")) * 100, F.lit(0.0))


def mean_of_numbers(v: Column) -> Column:
    """Mean without nulls and NaN."""
    return F.avg(F.when(~F.isnan(v), v))


def hyphen_join(lines: Column, kept_prefixes: list[str]) -> Column:
    """Lines put together; a hyphen at a line end stays after a known prefix or before a capital, else it goes."""
    prefixes = F.array(*[F.lit(p) for p in kept_prefixes])

    def add(acc: Column, line: Column) -> Column:
        prefix = F.regexp_extract(acc, r"([A-Za-z0-9]+)-$", 1)
        keeps = F.array_contains(prefixes, prefix) | line.rlike("^[A-Z]")
        return F.when(acc == "", line).when(acc.endswith("-"), F.when(keeps, F.concat(acc, line)).otherwise(F.concat(F.regexp_replace(acc, "-$", ""), line))).otherwise(F.concat_ws(" ", acc, line))

    return F.aggregate(lines, F.lit(""), add)


def restore_case(line: Column, acronyms: dict[str, str], first: bool) -> Column:
    """Sentence case for a line in title case; known acronyms keep their form and punctuation."""
    table = _map(acronyms)

    def word(w: Column, i: Column) -> Column:
        bare = F.lower(F.regexp_replace(w, "[^A-Za-z0-9]", ""))
        known = F.try_element_at(table, bare)
        kept = F.concat(F.regexp_extract(w, "^([^A-Za-z0-9]*)", 1), known, F.regexp_extract(w, "([^A-Za-z0-9]*)$", 1))
        lead = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))
        return F.coalesce(kept, F.when((i == 0) & F.lit(first), lead).otherwise(F.lower(w)))

    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    return F.regexp_replace(F.array_join(F.transform(words, word), " "), r"^Arule\b", "A rule")


def title_case(text: Column) -> Column:
    """Every run of letters with a capital: ``jean-pierre o'neil 3d`` gives ``Jean-Pierre O'Neil 3D``; ``initcap`` sees blanks only."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def title_cases(texts: Column) -> Column:
    """``title_case`` of each element."""
    return F.transform(texts, title_case)


def json_path(text: Column, path: str, kind: str, default: object) -> Column:
    """A value inside a JSON text by its path; the default where the text, the path or the type does not fit."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), path, kind), F.lit(default))
