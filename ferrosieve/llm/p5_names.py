"""Problem 5: variant spellings of the names of people and bodies.

Method. Every distinct spelling is parsed into its parts: of people surname, given name (nicknames and near
misses of known given names lead to one root), initials; of bodies place and kind (abbreviations written out,
legal forms, articles and departments dropped). Spellings with equal parts form a unit. Units that may be
typing errors of another are blocked by the phonetic codes of the pieces of their sorted tokens, so that one
error leaves at least one block shared, and compared by Jaro-Winkler and edit distance; a unit follows a more often
spelled one. Given names outside the list are compared likewise within a surname, and with the surname where the order may be turned. Short forms (initials, acronyms, the place alone) follow the one entity they
fit, and stay alone where several fit. Entities are the connected components of these links.

Only distinct spellings are compared, never rows. The units of one entity are linked to one unit each, so links
grow with the units; the components are found by label propagation with tables in the shared folder. All pairs
of an entity are written only because the result is defined so.

Defined results: null and blank names and the sentinels are no names; a spelling is only ever linked within its
list; equal names in two lists are two kinds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from ferrosieve.tables import settle

SENTINELS = ("Manual Upload", "Unknown")  # fixed values of the record source

# Given names and the short forms in use for them.
GIVEN_NAMES = """
aleksandr alexander alexandre alejandro: sasha alex sascha alec sandy ale
andrew andreas andrea andrei: andy drew
anna anne: annie
anthony antonio anton: tony toni
benjamin: ben benny benji
catherine: cathy
charles carlos carl: chuck charlie carlo
christopher christoph cristobal: chris kit topher
daniel: dan danny
david: dave
dimitri dmitri: dima mitya
dorothea dorothy: thea dora dolly dot
edward eduard eduardo: ned ed eddie
ekaterina: katya katja
elizabeth elisabeth: liz beth betty lizzie eliza lisa
francisco: paco pancho fran
frederick friedrich: fred freddie fritz
gabriela gabriele gabrielle: gabi gaby
george georg jorge:
giuseppe: beppe peppe pino
gregory: greg
henry heinrich: hank harry heinz
ingrid: inga
james: jim jimmy jamie
jennifer: jenny jen
johannes johann: hannes hans
john: jack johnny
joseph josef: joe jos joey
katherine katharina: kate kathy katie kitty
kenji: ken
leonardo leonhard leonard: leo leon lenny
margaret margarete: peggy maggie meg greta
maria: mia
matthias matthew: matze matt matthes
michael: mike mick micha mischa
nikolaus nikolas nicholas nicolas: klaus niklas niko nick nico
oskar oscar: ossi
patricia: pat patty trish
patrick: paddy
peter: pete
philip philipp: phil
rebecca: becky becca
richard: dick rick rich ricky
robert: bob rob bobby bert robbie
samuel: sam sammy
sebastian: basti
stephen steven stefan: steve
susan susanne: susi sue suzy sanne
theodore theodor: ted theo teddy
thomas: tom tommy
timothy: tim
ulrike: uli ulli rike
ursula: uschi
victoria viktoria: vicky vicki tori
walter: walt
william wilhelm: bill will billy willy willi
zofia sofia sophia: zosia zo sofie
"""
# Words of the kind of a body and their abbreviations.
BODY_WORDS = """
academy: acad
aerospace: aerosp
agency:
applied: appl
automotive: autom automot
autonomous: auton
cars:
center centre: ctr cent
college: coll
communications: comm
computing: comput
council:
dynamics: dyn
electronics: electron elec
engineering: eng engrg engin
faculty: fac
foundation: found
group: grp
hospital: hosp
industries: ind
informatics: inform
institute: inst
instruments: instrum
international: intl int
laboratory laboratories: lab labs
logistics:
machines:
mobility:
motors: mot
national: natl nat
optics:
perception: percept
photonics:
polytechnic: polytech
research: res
robotics: robot
school: sch
science sciences: sci
semiconductors: semicond semi
sensing: sens
sensors:
simulation: sim simul
software: softw sw
studies: stud
systems: syst sys
technologies:
technology technical: tech technol techn
test testing:
transport: transp
university: univ uni
vehicle vehicles: veh
vision:
"""
LEGAL = frozenset("ltd limited inc incorporated gmbh ag co corp corporation company llc plc sa srl spa kg bv nv oy ab se".split())
STOPS = frozenset("the of for and in at de la le der die das und et y del von".split())
TITLES = frozenset("dr prof professor phd md jr sr mr mrs ms msc bsc dipl ing habil rer nat".split())
# Fixed value: groups of consonants that sound alike; vowels, h, w and y have no code.
PHONETIC = {c: d for d, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}


def _table(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in text.strip().splitlines():
        names, _, shorts = line.partition(":")
        root = names.split()[0]
        for w in names.split() + shorts.split():
            out.setdefault(w, root)
    return out


_GIVEN, _BODY = _table(GIVEN_NAMES), _table(BODY_WORDS)


def fold(text: str) -> str:
    """Lower case without accents; umlauts written with e are as the letter alone."""
    t = text.lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "a").replace("œ", "o")
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    return t


def _flat(word: str) -> str:
    return re.sub(r"(a|o|u)e", r"\1", word)


def edits_within_one(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours leads from a to b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(first, second)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    head = 0
    while head < min(4, len(a), len(b)) and a[head] == b[head]:
        head += 1
    return jaro + 0.1 * head * (1 - jaro)


def _root(word: str, table: dict[str, str], least: int = 4) -> str | None:
    """The root of a known word, or of the one longer known word an edit away."""
    if word in table:
        return table[word]
    if len(word) >= least:
        near = {table[w] for w in table if len(w) > least and edits_within_one(w, word) and jaro_winkler(w, word) >= 0.85}
        if len(near) == 1:
            return near.pop()
    return None


def _legal(word: str) -> bool:
    return word in LEGAL or len(word) > 7 and any(edits_within_one(w, word) for w in LEGAL if len(w) > 6)


def parse_person(name: str) -> tuple[str, str, str, str]:
    """(surname, root of the given name or "", first initial, other initials)."""
    parts = [[w for w in re.findall(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*", fold(p)) if w not in TITLES] for p in name.split(",")]
    parts = [p for p in parts if p]
    if not parts:
        return "", "", "", ""
    if len(parts) > 1:
        surname, rest = parts[0], [w for p in parts[1:] for w in p]
    else:
        words = parts[0]
        full = [w for w in words if len(w) > 1]
        if len(full) >= 2:
            head, tail = _root(full[0], _GIVEN), _root(full[-1], _GIVEN)
            surname = [full[0]] if tail and not head else [full[-1]]
        else:
            surname = full or words[-1:]
        rest = list(words)
        for w in surname:
            rest.remove(w)
    given = next((w for w in rest if len(w) > 1), "")
    root = _root(given, _GIVEN) or _root(_flat(given), _GIVEN) or _flat(given)
    initials = [w[0] for w in rest if len(w) == 1 or w != given]
    first = root[:1] or (initials[0] if initials else "")
    return "".join(surname), root, first, "".join(initials if root else initials[1:])


def parse_body(name: str) -> tuple[str, str, str, str]:
    """(place, kind or "", acronym or "", acronym that the name spells out or "")."""
    given = re.findall(r"\(([A-Z]{2,8})\)", name)
    text = re.sub(r"\([^)]*\)", " ", name)
    text = re.sub(r"(?i)^\s*(dept|department|div|division|faculty|fac|school)\b\.?[^,]*,\s*", "", text)
    text = re.sub(r"(?i),\s*(dept|department|div|division|faculty|school)\b.*$", "", text)
    bare = text.strip()
    if re.fullmatch(r"[A-Z]{2,8}", bare) and _root(bare.lower(), _BODY) is None:
        return "", "", bare, ""
    words = [w for w in re.findall(r"[^\W\d_]+", fold(text)) if not _legal(w) and w not in STOPS]
    kind, place = [], []
    for w in words:
        root = _root(w, _BODY)
        (kind if root else place).append(root or w)
    ordered = "" if "," in text.split("(")[0].rstrip(" ,") and not re.search(r"(?i)\b(co|inc)\b", text) else "".join((_root(w, _BODY) or w)[0] for w in words).upper()
    return "".join(place), " ".join(sorted(set(kind))), given[0] if given else "", ordered if kind else ""


def codes(word: str) -> list[str]:
    """Phonetic codes of the two halves of a word, each in two lengths, so that one edit leaves one in common."""
    out = []
    for h in {max(1, (len(word) - 1) // 2), max(1, (len(word) - 1) // 2 - 1)}:
        for side, piece in (("<", word[:h]), (">", word[-h:])):
            out.append(f"{side}{h}{piece[0] if side == '<' else piece[-1]}{''.join(PHONETIC.get(c, '') for c in piece)}")
    return out


def _units(names: DataFrame) -> DataFrame:
    """kind, name and its unit: main (surname or place), tag (given root or kind of body), ini, more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [(parse_person if k == "author" else parse_body)(n) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cols = [pa.array([p[i] for p in parsed], pa.string()) for i in range(4)]
            flat = pa.array([_flat(p[0]) for p in parsed], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, flat], names=["kind", "name", "main", "tag", "ini", "more", "flat"])

    return names.mapInArrow(run, "kind string, name string, main string, tag string, ini string, more string, flat string")


def edits_within_two(a: str, b: str) -> bool:
    """Whether at most two insertions, deletions, replacements or swaps of neighbours lead from a to b."""
    if abs(len(a) - len(b)) > 2:
        return False
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, d in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != d))
            if older and j > 1 and c == b[j - 2] and a[i - 2] == d:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1] <= 2


def near_names(p: str, q: str, ratio: float) -> bool:
    """Whether p may be a misspelling of q, which is spelled ``ratio`` times as often.

    One edit and a Jaro-Winkler similarity of 0.84 (an edit near the start costs much similarity where letters repeat); names of
    three and four letters have so many neighbours that the right one must be spelled three times as often. Two edits need seven
    letters, a similarity of 0.9 and twice as many spellings.
    """
    if min(len(p), len(q)) < 3:
        return False
    similarity = jaro_winkler(p, q)
    if edits_within_one(p, q):
        return similarity >= 0.84 if max(len(p), len(q)) >= 5 else similarity >= 0.75 and ratio >= 3
    return len(p) >= 7 and similarity >= 0.9 and ratio >= 2 and edits_within_two(p, q)


def _close(pairs: DataFrame) -> DataFrame:
    """Keep the rows (a, b, nx, ny) whose names are near."""

    def near(a: pa.Array, b: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([near_names(p, q, m / n) for p, q, n, m in zip(a.to_pylist(), b.to_pylist(), x.to_pylist(), y.to_pylist())], pa.bool_())

    return pairs.where(F.arrow_udf(near, "boolean", ArrowUDFType.SCALAR)("a", "b", "nx", "ny"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component), by label propagation and pointer jumping."""
    both = settle(links.select("x", "y").union(links.select("y", "x")).where("x <> y").distinct(), "p5-links")
    labels = settle(nodes.select("node", F.col("node").alias("label")), "p5-labels")
    if both.isEmpty():
        return labels
    while True:
        heard = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("heard"))
        told = labels.join(heard, labels["node"] == heard["x"], "left").select("node", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("old"))
        jump = told.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = settle(told.join(jump, "label", "left").select("node", F.least("label", F.coalesce("root", "label")).alias("label"), "old"), "p5-labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def link(names: DataFrame) -> DataFrame:
    """``kind``, ``name`` and ``entity`` of distinct spellings (kind, name)."""
    parsed = settle(_units(names).where("main <> '' OR ini <> ''"), "p5-parsed")
    node = F.when((F.col("kind") == "author") & (F.col("tag") == ""), F.concat_ws("|", "kind", "flat", F.lit(""), "ini", "more"))
    node = node.when(F.col("main") == "", F.concat_ws("|", "kind", F.lit("="), "ini")).otherwise(F.concat_ws("|", "kind", "flat", "tag"))
    parsed = settle(parsed.withColumn("node", node), "p5-nodes")
    units = parsed.groupBy("node", "kind", "flat", "tag").agg(F.count("*").alias("n"), F.min("ini").alias("ini"), F.min_by("main", F.struct(F.length("main"), "main")).alias("main"))
    full = settle(units.where("tag <> '' AND main <> ''"), "p5-full")
    code = F.arrow_udf(lambda words: pa.array([codes(w) for w in words.to_pylist()], pa.list_(pa.string())), "array<string>", ArrowUDFType.SCALAR)
    keyed = settle(full.select("node", "kind", "main", "tag", "n", F.explode(code("main")).alias("code")), "p5-keys")
    odd = keyed.select(F.col("node").alias("x"), "kind", "tag", "code", F.col("main").alias("a"), F.col("n").alias("nx"))
    pairs = odd.join(keyed.select(F.col("node").alias("y"), "kind", "tag", "code", F.col("main").alias("b"), F.col("n").alias("ny")), ["kind", "tag", "code"])
    # of two units the one with fewer spellings follows
    pairs = pairs.where("x <> y AND (ny > nx OR ny = nx AND nx <= 2 AND y < x)").select("x", "y", "a", "b", "nx", "ny").distinct()
    typos = _close(pairs).groupBy("x").agg(F.max_by("y", F.struct("ny", "y")).alias("y"))
    # errors in given names that are not listed; listed ones were led to their roots
    strangers = full.where((F.col("kind") == "author") & ~F.col("tag").isin(*sorted(set(_GIVEN.values())))).select("node", "flat", "tag", "n", F.explode(code("tag")).alias("code"))
    odd = strangers.select(F.col("node").alias("x"), "flat", "code", F.col("tag").alias("a"), F.col("n").alias("nx"))
    pairs = odd.join(strangers.select(F.col("node").alias("y"), "flat", "code", F.col("tag").alias("b"), F.col("n").alias("ny")), ["flat", "code"])
    givens = _close(pairs.where("x <> y AND ny >= 2 * nx").select("x", "y", "a", "b", "nx", "ny").distinct()).groupBy("x").agg(F.max_by("y", F.struct("ny", "y")).alias("y"))
    # surname first without a comma: the same two names the other way round, where neither is a known given name
    turned = full.where("kind = 'author'").select(F.col("node").alias("y"), F.col("tag").alias("flat"), F.col("flat").alias("tag"), F.col("n").alias("ny"))
    turned = strangers.select(F.col("node").alias("x"), "flat", "tag", F.col("n").alias("nx")).distinct().join(turned, ["flat", "tag"]).where("ny > nx OR ny = nx AND y < x").groupBy("x").agg(F.max("y").alias("y"))
    typos = settle(typos.union(givens).union(turned), "p5-typos")
    entity = settle(components(full, typos).join(full.select("node", "kind", "main", "flat", "tag", "ini", "n"), "node"), "p5-entities")

    # initials follow the one person of that surname and initial; other initials help where several fit
    short = settle(parsed.where("kind = 'author' AND tag = '' AND main <> ''").groupBy("node", "flat", "ini", "more").agg(F.min("main").alias("main")), "p5-short")
    middles = parsed.where("kind = 'author' AND tag <> '' AND more <> ''").select(F.col("node").alias("holder"), F.col("more").alias("middle")).distinct()
    people = entity.where("kind = 'author'").select("label", F.col("node").alias("holder"), F.col("flat").alias("surname"), F.substring("tag", 1, 1).alias("first"))
    of_middle = people.join(middles, "holder").select("label", "middle").distinct()
    fits = short.join(people.select("surname", "first", "label").distinct(), (F.col("flat") == F.col("surname")) & (F.col("ini") == F.col("first")))
    fits = fits.join(of_middle.groupBy("label").agg(F.collect_set("middle").alias("middles")), "label", "left")
    agrees = (F.col("more") != "") & F.coalesce(F.array_contains("middles", F.col("more")), F.lit(False))
    fits = fits.groupBy("node").agg(F.collect_set("label").alias("all"), F.collect_set(F.when(agrees, F.col("label"))).alias("best"))
    one = F.when(F.size("all") == 1, F.col("all")[0]).when(F.size("best") == 1, F.col("best")[0])
    attached = fits.select(F.col("node").alias("x"), one.alias("y"))
    lost = short.join(attached.select(F.col("x").alias("node")), "node", "left_anti").select("node", "main", "ini", F.explode(code("main")).alias("code"))
    near = lost.join(entity.where("kind = 'author'").select("label", F.col("main").alias("b"), F.substring("tag", 1, 1).alias("ini"), "n", F.explode(code("main")).alias("code")), ["ini", "code"])
    near = _close(near.select(F.col("node").alias("x"), F.col("label").alias("y"), F.col("main").alias("a"), "b", F.col("n").alias("nx"), F.col("n").alias("ny")).distinct()).groupBy("x").agg(F.collect_set("y").alias("ys")).where("size(ys) = 1").select("x", F.col("ys")[0].alias("y"))

    # a place alone and an acronym follow the one body they fit
    bodies = entity.where("kind = 'institution'")
    alone = parsed.where("kind = 'institution' AND tag = '' AND main <> ''").select("node", "flat").distinct()
    by_place = alone.join(bodies.select("flat", "label").distinct(), "flat").groupBy("node").agg(F.collect_set("label").alias("ys")).where("size(ys) = 1").select(F.col("node").alias("x"), F.col("ys")[0].alias("y"))
    letters = parsed.where("kind = 'institution' AND main = ''").select("node", "ini").distinct()
    spelled = parsed.where("kind = 'institution' AND tag <> '' AND main <> ''").join(entity.select("node", "label", F.col("n").alias("weight")), "node")
    told = spelled.where("ini <> ''").select("ini", "label").distinct().groupBy("ini").agg(F.collect_set("label").alias("told"))
    fit = spelled.where("more <> ''").select(F.col("more").alias("ini"), "label").distinct().groupBy("ini").agg(F.collect_set("label").alias("fit"))
    by_letters = letters.join(told, "ini", "left").join(fit, "ini", "left").select(F.col("node").alias("x"), F.when(F.size("told") == 1, F.col("told")[0]).when(F.col("told").isNull() & (F.size("fit") == 1), F.col("fit")[0]).alias("y"))

    extra = attached.unionByName(near).unionByName(by_place).unionByName(by_letters).where("y IS NOT NULL")
    final = components(units.select("node"), typos.select("x", "y").unionByName(extra))
    return parsed.select("kind", "name", "node").join(final, "node").select("kind", "name", F.col("label").alias("entity"))


def distinct_names(df: DataFrame) -> DataFrame:
    lists = df.select(F.lit("author").alias("kind"), F.explode("authors").alias("name")).union(df.select(F.lit("institution"), F.explode("affiliated_institutions")))
    return lists.where(F.col("name").isNotNull() & (F.trim("name") != "") & ~F.col("name").isin(*SENTINELS)).distinct()


def members(df: DataFrame) -> DataFrame:
    """``name_kind``, ``name`` and ``entity`` of every distinct spelling: the links without writing out all pairs."""
    return link(distinct_names(df)).select(F.col("kind").alias("name_kind"), "name", "entity")


def found(df: DataFrame) -> DataFrame:
    """``name_kind``, ``name_a``, ``name_b``: all pairs of spellings of one entity."""
    linked = settle(link(distinct_names(df)), "p5-linked")
    a, b = linked.select("kind", "entity", F.col("name").alias("name_a")), linked.select("kind", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["kind", "entity"]).where("name_a < name_b").select(F.col("kind").alias("name_kind"), "name_a", "name_b")
