"""The pN queries against SQL where SQL can express them, else against plain versions on small tables."""

import math
import os
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from ferrosieve.llm import p1_repair, p2_ledger, p3_split, p4_history, p4_kernel, p4_sweep, p5_names, p6_pairs, p7_canon, p8_encode, p9_pack, p10_stuffing, queries
from ferrosieve.tables import drop, settle, shared_dir, table

from ..oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, sf_dir, name):
    queries.QUERIES[name](spark, sf_dir).count()


RECORD = "row_id long, batch_no int, id string, title string, abstract string, full_text string, authors array<string>, affiliated_institutions array<string>, key string, n int, cls string, h string"


def records(spark, rows):
    names = ["row_id", "batch_no", "id", "title", "abstract", "full_text", "authors", "affiliated_institutions", "key", "n", "cls", "h"]
    return spark.createDataFrame([tuple(r.get(c, 1 if c == "batch_no" else "clash" if c in ("key", "cls", "h") else None) for c in names) for r in rows], RECORD)


@pytest.mark.parametrize("rows", [[], [{"row_id": 1}], [{"row_id": 1, "full_text": ""}, {"row_id": 2, "full_text": "", "batch_no": 2}]])
def test_record_operators_take_empty_and_null(spark, rows):
    df = records(spark, rows)
    assert p1_repair.found(df).count() == 0
    assert p1_repair.repaired(df).count() == len(rows)
    assert p2_ledger.found(df).count() == max(0, len(rows) - 1)
    assert p3_split.found(df).count() == 0 and p3_split.split_documents(df).count() == sum(r.get("full_text") is not None for r in rows)
    assert p4_history.found(df).count() == 0
    assert p5_names.found(df).count() == 0


# 1


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = "the vehicle sensor measures distance while driving through heavy traffic under strong rain because operators need reliable estimation of motion planning results during calibration without interruption".split()
    return ["\n".join(" ".join(rng.choice(words) for _ in range(9)) + "." for _ in range(30)) for _ in range(n)]


def test_noise_is_found_and_repaired(spark):
    texts = corpus()
    lines = texts[0].split("\n")
    pages = []
    for p in range(5):
        pages += ["Working paper 12.345", *lines[p * 6 : p * 6 + 6], f"Page {p + 1}"]
    misread = texts[1].replace("vehicle", "vchicle").replace("traffic", "trafflc").replace("sensor", "sen5or")
    broken = texts[2].replace("estimation", "estima-\ntion")
    df = records(spark, [{"row_id": i, "full_text": t} for i, t in enumerate([*texts, "\n".join(pages), misread, broken])])
    got = defaultdict(set)
    for r in p1_repair.found(df).collect():
        got[r.row_id].add(r.noise_kind)
    assert got == {60: {"running_header", "page_number"}, 61: {"misrecognition"}, 62: {"hyphenation"}}
    out = {r.row_id: r.text for r in p1_repair.repaired(df).collect()}
    assert all(out[i] == t for i, t in enumerate(texts))
    assert out[61].split() == texts[1].split() and out[62].split() == texts[2].split()
    assert "Page" not in out[60] and out[60].split() == texts[0].split()


def test_editor_on_held_out_words(spark):
    editor = p1_repair.fit(records(spark, [{"row_id": i, "full_text": t} for i, t in enumerate(corpus())]))
    right = [("drlving", "driving"), ("stvong", "strong"), ("opera~ors", "operators"), ("reliab1e", "reliable"), ("planriing", "planning"), ("clistance", None), ("duving", None)]
    assert sum(editor.correct(a) == b for a, b in right[:5]) >= 4
    assert [editor.correct(w) for w in ("driving", "Xanidcta", "BK-87", "4D", "km", "日本", "x" * 10_000)] == [None] * 7


def test_lexicon_keeps_every_word():
    rng = p1_repair.np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=p1_repair.np.uint64) << p1_repair.np.uint64(14)  # all start at few places
    words = [f"w{i}" for i in range(3000)]
    own = p1_repair.np.array([p1_repair.xxhash.xxh64_intdigest(w) for w in words], dtype=p1_repair.np.uint64)
    lexicon = p1_repair.Lexicon.build(p1_repair.np.concatenate([own, hashes]), p1_repair.np.full(8000, 3, p1_repair.np.uint8), 100)
    assert all(lexicon.level(w) == 3 for w in words) and lexicon.level("other") == 0


def test_lexicon_in_parts_keeps_rare_words(spark):
    texts = corpus(40)
    bad = [texts[1].replace("vehicle", "vchicle"), texts[3].replace("estimation", "cstimatlon"), texts[2]]
    df = records(spark, [{"row_id": i, "full_text": t} for i, t in enumerate([*texts, *bad])])
    whole, sample = p1_repair.build_lexicon(df, "full_text")
    parted, same = p1_repair.build_lexicon(df, "full_text", most_words=5)
    words = sorted(set().union(*map(p1_repair.words_of, [*texts, *bad])))
    assert len(parted.tables) > 3 and same == sample and parted.rare == whole.rare and whole.rare > 0
    assert {w: parted.level(w) for w in words} == {w: whole.level(w) for w in words}
    got = {(r.row_id, r.noise_kind) for r in p1_repair.found(df, most_words=5).collect()}
    assert got == {(40, "misrecognition"), (41, "misrecognition")}


def test_noise_does_not_depend_on_the_size_of_the_corpus(spark):
    texts = corpus(40)
    bad = [texts[1].replace("vehicle", "vchicle"), texts[3].replace("estimation", "cstimatlon"), texts[2]]
    rows = [{"row_id": i, "full_text": t} for i, t in enumerate([*texts, *bad])]
    small = {(r.row_id, r.noise_kind) for r in p1_repair.found(records(spark, rows)).collect()}
    many = [{"row_id": k * 100 + r["row_id"], "full_text": r["full_text"]} for k in range(10) for r in rows]
    large = {(r.row_id % 100, r.noise_kind) for r in p1_repair.found(records(spark, many)).collect()}
    assert small == {(40, "misrecognition"), (41, "misrecognition")} and (41, "misrecognition") in large


# 2


def test_dress_of_records_does_not_matter(spark):
    rows = [
        {"row_id": 1, "title": "A Title: One", "abstract": "Speed 1.5 m"}, {"row_id": 2, "title": "speed 1.5m", "abstract": "“A title” — one.", "batch_no": 2},
        {"row_id": 3, "title": "A Title One", "abstract": "Speed 15 m", "batch_no": 3}, {"row_id": 4, "title": None, "abstract": ""}, {"row_id": 5, "title": " ", "abstract": None, "batch_no": 3},
        {"row_id": 6, "title": "A TITLE, ONE", "abstract": "speed 1.5 m!", "batch_no": 9},
    ]
    got = {tuple(r) for r in p2_ledger.found(records(spark, rows)).collect()}
    assert got == {(1, 2), (1, 6), (4, 5)}
    counts = {r.first_row_id: r.copies for r in p2_ledger.counts(records(spark, rows)).collect()}
    assert counts == {1: 3, 3: 1, 4: 2}


def test_ledger_is_the_same_however_it_is_loaded(spark, sf_dir, tmp_path):
    keyed = p2_ledger.keyed_records(table(spark, sf_dir, "doc_records").union(table(spark, sf_dir, "doc_records").selectExpr("row_id + 1000 AS row_id", "batch_no + 1 AS batch_no", "* EXCEPT (row_id, batch_no)")))
    rows = lambda ledger: sorted(map(tuple, ledger.read().select("first_row_id", "n").collect()))
    one = rows(p2_ledger.build(keyed.withColumn("batch_no", F.lit(1))))
    many = p2_ledger.build(keyed, str(tmp_path), 10, least_rows=1)
    assert rows(many) == one and len(many.runs) <= 4
    again = p2_ledger.Ledger.open(spark, str(tmp_path))
    assert rows(again) == one and again.state["bucket_rows"] == 10 and max(r.of for r in again.runs) > 1
    total = keyed.select("key").distinct().count()
    assert again.state["rewritten"] <= total * (1 + math.log2(20))
    few = keyed.limit(2)
    assert again.lookup(few).count() == few.select("key").distinct().count()


# 3


def check_cut(text, limit=100, overlap=20):
    level, pieces = p3_split.split_text(text, limit, overlap)
    end = 0
    for i, (s, e) in enumerate(pieces):
        assert s <= end and e > s and e - s <= limit and end - s <= overlap or i == 0
        end = e
    assert end == len(text) and (not text or pieces[0][0] == 0)
    return level


def naive_level(text, limit):
    lines = text.split("\n")
    stretches, current = [0], []
    for line in [*lines, ""]:
        if line.strip():
            current.append(line)
        elif current:
            stretches.append(len("\n".join(current)))
            current = []
    if max(stretches) <= limit:
        return "blank_line"
    if max(map(len, lines)) <= limit:
        return "line"
    return "space" if max(map(len, text.split() or [""])) <= limit else "none"


def test_cuts_by_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["word ", "a", "\n", "\n\n", " \n", ". ", "x" * rng.randrange(1, 60), "語", " "]) for _ in range(rng.randrange(1, 120)))
        level = check_cut(text)
        assert level == ("whole" if len(text) <= 100 else naive_level(text, 100)), repr(text)
    assert check_cut("y" * 5000) == "none" and check_cut("\n" * 500) == "blank_line" and check_cut("a b " * 100_000) == "space"
    assert p3_split.split_text(None) == ("whole", []) and p3_split.split_text("") == ("whole", [(0, 0)])


# 4


def plain_history(rows, least=0.55):
    accepted, out = [], set()
    for r in sorted(rows, key=lambda x: x["row_id"]):
        for a in accepted:
            same = r.get("id") is not None and a.get("id") == r.get("id")
            if same or (a.get("full_text") or "").split() and (r.get("full_text") or "").split() and p4_history.similar(a["full_text"], r["full_text"], least):
                out.add((a["row_id"], r["row_id"]))
                break
        else:
            accepted.append(r)
    return out


def drift(rng, words, n):
    return [w if rng.random() > n else f"new{rng.randrange(999)}" for w in words]


@pytest.mark.parametrize("hot,batch,one_task,prints", [(1000, 70, 1000, 10**6), (1000, 20, 1000, 10**6), (1000, 25, 1000, 0), (1000, 70, 0, 0), (2, 70, 1000, 10**6), (3, 20, 1000, 0)])
def test_history_by_brute_force(spark, hot, batch, one_task, prints):
    rng = random.Random(hot)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(160)] for _ in range(5)]
    rows = []
    for i in range(70):
        base = bases[0] if i % 3 == 0 else rng.choice(bases)
        words = base if rng.random() < 0.3 else drift(rng, base, rng.choice([0.03, 0.08, 0.12]))
        rows.append({"row_id": i + 1, "batch_no": i // batch, "id": rng.choice([None, f"id{rng.randrange(60)}"]), "full_text": rng.choice([" ".join(words), " ".join(words), None])})
    rule = p4_history.Rule(hot=hot, one_task=one_task, one_task_prints=prints, least_coverage=0.02, dropped=0.02, boundary=16, least_bytes=8, window=4)
    got = {tuple(r) for r in p4_history.found(records(spark, rows), rule=rule, least_rows=1).collect()}
    assert got == plain_history(rows)


@pytest.mark.parametrize("batch", [8, 3])
def test_history_of_repeated_passages(spark, batch):
    rng = random.Random(9)
    forms = [[f"{c}{rng.randrange(3000)}" for _ in range(40)] for c in "abc"]
    repeated = [f * 25 for f in forms]
    edited = [w if rng.random() > 0.01 else "new" for w in repeated[1]]
    within = forms[2] * 24 + ["end"]
    texts = [*repeated, repeated[0], edited, within, forms[0], forms[1] * 5]
    rows = [{"row_id": i + 1, "batch_no": 1 + i // batch, "id": f"id{i}", "full_text": " ".join(t)} for i, t in enumerate(texts)]
    want = plain_history(rows)
    assert {(1, 4), (2, 5), (3, 6)} == want
    assert {tuple(r) for r in p4_history.found(records(spark, rows), least_rows=1).collect()} == want


def test_pairs_of_hot_and_cold_chunks(spark):
    """Two texts share 4 % in a chunk of many holders and 4 % in one that no other text holds, and are alike word by word."""
    rng = random.Random(4)
    rule = p4_history.Rule(hot=3, dropped=0.0, least_coverage=0.05)
    hot, cold = " ".join(f"hot{i}" for i in range(40)), " ".join(f"cold{i}" for i in range(40))
    shared = [f"s{i % 50}" for i in range(900)]
    alike = lambda k: " ".join([hot, cold, *(w if i % 3 else f"own{k}x{i}" for i, w in enumerate(shared))])
    other = lambda k: " ".join([hot, *(f"other{k}x{rng.randrange(10**6)}" for i in range(900))])
    rows = [{"row_id": k, "full_text": alike(k) if k in (2, 3) else other(k)} for k in range(1, 6)]
    want = plain_history(rows)
    assert want == {(2, 3)}
    assert {tuple(r) for r in p4_history.found(records(spark, rows), rule=rule, least_rows=1).collect()} == want


def test_history_lasts_and_opens_only_the_buckets_it_needs(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(96)]
    rows = [{"row_id": i, "batch_no": i // 8, "id": f"id{i}", "full_text": t} for i, t in enumerate(texts)]
    probe = records(spark, [{"row_id": 500, "full_text": " ".join(texts[3].split()[4:])}])
    raw = p4_history.chunk_records(probe, p4_history.Rule())
    prints = p4_history._prints(raw).drop("load")
    read = []
    for part in (rows[:48], rows[48:]):
        history = p4_history.History.open(spark, str(tmp_path), bucket_rows=4, text_rows=4, fan=4)
        assert p4_history.found(records(spark, part), history=history, least_rows=1).count() == 0
        read.append((sum(r.rows for r in history.runs), p4_history.History.open(spark, str(tmp_path)).prints_met_by(prints).count()))
    (all_1, read_1), (all_2, read_2) = read
    assert all_2 > 1.9 * all_1 and read_1 < 0.5 * all_1 and read_2 <= 1.3 * read_1, read
    again = p4_history.History.open(spark, str(tmp_path))
    assert again.accepted().count() == 96 and again.texts_of([0]).count() == 4
    assert [tuple(r) for r in p4_history.found(probe, history=again).collect()] == [(3, 500)]


def test_history_of_test_table(spark, sf_dir):
    rows = [r.asDict() for r in table(spark, sf_dir, "doc_records").select("row_id", "id", "full_text").collect()]
    assert {tuple(r) for r in queries.QUERIES["p4_found"](spark, sf_dir).collect()} == plain_history(rows)


@pytest.mark.parametrize("batch,one_task", [(50, 1000), (2, 1000), (50, 0)])
def test_history_finds_texts_without_a_common_chunk(spark, batch, one_task):
    """Three words of five are the same, in turn with others, so that no run of three words is shared; also passages that most records hold."""
    rng = random.Random(8)
    base = [f"word{rng.randrange(10**6)}" for _ in range(300)]
    mixed = lambda k, of: " ".join(w if i % 5 in of else f"own{k}x{i}" for i, w in enumerate(base))
    common = " ".join(f"common{i}" for i in range(120))
    texts = [mixed(1, (0, 2, 4)), mixed(2, (0, 2, 4)), mixed(3, (0, 2)), *(f"{common} {' '.join(f'o{k}x{i}' for i in range(n))}" for k, n in ((4, 90), (5, 95), (6, 90), (7, 105))), " ".join(reversed(base)), " ".join(base[:200])]
    rows = [{"row_id": i + 1, "batch_no": i // batch, "full_text": t} for i, t in enumerate(texts)]
    want = plain_history(rows)
    assert want == {(1, 2), (4, 5), (4, 6)}
    rule = p4_history.Rule(one_task=one_task)
    assert {tuple(r) for r in p4_history.found(records(spark, rows), rule=rule, least_rows=1).collect()} == want


def test_sweep_by_brute_force():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghij" if i % 2 else "abcde") for _ in range(rng.randrange(0, 60))) for i in range(120)]
    sweep = p4_sweep.Sweep(p4_sweep.Piece.of(list(range(60, 120)), texts[60:]), 0.55).ready()
    want = {(x, w) for x in range(60, 120) for w in range(x) if p4_history.similar(texts[w], texts[x], 0.55)}
    assert set(sweep.similar(list(range(120)), texts)) == want and 20 < len(want) < 5000


@pytest.mark.parametrize("piece", [1000, 25])
def test_sweep_on_the_jvm(spark, monkeypatch, piece):
    """The compiled sweep gives what the plain one gives, also by several pieces, of short texts and of long ones with common and rare words."""
    monkeypatch.setattr(p4_sweep, "PIECE", piece)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij" if i % 2 else "abcdé") for _ in range(rng.randrange(0, 60))) for i in range(80)]
    bases = [[f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] for _ in range(3)]
    texts += [" ".join(drift(rng, bases[i % 3], rng.choice([0.1, 0.3, 0.44, 0.46, 0.6]))) for i in range(40)]
    rng.shuffle(texts)
    both = settle(p4_kernel.words(spark.createDataFrame(list(enumerate([*texts, None])), "cls long, text string")), "words")
    own = both.where("cls >= 60")
    got = p4_sweep.swept(own, own.count(), both.where("cls < 60"), 0.55).collect()
    want = {(x, w) for x in range(60, 120) for w in range(x) if p4_history.similar(texts[w], texts[x], 0.55)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50
    drop(both)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in both.inputFiles())


def test_sweep_on_the_jvm_counts_many_texts_at_once(spark):
    """Several longs of texts, words of one text, of a few and of most, counts near the share, and lengths of all kinds."""
    rng = random.Random(5)
    bases = [[f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([7, 33, 130, 260]))] for _ in range(40)]
    texts = [" ".join(drift(rng, bases[rng.randrange(40)], rng.choice([0.2, 0.42, 0.44, 0.46, 0.48]))) for _ in range(700)]
    both = settle(p4_kernel.words(spark.createDataFrame(list(enumerate(texts)), "cls long, text string")), "words")
    own = both.where("cls >= 200")
    got = p4_sweep.swept(own, own.count(), both.where("cls < 200"), 0.55).collect()
    sweep = p4_sweep.Sweep(p4_sweep.Piece.of(list(range(200, 700)), texts[200:]), 0.55).ready()
    want = set(sweep.similar(list(range(700)), texts))
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 300


def test_leads_are_found_without_moving_texts(spark):
    """The classes of a batch are sent to its texts, not both shuffled, whatever the planner thinks of their size."""
    df = records(spark, [{"row_id": i, "batch_no": 0, "full_text": f"text {i // 2} of a batch"} for i in range(8)])
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        leads = p4_history.prepare(df, [0], "batch_no", p4_history.Rule())[0].leads
        plan = leads._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r.cls for r in leads.collect()) == [0, 2, 4, 6]
    finally:
        spark.conf.set(name, before)


def test_words_on_the_jvm(spark):
    """Words are parted and hashed as in Python."""
    texts = ["Radar  RADAR\u00a0x\u2003\u0085y\x1cz ", "Ünï 漢字\u3000😀😀 ΟΔΟΣ", " ", "", None]
    got = {r.cls: bytes(r.words) for r in p4_kernel.words(spark.createDataFrame(list(enumerate(texts)), "cls long, text string")).collect()}
    assert got == {i: b"".join(xxhash.xxh32_intdigest(w).to_bytes(4, "little") for w in (t or "").lower().split()) for i, t in enumerate(texts)}


def test_loads_leave_no_tables(spark):
    """What a load was read from and what it met in the history is gone after it; its result stays."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(80)) for _ in range(12)]
    rows = [{"row_id": i, "batch_no": i // 8, "full_text": texts[i % 12]} for i in range(24)]
    at = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    got = {tuple(r) for r in p4_history.found(records(spark, rows), least_rows=1).collect()}
    new = set(os.listdir(at)) - before
    assert got == plain_history(rows) and len(got) == 12
    assert not [d for d in new if d.startswith(("p4-old", "p4-leads"))] and not [d for n in new if n.startswith(("p4-prints", "p4-chunks")) for d in os.listdir(os.path.join(at, n)) if d.startswith("load=")]


def test_common_words():
    assert p4_history.common_words("a b c d".split(), "b x c a d".split()) == 3 and p4_history.common_words([], ["a"]) == 0


# 5


def test_names(spark):
    people = ["Jennifer Marrowby", "Marrowby, J.", "Jenny Marrowby", "MARROWBY, Jennifer", "Dr. Jennifer Marowby", "Peter Marrowby", "A. Marrowby", "Jörg Köhlerstroem", "Joerg Köhlerström", " ", None, "Unknown", "Marrowby"]
    bodies = ["University of Alderton", "Univ. of Alderton", "Alderton, University of", "Unviersity of Alderton", "Alderton Robotics Ltd.", "Dept. of Sensors, Alderton Robotics", "Alderton", "Netherby Institute of Technology (NIT)", "NIT", "Netherby"]
    got = {(r.name_kind, r.name_a, r.name_b) for r in p5_names.found(records(spark, [{"row_id": 1, "authors": people, "affiliated_institutions": bodies}])).collect()}
    groups = [("author", [people[i] for i in (0, 1, 2, 3, 4)]), ("author", people[7:9]), ("institution", bodies[:4]), ("institution", bodies[4:6]), ("institution", bodies[7:10])]
    want = {(k, a, b) for k, g in groups for a in g for b in g if a < b}
    assert got == want


def name_pairs(spark, groups):
    people = [n for g in groups for n in g]
    got = {(r.name_a, r.name_b) for r in p5_names.found(records(spark, [{"row_id": 1, "authors": people}])).collect()}
    return got, {(a, b) for g in groups for a in g for b in g if a < b}


def test_errors_in_several_dresses(spark):
    dresses = lambda s: [f"Jennifer {s}", f"{s}, Jennifer", f"JENNIFER {s.upper()}", f"Dr. Jennifer {s}", f"Jenny {s}", f"{s}, Jenny"]
    even = lambda s: [f"Peter {s}", f"{s}, Peter", f"PETER {s.upper()}"]
    got, want = name_pairs(spark, [[*dresses("Marrowby"), *dresses("Marowby")[:3]], even("Hallström"), even("Hellström")])
    assert got == want


def test_errors_in_given_names_outside_the_list(spark):
    groups = [["Mehmet Yildirim", "Yildirim, Mehmet", "Mehmte Yildirim"], ["Takashi Yildirim"], ["Karin Oldenby"], ["Karen Oldenby"], ["Peter Yildirim"]]
    got, want = name_pairs(spark, groups)
    assert got == want


def test_errors_in_three_forms_and_short_names(spark):
    forms = lambda s: [f"Jennifer {s}", f"{s}, Jennifer", f"JENNIFER {s.upper()}", f"Dr. Jennifer {s}", f"{s}, Jennifer A."]
    groups = [[*forms("Marrowby"), *forms("Marowby")[:3]], [*forms("Wang"), "Jennifer Wnag"], [*forms("Quillfeather"), "Quilfaether, Jennifer"], ["Sanjay Ottersley", "Ottersley Sanjay", "Snajay Ottersley", "Ottersley, Sanjay"]]
    got, want = name_pairs(spark, groups)
    assert got == want
    rows = p5_names.members(records(spark, [{"row_id": 1, "authors": groups[0]}])).collect()
    assert len({r.entity for r in rows}) == 1 and len(rows) == 8


def test_parts_of_names():
    assert p5_names.edits_within_two("quillfeather", "quilfaether") and not p5_names.edits_within_two("abcdef", "abxyzf")
    assert p5_names.parse_person("Doe, J. R.") == ("doe", "", "j", "r") and p5_names.parse_person("Bob Doe") == ("doe", "robert", "r", "")
    assert p5_names.parse_person("Dr.") == ("", "", "", "") and p5_names.edits_within_one("abcd", "abdc") and not p5_names.edits_within_one("abcd", "acbde")
    assert abs(p5_names.jaro_winkler("martha", "marhta") - 0.9611) < 1e-3


# 6


def test_defects(spark, sf_dir):
    terminal = p6_pairs.fit_terminal_model(table(spark, sf_dir, "gen_checkpoint"))
    judge = lambda q, a: p6_pairs.defect(q, a, terminal)
    q = "How does the sensor behave in the rain on the road?"
    good = "The sensor of the vehicle is good in the rain and it sees far on the road for many hours."
    assert judge(q, good) is None and judge(None, "") is None and judge("nan", None) is None and judge(" ", "x") is None
    assert [judge(q, a) for a in (None, " ", "N/A", "{}", '{"summary_of_technical_relevance": "", "x": []}')] == ["empty"] * 5
    assert judge(q, good[:-12]) == "truncated" and judge(q, '{"summary_of_technical_relevance": "The sensor') == "truncated"
    assert judge(q, "I am sorry, but I cannot help with that.") == "refusal" and judge(q, "Lo siento, no puedo ayudar.") == "refusal"
    assert judge(q, q.upper()) == "copies_question" and judge(q, f"You asked: {q} {q}") == "copies_question" and judge(q, f"{q} {good}") is None
    german = "Der Sensor ist bei Regen gut und er sieht auf der Straße sehr weit, wenn die Kamera nicht nass wird."
    assert judge(q, german) == "wrong_language" and judge(q + " Answer in German.", german) is None
    assert judge(q, f"{good}\n- range\n- frame rate") is None and judge(q, f"{good} It is short (see e.g.") == "truncated"
    assert judge(q, "35.2 %") is None and judge(q, f'{{"summary_of_technical_relevance": "{german}"}}') == "wrong_language"


def test_long_refusals_and_bounded_sample(spark, sf_dir):
    df = table(spark, sf_dir, "gen_checkpoint")
    terminal = p6_pairs.fit_terminal_model(df)
    long = "I am sorry, but I cannot help with this question about the sensor and its behaviour on a public road in the rain. " * 5
    assert len(long) > 441 and p6_pairs.defect("How does the sensor behave in the rain?", long, terminal) == "refusal"
    many = df.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).selectExpr("copy * 1000 + pair_id AS pair_id", "answer").repartition(50)
    assert p6_pairs.fit_terminal_model(many, rows=50).weights


def test_defects_of_nothing(spark, sf_dir):
    df = table(spark, sf_dir, "gen_checkpoint")
    assert p6_pairs.found(df.limit(0)).count() == 0


# 7


def test_typed_values(spark):
    terms = spark.createDataFrame([(1, "sensor_types", "Long-range FMCW radar"), (2, "sensor_types", "Flash lidar"), (3, "simulation_tools_or_solvers", "Roadforge Drive Simulator"), (4, "sensor_types", None)], "term_id long, field_name string, canonical_name string")
    values = ["Flash lidar", "lidar / Flash", "LR FMCW radar", "Long-rnage FMCWradars", "L.R.F.R.", "flash lidar (front)", "2x Flash_lidar", "Geiger counter", "None", " ", None, "", "Flash lidar", "x" * 5000]
    tools = ["Roadforge", "Roadforge Drive sim v8", "Roadcraft Planner"]
    f = spark.createDataFrame([(7, values, tools, "clash"), (8, None, [], "clash")], "finding_id long, sensor_types array<string>, simulation_tools_or_solvers array<string>, value string")
    got = {(r.field_name, r.list_pos): r.term_id for r in p7_canon.match(f, terms).collect()}
    s, t = "sensor_types", "simulation_tools_or_solvers"
    assert got == {(s, 1): 2, (s, 2): 1, (s, 3): 1, (s, 4): 1, (s, 5): 2, (s, 6): 2, (s, 7): -1, (s, 13): -1, (t, 0): 3, (t, 1): 3, (t, 2): -1}
    assert p7_canon.match(f.limit(0), terms).count() == 0 and p7_canon.match(f, terms.limit(0)).count() > 0


def test_additions_anywhere_and_forms_of_two_entries(spark):
    names = ["Flash lidar", "Tyrelux Contact Model", "Simvelo Traffic Engine", "Simvelo Rain Engine", "Hyperspectral line scanner"]
    terms = spark.createDataFrame([(i + 1, "simulation_tools_or_solvers", n) for i, n in enumerate(names)], "term_id long, field_name string, canonical_name string")
    values = ["Tyrelux academic", "campus Tyrelux", "line scanner, borrowed once Hyperspectral", "oneFlash lidar", "Simvelo", "new Flash lidar unit B", "Flush counter", "lidar " * 200]
    f = spark.createDataFrame([(7, None, values)], "finding_id long, sensor_types array<string>, simulation_tools_or_solvers array<string>")
    got = [r.term_id for r in p7_canon.match(f, terms).orderBy("list_pos").collect()]
    assert got == [2, 2, 5, 1, 4, 1, -1, -1]


# 8


def reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p8_encode.vocabulary_path())
    t.encode_special_tokens = True
    return t


def test_ids_of_test_table(spark, sf_dir):
    t = reference_tokenizer()
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: r.ids for r in queries.QUERIES["p8_ids"](spark, sf_dir).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


def test_ids_of_odd_texts():
    t = reference_tokenizer()
    odd = ["", "a" * 5000, "aaaa bbbb  \n\n\t x", "<|endoftext|>", "é à ﬁ 日本語 🚗🚗", "\x1c \x85 \xa0　x", "don't I'LL we've", "​ 123,456.78", None]
    enc = p8_encode.Encoder(p8_encode.read_merges(p8_encode.vocabulary_path()), kept_words=3)
    for _ in range(2):
        ids, off = enc.encode(odd)
        assert [list(ids[a:b]) for a, b in zip(off, off[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in odd]


# 9


def test_best_fit_places_all():
    rng = random.Random(2)
    for _ in range(60):
        sizes = {rng.randrange(1, 101): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))}
        intervals, used = p9_pack.best_fit(sizes, 100)
        load = defaultdict(int)
        for size, lo, hi, base, each in intervals:
            for r in range(lo, hi):
                load[base + (r - lo) // each] += size
        placed = defaultdict(int)
        for size, lo, hi, *_ in intervals:
            placed[size] += hi - lo
        assert placed == sizes and max(load.values()) <= 100 and len(load) == used
        assert used <= 1 + 1.25 * sum(s * n for s, n in sizes.items()) / 100 + max(0, sum(n for s, n in sizes.items() if s > 50) - sum(s * n for s, n in sizes.items()) / 100)


def test_packing(spark):
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate([5000, 2048, 0, None, 7, 7, 2041, 1000])], "doc_id long, n_tokens int, rank int")
    rows = p9_pack.pack(df).collect()
    load = defaultdict(int)
    for r in rows:
        if r.n_units:
            load[r.container_id] += r.n_units
    assert max(load.values()) <= 2048 and sum(load.values()) == 5000 + 2048 + 14 + 2041 + 1000 and len(load) == 5
    assert [r.first_unit for r in rows if r.doc_id == 0] and {r.container_id for r in rows if not r.n_units} == {None}
    assert sum(r.doc_id == 0 for r in rows) == 3 and all(sum(r.doc_id == i for r in rows) == 1 for i in range(1, 8))
    assert p9_pack.pack(df.limit(0)).count() == 0


def test_packing_of_a_hot_size(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 2048 ELSE 1 + id % 700 END AS n_tokens")
    rows = [p9_pack.pack(df, rows_per_task=n).where("n_units > 0").collect() for n in (40, 500_000)]
    for got in rows:
        load = defaultdict(int)
        for r in got:
            load[r.container_id] += r.n_units
        assert max(load.values()) <= 2048 and len(got) == 3000 and len(load) == len({r.container_id for r in rows[0]})


def test_packing_is_tight(spark, sf_dir):
    rows = queries.QUERIES["p9_containers"](spark, sf_dir).where("n_units > 0").collect()
    used = len({r.container_id for r in rows})
    assert used <= 1.05 * sum(r.n_units for r in rows) / 2048 + 1


# 10


PROSE = """The operator of the vehicle has to check the sensor before it is used on the road. In the rain the radar sees more than the camera does.
Each run was measured once the camera had warmed up, although nobody could tell why. We found that under snow the range of a lidar is shorter than the maker says."""
ITALIAN = """Il conducente deve controllare il sensore prima di usarlo sulla strada. Con la pioggia il radar vede più della telecamera, ma di notte la differenza è
minore. Ogni misura è stata ripetuta tre volte, e nessuno sa spiegare perché la seconda sia diversa. Con la neve la portata del lidar è più breve di quanto dichiarato."""
POLISH = """Kierowca musi sprawdzić czujnik, zanim wyjedzie na drogę. W deszczu radar widzi więcej niż kamera, lecz w nocy różnica jest mniejsza. Każdy pomiar
powtórzono trzy razy i nikt nie wie, dlaczego drugi był inny. W śniegu zasięg lidaru jest krótszy, niż podaje producent, a kamera widzi tylko plamy."""


def test_stuffed_pages(spark):
    keywords = "cheap radar best price radar shop lidar deal online radar free lidar discount "
    links = "\n".join(f"> lidar\nbuy lidar https://www.shop{i}.invalid/deal" for i in range(30))
    tags = lambda k: "\n".join(f"SKU {k}{i} | radar {w} | new | {i}.90" for i in range(9) for w in ("cheap", "used"))
    stuffed = "If you need radar cover, the radar cover shop for radar cover offers radar cover and more radar cover. Our radar cover is the best radar cover for every radar cover buyer. " * 3
    rows = [
        (1, PROSE, "a"), (2, keywords * 10, "a"), (3, links, None), (4, PROSE + keywords * 3, "b"), (5, PROSE[:140] + "\n" + keywords * 12, "b"), (6, "", "a"), (7, None, "a"), (8, "radar radar", "a"), (9, keywords * 10, "c"),
        (10, "レーダー 激安 通販 " * 60, "d"), (11, "本手法は雨天では検出率を評価するが、試験場では温度に依存する。" * 8, "d"), (12, ITALIAN, "e"), (13, POLISH, "e"), (14, tags(3), "a"), (15, tags(4), "b"), (16, stuffed, "a"),
        (17, PROSE + "\nKeywords: radar, lidar, camera, rain, snow, road, range\nhttps://www.shop.invalid/paper", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in p10_stuffing.found(df).collect()} == {2, 3, 5, 9, 10, 14, 15, 16}
    seen = {r.doc_id: r for r in p10_stuffing.evidence(df).collect()}
    assert seen[2].replicated > 0.9 and seen[14].replicated > 0.5 and seen[16].replicated == 0.0 and seen[3].link_share > 0.4 and len(seen) == 17
    assert p10_stuffing.found(df.limit(0)).count() == 0


def test_replicated_phrases_decide(spark):
    """List material of 60 % of a page is spam where its phrases stand on another host, and not enough of its own."""
    page = PROSE + "\n" + ", ".join(f"{a} {b}" for a in ("radar", "lidar", "camera", "imager", "scanner") for b in ("shop", "price", "deal", "offer", "sale", "store", "outlet", "bargain"))
    df = spark.createDataFrame([(1, page, "a"), (2, page, "b"), (3, page.replace("radar", "sonar").replace("lidar", "gps").replace("camera", "dome").replace("imager", "mast").replace("scanner", "probe"), "a")], "doc_id long, text string, source string")
    assert 0.5 < p10_stuffing.evidence(df).first().list_share < 0.7
    assert {r.doc_id for r in p10_stuffing.found(df).collect()} == {1, 2}
    assert p10_stuffing.found(df, replication=False).count() == 0


def test_shingles_of_the_whole_page(spark):
    """Prose counts too, phrases within long items are met wherever they stand, and a host does not replicate itself."""
    part = "the radar sees more than the camera does in the rain"
    rows = [(1, f"On {part} of last winter.", "a"), (2, f"We heard that {part}.", "b"), (3, "A lidar was bought by nobody at all here.", "a"), (4, "A lidar was bought by nobody at all here.", "a"), (5, None, "b")]
    seen = {r.doc_id: r for r in p10_stuffing.evidence(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert 0.4 < seen[1].stitched < 0.8 and 0.5 < seen[2].stitched < 0.9 and seen[3].stitched == seen[4].stitched == seen[5].stitched == 0.0
    assert all(r.replicated == r.list_share == 0.0 for r in seen.values())


def test_list_material_on_the_jvm(spark):
    """The compiled pass gives what the plain one gives, on texts of odd letters, links, masked numbers and repeated words."""
    rng = random.Random(10)
    odd = ["radar", "Radar", "cover", "ΟΔΟΣ", "İstanbul", "x²", "٣ km", "naïve-été", "l'eau", "a-漢字", "レーダー激安", "漢字", "価格。", "𝒳y", "😀", "snake_case", "v2.0", "www.", "www.a", "http://", "https://shop.invalid/a,b", "xhttp://y", "- ", " – ", " ", "\x1c", " ", "·", ".", "!", "？", ",", "\n", ", ", " ", " ", " "]
    phrases = ["".join(rng.choice(odd) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    texts = [rng.choice(["", ", ", "\n", " "]).join(rng.choice(phrases) for _ in range(rng.randrange(0, 40))) for _ in range(150)]
    texts += [" ".join(rng.choice(["radar", "cover", "shop", "7", rng.choice("abcdefgh")]) for _ in range(rng.randrange(5, 120))) + rng.choice([". ", ", "]) + rng.choice(phrases) for _ in range(150)]
    df = spark.createDataFrame([(i, t, rng.choice(["a", "b", None])) for i, t in enumerate([*texts, None, "radar, " * 5000])], "doc_id long, text string, source string")
    want = {r.doc_id: r for r in p10_stuffing.evidence(df).collect()}
    got = {r.doc_id: r for r in p10_stuffing.list_evidence(df).collect()}
    for i, r in want.items():
        assert got[i] == pytest.approx((r.doc_id, r.chars, r.list_share, r.link_share, r.replicated)), (texts[i] if i < len(texts) else i)
    assert len(got) == len(want) and 60 < sum(0 < r.replicated < 1 for r in want.values()) and sum(r.link_share > 0 for r in want.values()) > 60


def test_stuffed_pages_keep_less_than_the_input(spark, sf_dir):
    """What is kept between the steps is list material, not the shingles of all text."""
    at = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    assert p10_stuffing.found(table(spark, sf_dir, "documents")).count()
    kept = [os.path.join(at, d, f) for d in set(os.listdir(at)) - before for f in ([""] if os.path.isfile(os.path.join(at, d)) else os.listdir(os.path.join(at, d)))]
    assert 0 < sum(os.path.getsize(f.rstrip("/")) for f in kept) < os.path.getsize(os.path.join(sf_dir, "documents.parquet"))
