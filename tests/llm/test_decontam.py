"""Benchmark decontamination: verbatim and re-parameterised leaks against brute force and generated copies."""

import random

import pytest

from procura.llm import decontam

NAMES = ["Tom", "Ann", "Bob", "Eve", "Max", "Zoe", "Ivy", "Leo", "New York", "Rio Grande", "Paris", "Rome", "Saint Louis", "Oslo"]


def leaks_of(spark, rows, items, *cols):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()


def kinds(found):
    return {(r.doc_id, r.item_id): r.kind for r in found}


def test_decontamination(spark):
    item = "a train leaves Boston at 5 km per hour and Tom eats 3 apples before Tom meets Ann in the park"
    same = item.replace("Boston", "Chicago").replace("Tom", "Bob").replace("Ann", "Eve").replace("5", "70").replace("3", "12")
    torn = same.replace("Bob meets", "Max meets")
    rows = [(1, "intro words here. " + item + " and more"), (2, "well, " + same), (3, torn), (4, "a quite different text about a train and apples"), (5, None), (6, ""), (None, item)]
    rows += [(7, item), (7, item)]
    items = [(10, item), (11, None), (12, "short one here"), (13, ""), (14, item), (None, "nothing but an item without any number of its own in the table of items")]
    found = leaks_of(spark, rows, items)
    # Cut at the contradiction, 14 and 4 words of 19 are left of the torn copy: a run of 13 and more.
    assert kinds(found) == {(1, 10): "verbatim", (2, 10): "template", (3, 10): "template", (None, 10): "verbatim", (7, 10): "verbatim"}
    assert sum(r.doc_id == 7 for r in found) == 2 and {r.n_items for r in found} == {2}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0


def test_late_contradiction_leaves_the_verbatim_run(spark):
    words = [f"w{i}x" for i in range(32)]
    item = " ".join(words[:6] + ["3"] + words[6:28] + ["3"] + words[28:])
    copy = " ".join(words[:6] + ["3"] + words[6:28] + ["4"] + words[28:])
    (r,) = leaks_of(spark, [(1, "so. " + copy)], [(5, item)])
    assert (r.kind, r.run, r.start, r.stop) == ("verbatim", 29, 1, 30)


def test_slots_are_held_to_one_value_over_all_runs(spark):
    a = "on that day TOM walked up there TOM saw many TOM birds"
    b = "later on TOM cooked fish with TOM onions for us TOM said"
    item, gap = f"{a.replace('TOM', 'Tom')} {b.replace('TOM', 'Tom')}", " ".join(f"z{i}" for i in range(40))
    write = lambda x, y: [(1, f"{a.replace('TOM', x)} {gap} {b.replace('TOM', y)}")]
    (r,) = leaks_of(spark, write("Bob", "Bob"), [(5, item)])
    assert (r.kind, r.covered, r.run) == ("template", 1.0, 12)
    # Bob and Max cannot both be Tom: the second run falls apart at the name, and one run alone is too short.
    assert leaks_of(spark, write("Bob", "Max"), [(5, item)]) == []


def test_case_punctuation_and_longer_names(spark):
    item = "Tom lives in Paris. He pays 20 dollars, Ann pays 30 dollars: how much do they pay for the room, in all, each month?"
    rows = [(1, item.upper()), (2, item.title()), (3, item.lower()), (4, "".join(c for c in item if c not in ".,:?"))]
    rows += [(5, item.replace("Paris", "New York").replace("Tom", "Bo").replace("20", "twenty five").replace("Ann", "Mary Jane"))]
    got = kinds(leaks_of(spark, rows, [(1, item)]))
    assert got == {(1, 1): "verbatim", (2, 1): "verbatim", (3, 1): "verbatim", (4, 1): "verbatim", (5, 1): "verbatim"}  # its last 13 words are as they were


def test_shared_preambles_give_one_row(spark):
    preamble = "read the following passage with care and then answer the question that is put below it in one word"
    r = random.Random(2)
    items = [(i, preamble + " " + " ".join(f"u{i}v{r.randrange(90)}" for _ in range(20))) for i in range(300)]
    found = leaks_of(spark, [(1, preamble), (2, items[7][1])], items)
    assert kinds(found) == {(1, 0): "verbatim", (2, 0): "verbatim", (2, 7): "verbatim"}
    assert {(r.doc_id, r.item_id): (r.n_items, r.covered) for r in found}[2, 7] == (1, 1.0)
    assert {r.n_items for r in found if r.item_id == 0} == {300}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.item_id for r in decontam.members(bench).collect()} == set(range(300))


def test_items_without_a_window_of_their_own(spark):
    """A short item inside a longer one, and an item made of parts of two others, all of smaller ids."""
    say = lambda x, n: [f"{x}{i}q" for i in range(n)]
    a, b = say("a", 60), say("b", 60)
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[20:30])), (4, " ".join(a[40:52] + say("c", 2) + b[5:17])), (5, " ".join(say("x", 3) + a[20:30]))]
    rows = [(1, " ".join(say("k", 20) + a[20:30] + say("m", 20))), (2, " ".join(a)), (3, " ".join(say("k", 9) + a[40:52] + say("z", 5) + b[5:17]))]
    got = kinds(leaks_of(spark, rows, items))
    assert got == {(1, 3): "verbatim", (1, 5): "verbatim", (2, 1): "verbatim", (2, 3): "verbatim", (2, 5): "verbatim", (3, 4): "verbatim"}


def problems(r, n):
    """Items with numbers and names, and functions that write them with other values."""
    out = []
    for i in range(n):
        f = [f"{x}{r.randrange(400)}" for x in "abcdefghijklmnopqrstuvwxyz"]

        def write(a, b, c, x, y, z, f=f):
            return (
                f"At the {f[0]} {f[1]} {c} a {f[2]} called {a} {f[3]} {x} {f[4]} {f[5]} then {f[6]} {y} kg {f[7]} {f[8]} for {b}. "
                f"When {a} meets {b} at {f[9]} {f[10]}, {b} {f[11]} {z} {f[12]} {f[13]} {f[14]} {f[15]}. How many {f[4]} does {a} have?"
            )

        out.append(write)
    return out


def values(r):
    a, b, c = r.sample(NAMES, 3)
    return a, b, c, *r.sample(["3", "17", "250", "1,200", "4.5", "twelve", "forty two", "96"], 3)


def test_recall_of_re_parameterised_items(spark):
    r = random.Random(4)
    made = problems(r, 150)
    items = [(i, w(*values(r))) for i, w in enumerate(made)]
    rows = [(i, " ".join(f"k{r.randrange(5000)}" for _ in range(60)) + ". " + w(*values(r)) + " And so on.") for i, w in enumerate(made)]
    rows += [(1000 + i, "He " + " ".join(r.choice(["3", "Tom", "kg", "has", "buys", "4"]) for _ in range(80))) for i in range(50)]
    got = kinds(leaks_of(spark, rows, items))
    right = sum((i, i) in got for i in range(150))
    print("recall of re-parameterised items", right / 150, "others", len(got) - right)
    assert right >= 0.95 * 150 and len(got) == right


@pytest.mark.parametrize("blocks", [decontam.MOST_BLOCKS, 1 << 10])
def test_decontamination_finds_all_of_the_real_leaks(spark, sf_dir, monkeypatch, blocks):
    monkeypatch.setattr(decontam, "MOST_BLOCKS", blocks)
    docs, bench = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    grams = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    words = lambda t: (t or "").encode().split()
    items = {r.item_id: grams(words(r.text), 13) for r in bench.collect()}
    texts = {r.doc_id: grams(words(r.text), 13) for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() for i, g in items.items() if g & t}
    got = kinds(decontam.leaks(docs, bench).collect())
    assert want <= set(got)
    # Brute force without filter and join: every window of every pair that has one in common.
    lex = decontam.Lexicon()
    made = lambda t: decontam.streams((t or "").encode(), lex)
    pieces = {r.item_id: (made(r.text), decontam.windows(made(r.text), [8])) for r in bench.collect()}
    every = set()
    for r in docs.collect():
        d = made(r.text)
        mine = [(s, int(h), int(p)) for s, hs, ps in decontam.windows(d, [8]) for h, p in zip(hs, ps)]
        have = {h for _, h, _ in mine}
        for i, (item, wins) in pieces.items():
            theirs = [(s, int(h), int(p)) for s, hs, ps in wins for h, p in zip(hs, ps) if int(h) in have]
            hits = {(ds, at, bs, p) for bs, h, p in theirs for ds, x, at in mine if x == h}
            if hits and decontam.verified(d, item, hits):
                every.add((r.doc_id, i))
    assert set(got) == every


def test_stage_keeps_the_clean_rows(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    rows = [(1, "before " + item, "en", "a", 5, "x"), (2, "clean", None, None, None, "x"), (2, "clean", None, None, None, "x"), (None, None, None, None, None, "x"), (None, item, "en", "a", 1, "x"), (1, "other text", "en", "a", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, item_id string")
    got = sorted(map(str, (tuple(r)[:2] for r in decontam.stage(spark, docs, sf_dir).collect())))
    assert got == sorted(map(str, [(2, "clean"), (2, "clean"), (None, None), (1, "other text")]))


def test_stage_drops_texts_of_items_without_a_window_of_their_own(spark, tmp_path):
    long = [f"a{i}q" for i in range(60)]
    items = [(1, " ".join(long)), (2, " ".join(long[20:30]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "before " + items[1][1] + " after", "en", "a", 5), (2, "clean", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in decontam.stage(spark, docs, str(tmp_path)).collect()] == [2]
