import os
import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from strataline.llm import decontaminate as D

ITEM = "A train leaves Paris at 9 and runs 120 km to Lyon while another train leaves Lyon at 10 and goes 80 km toward Paris so when do they meet again"
OTHER = "If a farmer buys seven red hens for every field and each hen lays two brown eggs how many eggs will the farmer sell when the market opens"


def frames(spark):
    changed = ITEM.replace("Paris", "Turin").replace("Lyon", "Genoa").replace("120", "95").replace("9 ", "7 ")
    broken = ITEM.replace("Paris", "Turin", 1)  # one name became two
    docs = [(1, f"Intro text here.\n{ITEM}. The end."), (2, f"So, {changed}, he asked"), (3, "nothing of the kind stands in this long enough text about trains and farmers"), (4, None), (5, ""), (6, OTHER.upper()),
            (7, "A train leaves Paris at 9 and"), (7, "A train leaves Paris at 9 and"), (8, broken), (None, ITEM), (9, "9 km 9 km " * 30)]
    items = [(10, ITEM), (11, OTHER), (12, None), (13, "too short"), (None, ITEM), (14, ""), (15, "five plain words stand here")]
    return (spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(0)))


def test_verbatim_and_changed_items(spark):
    docs, items = frames(spark)
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, items).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 11), (None, 10)}
    assert got[1, 10].changed == 0 and got[2, 10].changed > 0 and got[2, 10].n_slots >= got[2, 10].changed
    other = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, items, max_broadcast=0).collect()}
    assert other == got


def test_clean_rows_stay(spark):
    docs, items = frames(spark)
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "7", "7", "8", "9"]
    assert sorted(str(r.doc_id) for r in D.clean(docs, items, max_broadcast=0).collect()) == ["3", "4", "5", "7", "7", "8", "9"]
    assert D.clean(docs, items.limit(0)).count() == docs.count() and D.contaminated(docs.limit(0), items).count() == 0


def test_short_items_and_repeats(spark):
    docs = spark.createDataFrame([(1, "see: Five plain words stand here!"), (2, "five plain words stand")], "doc_id bigint, text string")
    items = spark.createDataFrame([(15, "five plain words stand here"), (15, "five plain words stand here")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id, r.n_tokens) for r in D.contaminated(docs, items).collect()] == [(1, 15, 5)]


def test_items_in_pieces(spark):
    words = OTHER.split()
    edited = " ".join("xx" if k % 10 == 9 else w for k, w in enumerate(words))
    half = " ".join(words[:9]) + " xx yy " + " ".join(words[18:20])
    docs = spark.createDataFrame([(1, edited), (2, half)], "doc_id bigint, text string")
    items = spark.createDataFrame([(11, OTHER)], "item_id bigint, text string")
    assert [(r.doc_id, r.n_tokens) for r in D.contaminated(docs, items).collect()] == [(1, 26)]


def test_a_copy_after_an_inconsistent_one_counts(spark):
    broken = ITEM.replace("Paris", "Turin", 1)
    docs = spark.createDataFrame([(1, f"{broken}.\n{ITEM}."), (2, broken)], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, ITEM)], "item_id bigint, text string")
    for size in (D.MAX_BROADCAST, 0):
        assert [(r.doc_id, r.token_start, r.changed) for r in D.contaminated(docs, items, max_broadcast=size).collect()] == [(1, 31, 0)]


def test_rows_that_repeat_a_doc_id_are_judged_one_by_one(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, "nothing of the kind"), (1, None), (2, OTHER)], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, ITEM)], "item_id bigint, text string")
    for size in (D.MAX_BROADCAST, 0):
        assert sorted(str(r.text) for r in D.clean(docs, items, max_broadcast=size).collect()) == sorted([OTHER, "None", "nothing of the kind"])
        assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, items, max_broadcast=size).collect()] == [(1, 10)]


def test_short_items_inside_a_line(spark):
    items = [(1, "Which river flows through the city of Vienna"), (2, "Which river flows through it"), (3, "How many small boats can the old harbour hold in winter"), (4, "Days of rain come before the flood")]
    docs = [(k, f"{mark} {text}") for k, text in items for mark in ("1)", "so,", "see [", "x -", "1.")] + [(9, "so, Vienna river flows through it")]
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    docs = docs.withColumn("doc_id", F.col("doc_id") * 100 + F.length("text"))
    for size in (D.MAX_BROADCAST, 0):
        got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items, max_broadcast=size).collect()}
        assert {d for d, i in got if d // 100 == i} == {r.doc_id for r in docs.collect() if r.doc_id < 900} and not any(d >= 900 for d, _ in got)
        assert D.clean(docs, items, max_broadcast=size).count() == 1


NUMBERS, UNITS, OPENERS = set(D.NUMBER_WORDS), set(D.UNITS), set(D.OPENERS)


@lru_cache(None)
def template(text, form):
    """[(kind or word, words, may be a name)] by the rules of the docstring, letter by letter."""
    found = [(m[0], m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)]
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    out, before = [], None
    for k, (raw, a, b) in enumerate(found):
        word, gap = raw.translate(lower), text[before[1] : a] if before else "\n"
        number = raw[0] in "0123456789" or word in NUMBERS
        point = number and before is not None and before[0] == "9" and len(gap) == 1 and gap > " "
        begins = not before or any(c in "\n\r!.:?" for c in gap) and not point
        capital = "A" <= raw[0] <= "Z" and not ("A" <= raw[1:2] <= "Z" or len(raw) == 1 or raw[1:2].isdigit() or raw[1:2] in ":;<=>?@") and not number and word not in OPENERS
        unit = before is not None and before[0] == "9" and gap in (" ", "-") and word in UNITS and not number
        kind = "9" if number else "N" if capital and (form == 1 or not begins and not unit) else "U" if unit else None
        if form == 2:
            kind = None
        if kind and out and out[-1][0] == kind and not begins:
            out[-1] = (kind, out[-1][1] + (word,), out[-1][2] or capital and begins)
        else:
            out.append((kind, (word,), form < 2 and capital and begins))
        before = ("9" if number else "", b)
    return out


def held(text, item, least=13):
    """Whether a text holds an item, by comparing all windows of both."""
    for form in (0, 1, 2):
        it = template(item, form)
        telling = len(it) >= 5 and any(k is None for k, _, _ in it)
        plain = template(item, 0)
        usual = len(plain) >= 5 and any(k is None for k, _, _ in plain)
        if (form < 2 and not (usual and telling)) or (form == 2 and (usual or len(it) < 5)):
            continue
        doc = template(text, form)
        key = lambda t: [k or w for k, w, _ in t]
        width = min(8, len(it))
        a, b = key(it), key(doc)
        diagonal, places = {}, {}
        for j in range(len(a) - width + 1):
            places.setdefault(tuple(a[j : j + width]), []).append(j)
        for i in range(len(b) - width + 1):
            for j in places.get(tuple(b[i : i + width]), ()):
                diagonal.setdefault(i - j, []).append(i)
        found = []
        for d, starts in diagonal.items():
            group = [starts[0]]
            for s in starts[1:] + [None]:
                if s is not None and s == group[-1] + 1:
                    group.append(s)
                    continue
                found.append((-(len(group) - 1 + width), group[0], group[0] - d))
                group = [s]
        found.sort()
        tried = [[(y + k, x + k) for k in range(-n)] for n, x, y in found if -n >= min(least, len(it))]
        cover = {}
        for n, x, y in found[len(tried) :]:
            for k in range(-n):
                cover.setdefault(y + k, x + k)
        if len(cover) >= max(least, len(it) / 2):
            tried.append(sorted(cover.items()))
        for pairs in tried:
            said = [(it[y], doc[x]) for y, x in pairs]
            if len(it) < 8 and any(t[1] != m[1] and (t[2] or m[2]) for t, m in said):
                continue
            if all(t[1] == m[1] for t, m in said):
                return True
            values = {(t[1], m[1]) for t, m in said if t[0]}
            if sum(t[0] is None for t, _ in said) >= 0.6 * len(said) and len(values) == len({x for x, _ in values}) == len({y for _, y in values}):
                return True
    return False


def both(spark, docs, items):
    """(doc_id, item_id) found with the benchmark as one block, and as four or so."""
    few = sum(len(t.encode()) for _, t in items) // 8
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one, many = ({tuple(r) for r in D.contaminated(docs, items, max_broadcast=n).collect()} for n in (D.MAX_BROADCAST, few))
    assert one == many
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in D.clean(docs, items, max_broadcast=few).collect()}
    assert gone == {r[0] for r in one} == {r.doc_id for r in docs.collect()} - {r.doc_id for r in D.clean(docs, items).collect()}
    return {r[:2] for r in one}


ANN = "Ann has 8 apples and buys 12 more how many now"
MONTHS = "Rain fell on nine days in April and on four days in May and the farmers of the valley then counted all their losses"


@pytest.mark.parametrize(("text", "item", "expected"), [
    ("Tom has 5 apples and buys 9 more how many now", ANN, True),
    ("He said: so Tom Smith has 1,250 apples and buys 9.5 more how many now", ANN, True),
    ("Tom has 5 pears and buys 9 more how many now", ANN, False),
    (MONTHS.replace("April", "June").replace("May", "July"), MONTHS, True),
    (MONTHS.replace("April", "June").replace("May", "June"), MONTHS, False),
    (MONTHS.replace("April", "New Town"), MONTHS, True),
    ("so, Paris Lyon Turin Genoa Milan it is", "Paris Lyon Turin Genoa Milan", True),
    ("so, Paris Lyon Turin Genoa Rome it is", "Paris Lyon Turin Genoa Milan", False),
    ("a note: 3-km walk", "five plain words stand here", False)])
def test_slots(spark, text, item, expected):
    assert bool(both(spark, [(1, text)], [(7, item)])) is expected is held(text, item)


def test_against_brute_force_on_made_up_texts(spark):
    r = random.Random(5)
    names, plain = ["Ann", "Tom", "Paris", "New York", "Lyon"], "walks runs buys sells apples when then many for and the river town sees goes".split()

    def sentence(n):
        words = [r.choice(names) if (x := r.random()) < 0.15 else r.choice(["7", "1,250", "two", "12 km", "3.5"]) if x < 0.3 else r.choice(plain) for _ in range(n)]
        return (words[0][0].upper() + words[0][1:] + " " + " ".join(words[1:]) + r.choice([".", "?", "\n", " -", ""])).strip()

    items = [(k, " ".join(sentence(r.randint(3, 14)) for _ in range(r.randint(1, 3)))) for k in range(40)]
    docs = []
    for k in range(200):
        text = r.choice(items)[1]
        for _ in range(r.randint(0, 3)):
            text = text.replace(r.choice(names), r.choice(names), r.choice([1, 9])) if r.random() < 0.6 else text.replace(r.choice(["7", "two", "12 km"]), r.choice(["8", "nine", "14 km"]))
        docs.append((k, f"{sentence(8)} {text} {sentence(8)}" if r.random() < 0.7 else text[r.randint(0, 9) :]))
    got = both(spark, docs, items)
    want = {(d, i) for d, t in docs for i, it in items if held(t, it)}
    assert got == want and len({d for d, _ in want}) > 50


def test_query_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    texts, wanted = docs.select("doc_id", "text").collect(), items.collect()
    vocabulary = {i.item_id: {w for k, w, _ in template(i.text, 2)} for i in wanted}
    want = set()
    for r in texts:
        words = {w for k, w, _ in template(r.text, 2)}
        # fewer words in common leave no share of plain ones
        want |= {(r.doc_id, i.item_id) for i in wanted if len(words & vocabulary[i.item_id]) >= 3 and held(r.text, i.text)}
    assert want == {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()} and want


def test_very_long_texts(spark):
    filler = "plain words of no item at all stand here and there. "
    long = filler * 40000 + ITEM + ". " + filler * 20000
    assert both(spark, [(1, long), (2, filler * 60000), (3, "9 km " * 300000)], [(10, ITEM), (11, "9 km 9 km 9 km 9 km")]) == {(1, 10), (3, 11)}
