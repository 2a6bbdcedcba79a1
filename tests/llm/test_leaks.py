import random

from pyspark.sql import functions as F

from quillspark.llm import leaks


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_against_the_plain_recurrence():
    rng = random.Random(2)
    for _ in range(600):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 110)))
        assert leaks.myers(p, t, 999) == plain_distance(p, t)


def brute(docs, items, run=12):
    out = set()
    for item, text in items:
        w = leaks.words(text)
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for doc, body in docs:
            b = leaks.words(body or "")
            if any(tuple(b[i : i + run]) in grams for i in range(len(b) - run + 1)):
                out.add((doc, item))
    return out


def make(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40))) + ".") for i in range(12)]
    docs = []
    for d in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            _, text = rng.choice(items)
            w = text.rstrip(".").split()
            n = rng.randint(6, len(w))
            at = rng.randint(0, len(w) - n)
            body[10:10] = [rng.choice(["", "("]) + x.upper() + rng.choice(["", ",", "\n"]) for x in w[at : at + n]]
        docs.append((d, " ".join(body)))
    return docs, items


def test_exact_runs_against_brute_force(spark):
    docs, items = make()
    docs += [(900, None), (901, ""), (902, docs[0][1]), (0, docs[0][1])]
    items += [(50, None), (51, "too short"), (items[0])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("distance", F.lit("x"))
    i = spark.createDataFrame(items, "item_id long, text string")
    for edits in (0, 1, 2):
        found = leaks.leaks(d, i, max_edits=edits).filter("distance = 0").select("doc_id", "item_id").collect()
        assert {tuple(r) for r in found} == brute(docs, [x for x in items if x[1]]) and len(found) == len(set(found))


def test_every_passage_within_the_budget_is_found():
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(12))
    m = leaks.Matcher([(1, text)], 12, 2)
    for _ in range(200):
        body = list(text)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(1, len(body) - 1)
            rng.choice([lambda: body.__setitem__(k, "z"), lambda: body.pop(k), lambda: body.insert(k, "q")])()
        hit = m.find("before " + "".join(body) + " after")
        assert hit and hit[0][1] == plain_distance(f" {text} ", leaks.normal("before " + "".join(body) + " after"))


def test_one_edit_at_every_character_is_found():
    own = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"
    for edits in (1, 2):
        m = leaks.Matcher([(1, own)], 12, edits)
        for at in range(len(own)):
            for body in (own[:at] + own[at + 1 :], own[:at] + "x" + own[at:], own[:at] + "x" + own[at + 1 :], own[:at] + " " + own[at:], own[:at] + "ß" + own[at + 1 :]):
                for text in (body, "before " + body + " after", "b" + body, body + "a"):
                    distance = plain_distance(f" {own} ", leaks.normal(text))
                    hit = m.find(text)
                    assert (bool(hit) and hit[0][1] == distance) if distance <= edits else not hit


def test_item_passes_and_empty_tables(spark, monkeypatch):
    docs, items = make(8)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    once = {tuple(r) for r in leaks.leaks(d, i).collect()}
    monkeypatch.setattr(leaks, "PASS_CHARS", 300)
    assert {tuple(r) for r in leaks.leaks(d, i).collect()} == once
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0
