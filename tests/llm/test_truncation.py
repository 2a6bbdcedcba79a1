import random

from pyspark.sql import functions as F

from quillspark.llm import truncation as X

SUBJECTS = "the parser,the reader,the night shift,the cache,a small team,the old index,the queue".split(",")
VERBS = "stores,drops,counts,repairs,rejects,exports,merges".split(",")
OBJECTS = "the full report,every late record,the second table,many short notes,the shared folder,a broken page".split(",")
ENDS = "after midnight,before lunch,without warning,as planned,under load,on every retry".split(",")


def sentence(rng):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)} {rng.choice(ENDS)}".capitalize() + rng.choice(".!?.")


def text(rng):
    body = " ".join(sentence(rng) for _ in range(rng.randint(5, 14)))
    return body + rng.choice(["", "", "\n- counts the pages\n- repairs the index", "\n\nRegards,\nthe parser team", "\n\n```\nset a 1\n```", "\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"])


def corpus(n=1500, seed=3):
    rng = random.Random(seed)
    rows, cut = [], set()
    for d in range(n):
        t, source = text(rng), rng.choice(["wiki", "mail", "limited"])
        if source == "limited" and len(t) > 400:
            t = t[:400]
            if t[-1] not in ".!?\n" and not t.endswith("\n```"):
                cut.add(d)
        elif rng.random() < 0.04:
            at = rng.randint(60, len(t) - 4)
            if t[at - 1] not in ".!?\n" and t[at] not in "\n":
                t = t[:at]
                cut.add(d)
        rows.append((d, t, source))
    return rows, cut


def test_held_out_accuracy_and_copies(spark):
    rows, cut = corpus()
    copied = next(d for d in sorted(cut) if rows[d][2] == "limited")
    rows += [(9001, rows[copied][1], "wiki"), (9002, None, "wiki"), (9003, "", None), (9004, "  \n", "mail"), (9005, "ok", None), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit("x")).withColumn("h1", F.lit(2))
    got = [r.doc_id for r in X.cut_off(df).collect()]
    assert len(got) == len(set(got)) and 9001 in got and not {9002, 9003, 9004} & set(got)
    found = set(got) - {9001}
    assert len(found & cut) / len(cut) > 0.93 and len(found & cut) / len(found) > 0.93


def test_limits_and_shares(spark):
    rows, _ = corpus(600)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    piles = {(r.source, r.unit, r["size"]) for r in X.limits(df).collect()}
    assert ("limited", "chars", 400) in piles and not [p for p in piles if p[0] == "wiki"]
    shares = {r.source: r for r in X.cut_share(df).collect()}
    assert set(shares) == {"wiki", "mail", "limited"} and shares["limited"].share > 3 * shares["wiki"].share


def test_empty_and_tiny(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert X.cut_off(df).count() == 0 and X.cut_share(df).count() == 0
    one = spark.createDataFrame([(1, "Short.", None)], "doc_id long, text string, source string")
    assert X.cut_off(one).count() == 0


def test_features_take_any_text():
    for t in ("x", "…", "�", "```", "| a", "- ", "字" * 5000, "a" * 300_000, '"', "„x“ “y"):
        assert len(X.hashed(X.features(t, False, False)[0])) > 10


def test_the_sampled_regime_and_many_sources_give_the_same_accuracy(spark, monkeypatch):
    rows, cut = corpus(2000, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(X, "SOURCES_SENT", 0)
    piles, words = X.limits(df), X.known_words(df)
    model = X.train(df, piles, words, sample=700)
    found = {r.doc_id for r in X.scores(df, model).filter("cut").collect()}
    assert len(found & cut) / len(cut) > 0.93 and len(found & cut) / len(found) > 0.93


def test_known_words_leave_out_the_last(spark):
    df = spark.createDataFrame([(i, "the reader stores the tab", "a") for i in range(5)] + [(9, None, "a")], "doc_id long, text string, source string")
    assert {r.word for r in X.known_words(df).collect()} == {"the", "reader", "stores"}


def test_examples_near_limits_have_both_labels():
    made = [e for i in range(400) for e in X.examples("one word after the other " * 20 + "end.", [200, 300], X.np.random.default_rng(i))]
    for piled, near in ((True, False), (False, True)):
        assert {label for _, p, n, label in made if (p, n) == (piled, near)} == {0, 1}
    assert {len(t) for t, p, n, label in made if n and label and t[-1] not in "…\ufffd" and "&" not in t} <= {197, 198, 199, 297, 298, 299}
