import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.config import Settings
from quillspark.functions import models
from quillspark.functions import vector as V
from quillspark.operators import index as I
from quillspark.operators import retrieval as R
from quillspark.plans import search
from quillspark.plans.documents import chunk_table
from quillspark.plans.search import questions
from quillspark.sources import artefacts


def lists(spark, rows):
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, dense_score double, lexical_score double")
    return R.ranked_lists(df.withColumn("rank", F.lit("clash")))


def golden(spark):
    return lists(spark, [("q", "x", 0.8, None), ("q", "y", 0.3, 5.0), ("q", "z", None, 4.0), ("q", "y", 0.3, 5.0)])


def test_fusion_golden(spark):
    got = {r.chunk_id: (round(r.rrf, 9), r["rank"]) for r in R.fuse(golden(spark)).collect()}
    assert got == {"y": (0.033060109, 1), "x": (0.016666667, 2), "z": (0.016393443, 3)}


def test_score_filter_keeps_equality(spark):
    fused = R.fuse(golden(spark))
    assert {r.chunk_id for r in R.passes(fused, Settings(min_score=0.3)).collect()} == {"x", "y"}
    assert {r.chunk_id for r in R.passes(fused, Settings(min_score=0.3, keep_lexical_only=True)).collect()} == {"x", "y", "z"}


def test_lists_that_do_not_meet(spark):
    fused = R.fuse(golden(spark), compat=True)
    assert fused.count() == 4
    kept = {r.chunk_id: round(r.rrf, 9) for r in R.passes(fused, Settings(min_score=0.3)).collect()}
    assert kept == {"x": round(1 / 60, 9), "y": round(1 / 61, 9)}


def test_hashing_embedder(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "fox red"), (3, ""), (4, None)], "n int, t string")
    got = {r.n: r.v for r in df.select("n", models.hashing_embedder()(F.col("t")).alias("v")).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[3] is None and got[4] is None


def test_mmr_golden(spark):
    rows = [("q", "a", 0.9, [1.0, 0.0]), ("q", "b", 0.8, [1.0, 0.0]), ("q", "c", 0.5, [0.0, 1.0]), ("q", "n", None, [1.0, 1.0]), ("q", "m", 0.7, None), ("z", "only", 0.1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, relevance double, embedding array<float>")
    got = sorted((r.query_id, r.mmr_pos, r.chunk_id) for r in R.mmr(df).collect())
    assert got == [("q", 0, "a"), ("q", 1, "c"), ("q", 2, "b"), ("z", 0, "only")]
    relevance = np.array([0.9, 0.8, 0.5])
    assert R.mmr_order(relevance, np.eye(3), 3, 1.0) == [0, 1, 2]
    assert R.mmr(df.limit(0)).count() == 0


def test_bm25_golden(spark):
    chunks = spark.createDataFrame([("d1", "a b"), ("d2", "a c"), ("d3", "d e")], "chunk_id string, text string")
    tokens = I.tokenised(chunks)
    posted, size = I.postings(chunks), I.corpus_size(tokens)
    stats = I.term_stats(posted, size)
    assert round(stats.filter("term = 'a'").first().idf, 6) == 0.076624
    asked = spark.createDataFrame([("q", "a b"), ("none", "zzz"), ("blank", " "), ("null", None)], "query_id string, question string")
    got = {r.chunk_id: round(r.score, 6) for r in R.bm25(asked, posted, size, stats, 5).collect()}
    assert got == {"d1": 0.587449, "d2": 0.076624}
    again = {r.chunk_id: round(r.score, 6) for r in R.bm25_scan(asked, tokens, size, stats, 5).collect()}
    assert again == got


def test_bm25_scan_equals_the_join(spark, data, monkeypatch):
    chunks = chunk_table(spark, data).select("chunk_id", F.col("child").alias("text"))
    tokens = I.tokenised(chunks)
    size, posted = I.corpus_size(tokens), I.postings(chunks)
    stats = I.term_stats(posted, size)
    asked = questions(spark, data)
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    want = rows(R.bm25(asked, posted, size, stats, 6))
    monkeypatch.setattr(R, "QUESTION_ROWS", 7)
    assert rows(R.bm25_scan(asked, tokens, size, stats, 6)) == want and want
    assert R.bm25_scan(asked.limit(0), tokens, size, stats, 6).count() == 0


@pytest.mark.parametrize(("a", "b", "cos", "rel"), [([1.0, 0.0], [1.0, 0.0], 1.0, 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0, -0.414214), ([0.0, 0.0], [1.0, 0.0], 0.0, 0.292893)])
def test_vectors_golden(spark, a, b, cos, rel):
    r = spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.l2_relevance(F.col("a"), F.col("b")).alias("l")).first()
    assert round(r.c, 6) == cos and round(r.l, 6) == rel


def test_nearest_in_blocks_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(150, 5)), 1)
    rows = [(i, [float(v) for v in x[i % 140]]) for i in range(150)] + [(500, None), (501, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    once = sorted(tuple(r) for r in R.nearest(df.filter("vec_id % 5 = 0"), df, 7).select("query_id", "rank", "vec_id", "score").collect())
    monkeypatch.setattr(R, "QUERY_ROWS", 4)
    monkeypatch.setattr(R, "SLICE", 16)
    assert sorted(tuple(r) for r in R.nearest(df.filter("vec_id % 5 = 0"), df, 7).select("query_id", "rank", "vec_id", "score").collect()) == once
    ids = np.array([r[0] for r in rows if r[1]])
    m = np.array([r[1] for r in rows if r[1]], np.float32).astype(float)
    n = np.linalg.norm(m, axis=1)
    for q in (0, 145):
        k = int(np.flatnonzero(ids == q)[0])
        s = np.round(np.divide(m @ m[k], n * n[k], out=np.zeros(len(m)), where=n * n[k] != 0), 9)
        order = [i for i in np.lexsort((ids, -s)) if i != k][:7]
        assert [v for qq, _, v, _ in once if qq == q] == ids[order].tolist()
    assert R.nearest(df.limit(0), df, 3).count() == 0 and R.nearest(df, df.limit(0), 3).count() == 0


def test_rerank_and_prompt(spark):
    rows = [("q", "1", "red fox", "a Red dog"), ("q", "2", "red fox", "the red fox"), ("q", "3", "red fox", ""), ("q", "4", "red fox", "none here")]
    pairs = spark.createDataFrame(rows, "query_id string, chunk_id string, question string, text string")
    ranked = R.rerank(pairs, Settings(top_k=2))
    assert [(r.chunk_id, round(r.rerank_score, 4)) for r in ranked.orderBy("rank").collect()] == [("2", 0.6667), ("1", 0.25)]
    same = spark.createDataFrame([("q", "Q", 2, "P"), ("q", "Q", 1, "P")], "query_id string, question string, rank int, text string")
    assert "Context:\nP\n\nP\n\n" in R.prompts(same).first().prompt and "Context:\nP\n\nQuestion" in R.prompts(same, dedup_parents=True).first().prompt


def test_incremental_and_distinct(spark):
    old = spark.createDataFrame([("a",)], "key string")
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    assert [r.key for r in I.new_chunks(new, old, ["key"]).collect()] == ["b"]
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "")], "doc_id long, text string").withColumn("copies", F.lit("z"))
    assert sorted((r.doc_id, r.copies) for r in I.distinct_texts(docs).collect()) == [(1, 2), (3, 2), (5, 1)]


def test_postings_count_terms(spark):
    df = spark.createDataFrame([("a", "b a b  c b"), ("e", " "), ("n", None), ("x", "z")], "chunk_id string, text string")
    assert sorted(tuple(r) for r in I.postings(df).collect()) == [("a", 5, "a", 1), ("a", 5, "b", 3), ("a", 5, "c", 1), ("x", 1, "z", 1)]


def test_one_question_without_results_raises(spark, tmp_path):
    pages = spark.createDataFrame([("d", 0, ["the quick fox jumps over lazy dogs"], [0], 10.0)], "source string, page_number int, blocks array<string>, section_boundaries array<int>, body_font_size double")
    artefacts.add_to_index(artefacts.parent_table(pages, search.OFFLINE), str(tmp_path / "i"), settings=search.OFFLINE)
    tables = artefacts.load_index(spark, str(tmp_path / "i"))
    assert "quick fox" in search.ask(tables, "quick fox").first().prompt
    with pytest.raises(R.NothingFound):
        search.ask(tables, " ")
    with pytest.raises(R.NothingRelevant):
        search.ask(tables, "zebra", Settings(min_score=1.0, passage_prefix="", query_prefix=""))


def test_zero_scores_fill_up(spark):
    chunks = spark.createDataFrame([("d1", "a b"), ("d2", "a c"), ("d3", "d e"), ("d4", "f")], "chunk_id string, text string")
    tokens = I.tokenised(chunks)
    size, posted = I.corpus_size(tokens), I.postings(chunks)
    asked = spark.createDataFrame([("q", "a b"), ("none", "zzz")], "query_id string, question string")
    found = R.bm25(asked, posted, size, I.term_stats(posted, size), 3)
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.score == 0) for r in R.with_zero_scores(found, asked, chunks, 3).collect())
    assert got == [("none", 1, "d1", True), ("none", 2, "d2", True), ("none", 3, "d3", True), ("q", 1, "d1", False), ("q", 2, "d2", True), ("q", 3, "d3", True)]  # d2 shares a term of idf 0
