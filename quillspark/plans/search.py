"""Queries of the retrieval pipeline, for all questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import Settings
from quillspark.functions import models
from quillspark.functions import text as T
from quillspark.functions import vector as V
from quillspark.operators import index, layout, retrieval
from quillspark.plans import sql
from quillspark.plans.documents import chunk_table, pages_of
from quillspark.session import new_folder, written
from quillspark.sources import artefacts
from quillspark.sources.tables import table

#: Asked are the rows whose id this divides, against all rows.
EVERY = 20


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Different questions of the runs whose run_id is divisible by 20, each under its smallest run_id."""
    timings = table(spark, folder, "rag_timings", "run_id", "question")
    asked = timings.filter((F.col("run_id") % EVERY == 0) & ~T.is_blank(F.col("question")))
    return asked.groupBy("question").agg(F.min("run_id").alias("query_id"))


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return index.tokenised(chunk_table(spark, folder), text="child")


def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _tokens(spark, folder)
    found = index.term_stats(index.different_terms(tokens), index.corpus_size(tokens))
    return found.select("term", "df", F.round("idf", 6).alias("idf"))


def doc_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(spark, folder).select("chunk_id", F.size("terms").alias("dl"))


def _lexical(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """Lexical search over tokenised chunks, which are written once and read for the size, the statistics and the scan."""
    tokens = written(tokens)
    size = index.corpus_size(tokens)
    return retrieval.bm25_scan(asked, tokens, size, index.term_stats(index.different_terms(tokens), size), k=Settings().candidate_k)


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = _lexical(_tokens(spark, folder), questions(spark, folder))
    return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def bm25_zero(spark: SparkSession, folder: str) -> DataFrame:
    """As ``bm25_topk``, with chunks of score 0 for questions that have fewer hits; blank questions have none but these."""
    asked, tokens = questions(spark, folder), _tokens(spark, folder)
    found = retrieval.with_zero_scores(_lexical(tokens, asked), asked, tokens, Settings().candidate_k)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _document_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one parent."""
    documents = table(spark, folder, "documents", "doc_id", "text", "source")
    none = F.lit(None)
    return documents.select(
        F.col("doc_id").cast("string").alias("parent_id"), "source", F.lit(0).alias("page_number"), none.cast("string").alias("heading"), "text", none.cast("array<int>").alias("boundaries")
    )


def bm25_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``bm25_topk`` from a stored index, which got the documents in two batches, the second with the first once more."""
    parents, at = _document_parents(spark, folder), new_folder(spark)
    artefacts.add_to_index(parents.filter("CAST(parent_id AS BIGINT) % 3 = 0"), at)
    artefacts.add_to_index(parents, at)
    tables = artefacts.load_index(spark, at)
    size, stats = artefacts.term_stats(tables)
    found = retrieval.bm25(questions(spark, folder), tables["postings"], size, stats, Settings().candidate_k)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def stored_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(name, stored): rows of each table of an index of the documents after its round trip, and the characters of its texts."""
    at = new_folder(spark)
    artefacts.add_to_index(_document_parents(spark, folder), at)
    tables = artefacts.load_index(spark, at)
    count = lambda name, df, value: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("stored"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total"))
    out = count("parents", tables["parents"], F.length("text")).union(count("chunks", tables["chunks"], F.length("text")))
    out = out.union(count("postings", tables["postings"], F.col("tf"))).union(count("doc_stats", tables["doc_stats"], F.col("dl")))
    terms = tables["term_counts"].groupBy("term").agg(F.sum("df").alias("df"))
    return out.union(count("term_counts", terms, F.col("df"))).union(count("embeddings", tables["embeddings"], F.lit(0)))


def _asking(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vec_id") % EVERY == 0)


def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding")
    found = retrieval.nearest(_asking(vectors), vectors, k=Settings().candidate_k)
    return found.select("query_id", "rank", "vec_id", F.round(F.round("score", 9), 6).alias("score"))


def knn_l2_relevance(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding")
    found = retrieval.nearest(_asking(vectors), vectors, k=4, score="l2_relevance")
    return found.select("query_id", "rank", "vec_id", F.round(F.round("score", 9), 6).alias("score"))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Two ranked lists per question from scored_chunks: finite faiss_score is the dense one, rrf_score the other."""
    rows = table(spark, folder, "scored_chunks")
    finite = F.col("faiss_score").isNotNull() & ~F.isnan("faiss_score") & (F.abs("faiss_score") < float("inf"))
    return rows.select("query_id", "chunk_id", "source", "page_number", "embedding", F.when(finite, F.col("faiss_score")).alias("dense_score"), F.col("rrf_score").alias("lexical_score"))


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.fuse(retrieval.ranked_lists(candidates(spark, folder)))


def rrf_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder).select("query_id", "rank", "chunk_id", F.round("rrf", 9).alias("rrf"), "dense_score")


def min_score_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = retrieval.passes(_fused(spark, folder), Settings(min_score=0.5))
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"), F.min("dense_score").alias("least_score"))


def mmr_select(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder).filter(F.col("dense_score").isNotNull() & (F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    unique = rows.groupBy("query_id", "chunk_id").agg(F.max("dense_score").alias("relevance"), F.first("embedding").alias("embedding"))
    return retrieval.mmr(unique).select("query_id", "mmr_pos", "chunk_id", F.round("relevance", 6).alias("relevance"))


def candidate_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """How like the best dense candidate of its question each candidate is."""
    rows = candidates(spark, folder).filter(F.col("dense_score").isNotNull() & (F.size("embedding") == 64)).select("query_id", "chunk_id", "dense_score", "embedding").dropDuplicates(["query_id", "chunk_id"])
    best = retrieval.top(rows, "query_id", 1, F.col("dense_score").desc(), F.col("chunk_id")).select("query_id", F.col("embedding").alias("best_vector"))
    return rows.join(best, "query_id").select("query_id", "chunk_id", F.round(V.cosine(F.col("embedding"), F.col("best_vector")), 5).alias("cosine"))


def candidate_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates without a vector of their own that another row of their chunk has one for."""
    rows = table(spark, folder, "scored_chunks", "query_id", "chunk_id", "embedding")
    stored = rows.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    bare = rows.filter(F.col("embedding").isNull()).select("query_id", "chunk_id").distinct()
    filled = retrieval.with_vectors(bare, stored, F.lit(None).cast("array<float>"))
    return filled.select("query_id", "chunk_id", F.col("vector").isNotNull().alias("known"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of every traced question that pass the score filter, with the text of their page.

    Terms of questions and pages are made once, before they meet.
    """
    traced = table(spark, folder, "rag_timings", "query_id", "question").filter(F.col("query_id").isNotNull() & F.col("question").isNotNull())
    asked = traced.groupBy("query_id").agg(F.min("question").alias("question")).withColumn("asked_terms", retrieval.question_terms(F.col("question")))
    places = candidates(spark, folder).groupBy("query_id", "chunk_id").agg(F.min("source").alias("source"), F.min("page_number").alias("page_number"))
    kept = retrieval.passes(_fused(spark, folder)).select("query_id", "chunk_id")
    pages = layout.page_text(pages_of(spark, folder, "source", "page_number", "blocks"))
    pages = pages.withColumn("given_terms", retrieval.question_terms(F.col("text")))
    return kept.join(places, ["query_id", "chunk_id"]).join(asked, "query_id").join(pages, ["source", "page_number"])


def _reranked(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.rerank(_pairs(spark, folder))


def rerank_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return _reranked(spark, folder).select("query_id", "rank", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"))


def parent_substitution(spark: SparkSession, folder: str) -> DataFrame:
    """The pages behind the best fused candidates: top-k first, then the join with the page table."""
    places = candidates(spark, folder).groupBy("query_id", "chunk_id").agg(F.min("source").alias("source"), F.min("page_number").alias("page_number"))
    best = _fused(spark, folder).filter(F.col("rank") <= Settings().top_k).select("query_id", "chunk_id", "rank").join(places, ["query_id", "chunk_id"])
    found = retrieval.with_parents(best, layout.page_text(pages_of(spark, folder, "source", "page_number", "blocks")), ["source", "page_number"])
    return found.select("query_id", "rank", "chunk_id", T.basename(F.col("source")).alias("name"), "page_number", T.preview(F.col("text")).alias("preview"))


def context_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.prompts(_reranked(spark, folder))


def context_prompt_v1(spark: SparkSession, folder: str) -> DataFrame:
    """The same in the wording of the first generation."""
    return retrieval.prompts(_reranked(spark, folder), cite=False)


def prefixed_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions as an embedder gets them."""
    return questions(spark, folder).select("query_id", F.concat(F.lit(Settings().query_prefix), F.col("question")).alias("prefixed"))


def chunk_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Card heading, file name and colour of the first five candidates of each question."""
    rows = candidates(spark, folder).groupBy("query_id", "chunk_id").agg(F.max("dense_score").alias("score"), F.min("source").alias("source"))
    best = retrieval.top(rows, "query_id", 5, F.col("score").desc_nulls_last(), F.col("chunk_id"))
    name = T.basename(F.col("source"))
    return best.select("query_id", "rank", F.format_string("Chunk %d — %s", "rank", name).alias("heading"), T.score_color(F.col("score")).alias("color"))


def _chunk_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Child windows with a numeric id, for the vector search."""
    return chunk_table(spark, folder).select((F.col("doc_id") * 100_000 + F.col("child_no")).alias("vec_id"), "chunk_id", "doc_id", F.col("child").alias("text"))


def text_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the prefixed child windows by the offline embedder."""
    prefixed = F.concat(F.lit(Settings().passage_prefix), F.col("text"))
    return _chunk_numbers(spark, folder).select("vec_id", "chunk_id", models.hashing_embedder()(prefixed).alias("embedding"))


#: The stand-in embedder counts shared words, those of prefixes too, so there are none; its scores are low.
OFFLINE = Settings(min_score=0.05, passage_prefix="", query_prefix="")


def page_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A stored index of the extracted pages: hierarchical parents, their chunks, both indexes."""
    at = new_folder(spark)
    artefacts.add_to_index(artefacts.parent_table(pages_of(spark, folder, "source", "page_number", "blocks", "section_boundaries"), OFFLINE), at, settings=OFFLINE)
    return artefacts.load_index(spark, at)


def retrieve(tables: dict[str, DataFrame], asked: DataFrame, settings: Settings = OFFLINE) -> tuple[DataFrame, DataFrame]:
    """(fused hits, reranked parents) of (query_id, question) from a loaded index: dense and lexical search, fusion, score
    filter, MMR and reranking over child chunks, then each child's parent."""
    embed = models.hashing_embedder()
    asking = asked.select((-F.col("query_id") - 1).alias("vec_id"), embed(F.concat(F.lit(settings.query_prefix), F.col("question"))).alias("embedding"))
    dense = retrieval.nearest(asking, tables["embeddings"], settings.candidate_k).select((-F.col("query_id") - 1).alias("query_id"), "vec_id", F.col("score").alias("dense_score"))
    lexical = _lexical(index.tokenised(tables["chunks"]), asked)
    none = F.lit(None).cast("double")
    hits = dense.join(tables["embeddings"].select("vec_id", "chunk_id"), "vec_id").select("query_id", "chunk_id", "dense_score", none.alias("lexical_score")).unionByName(
        lexical.select("query_id", "chunk_id", none.alias("dense_score"), F.col("score").alias("lexical_score"))
    )
    fused = written(retrieval.fuse(retrieval.ranked_lists(hits), settings))
    kept = retrieval.passes(fused, settings).join(tables["embeddings"].select("chunk_id", "embedding"), "chunk_id")
    varied = retrieval.mmr(kept.select(F.col("query_id").cast("string").alias("query_id"), "chunk_id", F.col("dense_score").alias("relevance"), "embedding"), settings)
    pairs = varied.select(F.col("query_id").cast("long").alias("query_id"), "chunk_id").join(tables["chunks"].select("chunk_id", "parent_id", "text"), "chunk_id").join(asked, "query_id")
    ranked = retrieval.rerank(pairs, settings).select("query_id", "question", "rank", "parent_id")
    return fused, retrieval.with_parents(ranked, tables["parents"].select("parent_id", "source", "page_number", "heading", "text"), ["parent_id"])


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """The whole pipeline for every asked question, over the stored index of the pages, up to the prompt with the parents."""
    return retrieval.prompts(retrieve(page_index(spark, folder), questions(spark, folder))[1], dedup_parents=True)


def ask(tables: dict[str, DataFrame], question: str, settings: Settings = OFFLINE) -> DataFrame:
    """The prompt of one question; raises ``NothingFound`` or ``NothingRelevant`` if no hit is there, or none good enough."""
    asked = tables["chunks"].sparkSession.createDataFrame([(0, question)], "query_id long, question string")
    fused, ranked = retrieve(tables, asked, settings)
    retrieval.require(fused, retrieval.NothingFound)
    return retrieval.prompts(retrieval.require(ranked, retrieval.NothingRelevant), dedup_parents=True)


QUERIES = {
    f.__name__: f
    for f in (
        text_embeddings, answers, bm25_stored, stored_tables, term_stats, doc_stats, bm25_topk, bm25_zero, knn_cosine, knn_l2_relevance, rrf_hybrid, min_score_filter, mmr_select, candidate_similarity,
        candidate_vectors, rerank_overlap, parent_substitution, context_prompt, context_prompt_v1, prefixed_questions, chunk_cards,
    )
}

_BM25 = f"""
{sql.CHUNKS},
toks AS (SELECT chunk_id, {sql.tokens("child")} AS ws FROM chunks),
size AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM toks),
posted AS (SELECT chunk_id, len(ws) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, ws, unnest(ws) AS term FROM toks) GROUP BY chunk_id, len(ws), term),
raws AS (SELECT term, count(*) AS df, ln((SELECT n FROM size) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posted GROUP BY term),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)
"""

_LISTS = """
cand AS (SELECT query_id, chunk_id, max(CASE WHEN isfinite(faiss_score) THEN faiss_score END) AS dense, max(rrf_score) AS lexical FROM scored_chunks GROUP BY query_id, chunk_id),
lists AS (
    SELECT query_id, chunk_id, 'dense' AS list, dense AS score FROM cand WHERE dense IS NOT NULL
    UNION ALL SELECT query_id, chunk_id, 'lexical', lexical FROM cand WHERE lexical IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, chunk_id) - 1 AS r FROM lists),
summed AS (
    SELECT query_id, chunk_id, sum(1.0::DOUBLE / (r + 60)) AS rrf, max(CASE WHEN list = 'dense' THEN score END) AS dense_score,
           min(r + CASE WHEN list = 'dense' THEN 0 ELSE 20 END) AS seen FROM ranked WHERE r < 20 GROUP BY query_id, chunk_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, seen, chunk_id) AS rank FROM summed)
"""

_RERANKED = f"""
{_LISTS}, {sql.PAGE_TEXT},
asked AS (SELECT query_id, min(question) AS question FROM rag_timings WHERE query_id IS NOT NULL AND question IS NOT NULL GROUP BY query_id),
places AS (SELECT query_id, chunk_id, min(source) AS source, min(page_number) AS page_number FROM scored_chunks GROUP BY query_id, chunk_id),
pairs AS (
    SELECT f.query_id, f.chunk_id, a.question, p.text,
           list_distinct({sql.tokens("lower(a.question)")}) AS x, list_distinct({sql.tokens("lower(p.text)")}) AS y
    FROM fused f JOIN places USING (query_id, chunk_id) JOIN asked a USING (query_id) JOIN page_text p USING (source, page_number) WHERE f.dense_score >= 0.3),
scored AS (
    SELECT query_id, chunk_id, question, text,
           CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END AS s FROM pairs),
best AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM scored) WHERE rank <= 5)
"""


def _knn(k: int, score: str) -> str:
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, e.vec_id, round({score}, 9) AS score FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {k}
"""


SQL = {
    "term_stats": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM stats",
    "doc_stats": f"WITH {_BM25} SELECT chunk_id, CAST(len(ws) AS INTEGER) AS dl FROM toks",
    "bm25_topk": f"""
WITH {_BM25},
asked AS (
    SELECT min(run_id) AS query_id, question FROM rag_timings WHERE run_id % 20 = 0 AND {sql.trim_all("question")} <> '' GROUP BY question),
terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({sql.tokens("question")}) AS term FROM asked) GROUP BY query_id, term),
scored AS (
    SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM size)))) AS score
    FROM posted JOIN terms USING (term) JOIN stats USING (term) GROUP BY query_id, chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 20
""",
    "bm25_zero": f"""
WITH {_BM25},
asked AS (
    SELECT min(run_id) AS query_id, question FROM rag_timings WHERE run_id % 20 = 0 AND {sql.trim_all("question")} <> '' GROUP BY question),
terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({sql.tokens("question")}) AS term FROM asked) GROUP BY query_id, term),
scored AS (
    SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM size)))) AS score
    FROM posted JOIN terms USING (term) JOIN stats USING (term) GROUP BY query_id, chunk_id),
every AS (
    SELECT query_id, chunk_id, score FROM scored
    UNION ALL SELECT a.query_id, t.chunk_id, 0.0 FROM asked AS a CROSS JOIN (SELECT chunk_id FROM toks ORDER BY chunk_id LIMIT 40) AS t
    ANTI JOIN scored AS s ON s.query_id = a.query_id AND s.chunk_id = t.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM every)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 20
""",
    "stored_tables": f"""
WITH {_BM25}
SELECT 'parents' AS name, count(*) AS stored, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total FROM documents
UNION ALL SELECT 'chunks', count(*), CAST(sum(length(child)) AS BIGINT) FROM chunks
UNION ALL SELECT 'postings', count(*), CAST(sum(tf) AS BIGINT) FROM posted
UNION ALL SELECT 'doc_stats', count(*), CAST(sum(len(ws)) AS BIGINT) FROM toks
UNION ALL SELECT 'term_counts', count(*), CAST(sum(df) AS BIGINT) FROM stats
UNION ALL SELECT 'embeddings', count(*), 0 FROM chunks
""",
    "mmr_select": """
WITH RECURSIVE c AS (
    SELECT query_id, chunk_id, max(faiss_score) AS rel, any_value(CAST(embedding AS DOUBLE[])) AS v FROM scored_chunks
    WHERE isfinite(faiss_score) AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY query_id, chunk_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id) AS r FROM c) WHERE r <= 20),
sim AS (
    SELECT x.query_id, x.r AS i, y.r AS j, CASE WHEN list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v) = 0 THEN 0.0 ELSE list_cosine_similarity(x.v, y.v) END AS s
    FROM b AS x JOIN b AS y USING (query_id)),
m AS (
    SELECT query_id, 0 AS pos, [CAST(1 AS BIGINT)] AS picked FROM b WHERE r = 1
    UNION ALL
    SELECT query_id, pos + 1, list_append(picked, nxt) FROM (
        SELECT m.query_id, m.pos, m.picked, b.r AS nxt,
               row_number() OVER (PARTITION BY m.query_id ORDER BY round(0.5 * any_value(b.rel) - 0.5 * max(sim.s), 12) DESC, b.r) AS place
        FROM m JOIN b USING (query_id) JOIN sim ON sim.query_id = m.query_id AND sim.j = b.r AND list_contains(m.picked, sim.i)
        WHERE NOT list_contains(m.picked, b.r) GROUP BY m.query_id, m.pos, m.picked, b.r) WHERE place = 1)
SELECT m.query_id, CAST(m.pos AS INTEGER) AS mmr_pos, b.chunk_id, round(b.rel, 6) AS relevance FROM m JOIN b ON b.query_id = m.query_id AND b.r = m.picked[-1]
""",
    "knn_cosine": _knn(20, "list_cosine_similarity(q.v, e.v)"),
    "knn_l2_relevance": _knn(4, "1 - power(list_distance(q.v, e.v), 2) / sqrt(2.0)"),
    "rrf_hybrid": f"WITH {_LISTS} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(rrf, 9) AS rrf, dense_score FROM fused",
    "min_score_filter": f"WITH {_LISTS} SELECT query_id, count(*) AS kept, min(dense_score) AS least_score FROM fused WHERE dense_score >= 0.5 GROUP BY query_id",
    "candidate_similarity": """
WITH c AS (
    SELECT query_id, chunk_id, any_value(faiss_score) AS s, any_value(CAST(embedding AS DOUBLE[])) AS v FROM scored_chunks
    WHERE isfinite(faiss_score) AND len(embedding) = 64 GROUP BY query_id, chunk_id),
b AS (SELECT query_id, v AS bv FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM c) WHERE r = 1)
SELECT query_id, chunk_id, round(CASE WHEN list_dot_product(v, v) * list_dot_product(bv, bv) = 0 THEN 0.0 ELSE list_cosine_similarity(v, bv) END, 5) AS cosine
FROM c JOIN b USING (query_id)
""",
    "candidate_vectors": """
SELECT query_id, chunk_id, chunk_id IN (SELECT chunk_id FROM scored_chunks WHERE embedding IS NOT NULL) AS known
FROM (SELECT DISTINCT query_id, chunk_id FROM scored_chunks WHERE embedding IS NULL)
""",
    "rerank_overlap": f"WITH {_RERANKED} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 6) AS rerank_score FROM best",
    "parent_substitution": f"""
WITH {_LISTS}, {sql.PAGE_TEXT},
places AS (SELECT query_id, chunk_id, min(source) AS source, min(page_number) AS page_number FROM scored_chunks GROUP BY query_id, chunk_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, string_split(source, '/')[-1] AS name, page_number,
       CASE WHEN length(text) > 280 THEN substring(text, 1, 280) || '…' ELSE text END AS preview
FROM fused JOIN places USING (query_id, chunk_id) JOIN page_text USING (source, page_number) WHERE rank <= 5
""",
    "context_prompt": f"""
WITH {_RERANKED}
SELECT query_id, question, count(*) AS chunks,
       'You are an assistant that answers questions based only on the provided context.' || chr(10) || 'Cite the document section when available.' || chr(10)
       || 'If the answer cannot be determined from the context, say "I don''t know based on the provided context."' || chr(10) || chr(10) || 'Context:' || chr(10)
       || string_agg(text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Answer:' AS prompt
FROM best GROUP BY query_id, question
""",
    "chunk_cards": """
WITH c AS (SELECT query_id, chunk_id, max(CASE WHEN isfinite(faiss_score) THEN faiss_score END) AS s, min(source) AS source FROM scored_chunks GROUP BY query_id, chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, chunk_id) AS rank FROM c)
SELECT query_id, CAST(rank AS INTEGER) AS rank, 'Chunk ' || rank || ' — ' || string_split(source, '/')[-1] AS heading,
       CASE WHEN s >= 0.8 THEN 'green' WHEN s >= 0.5 THEN 'orange' ELSE 'red' END AS color
FROM r WHERE rank <= 5
""",
}
SQL["bm25_stored"] = SQL["bm25_topk"]
SQL["context_prompt_v1"] = SQL["context_prompt"].replace("'Cite the document section when available.' || chr(10)\n       || ", "")
SQL["prefixed_questions"] = f"""
SELECT min(run_id) AS query_id, 'Represent this sentence for searching relevant passages: ' || question AS prefixed
FROM rag_timings WHERE run_id % 20 = 0 AND {sql.trim_all("question")} <> '' GROUP BY question
"""
