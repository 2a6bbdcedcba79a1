"""Search, fusion, filtering, diversity, reranking and prompt assembly, for all questions at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import Settings
from quillspark.functions import text as T
from quillspark.operators import index
from quillspark.operators.grouped import by_group

#: Query vectors of one block of an exact search, and stored vectors compared with them at once.
QUERY_ROWS, SLICE = 4_000, 1_000
#: Questions of one block of a lexical scan.
QUESTION_ROWS = 500


def top(df: DataFrame, group: str, k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1; Spark keeps ``k`` per group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(name) <= k)


def bm25(questions: DataFrame, posted: DataFrame, size: DataFrame, stats: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best chunks of each question with a shared term, smaller keys first on ties.

    Only postings of asked terms are scored. A term repeated in a question counts as often.
    """
    asked = (
        questions.select("query_id", F.explode(T.tokens(F.col("question"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("times"))
        .join(stats.select("term", "idf"), "term")
    )
    weight = F.col("times") * F.col("idf") * index.bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    scored = (
        posted.join(asked, "term")
        .crossJoin(F.broadcast(size.select("avgdl")))
        .groupBy("query_id", key)
        .agg(F.sum(weight).alias("score"))
    )
    return top(scored, "query_id", k, F.round("score", 9).desc(), F.col(key))


def with_zero_scores(found: DataFrame, questions: DataFrame, keys: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """``found`` filled up to ``k`` chunks per question with chunks that share no term with it, score 0, smallest keys first.

    ``keys`` has the key of every chunk. A question with fewer than ``k`` hits needs at most the 2 ``k`` smallest keys, so
    these alone meet the questions. Chunks of negative score stay behind those of score 0.
    """
    first = F.broadcast(keys.select(key).distinct().orderBy(key).limit(2 * k))
    zero = questions.select("query_id").distinct().crossJoin(first).join(found.select("query_id", key), ["query_id", key], "left_anti")
    every = found.select("query_id", key, "score").unionByName(zero.withColumn("score", F.lit(0.0)))
    return top(every, "query_id", k, F.round("score", 9).desc(), F.col(key))


def bm25_scan(questions: DataFrame, tokens: DataFrame, size: DataFrame, stats: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The same rows as ``bm25`` for a large stated set of questions, in one pass over ``index.tokenised`` chunks per block of questions.

    Where many questions share frequent terms a join makes a row for every question and chunk; here each partition
    scores its chunks against all questions of a block at once and keeps its ``k`` best, so only those are shuffled.
    """
    asked = questions.select("query_id", T.tokens(F.col("question")).alias("terms")).filter(F.size("terms") > 0)
    blocks = max(1, -(-asked.count() // QUESTION_ROWS))
    average = size.first().avgdl or 1.0
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.collect()
        used = part.select(F.explode("terms").alias("term")).distinct()
        idf = {r.term: r.idf for r in stats.join(F.broadcast(used), "term").select("term", "idf").collect()}
        found = _score(tokens, [r.query_id for r in rows], [r.terms for r in rows], idf, average, k, key, asked)
        out = found if out is None else out.unionByName(found)
    return top(out, "query_id", k, F.round("score", 9).desc(), F.col(key))


def _score(tokens: DataFrame, ids: list, terms: list[list[str]], idf: dict[str, float], average: float, k: int, key: str, asked: DataFrame) -> DataFrame:
    place = {t: i for i, t in enumerate(sorted(idf))}
    weights = np.zeros((len(place), len(ids)))
    for q, words in enumerate(terms):
        for w in words:
            if w in place:
                weights[place[w], q] += idf[w]
    shared = tokens.sparkSession.sparkContext.broadcast((place, weights))
    kinds = asked.schema["query_id"].dataType.simpleString(), tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weights = shared.value
        signs = (weights != 0).astype(np.float64) if (weights < 0).any() else None
        step = max(50, 2_000_000 // max(1, len(place)))
        best_keys, best = np.zeros((len(ids), k), "U1"), np.full((len(ids), k), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column(1)
                sizes = np.asarray(lists.value_lengths())
                at_term = np.fromiter((place.get(t, -1) for t in lists.flatten().to_pylist()), np.int64, int(sizes.sum()))
                owner = np.repeat(np.arange(len(sizes)), sizes)[at_term >= 0]
                if not len(owner) or not len(ids):
                    continue
                tf = np.bincount(owner * len(place) + at_term[at_term >= 0], minlength=len(sizes) * len(place)).reshape(len(sizes), -1).astype(np.float64)
                tf *= (index.K1 + 1) / (tf + index.K1 * (1 - index.B + index.B * sizes[:, None] / average))
                value = (tf @ weights).T
                shares = value != 0 if signs is None else ((tf > 0).astype(np.float64) @ signs).T > 0
                value = np.where(shares, value, -np.inf)
                keys = np.broadcast_to(np.asarray(part.column(0).to_pylist()), value.shape)
                best_keys, best = _best(np.hstack([best_keys, keys]), np.hstack([best, value]), k)
        keep = np.isfinite(best).ravel()
        owners = np.repeat(np.arange(len(ids)), k)[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in owners]), pa.array(best_keys.ravel()[keep].tolist()), pa.array(best.ravel()[keep])], names=["query_id", key, "score"]
        )

    return tokens.select(key, "terms").mapInArrow(run, f"query_id {kinds[0]}, {key} {kinds[1]}, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, score: str = "cosine", min_score: float | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): exact search of every query vector against all stored vectors but its own.

    The asking side is a stated set and goes to the executors in blocks of at most ``QUERY_ROWS``; each partition
    of the stored side keeps its ``k`` best per query before anything is shuffled. Cosines of a vector of norm 0
    are 0; null vectors take no part.
    """
    asking = queries.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    stored = vectors.filter(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    blocks = max(1, -(-asking.count() // QUERY_ROWS))
    out = None
    for b in range(blocks):
        part = asking if blocks == 1 else asking.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.select("query_id", F.col("query_vector")).toArrow()
        ids = np.asarray(rows["query_id"])
        matrix = np.stack([np.asarray(v.values, np.float64) for v in rows["query_vector"]]) if len(ids) else np.empty((0, 1))
        found = _scan(stored, ids, matrix, k, score)
        out = found if out is None else out.unionByName(found)
    ranked = top(out, "query_id", k, F.round("score", 9).desc(), F.col("vec_id"))
    return ranked if min_score is None else ranked.filter(F.col("score") >= min_score)


def _best(ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest values of each row, to 9 decimals, smaller ids first on ties; missing places have -inf."""
    n, m = values.shape
    rounded = np.round(values, 9)
    floor = np.partition(rounded, m - k, axis=1)[:, m - k] if m > k else np.full(n, -np.inf)
    row, column = np.nonzero((rounded >= floor[:, None]) & np.isfinite(values))
    value, vid = values[row, column], ids[row, column]
    order = np.lexsort((vid, -rounded[row, column], row))
    row, value, vid = row[order], value[order], vid[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    use = place < k
    out_ids, out_values = np.zeros((n, k), ids.dtype), np.full((n, k), -np.inf)
    out_ids[row[use], place[use]], out_values[row[use], place[use]] = vid[use], value[use]
    return out_ids, out_values


def _scan(stored: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, score: str) -> DataFrame:
    shared = stored.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches):
        own, q = shared.value
        norms, squares = np.linalg.norm(q, axis=1), (q**2).sum(1)
        best_ids, best = np.zeros((len(q), k), np.int64), np.full((len(q), k), -np.inf)
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                part = pdf.iloc[at : at + SLICE]
                if not len(q):
                    continue
                x = np.stack(part.embedding.to_numpy()).astype(np.float64)
                inner = q @ x.T
                if score == "cosine":
                    both = norms[:, None] * np.linalg.norm(x, axis=1)[None, :]
                    value = np.divide(inner, both, out=np.zeros_like(inner), where=both != 0)
                else:
                    value = 1 - (squares[:, None] + (x**2).sum(1)[None, :] - 2 * inner) / np.sqrt(2.0)
                vec = part.vec_id.to_numpy()
                value[own[:, None] == vec[None, :]] = -np.inf
                best_ids, best = _best(np.hstack([best_ids, np.broadcast_to(vec, value.shape)]), np.hstack([best, value]), k)
        keep = np.isfinite(best).ravel()
        yield pd.DataFrame({"query_id": np.repeat(own, k)[keep], "vec_id": best_ids.ravel()[keep], "score": best.ravel()[keep]})

    return stored.mapInPandas(run, "query_id long, vec_id long, score double")


def ranked_lists(candidates: DataFrame, k: int = Settings().candidate_k) -> DataFrame:
    """(query_id, chunk_id, list, score, rank0): the first ``k`` of the dense and the lexical list of every question, ranked from 0.

    Dense hits have a finite dense_score; lexical hits a lexical_score. Repeated rows of a candidate count once,
    with the highest score. Ties go to the smaller chunk_id.
    """
    best = candidates.groupBy("query_id", "chunk_id").agg(F.max("dense_score").alias("dense"), F.max("lexical_score").alias("lexical"))
    lists = F.explode(F.array(*(F.struct(F.lit(n).alias("list"), F.col(n).alias("score")) for n in ("dense", "lexical"))))
    long = best.select("query_id", "chunk_id", lists.alias("l")).select("query_id", "chunk_id", "l.list", "l.score").filter(F.col("score").isNotNull())
    order = Window.partitionBy("query_id", "list").orderBy(F.col("score").desc(), "chunk_id")
    first = long.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
    return first.withColumn("rank0", F.col("_place") - 1).drop("_place")


def fuse(lists: DataFrame, settings: Settings = Settings(), compat: bool = False) -> DataFrame:
    """(query_id, chunk_id, rrf, dense_score, rank): reciprocal-rank fusion of the first ``candidate_k`` of each list.

    The first of a list contributes 1 / rrf_k. ``dense_score`` is null for a chunk that only the lexical list has.
    With ``compat`` the lists do not meet, as where their chunks are keyed by differently stored texts: a chunk
    of both lists comes out twice.
    """
    k = settings.candidate_k
    fused = (
        lists.filter(F.col("rank0") < k)
        .groupBy("query_id", "chunk_id", *(["list"] if compat else []))
        .agg(
            F.sum(F.lit(1.0) / (F.col("rank0") + settings.rrf_k)).alias("rrf"),
            F.max(F.when(F.col("list") == "dense", F.col("score"))).alias("dense_score"),
            F.min(F.col("rank0") + F.when(F.col("list") == "dense", 0).otherwise(k)).alias("_seen"),
        )
    )
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "_seen", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).drop("_seen", "list")


def passes(fused: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fused rows of at least ``min_score``; equal is enough. Lexical-only rows go, unless ``keep_lexical_only``."""
    enough = F.col("dense_score") >= settings.min_score
    return fused.filter(enough | F.col("dense_score").isNull() if settings.keep_lexical_only else enough)


class NoResults(Exception):
    """A question without results; raised for one question asked interactively, not in batches."""


class NothingFound(NoResults):
    """The index holds nothing for the question."""


class NothingRelevant(NoResults):
    """What the index holds for the question does not reach the least score."""


def require(rows: DataFrame, error: type[NoResults]) -> DataFrame:
    """``rows``, or ``error`` if there are none."""
    if rows.isEmpty():
        raise error(error.__doc__)
    return rows


def mmr_order(relevance: np.ndarray, similarity: np.ndarray, k: int, lam: float) -> list[int]:
    """Rows in the order chosen: the most relevant, then always the best of relevance against likeness to those chosen."""
    left = list(range(len(relevance)))
    chosen: list[int] = []
    closest = np.full(len(relevance), -np.inf)
    while left and len(chosen) < k:
        value = relevance[left] if not chosen else lam * relevance[left] - (1 - lam) * closest[left]
        pick = left[int(np.argmax(value))]
        chosen.append(pick)
        left.remove(pick)
        closest = np.maximum(closest, similarity[pick])
    return chosen


def mmr(candidates: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, chunk_id, relevance, mmr_pos): maximal marginal relevance over the best ``candidate_k`` of each question.

    Candidates have relevance and embedding; rows without either take no part, equal relevance goes to the
    smaller chunk_id. Cutting to ``candidate_k`` first bounds every group.
    """
    usable = candidates.filter(F.col("relevance").isNotNull() & ~F.isnan("relevance") & F.col("embedding").isNotNull())
    best = top(usable, "query_id", settings.candidate_k, F.col("relevance").desc(), F.col("chunk_id"), name="_rank")
    k, lam = settings.mmr_k or settings.candidate_k, settings.mmr_lambda

    def select(group: pa.Table) -> list[tuple]:
        query, ids, relevance = group["query_id"][0].as_py(), group["chunk_id"].to_pylist(), np.asarray(group["relevance"])
        x = np.stack([np.asarray(v.values, np.float64) for v in group["embedding"]])
        norms = np.linalg.norm(x, axis=1)
        both = norms[:, None] * norms[None, :]
        inner = x @ x.T
        order = mmr_order(relevance, np.divide(inner, both, out=np.zeros_like(inner), where=both != 0), k, lam)
        return [(query, ids[i], float(relevance[i]), n) for n, i in enumerate(order)]

    kinds = {"query_id": pa.string(), "chunk_id": pa.string(), "relevance": pa.float64(), "mmr_pos": pa.int32()}
    schema = "query_id string, chunk_id string, relevance double, mmr_pos int"
    return by_group(best.select("query_id", "chunk_id", "relevance", "embedding", "_rank"), ["query_id"], ["_rank"], select, kinds, schema)


def overlap(question: Column, text: Column) -> Column:
    """Jaccard similarity of the lower-cased terms of two texts; 0 if both have none."""
    a, b = (F.array_distinct(T.tokens(F.lower(c))) for c in (question, text))
    common, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every > 0, common / every).otherwise(0.0)


def question_terms(c: Column) -> Column:
    """Different lower-cased terms of a text, for ``rerank``."""
    return F.array_distinct(T.tokens(F.lower(c)))


def rerank(pairs: DataFrame, settings: Settings = Settings(), scorer=None) -> DataFrame:
    """``pairs`` with rerank_score and rank, the best ``top_k`` of each question; ties by chunk_id.

    ``scorer`` makes a Column from question and text; the default is ``overlap``, a stand-in for a model. Where
    pairs have ``asked_terms`` and ``given_terms``, made once per question and text before they met, these are used.
    """
    if scorer is not None:
        scored = pairs.withColumn("rerank_score", scorer(F.col("question"), F.col("text")))
    else:
        made = {name: question_terms(F.col(c)) for name, c in (("asked_terms", "question"), ("given_terms", "text")) if name not in pairs.columns}
        common = pairs.withColumns(made).withColumn("_common", F.size(F.array_intersect("asked_terms", "given_terms")))
        every = F.size("asked_terms") + F.size("given_terms") - F.col("_common")
        scored = common.withColumn("rerank_score", F.when(every > 0, F.col("_common") / every).otherwise(0.0)).drop("asked_terms", "given_terms", "_common")
    return top(scored, "query_id", settings.top_k, F.round("rerank_score", 9).desc(), F.col("chunk_id"))


def with_parents(ranked: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """``ranked`` with the text of its parents; joined after the top-k, so few rows meet the parent table."""
    return ranked.join(parent, keys)


def prompts(ranked: DataFrame, cite: bool = True, dedup_parents: bool = False) -> DataFrame:
    """(query_id, question, chunks, prompt): texts of each question joined by a blank line in rank order, in the prompt.

    Equal parents are kept unless ``dedup_parents``.
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text)
    joined = F.array_join(F.array_distinct(texts) if dedup_parents else texts, "\n\n")
    grouped = ranked.groupBy("query_id", "question").agg(F.count(F.lit(1)).alias("chunks"), joined.alias("context"))
    return grouped.select("query_id", "question", "chunks", T.prompt(F.col("context"), F.col("question"), cite).alias("prompt"))


def with_vectors(candidates: DataFrame, stored: DataFrame, fallback: Column) -> DataFrame:
    """Candidates with the stored vector of their chunk, or ``fallback`` where the index has none."""
    known = stored.groupBy(F.col("chunk_id").alias("_id")).agg(F.first("embedding", ignorenulls=True).alias("stored_vector"))
    return candidates.join(known, F.col("chunk_id") == F.col("_id"), "left").withColumn("vector", F.coalesce("stored_vector", fallback)).drop("_id", "stored_vector")

