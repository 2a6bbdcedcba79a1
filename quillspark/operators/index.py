"""The lexical index as tables: postings, document lengths, term statistics; and incremental appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.session import cut_lineage

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, dl, term, tf): the term counts of every chunk with its length; within the row, so nothing is shuffled.

    The terms of a chunk are sorted and counted by runs. A chunk is expected once per key. Chunks without terms
    have no postings but count in ``corpus_size``.
    """
    terms = chunks.select(key, F.array_sort(T.tokens(F.col(text))).alias("_terms")).withColumn("dl", F.size("_terms")).filter("dl > 0")
    first = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.col("_terms")[i] != F.col("_terms")[F.greatest(i - 1, F.lit(0))]))
    runs = terms.withColumn("_first", first)
    end = lambda j: F.coalesce(F.get(F.col("_first"), j + 1), F.col("dl"))
    counted = F.transform("_first", lambda i, j: F.struct(F.col("_terms")[i].alias("term"), (end(j) - i).alias("tf")))
    return runs.select(key, "dl", F.explode(counted).alias("p")).select(key, "dl", "p.term", "p.tf")


def tokenised(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, terms): the terms of every chunk, as ``corpus_size``, ``term_stats`` and ``retrieval.bm25_scan`` take them."""
    return chunks.select(key, T.tokens(F.col(text)).alias("terms"))


def different_terms(tokens: DataFrame) -> DataFrame:
    """(term): each term of each chunk once, for ``term_stats``."""
    return tokens.select(F.explode(F.array_distinct("terms")).alias("term"))


def corpus_size(tokens: DataFrame) -> DataFrame:
    """One row (n, avgdl) from ``tokenised``: number of chunks and their mean length in terms."""
    return tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avgdl"))


def term_stats(posted: DataFrame, size: DataFrame) -> DataFrame:
    """(term, df, idf): document frequency and inverse document frequency; negative ones become ``EPSILON`` times the mean.

    The mean runs over all terms, the negative ones included. ``posted`` has a row for every term of every chunk.
    """
    return weighed(cut_lineage(posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))), size)  # read twice; the texts only once


def weighed(counts: DataFrame, size: DataFrame) -> DataFrame:
    """``term_stats`` from (term, df)."""
    raw = counts.crossJoin(F.broadcast(size.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))


def bm25_weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def new_chunks(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key the index does not have, each key once."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def distinct_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text, copies): each different text under its smallest id, with the number of documents that have it.

    Null texts count as one text. Grouped by a 128-bit hash, so that long texts are not shuffled.
    """
    hashed = documents.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    first = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("copies")).select("doc_id", "copies")
    return documents.select("doc_id", "text").dropDuplicates(["doc_id"]).join(first, "doc_id")
