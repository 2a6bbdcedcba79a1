"""The pN_ queries over the tables of a data folder, and the SQL that checks them where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import encode, leaks, lines, neighbours, percentiles, split, subset, truncation
from quillspark.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary file; its folder is a setting of the environment."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.oversized(table(spark, folder, "extracted_pages"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.pieces(table(spark, folder, "extracted_pages"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    chosen = subset.select_varied(table(spark, folder, "scored_chunks"), table(spark, folder, "subset_requests"))
    return chosen.select("query_id", "chunk_id")


def p2_dispersion(spark: SparkSession, folder: str) -> DataFrame:
    chosen = subset.select_varied(table(spark, folder, "scored_chunks"), table(spark, folder, "subset_requests"), alike=None)
    return chosen.groupBy("query_id", "subset_size").agg(
        F.count(F.lit(1)).alias("chosen"), F.round(F.max("dispersion"), 6).alias("dispersion"), F.round(F.avg("score"), 6).alias("mean_score")
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, folder, "scored_chunks")).select("chunk_a", "chunk_b")


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_chunks(table(spark, folder, "scored_chunks"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.slow_groups(table(spark, folder, "rag_timings"))


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    kept = percentiles.period_percentiles(table(spark, folder, "rag_timings"))
    return kept.withColumn("percentile", F.round("percentile", 6))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_places(table(spark, folder, "extracted_pages"))


def p5_near(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_near(table(spark, folder, "extracted_pages"))


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "extracted_pages")
    return lines.clean_blocks(pages, lines.repeated_near(pages))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(spread(table(spark, folder, "documents", "doc_id", "text")), vocabulary())


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text does not come back from its ids; well-formed texts give no row."""
    documents = table(spark, folder, "documents", "doc_id", "text").dropDuplicates(["doc_id"])
    back = encode.decode(encode.encode(documents, vocabulary()), vocabulary())
    pairs = documents.join(back.withColumnRenamed("text", "back"), "doc_id")
    return pairs.groupBy((F.coalesce("text", F.lit("")) == F.col("back")).alias("same")).agg(F.count(F.lit(1)).alias("documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.leaks(spread(table(spark, folder, "documents", "doc_id", "text")), table(spark, folder, "eval_items"))
    return found.filter(F.col("distance") == 0).select("doc_id", "item_id")


def p7_near(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(spread(table(spark, folder, "documents", "doc_id", "text")), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_off(spread(table(spark, folder, "documents", "doc_id", "text", "source")))


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_share(spread(table(spark, folder, "documents", "doc_id", "text", "source")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p2_found, p2_dispersion, p3_found, p3_neighbours, p4_found, p4_percentiles,
        p5_found, p5_near, p5_clean, p6_ids, p6_round_trip, p7_found, p7_near, p8_found, p8_sources,
    )
}

_RUNS = """
runs AS (
    SELECT run_id, min(deployment) AS deployment, min(CAST(log_ts AS TIMESTAMPTZ)) AS ts,
           min(llm_generate_s) AS llm_generate_s, min(total_s) AS total_s
    FROM rag_timings WHERE lower(trim(status, chr(32) || chr(9) || chr(13) || chr(10))) = 'ok' GROUP BY run_id),
found_values AS (
    SELECT deployment, CAST(ts AT TIME ZONE 'UTC' AS DATE) AS d, 'llm_generate_s' AS measure, llm_generate_s AS v FROM runs
    UNION ALL SELECT deployment, CAST(ts AT TIME ZONE 'UTC' AS DATE), 'total_s', total_s FROM runs),
periods AS (
    SELECT deployment, 'day' AS period, d, measure, v FROM found_values WHERE v >= 0 AND NOT isnan(v)
    UNION ALL SELECT deployment, 'week', CAST(date_trunc('week', d) AS DATE), measure, v FROM found_values WHERE v >= 0 AND NOT isnan(v)),
stats AS (
    SELECT deployment, period, strftime(d, '%Y-%m-%d') AS start_day, measure, count(*) AS n,
           quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95
    FROM periods GROUP BY deployment, period, d, measure HAVING count(*) >= 20),
long AS (
    SELECT deployment, period, start_day, measure, CAST(50 AS INTEGER) AS pct, n, p50 AS percentile FROM stats
    UNION ALL SELECT deployment, period, start_day, measure, CAST(95 AS INTEGER), n, p95 FROM stats)
"""

SQL: dict[str, str] = {
    "p1_found": r"""
WITH pages AS (
    SELECT DISTINCT source, page_number, section_boundaries,
           coalesce(array_to_string(list_filter(blocks, lambda b: b IS NOT NULL), chr(10)), '') AS t
    FROM extracted_pages),
starts AS (
    SELECT source, page_number, t, b FROM (
        SELECT source, page_number, t, unnest(list_distinct(list_concat([0], list_filter(section_boundaries, lambda b: b > 0 AND b < length(t))))) AS b
        FROM pages WHERE length(t) > 0)),
sections AS (
    SELECT source, page_number, b, substring(t, b + 1, coalesce(lead(b) OVER (PARTITION BY source, page_number, t ORDER BY b), length(t)) - b) AS s
    FROM starts)
SELECT DISTINCT source, page_number, b AS section_start FROM sections
WHERE length(trim(s, chr(32) || chr(9) || chr(13) || chr(10))) > 1500
""",
    "p2_found": """
WITH RECURSIVE c AS (
    SELECT query_id, chunk_id, max(faiss_score) AS score, any_value(CAST(embedding AS DOUBLE[])) AS v FROM scored_chunks
    WHERE query_id IN (SELECT query_id FROM subset_requests WHERE subset_size > 0) AND isfinite(faiss_score) AND len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY query_id, chunk_id),
links AS (SELECT a.query_id, a.chunk_id AS x, b.chunk_id AS y FROM c AS a JOIN c AS b ON a.query_id = b.query_id WHERE list_cosine_similarity(a.v, b.v) >= 0.5),
reach AS (
    SELECT query_id, x, y FROM links
    UNION SELECT r.query_id, r.x, l.y FROM reach AS r JOIN links AS l ON r.query_id = l.query_id AND r.y = l.x),
grouped AS (SELECT query_id, x AS chunk_id, min(y) AS g FROM reach GROUP BY query_id, x)
SELECT query_id, arg_min(chunk_id, (-score, chunk_id)) AS chunk_id FROM grouped JOIN c USING (query_id, chunk_id) GROUP BY query_id, g
""",
    "p3_found": """
WITH c AS (
    SELECT chunk_id, any_value(CAST(embedding AS DOUBLE[])) AS v FROM scored_chunks
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY chunk_id),
s AS (SELECT a.chunk_id AS x, b.chunk_id AS y, list_cosine_similarity(a.v, b.v) AS cosine FROM c AS a JOIN c AS b ON a.chunk_id <> b.chunk_id),
r AS (SELECT x, y, cosine, row_number() OVER (PARTITION BY x ORDER BY cosine DESC, y) AS place FROM s)
SELECT DISTINCT least(x, y) AS chunk_a, greatest(x, y) AS chunk_b FROM r WHERE place <= 10 AND cosine >= 0.92
""",
    "p4_found": f"""
WITH {_RUNS}
SELECT deployment, period, start_day, measure, pct FROM long
WHERE (measure = 'llm_generate_s' AND ((pct = 50 AND percentile > 9) OR (pct = 95 AND percentile > 25)))
   OR (measure = 'total_s' AND ((pct = 50 AND percentile > 20) OR (pct = 95 AND percentile > 40)))
""",
    "p4_percentiles": f"""
WITH {_RUNS}
SELECT deployment, period, start_day, measure, pct, n, round(percentile, 6) AS percentile FROM long
""",
    "p5_found": r"""
WITH b AS (
    SELECT DISTINCT source, page_number, block, pos - 1 AS block_no FROM (
        SELECT source, page_number, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS pos FROM extracted_pages)
    WHERE block IS NOT NULL),
l AS (
    SELECT source, page_number, block_no, unnest(string_split(block, chr(10))) AS line,
           generate_subscripts(string_split(block, chr(10)), 1) - 1 AS line_no FROM b),
k AS (SELECT source, page_number, block_no, line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS letters FROM l),
f AS (
    SELECT source, letters FROM k WHERE length(letters) >= 4
    GROUP BY source, letters HAVING count(DISTINCT page_number) >= 6)
SELECT DISTINCT k.source, k.page_number, CAST(k.block_no AS INTEGER) AS block_no, CAST(k.line_no AS INTEGER) AS line_no
FROM k JOIN f ON k.source = f.source AND k.letters = f.letters
""",
    "p6_round_trip": "SELECT true AS same, count(DISTINCT doc_id) AS documents FROM documents",
    "p7_found": r"""
WITH d AS (
    SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM eval_items WHERE text IS NOT NULL),
p AS (
    SELECT DISTINCT item_id, ' ' || array_to_string(list_slice(ws, i, i + 11), ' ') || ' ' AS passage
    FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 12)),
words AS (
    SELECT doc_id, string_split(trim(t), ' ') AS ws FROM d),
runs AS (
    SELECT doc_id, ' ' || array_to_string(list_slice(ws, i, i + 11), ' ') || ' ' AS passage
    FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 11)) AS i FROM words WHERE len(ws) >= 12))
SELECT DISTINCT doc_id, item_id FROM runs JOIN p USING (passage)
""",
    "p7_near": r"""
WITH d AS (
    SELECT DISTINCT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM eval_items WHERE text IS NOT NULL),
p AS (
    SELECT item_id, ws, i, ' ' || array_to_string(list_slice(ws, i, i + 11), ' ') || ' ' AS passage,
           ' ' || array_to_string(list_slice(ws, i, i + 5), ' ') || ' ' AS head
    FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 12)),
pieces AS (
    SELECT item_id, i, passage, head AS piece, 0 AS before, array_to_string(list_slice(ws, i + 1, i + 5), ' ') AS five FROM p
    UNION ALL SELECT item_id, i, passage, substring(passage, length(head) + 1, length(passage)), length(head), array_to_string(list_slice(ws, i + 7, i + 11), ' ') FROM p),
fives AS (
    SELECT DISTINCT doc_id, t, array_to_string(list_slice(string_split(trim(t), ' '), k, k + 4), ' ') AS five
    FROM (SELECT doc_id, t, unnest(generate_series(1, len(string_split(trim(t), ' ')) - 4)) AS k FROM d)),
hits AS (SELECT DISTINCT doc_id, t, item_id, i, passage, piece, before FROM fives JOIN pieces USING (five) WHERE contains(t, piece)),
places AS (
    SELECT doc_id, t, item_id, i, passage, spot - before AS start
    FROM (SELECT *, unnest(generate_series(1, length(t) - length(piece) + 1)) AS spot FROM hits) WHERE substring(t, spot, length(piece)) = piece),
tried AS (
    SELECT doc_id, item_id, i, levenshtein(passage, substring(t, greatest(1, start + a), length(passage) + b)) AS distance
    FROM places, (VALUES (-1), (0), (1)) AS x(a), (VALUES (-1), (0), (1)) AS y(b))
SELECT doc_id, item_id, CAST(min(distance) AS INTEGER) AS distance, CAST(count(DISTINCT i) AS INTEGER) AS passages FROM tried WHERE distance <= 1 GROUP BY doc_id, item_id
""",
}
