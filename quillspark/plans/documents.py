"""Queries over pages and documents: chunking, layout, text functions, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.times import event_time
from quillspark.operators import chunking, index, layout, platform
from quillspark.plans import sql
from quillspark.sources.tables import once, spread, table


def pages_of(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The extracted pages, dealt out over all cores where they come in few splits."""
    return spread(table(spark, folder, "extracted_pages", *columns))


def chunk_table(spark: SparkSession, folder: str) -> DataFrame:
    """Child windows of the documents under one chunk_id."""
    made = chunking.child_windows(spread(table(spark, folder, "documents", "doc_id", "text")), ["doc_id"])
    return made.withColumn("chunk_id", F.concat_ws(":", "doc_id", "child_no"))


def child_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.child_windows(table(spark, folder, "documents", "doc_id", "text"), ["doc_id"])


def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    return child_chunks(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("child")).alias("chars"))


def parent_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.parents(pages_of(spark, folder, "source", "page_number", "blocks", "section_boundaries"))


def parent_children(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["source", "section_no", "parent_no"]
    return chunking.child_windows(parent_chunks(spark, folder), [*keys, "heading"], boundaries="boundaries")


def block_segments(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.segments(pages_of(spark, folder, "source", "page_number", "blocks", "section_boundaries"))


def recursive_split(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.recursive_chunks(spread(table(spark, folder, "documents", "doc_id", "text")), "doc_id")


def paragraph_splits(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text")
    return documents.select("doc_id", F.explode(T.paragraph_starts(F.col("text"))).alias("start"))


def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text")
    return documents.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("doc_id").alias("documents")
    )


def document_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Heading, basename of the source, preview, prefixed passage length and blank test of every document."""
    documents = table(spark, folder, "documents", "doc_id", "text", "source", "lang")
    return documents.select(
        "doc_id",
        T.first_line(F.col("text")).alias("heading"),
        T.basename(F.col("source")).alias("name"),
        T.preview(F.col("text")).alias("preview"),
        F.length(F.concat(F.lit("passage: "), F.col("text"))).alias("passage_chars"),
        T.is_blank(F.col("text")).alias("blank"),
        F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("und")).alias("language"),
    )


def chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = index.distinct_texts(table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", "copies", F.length("text").alias("chars"))


#: Documents up to this time are in the index when the later ones are added.
INDEXED_UNTIL = "2026-05-24T00:00:00Z"


def incremental_new(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the documents after ``INDEXED_UNTIL`` that the earlier ones do not have."""
    documents = table(spark, folder, "documents", "doc_id", "text", "created_at")
    is_old = event_time(documents, "created_at") <= F.lit(INDEXED_UNTIL).cast("timestamp")
    old, fresh = (chunking.child_windows(documents.filter(c), ["doc_id"]) for c in (is_old, ~is_old))
    hashed = lambda df: df.select("doc_id", "child_no", F.sha2("child", 256).alias("key"))
    first = hashed(fresh).groupBy("key").agg(F.min(F.struct("doc_id", "child_no")).alias("at"))
    return index.new_chunks(first, hashed(old).select("key"), ["key"]).select("key", "at.doc_id", "at.child_no")


def header_footer_lines(spark: SparkSession, folder: str) -> DataFrame:
    return layout.header_footer_lines(layout.page_text(pages_of(spark, folder, "source", "page_number", "blocks")))


def strip_lines(spark: SparkSession, folder: str) -> DataFrame:
    texts = layout.page_text(pages_of(spark, folder, "source", "page_number", "blocks"))
    return layout.strip_lines(texts, layout.header_footer_lines(texts))


def edge_lines(spark: SparkSession, folder: str) -> DataFrame:
    return layout.edge_lines(layout.page_text(pages_of(spark, folder, "source", "page_number", "blocks")))


def section_headings(spark: SparkSession, folder: str) -> DataFrame:
    """The heading at every given section boundary of a page: the first line of the text from there on, and the page's given body size."""
    pages = once(pages_of(spark, folder), ["source", "page_number"])
    text = F.concat_ws("\n", F.coalesce("blocks", F.array().cast("array<string>")))
    starts = F.array_distinct(F.filter(F.coalesce("section_boundaries", F.array().cast("array<int>")), lambda b: (b >= 0) & (b < F.length("text"))))
    found = pages.select("source", "page_number", "body_font_size", "section_boundaries", text.alias("text")).withColumn("start", F.explode(starts))
    return found.select("source", "page_number", F.col("body_font_size").alias("body"), "start", T.first_line(F.substring(F.col("text"), F.col("start") + 1, F.length("text"))).alias("heading"))


def source_font_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Median body size of each source over its pages with a size."""
    pages = table(spark, folder, "extracted_pages", "source", "page_number", "body_font_size").dropDuplicates(["source", "page_number"])
    good = pages.filter(F.col("body_font_size") > 0)
    return good.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.percentile("body_font_size", F.lit(0.5)).alias("body_size"))


def text_table_regions(spark: SparkSession, folder: str) -> DataFrame:
    return layout.regions(spread(table(spark, folder, "documents", "doc_id", "text")))


def markdown_table(spark: SparkSession, folder: str) -> DataFrame:
    """Token usage of each question as a Markdown table."""
    usage = table(spark, folder, "token_usage").distinct()
    row = lambda name, c: F.array(F.lit(name), F.col(c).cast("string"))
    rows = F.array(F.array(F.lit("kind"), F.lit("tokens")), *(row(c.split("_")[0], c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")))
    return usage.select("query_id", T.markdown_table(rows).alias("markdown"))


def pii_redact(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text").withColumn("redacted", T.redact(F.col("text")))
    return documents.filter(F.col("redacted") != F.col("text")).select("doc_id", "redacted")


def missing_tags(spark: SparkSession, folder: str) -> DataFrame:
    required = ("lang", "source", "text")
    return platform.missing_tags(table(spark, folder, "documents"), "doc_id", required).select("doc_id", F.array_join("missing", ",").alias("missing"))


QUERIES = {
    f.__name__: f
    for f in (
        child_chunks, chunk_counts, parent_chunks, parent_children, block_segments, recursive_split, paragraph_splits, term_counts,
        document_profile, chunk_dedup, incremental_new, header_footer_lines, strip_lines, edge_lines, section_headings,
        source_font_sizes, text_table_regions, markdown_table, pii_redact, missing_tags,
    )
}

_EDGES = f"""
{sql.PAGE_TEXT},
trimmed AS (
    SELECT source, page_number, list_filter(list_transform({sql.text_lines("text")}, lambda x: {sql.trim_all("x")}), lambda x: x <> '') AS ls FROM page_text),
sides AS (
    SELECT source, page_number, 'top' AS edge, list_slice(ls, 1, 3) AS e FROM trimmed
    UNION ALL SELECT source, page_number, 'bottom', list_slice(ls, greatest(1, len(ls) - 2), len(ls)) FROM trimmed),
edges AS (
    SELECT source, page_number, edge, unnest(e) AS line, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS pos FROM sides)
"""

_REPEATED = f"""
{_EDGES},
ranked AS (SELECT source, page_number, row_number() OVER (PARTITION BY source ORDER BY page_number) AS r FROM page_text),
placed AS (SELECT e.*, r.r FROM edges e JOIN ranked r USING (source, page_number)),
repeated AS (
    SELECT DISTINCT a.source, a.line FROM placed a
    JOIN placed b ON a.source = b.source AND a.edge = b.edge AND a.pos = b.pos AND a.line = b.line AND b.r = a.r + 1
    JOIN placed c ON a.source = c.source AND a.edge = c.edge AND a.pos = c.pos AND a.line = c.line AND c.r = a.r + 2)
"""

_CHILDREN = f"""
WITH parts AS (
    SELECT doc_id, text, CASE WHEN created_at <= TIMESTAMPTZ '{INDEXED_UNTIL}' THEN 1 ELSE 0 END AS old FROM documents WHERE length(text) > 0 AND created_at IS NOT NULL),
kids AS (
    SELECT doc_id, old, text, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 400) / 320.0) AS INTEGER)))) AS child_no FROM parts),
keyed AS (SELECT doc_id, old, child_no, sha256(substring(text, child_no * 320 + 1, 400)) AS key FROM kids)
SELECT key, arg_min(doc_id, (doc_id, child_no)) AS doc_id, CAST(arg_min(child_no, (doc_id, child_no)) AS INTEGER) AS child_no
FROM keyed WHERE old = 0 AND key NOT IN (SELECT key FROM keyed WHERE old = 1) GROUP BY key
"""

SQL = {
    "child_chunks": f"WITH {sql.CHUNKS} SELECT doc_id, CAST(child_no AS INTEGER) AS child_no, CAST(start AS INTEGER) AS start, child FROM chunks",
    "chunk_counts": f"WITH {sql.CHUNKS} SELECT doc_id, count(*) AS chunks, CAST(sum(length(child)) AS BIGINT) AS chars FROM chunks GROUP BY doc_id",
    "paragraph_splits": """
WITH places AS (SELECT doc_id, text, unnest(generate_series(1, length(text))) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(i + 1 AS INTEGER) AS start FROM places WHERE substring(text, i, 2) = chr(10) || chr(10) AND i + 1 < length(text)
""",
    "term_counts": f"""
WITH t AS (SELECT doc_id, unnest({sql.tokens("text")}) AS term FROM documents)
SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM t GROUP BY term
""",
    "document_profile": f"""
SELECT doc_id, {sql.trim_all(f"string_split_regex({sql.trim_all('text')}, '{sql.LINE_END}')[1]")} AS heading,
       string_split(source, '/')[-1] AS name,
       CASE WHEN length(text) > 280 THEN substring(text, 1, 280) || '…' ELSE text END AS preview,
       CAST(length('passage: ' || text) AS INTEGER) AS passage_chars,
       coalesce({sql.trim_all("text")} = '', true) AS blank,
       coalesce(lower(substring(lang, 1, 2)), 'und') AS language
FROM documents
""",
    "chunk_dedup": """
SELECT min(doc_id) AS doc_id, count(DISTINCT doc_id) AS copies, CAST(length(text) AS INTEGER) AS chars FROM documents GROUP BY text
""",
    "incremental_new": _CHILDREN,
    "section_headings": f"""
WITH p AS (
    SELECT DISTINCT source, page_number, body_font_size AS body, section_boundaries,
           coalesce(array_to_string(list_filter(blocks, lambda b: b IS NOT NULL), chr(10)), '') AS text FROM extracted_pages),
s AS (SELECT source, page_number, body, text, unnest(list_distinct(list_filter(section_boundaries, lambda b: b >= 0 AND b < length(text)))) AS start FROM p)
SELECT source, page_number, body, start, {sql.trim_all(f"string_split_regex({sql.trim_all('substring(text, start + 1)')}, '{sql.LINE_END}')[1]")} AS heading FROM s
""",
    "block_segments": f"""
WITH p AS (SELECT DISTINCT source, page_number, section_boundaries, list_filter(blocks, lambda b: b IS NOT NULL) AS bs FROM extracted_pages WHERE blocks IS NOT NULL),
b AS (
    SELECT source, page_number, section_boundaries, unnest(bs) AS block, generate_subscripts(bs, 1) - 1 AS block_no,
           unnest(list_transform(bs, lambda x, i: list_sum(list_transform(bs[1:i - 1], lambda y: length(y) + 1)))) AS o FROM p),
k AS (
    SELECT source, page_number, block_no, block, list_transform(list_filter(list_distinct(coalesce(section_boundaries, [])),
           lambda x: x >= coalesce(o, 0) AND x < coalesce(o, 0) + length(block)), lambda x: CAST(x - coalesce(o, 0) AS BIGINT)) AS own FROM b WHERE length(block) > 0),
c AS (
    SELECT *, unnest(list_sort(list_distinct(list_concat([0::BIGINT], own,
        list_filter(generate_series(2, length(block) - 1), lambda i: substring(block, i - 1, 2) = chr(10) || chr(10)))))) AS start FROM k),
s AS (
    SELECT source, page_number, block_no, own, start, row_number() OVER w - 1 AS seg_no,
           substring(block, start + 1, coalesce(lead(start) OVER w, length(block)) - start) AS segment
    FROM c WINDOW w AS (PARTITION BY source, page_number, block_no ORDER BY start))
SELECT source, page_number, CAST(block_no AS INTEGER) AS block_no, CAST(seg_no AS INTEGER) AS seg_no, CAST(start AS INTEGER) AS start,
       list_contains(own, start) AS is_boundary, segment FROM s WHERE {sql.trim_all("segment")} <> ''
""",
    "edge_lines": f"WITH {_EDGES} SELECT source, page_number, edge, pos, line FROM edges",
    "header_footer_lines": f"WITH {_REPEATED} SELECT source, line FROM repeated",
    "strip_lines": f"""
WITH {_REPEATED},
gone AS (SELECT source, list(line) AS gone FROM repeated GROUP BY source)
SELECT p.source, p.page_number, CASE WHEN gone IS NULL THEN text ELSE
       coalesce(array_to_string(list_filter({sql.text_lines("text")}, lambda x: NOT list_contains(gone, {sql.trim_all("x")})), chr(10)), '') END AS text
FROM page_text p LEFT JOIN gone g ON p.source = g.source
""",
    "source_font_sizes": """
SELECT source, count(*) AS pages, quantile_cont(body_font_size, 0.5) AS body_size
FROM (SELECT DISTINCT source, page_number, body_font_size FROM extracted_pages) WHERE body_font_size > 0 GROUP BY source
""",
    "text_table_regions": f"""
WITH l AS (
    SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS no
    FROM (SELECT doc_id, {sql.text_lines("text")} AS ls FROM documents WHERE length(text) > 0)),
k AS (SELECT doc_id, no, line, starts_with(regexp_replace(line, '^{sql.BLANK}+', ''), '|') AS is_table FROM l),
f AS (SELECT *, CASE WHEN is_table = lag(is_table) OVER (PARTITION BY doc_id ORDER BY no) THEN 0 ELSE 1 END AS fresh FROM k),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY no) - 1 AS region_no FROM f)
SELECT doc_id, CAST(region_no AS INTEGER) AS region_no, CASE WHEN is_table THEN 'table' ELSE 'text' END AS kind,
       CAST(min(no) AS INTEGER) AS top, CAST(count(*) AS INTEGER) AS lines, string_agg(line, chr(10) ORDER BY no) AS body
FROM g GROUP BY doc_id, region_no, is_table
""",
    "markdown_table": """
SELECT query_id, '| kind | tokens |' || chr(10) || '| --- | --- |' || chr(10) || '| prompt | ' || coalesce(CAST(prompt_tokens AS VARCHAR), '') || ' |' || chr(10)
       || '| completion | ' || coalesce(CAST(completion_tokens AS VARCHAR), '') || ' |' || chr(10)
       || '| total | ' || coalesce(CAST(total_tokens AS VARCHAR), '') || ' |' AS markdown
FROM (SELECT DISTINCT * FROM token_usage)
""",
    "pii_redact": """
WITH r AS (
    SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'),
        '\\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\\b', '[card]', 'g'),
        '\\+[0-9]{1,3}[ -][0-9][0-9 -]{6,12}[0-9]', '[phone]', 'g'),
        '\\b[0-9a-f]{32,64}\\b', '[token]', 'g') AS redacted FROM documents)
SELECT doc_id, redacted FROM r WHERE redacted <> text
""",
    "missing_tags": f"""
SELECT doc_id, missing FROM (
    SELECT doc_id, concat_ws(',', {", ".join(f"CASE WHEN coalesce({sql.trim_all(c)}, '') = '' THEN '{c}' END" for c in ("lang", "source", "text"))}) AS missing FROM documents)
WHERE missing <> ''
""",
}
