"""Page files and index tables on shared storage."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import Settings
from quillspark.functions import models
from quillspark.functions import text as T
from quillspark.operators import chunking, index
from quillspark.session import written
from quillspark.sources.tables import spread

PAGE_SCHEMA = "source string, page_number int, blocks array<string>, section_boundaries array<int>, body_font_size double, error string"
#: Tables of an index; every batch of an ingest adds a part to each and is valid once it is named in ``COMMITS``.
TABLES, COMMITS = ("parents", "chunks", "postings", "doc_stats", "term_counts", "embeddings"), "commits"


class IndexMissing(Exception):
    """The index folder lacks a table; the ingest has to run first."""


def plain_text_pages(content: bytes) -> list[dict]:
    """Pages of a text file: form feeds part pages, blank lines part blocks."""
    return [{"blocks": [b for b in page.split("\n\n") if b.strip()]} for page in content.decode("utf-8").split("\f")]


def read_pages(spark: SparkSession, folder: str, parse: Callable[[bytes], list[dict]] = plain_text_pages, pattern: str = "*.txt") -> DataFrame:
    """Pages of every file under ``folder``: files are parsed in parallel, and one that fails gives one row with its error.

    ``parse`` turns the bytes of a file into pages; readers of other formats are passed in. Files come in the order
    of their paths. A missing folder raises; an empty one gives no rows and a warning.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    if files.select("path").isEmpty():
        warnings.warn(f"no {pattern} files in {folder}", stacklevel=2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content):
                try:
                    for n, page in enumerate(parse(content)):
                        rows.append((path, n, page.get("blocks"), page.get("section_boundaries") or [], float(page.get("body_font_size") or 0), None))
                except Exception as error:  # one broken file must not stop the others
                    rows.append((path, None, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["source", "page_number", "blocks", "section_boundaries", "body_font_size", "error"])

    return files.select("path", "content").repartitionByRange("path").sortWithinPartitions("path").mapInPandas(run, PAGE_SCHEMA)


def parent_table(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(parent_id, source, page_number, heading, text, boundaries) of all pages.

    The id is made of the source, the page and the text alone, so it stays when sections before it come or go and
    is the same in a stream; a text that stands twice on one page is one parent.
    """
    made = chunking.parents(pages, settings)
    return made.select(F.sha2(F.concat_ws("|", "source", "page_number", "text"), 256).alias("parent_id"), "source", "page_number", "heading", "text", "boundaries")


def chunk_table(parents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(chunk_id, parent_id, source, page_number, heading, text): the child windows of parents."""
    kids = chunking.child_windows(parents, ["parent_id", "source", "page_number", "heading"], settings=settings, boundaries="boundaries")
    return kids.select(F.concat_ws(":", "parent_id", "child_no").alias("chunk_id"), "parent_id", "source", "page_number", "heading", F.col("child").alias("text"))


def save_index(parents: DataFrame, folder: str, mode: str = "overwrite", embed: models.Embedder | None = None, settings: Settings = Settings()) -> None:
    """Write the parents of ``parent_table``, their chunks, the lexical and the dense index as one batch.

    Chunks are made once and the indexes from what was written. The batch is named in the table of commits last, in
    one file: until then readers do not see any of it, and what a broken ingest leaves behind is never read.
    """
    spark, batch = parents.sparkSession, f"b{uuid.uuid4().hex}"

    def put(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder}/{name}/batch={batch}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    chunks = put("chunks", chunk_table(put("parents", parents), settings))
    posted = put("postings", index.postings(spread(chunks)))
    put("doc_stats", chunks.select("chunk_id", F.size(T.tokens(F.col("text"))).alias("dl")))
    put("term_counts", posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    vector = (embed or models.hashing_embedder())(F.concat(F.lit(settings.passage_prefix), F.col("text")))
    put("embeddings", spread(chunks).select(F.xxhash64("chunk_id").alias("vec_id"), "chunk_id", vector.alias("embedding")))
    spark.createDataFrame([(batch,)], "name string").coalesce(1).write.mode(mode).parquet(f"{folder}/{COMMITS}")


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The index tables by name, with the committed batches; raises ``IndexMissing`` if one is not there.

    ``term_counts`` has one row per term and batch; ``term_stats`` adds them up.
    """
    try:
        batches = [r.name for r in spark.read.parquet(f"{folder}/{COMMITS}").collect()]
        return {t: spark.read.parquet(f"{folder}/{t}").filter(F.col("batch").isin(batches)).drop("batch") for t in TABLES}
    except AnalysisException as error:
        raise IndexMissing("Index not found. Run the ingest step first.") from error


def term_stats(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(size, statistics of the terms) of a loaded index, as ``retrieval.bm25`` takes them."""
    size = tables["doc_stats"].agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return size, index.weighed(written(tables["term_counts"].groupBy("term").agg(F.sum("df").alias("df"))), size)


def add_to_index(parents: DataFrame, folder: str, embed: models.Embedder | None = None, settings: Settings = Settings()) -> int:
    """Append the parents the index does not have, with their chunks, and return how many parents; without an index it is built.

    Adding twice adds once, also after an ingest that broke off. One ingest at a time may add to an index.
    """
    spark = parents.sparkSession
    try:
        known, mode = load_index(spark, folder)["parents"], "append"
        fresh = written(index.new_chunks(parents, known, ["parent_id"]))
    except IndexMissing:
        mode, fresh = "overwrite", written(parents.dropDuplicates(["parent_id"]))
    added = fresh.count()
    if added or mode == "overwrite":
        save_index(fresh, folder, mode, embed, settings)
    return added
