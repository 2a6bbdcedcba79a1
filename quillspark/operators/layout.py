"""Page layout: repeated edge lines, headings by size, tables between text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.chunking import running_total
from quillspark.sources.tables import once

EDGE = 3
HEADING_EXTRA = 2.0


def page_text(pages: DataFrame) -> DataFrame:
    """(source, page_number, text): non-null blocks joined by a newline; repeated pages count once."""
    text = F.concat_ws("\n", F.coalesce("blocks", F.array().cast("array<string>")))
    return once(pages.select("source", "page_number", "blocks"), ["source", "page_number"]).select("source", "page_number", text.alias("text"))


def edge_lines(texts: DataFrame) -> DataFrame:
    """(source, page_number, edge, pos, line): the first and the last three non-empty trimmed lines of each page.

    Positions at the bottom count from the top of the last three. A short page gives its lines to both edges.
    """
    lines = F.filter(F.transform(T.text_lines(F.col("text")), T.trim_all), lambda x: x != "")
    bottom = F.slice("lines", F.greatest(F.lit(1), F.size("lines") - (EDGE - 1)), F.lit(EDGE))
    edges = F.array(
        F.struct(F.lit("top").alias("edge"), F.slice("lines", 1, EDGE).alias("lines")),
        F.struct(F.lit("bottom").alias("edge"), bottom.alias("lines")),
    )
    return (
        texts.select("source", "page_number", lines.alias("lines"))
        .select("source", "page_number", F.explode(edges).alias("e"))
        .select("source", "page_number", "e.edge", F.posexplode("e.lines").alias("pos", "line"))
    )


def header_footer_lines(texts: DataFrame) -> DataFrame:
    """(source, line): lines that stand at one edge position of three pages in a row of their source.

    Pages in a row are neighbours in the order of the pages a source has. Pages are numbered by a running count
    over one range sort, and three in a row are found by an aggregate on (source, edge, pos, line, first page),
    so no task holds all pages of a source.
    """
    ranks = running_total(texts.select("source", "page_number", F.lit(1).alias("one")), ["source"], ["page_number"], "one", "page_rank").drop("one")
    lines = edge_lines(texts).join(ranks, ["source", "page_number"]).select("source", "edge", "pos", "line", "page_rank")
    key = ["source", "edge", "pos", "line"]
    runs = lines.select(*key, F.explode(F.array(*(F.col("page_rank") - F.lit(i) for i in range(3)))).alias("start"))
    return runs.groupBy(*key, "start").agg(F.count(F.lit(1)).alias("n")).filter("n = 3").select("source", "line").distinct()


def strip_lines(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """(source, page_number, text): page texts without the lines whose trimmed text is repeated in their source.

    Once found, a line goes everywhere in its document. Pages of sources without such lines come out as they are.
    """
    gone = repeated.groupBy(F.col("source").alias("own")).agg(F.collect_set("line").alias("gone"))
    joined = texts.join(gone, F.col("source").eqNullSafe(F.col("own")), "left")
    kept = F.filter(T.text_lines(F.col("text")), lambda line: ~F.array_contains(F.col("gone"), T.trim_all(line)))
    return joined.select("source", "page_number", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def body_size(glyphs: Column) -> Column:
    """Median size of the glyphs with a positive size and some text; 0 if there is none."""
    sizes = F.array_sort(F.transform(F.filter(glyphs, lambda g: (g.size > 0) & ~T.is_blank(g.text)), lambda g: g.size))
    n = F.size(sizes)
    middle = (F.element_at(sizes, F.floor((n + 1) / 2).cast("int")) + F.element_at(sizes, F.floor(n / 2).cast("int") + 1)) / 2
    return F.when(n > 0, middle).otherwise(0.0)


def section_starts(glyphs: Column, body: Column) -> Column:
    """Offsets at which a run of heading glyphs begins, in the text of all glyphs put together.

    A glyph is of a heading if it is larger than the body by more than ``HEADING_EXTRA``; without a body size
    there are no headings. Blank glyphs and glyphs without a size do not end a run.
    """
    empty = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, g: Column) -> Column:
        counts = ~T.is_blank(g.text) & (g.size > 0)
        heading = counts & (body > 0) & (g.size > body + HEADING_EXTRA)
        begins = F.coalesce(heading & ~acc.inside, F.lit(False))
        return F.struct(
            (acc.at + F.coalesce(F.length(g.text), F.lit(0))).alias("at"),
            F.when(F.coalesce(counts, F.lit(False)), heading).otherwise(acc.inside).alias("inside"),
            F.when(begins, F.array_append(acc.starts, acc.at)).otherwise(acc.starts).alias("starts"),
        )

    return F.aggregate(F.coalesce(glyphs, F.array().cast("array<struct<text:string,size:double>>")), empty, step, lambda acc: acc.starts)


def regions(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, region_no, kind, top, lines, body): runs of table lines and of text lines of each text, from the top.

    A table line starts with a bar. ``top`` is the number of the first line. All within the row, no shuffle: every
    line is compared with the one before, and the lines between two changes are a region.
    """
    parts = documents.filter(F.length("text") > 0).select(key, T.text_lines(F.col("text")).alias("_lines"))
    parts = parts.withColumn("_table", F.transform("_lines", lambda x: F.startswith(T.trim_left(x), F.lit("|"))))
    changes = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | (F.col("_table")[i] != F.col("_table")[F.greatest(i - 1, F.lit(0))]))
    cut = parts.withColumn("_tops", changes)
    end = lambda j: F.coalesce(F.get(F.col("_tops"), j + 1), F.size("_lines"))
    made = F.transform("_tops", lambda i, j: F.struct(i.alias("top"), F.col("_table")[i].alias("is_table"), F.slice("_lines", i + 1, end(j) - i).alias("lines")))
    return cut.select(key, F.posexplode(made).alias("region_no", "r")).select(
        key, "region_no", F.when(F.col("r.is_table"), "table").otherwise("text").alias("kind"), "r.top", F.size("r.lines").alias("lines"), F.array_join("r.lines", "\n").alias("body")
    )
