"""Pages to parents to child windows, and the recursive splitter."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import Settings, SplitterSettings
from quillspark.functions import text as T
from quillspark.session import cut_lineage
from quillspark.sources.tables import once


def snapped_windows(c: Column, boundaries: Column, size: int, overlap: int) -> Column:
    """(start, text) of windows of ``size`` characters; the next starts at the first boundary inside the overlap, else where the overlap does.

    For texts of bounded length, such as parents: starts are found one after the other.
    """
    most = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / F.lit(float(size - overlap))).cast("int"))
    bounds = F.coalesce(boundaries, F.array().cast("array<int>"))

    def step(starts: Column, _: Column) -> Column:
        end = F.element_at(starts, -1) + size
        inside = F.filter(bounds, lambda b: (b >= F.greatest(end - overlap, F.element_at(starts, -1) + 1)) & (b < end))
        return F.when(end < F.length(c), F.array_append(starts, F.coalesce(F.array_min(inside), end - overlap))).otherwise(starts)

    starts = F.aggregate(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), step)
    made = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(c, s + 1, F.lit(size)).alias("text")))
    return F.when(F.length(c) > 0, made).otherwise(F.slice(made, 1, 0))


def child_windows(df: DataFrame, keys: list[str], text: str = "text", settings: Settings = Settings(), boundaries: str | None = None) -> DataFrame:
    """(keys, child_no, start, child): fixed windows over each text; null and empty texts give none. Narrow.

    With a column of ``boundaries`` a window starts at a boundary that lies inside its overlap with the one before.
    """
    size, overlap = settings.child_size, settings.child_overlap
    made = T.windows(F.col(text), size, overlap) if boundaries is None else snapped_windows(F.col(text), F.col(boundaries), size, overlap)
    return df.select(*keys, F.posexplode(made).alias("child_no", "w")).select(*keys, "child_no", "w.start", F.col("w.text").alias("child"))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over this and all earlier rows of the same keys.

    One sort by range spreads even a single key over many tasks; sums within a partition are joined with the
    offset of the partition, so no task sees more than one range.
    """
    ordered = cut_lineage(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_row", 33))
    own = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"), F.min("_row").alias("_first"))
    before = sums.select("_first", F.coalesce(F.sum("_sum").over(own), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_part", *keys)
    local = F.sum(value).over(here.orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    return (
        ordered.withColumn(name, local)
        .withColumn("_first", F.min("_row").over(here))
        .join(before, "_first")
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_row", "_part", "_first", "_before")
    )


def segments(pages: DataFrame) -> DataFrame:
    """(source, page_number, block_no, seg_no, start, is_boundary, segment): blocks cut at boundaries and paragraphs.

    A page boundary falls into the block whose part of the page text (non-null blocks joined by a newline) it
    lies in. A segment starts at 0, at a boundary, or after two newlines; a place that is both counts as a
    boundary. Blank segments are left out, null blocks are skipped, repeated pages count once.
    """
    blocks = F.filter("blocks", lambda b: b.isNotNull())
    sized = F.transform(blocks, lambda b: F.length(b) + 1)
    ends = F.transform(sized, lambda _, i: F.aggregate(F.slice(sized, F.lit(1), i), F.lit(0), lambda s, x: s + x))
    bounds = F.coalesce("section_boundaries", F.array().cast("array<int>"))
    own = F.transform(
        F.filter(F.array_distinct(bounds), lambda b: (b >= F.col("offset")) & (b < F.col("offset") + F.length("block"))), lambda b: b - F.col("offset")
    )
    points = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.col("own"), T.paragraph_starts(F.col("block")))))
    following = F.concat(F.slice("points", F.lit(2), F.size("points")), F.array(F.length("block")))
    return (
        once(pages.select("source", "page_number", "blocks", "section_boundaries"), ["source", "page_number"])
        .select("source", "page_number", bounds.alias("section_boundaries"), F.posexplode(F.arrays_zip(blocks.alias("block"), ends.alias("offset"))).alias("block_no", "b"))
        .select("source", "page_number", "section_boundaries", "block_no", "b.block", "b.offset")
        .filter(F.length("block") > 0)
        .withColumn("own", own)
        .withColumn("points", points)
        .select("source", "page_number", "block_no", "block", "own", F.posexplode(F.arrays_zip(F.col("points").alias("start"), following.alias("end"))).alias("seg_no", "p"))
        .select(
            "source", "page_number", "block_no", "seg_no", "p.start", F.array_contains("own", F.col("p.start")).alias("is_boundary"),
            F.substring(F.col("block"), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("segment"),
        )
        .filter(~T.is_blank(F.col("segment")))
    )


class ParentFold:
    """Parents of one run of segments, given one by one: (mark of the first segment, heading, text, boundaries).

    A boundary closes a parent with text, so does a segment that would overfill it; longer segments are cut into
    full parents. A parent that does not begin at a boundary has no heading. Holds no more than one parent.
    """

    def __init__(self, size: int) -> None:
        self.size, self.buffer, self.first, self.heading, self.marks = size, "", None, None, []
        self.done: list[tuple[object, str | None, str, list[int]]] = []

    def close(self) -> None:
        body = self.buffer.strip()
        if body:
            lead = len(self.buffer) - len(self.buffer.lstrip())
            self.done.append((self.first, self.heading, body, sorted({max(0, m - lead) for m in self.marks if m - lead < len(body)})))
        self.buffer, self.heading, self.marks = "", None, []

    def add(self, segment: str, boundary: bool, mark: object) -> None:
        if boundary and self.buffer.strip():
            self.close()
        if not self.buffer:
            self.first = mark
            if boundary and segment.strip():
                self.heading = segment.strip().splitlines()[0].strip()
        if self.buffer.strip() and len(self.buffer) + len(segment) > self.size:
            self.close()
            self.first = mark
        if boundary:
            self.marks.append(len(self.buffer))
        rest = segment
        while rest:
            room = self.size - len(self.buffer)
            self.buffer, rest = self.buffer + rest[:room], rest[room:]
            if rest:
                self.close()
                self.first = mark

    def take(self) -> list[tuple[object, str | None, str, list[int]]]:
        """The parents closed since the last call."""
        out, self.done = self.done, []
        return out


def fold_parents(segment_rows: list[tuple[str, bool]], size: int) -> list[tuple[object, str | None, str, list[int]]]:
    """Parents of (segment, is_boundary) rows; the mark is the number of the first segment."""
    fold = ParentFold(size)
    for i, (segment, boundary) in enumerate(segment_rows):
        fold.add(segment, boundary, i)
    fold.close()
    return fold.take()


def parents(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(source, section_no, parent_no, page_number, heading, text, boundaries): parents of each document's sections.

    A boundary segment always closes the parent before it, so the run of segments from one boundary to the next
    is folded by itself: sections are numbered by a running count over pages, which have no texts, and within each
    page, so that texts move twice only and a hot document is spread over its sections. Within a task the sorted segments are folded as they stream by, so a
    section of any length needs the memory of one parent. Documents do not share parents.
    """
    rows = segments(pages)
    order = ["page_number", "block_no", "seg_no"]
    marks = rows.groupBy("source", "page_number").agg(F.count_if("is_boundary").alias("here"))
    before = running_total(marks, ["source"], ["page_number"], "here", "upto").withColumn("before", F.col("upto") - F.col("here"))
    before = before.select(F.col("source").alias("of"), F.col("page_number").alias("no"), "before")
    own = Window.partitionBy("source", "page_number").orderBy("block_no", "seg_no")
    numbered = (
        rows.join(before, F.col("source").eqNullSafe(F.col("of")) & F.col("page_number").eqNullSafe(F.col("no")))
        .withColumn("section_no", F.col("before") + F.count_if("is_boundary").over(own))
    )
    size = settings.parent_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, key, number = ParentFold(size), None, 0
        for batch in chain(batches, (None,)):
            out: list[tuple] = []

            def emit() -> None:
                nonlocal number
                for page, heading, text, marks in fold.take():
                    out.append((*key, number, page, heading, text, marks))
                    number += 1

            if batch is None:
                if key is not None:
                    fold.close()
                    emit()
            else:
                for source, section, page, segment, boundary in zip(*(c.to_pylist() for c in batch.columns)):
                    if key != (source, section):
                        if key is not None:
                            fold.close()
                            emit()
                        key, number = (source, section), 0
                    fold.add(segment, boundary, page)
                    emit()
            if out:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=PARENT_COLUMNS)

    together = numbered.repartition("source", "section_no").sortWithinPartitions("source", "section_no", *order)
    schema = "source string, section_no long, parent_no int, page_number int, heading string, text string, boundaries array<int>"
    return together.select("source", "section_no", "page_number", "segment", "is_boundary").mapInArrow(run, schema)


PARENT_COLUMNS = ["source", "section_no", "parent_no", "page_number", "heading", "text", "boundaries"]

SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does, with up to ``overlap`` carried over."""
    separator, finer = "", ()
    for k, s in enumerate(separators):
        if not s or s in text:
            separator, finer = s, separators[k + 1 :]
            break
    parts = [p for p in text.split(separator)] if separator else list(text)
    if separator:
        parts = [parts[0], *(separator + p for p in parts[1:])]
    out: list[str] = []
    run: list[str] = []
    length = 0

    def emit() -> None:
        piece = "".join(run).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if not part:
            continue
        if len(part) > size and finer:
            emit()
            run, length = [], 0
            out.extend(split_recursively(part, size, overlap, finer))
            continue
        if length + len(part) > size and run:
            emit()
            while run and (length > overlap or length + len(part) > size):
                length -= len(run.pop(0))
        run.append(part)
        length += len(part)
    emit()
    return out


def recursive_chunks(df: DataFrame, key: str, text: str = "text", settings: SplitterSettings = SplitterSettings()) -> DataFrame:
    """(key, chunk_no, chunk) of every text; a narrow map in Arrow batches. Null and blank texts give none."""
    size, overlap = settings.chunk_size, settings.overlap

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, c) for k, t in zip(pdf[key], pdf[text]) if isinstance(t, str) for i, c in enumerate(split_recursively(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_no int, chunk string")
