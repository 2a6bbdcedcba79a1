"""Splitting oversized sections at natural boundaries by content-defined chunking.

A rolling hash over the last ``WINDOW`` characters marks landmarks; each cut is the first landmark
between the minimum and the maximum piece size, moved to the nearest natural boundary in that range.
Because landmarks depend only on the text around them, an edit changes the pieces next to it and the
cuts behind it fall into step again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.tables import once

MAX_CHARS = 1500
MIN_CHARS = 500
OVERLAP = 80
#: Characters under the rolling hash, and the share (a power of two) of positions that are landmarks.
WINDOW = 32
LANDMARK_EVERY = 256
BLANKS = " \t\r\n"

_BASE = 0x9E3779B97F4A7C15
_SPAN = 1 << 14
_PIECES = "array<struct<piece_start:int,piece_end:int>>"


def _powers(base: int) -> np.ndarray:
    out = np.full(_SPAN, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` code points that end at each position (fewer at the start).

    Computed modulo 2**64 from prefix sums; a text longer than the power table goes in slices
    that share ``WINDOW`` characters, so values are the same as in one sweep.
    """
    out = np.empty(len(codes), np.uint32)
    step = _SPAN - WINDOW
    for at in range(0, len(codes), step):
        first = max(0, at - WINDOW)
        part = codes[first : at + step].astype(np.uint64) + np.uint64(1)
        n = len(part)
        sums = np.cumsum(part * _DOWN[:n], dtype=np.uint64)
        sums[WINDOW:] -= sums[:-WINDOW].copy()
        out[at : at + step] = ((sums * _UP[:n]) >> np.uint64(32)).astype(np.uint32)[at - first :]
    return out


_ENDS = np.array(sorted(map(ord, ".!?…。！？；;:")), np.uint32)
_CLOSERS = np.array(sorted(map(ord, "\"')]}”’»」』")), np.uint32)
_SPACES = np.array(sorted(map(ord, " \t\r\n\u00a0\u2003\u3000")), np.uint32)
_WIDE_ENDS = np.array(sorted(map(ord, "。！？；")), np.uint32)


def natural_boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets after a line or sentence, and offsets after a word, each sorted."""
    space = np.isin(codes, _SPACES)
    end = np.isin(codes, _ENDS)
    close = np.isin(codes, _CLOSERS)
    end[1:] |= close[1:] & end[:-1]
    line = codes == 10
    strong = line.copy()
    strong[:-1] |= end[:-1] & space[1:]
    strong |= np.isin(codes, _WIDE_ENDS)
    return np.flatnonzero(strong) + 1, np.flatnonzero(space) + 1


def _nearest(sorted_at: np.ndarray, low: int, high: int, wanted: int) -> int | None:
    a, b = np.searchsorted(sorted_at, (low, high + 1))
    if a == b:
        return None
    k = a + int(np.searchsorted(sorted_at[a:b], wanted))
    near = [int(sorted_at[j]) for j in (k - 1, k) if a <= j < b]
    return min(near, key=lambda x: (abs(x - wanted), x))


def cut_points(text: str, max_chars: int, min_chars: int, overlap: int) -> list[int]:
    """Offsets at which ``text`` is cut; every piece with its overlap has at most ``max_chars`` characters."""
    n = len(text)
    if n <= max_chars:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = rolling_hash(codes)
    marks = np.flatnonzero((hashes & np.uint32(LANDMARK_EVERY - 1)) == 0) + 1
    strong, weak = natural_boundaries(codes)
    cuts: list[int] = []
    at, room = 0, max_chars
    while n - at > room:
        low, high = at + min_chars, at + room
        k = int(np.searchsorted(marks, low))
        if k < len(marks) and marks[k] <= high:
            mark = int(marks[k])
        else:  # no landmark in range: the smallest hash stands in, which the content defines as well
            mark = low + int(np.argmin(hashes[low - 1 : high]))
        cut = _nearest(strong, low, high, mark) or _nearest(weak, low, high, mark) or mark
        cuts.append(cut)
        at, room = cut, max_chars - overlap
    return cuts


def spans(text: str, max_chars: int, min_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; a piece starts ``overlap`` characters before the end of the one before."""
    ends = [*cut_points(text, max_chars, min_chars, overlap), len(text)]
    return [(max(0, ends[k - 1] - overlap) if k else 0, e) for k, e in enumerate(ends)]


def _cutter(max_chars: int, min_chars: int, overlap: int):
    @F.pandas_udf(_PIECES)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [
                    None if t is None else [{"piece_start": a, "piece_end": b} for a, b in spans(t, max_chars, min_chars, overlap)]
                    for t in texts
                ],
                dtype=object,
            )

    return cut


def _trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def sections(pages: DataFrame) -> DataFrame:
    """Sections of each page row: (source, page_number, section_start, lead, body).

    The page text is the non-null blocks joined by one newline; a section runs from 0 or a boundary to
    the next boundary or the end. Null, unordered, repeated and out-of-range boundaries are allowed and
    count once or not at all. ``body`` is the section without blanks at both ends and ``lead`` the number
    of blanks removed in front. Null or empty blocks give no section.
    """
    text = F.concat_ws("\n", F.coalesce("blocks", F.array().cast("array<string>")))
    inner = F.array_sort(
        F.array_distinct(
            F.filter(F.coalesce("section_boundaries", F.array().cast("array<int>")), lambda b: (b > 0) & (b < F.length("page_text")))
        )
    )
    starts = F.concat(F.array(F.lit(0)), F.col("inner"))
    ends = F.concat(F.col("inner"), F.array(F.length("page_text")))
    section = F.substring(F.col("page_text"), F.col("s.starts") + 1, F.col("s.ends") - F.col("s.starts"))
    return (
        pages.select("source", "page_number", text.alias("page_text"), "section_boundaries")
        .filter(F.length("page_text") > 0)
        .withColumn("inner", inner)
        .withColumn("s", F.explode(F.arrays_zip(starts.alias("starts"), ends.alias("ends"))))
        .select("source", "page_number", F.col("s.starts").alias("section_start"), section.alias("section"))
        .select(
            "source",
            "page_number",
            "section_start",
            (F.length("section") - F.length(F.ltrim("section", F.lit(BLANKS)))).alias("lead"),
            _trimmed(F.col("section")).alias("body"),
        )
    )


def split_sections(pages: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Every section with its pieces: (source, page_number, section_start, lead, body, pieces).

    ``pieces`` is an array of (piece_start, piece_end) within ``body``: one for a section of at most
    ``max_chars`` characters, more for a longer one, none (empty array) for a blank one. Only oversized
    bodies travel to Python; the rest stay in the JVM. Repeated page rows give repeated sections.
    """
    if not 0 <= overlap < min_chars <= max_chars - overlap:
        raise ValueError("0 <= overlap < min_chars <= max_chars - overlap is required")
    long_body = F.when(F.length("body") > max_chars, F.col("body"))
    whole = F.array(F.struct(F.lit(0).alias("piece_start"), F.length("body").alias("piece_end")))
    none = F.array().cast(_PIECES)
    return (
        sections(pages)
        .withColumn("cut", _cutter(max_chars, min_chars, overlap)(long_body))
        .withColumn("pieces", F.coalesce("cut", F.when(F.length("body") > 0, whole).otherwise(none)))
        .drop("cut")
    )


def pieces(pages: DataFrame, **sizes: int) -> DataFrame:
    """One row per piece: (source, page_number, section_start, piece_no, piece_start, piece_text).

    ``piece_start`` is the offset in the page text. Repeated page rows count once; no text of other pages is shuffled.
    """
    keys = ["source", "page_number", "section_start"]
    return (
        split_sections(once(pages.select("source", "page_number", "blocks", "section_boundaries"), ["source", "page_number"]), **sizes)
        .select(*keys, "lead", "body", F.posexplode("pieces").alias("piece_no", "p"))
        .select(
            *keys,
            "piece_no",
            (F.col("section_start") + F.col("lead") + F.col("p.piece_start")).alias("piece_start"),
            F.substring(F.col("body"), F.col("p.piece_start") + 1, F.col("p.piece_end") - F.col("p.piece_start")).alias("piece_text"),
        )
    )


def oversized(pages: DataFrame, **sizes: int) -> DataFrame:
    """Sections that came out in more than one piece: (source, page_number, section_start), each once."""
    return split_sections(pages, **sizes).filter(F.size("pieces") > 1).select("source", "page_number", "section_start").distinct()
