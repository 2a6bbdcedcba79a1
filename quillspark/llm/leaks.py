"""Evaluation passages inside corpus documents, by pigeonhole edit matching.

A passage is ``RUN`` consecutive words of an item. It is split into ``max_edits + 1`` pieces that have no character
in common, so a document within ``max_edits`` character edits of the passage must contain one of them unchanged.
Pieces are found by one automaton over the normalised document, and each hit is verified with Myers'
bit-parallel distance on the text around it.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import written

RUN = 12
MAX_EDITS = 1
#: Characters of item text that go to the executors at once, about 300 MB in a Python worker; a larger item table is
#: matched in several passes.
PASS_CHARS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
#: Anything but letters and digits: separators, and the numerals and marks that belong to neither.
_GAP = re.compile(r"[\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


def normal(text: str) -> str:
    """The words of ``text`` with one blank before, between and after."""
    return f" {_GAP.sub(' ', text.lower()).strip()} "


def trigrams(text: str) -> Iterator[str]:
    return map("".join, zip(text, text[1:], text[2:]))


def myers(pattern: str, text: str, limit: int) -> int:
    """Least edit distance between ``pattern`` and any substring of ``text``; ``limit + 1`` if above ``limit``.

    Myers' bit-parallel recurrence with one machine word of ``len(pattern)`` bits.
    """
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = (minus | ~(diag | plus)) & full
        down = plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full  # a match may start anywhere, so row 0 stays 0
        plus = (down | ~(diag | up)) & full
        minus = up & diag
        if score < best:
            best = score
            if not best:
                break
    return min(best, limit + 1)


class Matcher:
    """Items prepared for search: one automaton over the distinct pieces of all their passages."""

    def __init__(self, items: list[tuple[int, str]], run: int, max_edits: int) -> None:
        import ahocorasick

        self.run, self.max_edits = run, max_edits
        cuts = [round(k * run / (max_edits + 1)) for k in range(max_edits + 2)]
        self.items = [(item, words(text)) for item, text in items]
        self.counts = Counter(chain.from_iterable(w for _, w in self.items))
        self.automaton = ahocorasick.Automaton()
        self.longest = 0
        for k, (_, own) in enumerate(self.items):
            for start in range(len(own) - run + 1):
                self.longest = max(self.longest, sum(map(len, own[start : start + run])) + run + 1)
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    # the blank between two pieces belongs to the first of them
                    piece = " " * (n == 0) + " ".join(own[start + a : start + b]) + " "
                    length, places = self.automaton.get(piece, (len(piece), ()))
                    self.automaton.add_word(piece, (length, (*places, (k, start, a, b))))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()
        self.passages: dict[tuple[int, int], tuple[str, list[int], frozenset[str]]] = {}
        self.rare: dict[tuple[int, int, int, int], frozenset[str]] = {}

    def beside(self, place: tuple[int, int, int, int]) -> frozenset[str]:
        """Words of a passage outside a piece of which one must be left whole: an edit spoils at most two. None if there are too few."""
        known = self.rare.get(place)
        if known is None:
            k, start, a, b = place
            own = self.items[k][1][start : start + self.run]
            least = 2 * self.max_edits + 1
            picked = sorted({*own[:a], *own[b:]}, key=lambda w: (self.counts[w], w))[:least]
            known = self.rare[place] = frozenset(picked if len(picked) == least else ())
        return known

    def passage(self, k: int, start: int) -> tuple[str, list[int], frozenset[str]]:
        """Text of a passage with blanks around, the offset of each of its words, and its trigrams."""
        known = self.passages.get((k, start))
        if known is None:
            own = self.items[k][1][start : start + self.run]
            offsets, at = [], 1
            for w in own:
                offsets.append(at)
                at += len(w) + 1
            text = f" {' '.join(own)} "
            known = self.passages[k, start] = (text, offsets, frozenset(trigrams(text)))
        return known

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, least distance, passages found) for each item with a passage within ``max_edits`` edits."""
        if not text or not self.any:
            return []
        body = normal(text)
        found: dict[int, dict[int, int]] = {}
        spread = self.longest + self.max_edits
        for end, (length, places) in self.automaton.iter(body):
            at = end - length + 1
            around = body[max(0, at - spread) : end + spread]
            near, near_grams = set(around.split()), None
            for place in places:
                k, start, first, _ = place
                rare = self.beside(place)
                if rare and rare.isdisjoint(near):
                    continue
                passage, offsets, grams = self.passage(k, start)
                near_grams = near_grams or set(trigrams(around))
                if len(grams - near_grams) > 3 * self.max_edits:  # an edit spoils at most three trigrams
                    continue
                own = found.setdefault(k, {})
                if own.get(start) == 0:
                    continue
                begin = at - offsets[first] if first else at
                if begin >= 0 and body.startswith(passage, begin):
                    own[start] = 0
                    continue
                window = body[max(0, begin - self.max_edits) : max(0, begin + len(passage) + self.max_edits)]
                distance = myers(passage, window, self.max_edits)
                if distance <= self.max_edits:
                    own[start] = min(distance, own.get(start, distance))
        return [(self.items[k][0], min(v.values()), len(v)) for k, v in found.items() if v]


_matchers: dict[str, Matcher] = {}


def _search(documents: DataFrame, items: list[tuple[int, str]], run: int, max_edits: int) -> DataFrame:
    shared, name = documents.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matchers.get(name)
        if matcher is None:
            _matchers.clear()
            matcher = _matchers[name] = Matcher(shared.value, run, max_edits)
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(*(c.to_pylist() for c in batch.columns)) for hit in matcher.find(text)]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "distance", "passages"])

    return documents.select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, distance int, passages int")


def _passes(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most ``PASS_CHARS`` characters (a longer item is a list of its own), one list at a time."""
    part: list[tuple[int, str]] = []
    size = 0
    for row in items.select("item_id", "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct().toLocalIterator():
        if size + len(row.text) > PASS_CHARS and part:
            yield part
            part, size = [], 0
        part.append((row.item_id, row.text))
        size += len(row.text)
    yield part


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, max_edits: int = MAX_EDITS) -> DataFrame:
    """(doc_id, item_id, distance, passages) for every document with a passage of the item within ``max_edits``.

    ``distance`` is the least number of character edits over the item's passages, 0 for ``run`` consecutive
    words as they stand; ``passages`` counts the passages found. Null or empty texts and items of fewer than
    ``run`` words match nothing; repeated rows of either table count once. The document side is a narrow map.
    The items go to the executors in passes of at most ``PASS_CHARS`` characters, of which the driver holds one at
    a time; at the usual size that is one pass, and of several each writes what it found before the next.
    """
    if run < max_edits + 1:
        raise ValueError("a passage needs at least max_edits + 1 words")
    passes = _passes(items)
    out, following = _search(documents, next(passes), run, max_edits), next(passes, None)
    if following is not None:
        out = written(out)
    while following is not None:
        out = out.union(written(_search(documents, following, run, max_edits)))
        following = next(passes, None)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("passages").alias("passages"))
