"""Lines repeated across the pages of one source, by masking and locality-sensitive hashing.

Numbers, dates and names of a line are masked. The masked letters of every line get a MinHash signature over
character shingles; lines of a source that share a band of it meet in a bucket, where lines with a Jaccard
similarity of at least ``SIMILAR`` are linked. Lines linked directly or through others form a cluster, a line that
stands on many pages is one by itself, and lines of clusters that stand on many pages are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage, written

LEAST_PAGES = 6
LEAST_LETTERS = 4
SIMILAR = 0.8
#: Signature: BANDS bands of ROWS minimum hashes over shingles of SHINGLE characters.
BANDS, ROWS, SHINGLE = 9, 5, 4
#: Lines of a bucket that come with the same number, which orders them; all parts of a bucket are compared with each other.
PART = 2_000
#: Texts signed at once, few enough for their shingles to stay in the processor's cache.
TOGETHER = 500
#: Rows of hashes that a join may send to every executor; a larger side is shuffled.
SMALL_ROWS = 500_000

_KEYS = ["k1", "k2"]
_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)

_NAME = re.compile(r"(?<=[^\W_][ ,;:(]) *[^\W\d_a-zß-öø-ÿ][^\W\d_]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def masked(line: str) -> str:
    """``line`` in lower case without digits, signs and blanks, names replaced by one sign.

    A name is a capitalised word that does not begin the line or a sentence; dates fall with their digits,
    and months written out count as names.
    """
    low = line.lower()
    if low[1:] != line[1:]:  # else there is no name
        low = _NAME.sub("ª", line).lower()
    return "".join(_LETTERS.findall(low))


def signatures(texts: list[str]) -> np.ndarray:
    """MinHash of each text as (texts, BANDS * ROWS) 32-bit values; texts shorter than a shingle are one shingle."""
    out = np.empty((len(texts), BANDS * ROWS), np.uint32)
    for at in range(0, len(texts), TOGETHER):
        _minima(texts[at : at + TOGETHER], out[at : at + TOGETHER])
    return out


def _minima(texts: list[str], out: np.ndarray) -> None:
    padded = [t.ljust(SHINGLE, "\0") for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    hashed = np.zeros(len(codes), np.uint64)
    for j in range(SHINGLE):
        hashed[: len(codes) - SHINGLE + 1] = hashed[: len(codes) - SHINGLE + 1] * np.uint64(0x100000001B3) + codes[j : len(codes) - SHINGLE + 1 + j]
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0x94D049BB133111EB)
    inside = np.ones(len(codes), bool)  # shingles must not run over the end of their text
    for j in range(1, SHINGLE):
        inside[ends - j] = False
    own = (hashed[inside] >> np.uint64(32)).astype(np.uint32)
    mixed = np.empty_like(own)
    first = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1] - SHINGLE + 1, out=first[1:])
    for k in range(BANDS * ROWS):
        np.multiply(own, _MULTIPLY[k], out=mixed)
        mixed += _ADD[k]
        out[:, k] = np.minimum.reduceat(mixed, first)


def shingles(text: str) -> frozenset[str]:
    return frozenset(text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1)))


def overlap(x: frozenset[str], y: frozenset[str]) -> float:
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the character shingles of two texts."""
    return overlap(shingles(a), shingles(b))


def _keys() -> tuple[Column, Column]:
    """Two 64-bit hashes of the source and the letters of ``line``."""
    letters = F.regexp_replace(F.lower("line"), r"\P{L}+", "")
    return F.xxhash64("source", letters), F.xxhash64(letters, F.lit(1), "source")


def lines(pages: DataFrame) -> DataFrame:
    """(source, page_number, block_no, line_no, line, k1, k2) of every line that counts.

    Lines are the parts of a block between newlines; null blocks keep their place. ``k1`` and ``k2`` are two
    64-bit hashes of the source and the line's letters (Unicode letters, lower-cased). Lines with fewer than
    ``LEAST_LETTERS`` letters do not count. A null source is a source of its own.
    """
    # within the exploded arrays, so that the letters are not worked out for the filter and for the keys again
    both = lambda line: F.struct(line.alias("line"), F.regexp_replace(F.lower(line), r"\P{L}+", "").alias("letters"))
    return (
        pages.select("source", "page_number", F.posexplode("blocks").alias("block_no", "block"))
        .filter(F.col("block").isNotNull())
        .select("source", "page_number", "block_no", F.posexplode(F.transform(F.split("block", "\n", -1), both)).alias("line_no", "at"))
        .select("source", "page_number", "block_no", "line_no", "at.line", "at.letters")
        .filter(F.length("letters") >= LEAST_LETTERS)
        .withColumn("k1", F.xxhash64("source", "letters"))
        .withColumn("k2", F.xxhash64("letters", F.lit(1), "source"))
        .drop("letters")
    )


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, k1): every band of every masked text of a line, once for a text that a task meets again.

    Lines of the same letters can differ in capitals and so in their names, and any of them may be the one that is compared.
    """
    seen: dict[int, int] = {}
    more: set[tuple[int, int]] = set()
    for batch in batches:
        fresh, texts = [], []
        for i, (key, line) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            text = masked(line)
            known, new = seen.get(key), hash(text)
            if known is None:
                seen[key] = new
            elif known == new or (key, new) in more:
                continue
            else:
                more.add((key, new))
            fresh.append(i)
            texts.append(text)
        own = batch.take(pa.array(fresh, pa.int64()))
        signed = signatures(texts).reshape(own.num_rows, BANDS, ROWS)
        source = np.asarray(own.column(1)).view(np.uint64)
        bands = np.empty((own.num_rows, BANDS), np.int64)
        for b in range(BANDS):
            band = source * np.uint64(0xD6E8FEB86659FD93) + np.uint64(b)
            for j in range(ROWS):
                band = (band ^ (band >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + signed[:, b, j]
            bands[:, b] = (band ^ (band >> np.uint64(29))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(np.repeat(np.asarray(own.column(0)), BANDS))], names=["band", "k1"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, part, k1) of the lines that share a band with another line, from (band, k1) in order.

    ``part`` cuts a bucket into runs of ``PART`` lines. Of a bucket that goes on in the next batch only its last line is held.
    """
    band, key, place = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for batch in chain(batches, (None,)):
        if batch is not None:
            band, key = np.concatenate([band, np.asarray(batch.column(0))]), np.concatenate([key, np.asarray(batch.column(1))])
        if not len(band):
            continue
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1])
        band, key = band[new], key[new]
        first = np.ones(len(band), bool)  # of its bucket
        first[1:] = band[1:] != band[:-1]
        number = np.arange(len(band)) - np.maximum.accumulate(np.where(first, np.arange(len(band)), 0))
        number[band == band[0]] += place
        met = number > 0
        met[:-1] |= ~first[1:]
        done = len(band) if batch is None else len(band) - 1
        use = np.flatnonzero(met[:done])
        yield pa.RecordBatch.from_arrays([pa.array(band[use]), pa.array((number[use] // PART).astype(np.int64)), pa.array(key[use])], names=["band", "part", "k1"])
        place = int(number[-1])
        band, key = band[done:], key[done:]


class _Bucket:
    """The lines of one bucket so far: heads, and for each head its members, which are all near it."""

    def __init__(self, similar: float):
        self.similar, self.apart = similar, 1 - similar + 1e-9
        self.keys: dict[str, int] = {}  # of each masked text
        self.heads: list[tuple[frozenset[str], int]] = []
        self.members: list[list[tuple[float, str]]] = []  # (distance from the head, masked text)
        self.radius: list[float] = []
        self.root: list[int] = []  # heads that are connected lead to the same one

    def top(self, head: int) -> int:
        while self.root[head] != head:
            self.root[head] = head = self.root[self.root[head]]
        return head

    def add(self, text: str, key: int) -> list[int]:
        """Keys of earlier lines the text is near: one of every group of connected lines that holds any.

        1 - Jaccard is a metric, so lines near a member are not farther from its head than ``apart`` and the
        head's radius together, and only members about as far from the head as the text can be near it.
        """
        if text in self.keys:
            return [self.keys[text]]
        self.keys[text] = key
        own = shingles(text)
        at, home, found, maybe = None, None, [], []
        for h, (head, other) in enumerate(self.heads):
            if at is not None and self.top(h) == self.top(at):
                continue
            if min(len(own), len(head)) < (1 - 2 * self.apart) * max(len(own), len(head)):
                continue
            near = overlap(own, head)
            if near >= self.similar:
                found.append(other)
                if at is None:
                    at, home = h, 1 - near
                else:
                    self.root[self.top(h)] = self.top(at)
            elif 1 - near <= self.apart + self.radius[h]:
                maybe.append((h, 1 - near))
        if at is None:  # a head of its own
            at = len(self.heads)
            self.heads.append((own, key))
            self.members.append([])
            self.radius.append(0.0)
            self.root.append(at)
        else:
            self.members[at].append((home, text))
            self.radius[at] = max(self.radius[at], home)
        for h, distance in maybe:
            if self.top(h) == self.top(at):
                continue
            for far, member in self.members[h]:
                if abs(distance - far) <= self.apart and overlap(own, shingles(member)) >= self.similar:
                    found.append(self.keys[member])
                    self.root[self.top(h)] = self.top(at)
                    break
        return found


def _link(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come one after the other: (a, b) for a line and the earlier ones it is near, (a, null) for a line near none.

        No two lines of a bucket that are near each other are left unconnected, whatever parts they are in; a link
        is left out only where others connect its lines.
        """
        bucket, held = None, _Bucket(similar)
        for batch in batches:
            out: list[tuple[int, int, int | None]] = []
            for band, _, key, line in zip(*(c.to_pylist() for c in batch.columns)):
                if band != bucket:
                    bucket, held = band, _Bucket(similar)
                out += [(band, key, other) for other in held.add(masked(line), key)] or [(band, key, None)]
            columns = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["band", "a", "b"])

    return run


def sized(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``SMALL_ROWS`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b): the smallest node it is connected to.

    Every node in turn hands its larger neighbours, then its smaller ones, to the smallest it knows, until nothing
    changes; only minima are aggregated, and distances shrink by powers. Nodes must not be null.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        handed = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(handed.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        mark = now


def links(pages: DataFrame, places: DataFrame, similar: float) -> DataFrame:
    """(a, b) of the lines, by ``k1``, that share a bucket and are similar, as far as clusters need them; ``places`` has their places."""
    source = F.xxhash64("source").alias("s")
    bands = lines(pages).select("k1", source, "line").mapInArrow(_sign, "band long, k1 long")
    met = bands.repartition("band").sortWithinPartitions("band", "k1").mapInArrow(_meet, "band long, part long, k1 long")
    met = cut_lineage(met)
    where = F.min(F.struct("source", "page_number", "block_no", "line_no")).alias("at")
    first = places.join(sized(met.select("k1").distinct()), "k1", "left_semi").groupBy("k1").agg(where)
    wanted = sized(cut_lineage(first.select(F.col("k1").alias("key"), "at.*").withColumnsRenamed({"source": "of", "page_number": "no"})))
    line = F.try_element_at(F.split(F.try_element_at("blocks", F.col("block_no") + 1), "\n", -1), F.col("line_no") + 1).alias("line")
    texts = (
        pages.select("source", "page_number", "blocks")
        .join(wanted, F.col("source").eqNullSafe(F.col("of")) & F.col("page_number").eqNullSafe(F.col("no")))
        .select("key", "source", line)
        .filter(_keys()[0] == F.col("key"))  # another row of the page may hold another line there
        .groupBy(F.col("key").alias("k1"))
        .agg(F.min("line").alias("line"))
    )
    full = met.join(texts, "k1").select("band", "part", "k1", "line")
    together = full.repartition("band").sortWithinPartitions("band", "part", "k1")
    return cut_lineage(together.mapInArrow(_link(similar), "band long, a long, b long").filter("b IS NOT NULL").select("a", "b"))


def repeated_near(pages: DataFrame, least: int = LEAST_PAGES, similar: float = SIMILAR) -> DataFrame:
    """(source, page_number, block_no, line_no, line_pages, cluster_pages) of every line whose cluster stands on ``least`` pages.

    ``line_pages`` is the number of different pages with the same letters, ``cluster_pages`` with any line of the
    cluster. Repeated page rows count once, rows without a page number are on no page.
    """
    places = written(lines(pages).select("source", "page_number", "block_no", "line_no", *_KEYS))
    clusters = connected(links(pages, places, similar))
    per_line = places.select(*_KEYS, "page_number").distinct().groupBy(*_KEYS).agg(F.count("page_number").alias("n"))
    alone = per_line.filter(F.col("n") >= least).select("k1").distinct()  # a cluster of its own, unless it is in one
    members = cut_lineage(clusters.select(F.col("node").alias("k1"), "root").union(alone.select("k1", F.col("k1").alias("root"))).groupBy("k1").agg(F.min("root").alias("root")))
    on = written(places.select(*_KEYS, "page_number").join(sized(members), "k1").distinct())
    own = on.groupBy(*_KEYS, "root").agg(F.count("page_number").alias("line_pages"))
    whole = on.select("root", "page_number").distinct().groupBy("root").agg(F.count("page_number").alias("cluster_pages"))
    found = cut_lineage(own.join(whole.filter(F.col("cluster_pages") >= least), "root").select(*_KEYS, "line_pages", "cluster_pages"))
    return places.join(sized(found), _KEYS).select("source", "page_number", "block_no", "line_no", "line_pages", "cluster_pages").distinct()


def repeated_places(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """(source, page_number, block_no, line_no) of every line of a repeated cluster whose own letters stand on ``least`` pages of its source."""
    return repeated_near(pages, least).filter(F.col("line_pages") >= least).select("source", "page_number", "block_no", "line_no")


def clean_blocks(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """(source, page_number, block_no, block, removed): every non-null block without the lines named in ``repeated``.

    A block all of whose lines are removed comes out empty. Repeated page rows count once.
    """
    keys = ["source", "page_number", "block_no"]
    gone = repeated.groupBy(*keys).agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    blocks = (
        pages.select("source", "page_number", F.posexplode("blocks").alias("block_no", "block"))
        .filter(F.col("block").isNotNull())
        .dropDuplicates(keys)
    )
    same = [blocks[k].eqNullSafe(gone[k]) for k in keys]
    joined = blocks.join(gone, same[0] & same[1] & same[2], "left").select(*(blocks[k] for k in keys), "block", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    numbered = F.transform(F.split("block", "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("no")))
    kept = F.filter(numbered, lambda s: ~F.array_contains(F.col("gone"), s.no))
    return joined.select(*keys, F.array_join(F.transform(kept, lambda s: s.line), "\n").alias("block"), F.size("gone").alias("removed"))
