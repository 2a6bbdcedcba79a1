"""The k most similar vectors of every vector: a forest of random-projection trees.

Each tree splits at hyperplanes between two points of a bounded sample, down to regions. A vector is stored in
its own region of every tree. A search walks all trees with one shared priority queue, ordered by how far the
vector is from the hyperplanes on the wrong side of the path, and asks in the best regions of the whole forest.
A region is split further on its own members, however many it has, down to leaves of a fixed size; of these an
asking vector visits the best in the same order, and the candidates found are ranked by exact cosine. Equal vectors
are searched once and share the answer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

DIMENSIONS = 64
K = 10
TREES = 4
#: Vectors a region should hold: a share of the table between two bounds.
REGION_SHARE, LEAST_REGION, MOST_REGION = 1 / 16, 500, 20_000
#: Vectors a leaf of a region holds at most, a share of the region between two bounds, and leaves of a region that an asking vector visits.
LEAF_SHARE, LEAST_LEAF, MOST_LEAF = 1 / 35, 20, 80
VISITS = 10
#: Vectors the trees are fitted on (about that many of a larger table).
SAMPLE = 20_000
#: Sampled vectors a region needs to be split again; bounds the number of regions at SAMPLE / LEAST.
LEAST = 8
#: Members, and asking vectors, that one task of a region takes; a fuller region is compared block by block.
BLOCK, ASKING = 50_000, 200_000
#: Planes tried at a node, moves of their two points, the least share on one side, and the distance that counts as near a plane.
TRIES, MOVES, UNEVEN, NEAR = 4, 10, 0.1, 0.1
SEED = 7


def proper(c: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has the right length and finite numbers, not all zero."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == dimensions) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def plane(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
    """(normal, shift, side) of a hyperplane between two points, with few points near it; None if nothing parts them."""
    best = None
    for _ in range(TRIES):
        a, b = points[rng.choice(len(points), 2, replace=False)]
        for _ in range(MOVES):  # the two points move to the middle of what is nearer to each
            side = points @ (a - b) > (a @ a - b @ b) / 2
            if side.all() or not side.any():
                break
            a, b = points[side].mean(0), points[~side].mean(0)
        norm = float(np.linalg.norm(a - b))
        if norm < 1e-6:
            continue
        normal = (a - b) / norm
        shift = float(normal @ (a + b)) / 2
        margin = points @ normal - shift
        if not UNEVEN <= float((margin > 0).mean()) <= 1 - UNEVEN:
            continue
        near = float((np.abs(margin) < NEAR).mean())
        if best is None or near < best[0]:
            best = (near, normal, shift, margin > 0)
    if best is None:  # no plane with points enough on both sides: the middle along a random direction
        normal = rng.normal(size=points.shape[1])
        normal = normal / np.linalg.norm(normal)
        along = points @ normal
        shift = float(np.median(along))
        best = (0.0, normal, shift, along > shift)
    return best[1:] if 0 < int(best[3].sum()) < len(points) else None


class Tree:
    """Hyperplanes of one tree as flat arrays; child -1 - n is leaf n."""

    def __init__(self, points: np.ndarray, leaf: float, least: int, rng: np.random.Generator) -> None:
        self.left: list[int] = []
        self.right: list[int] = []
        self.members: list[np.ndarray] = []
        normals: list[np.ndarray] = []
        shifts: list[float] = []
        todo: list[tuple[np.ndarray, int, bool]] = [(np.arange(len(points)), -1, False)]
        self.root = 0
        while todo:
            own, parent, right = todo.pop()
            cut = plane(points[own], rng) if len(own) > leaf and len(own) >= 2 * least else None
            if cut is None:
                self.members.append(own)
                node = -len(self.members)
            else:
                node = len(normals)
                normals.append(cut[0])
                shifts.append(cut[1])
                self.left.append(0)
                self.right.append(0)
                todo += [(own[cut[2]], node, True), (own[~cut[2]], node, False)]
            if parent < 0:
                self.root = node
            else:
                (self.right if right else self.left)[parent] = node
        self.normals = np.asarray(normals, np.float32).reshape(-1, points.shape[1])
        self.shifts = np.asarray(shifts, np.float32)

    def far(self, vectors: np.ndarray) -> np.ndarray:
        """How far each vector is from each leaf: the largest distance to a plane on the wrong side of the path, 0 for its own.

        Best-first search with a priority queue reaches leaves in just this order.
        """
        out = np.zeros((len(vectors), len(self.members)), np.float32)
        margins = vectors @ self.normals.T - self.shifts if len(self.normals) else None
        todo = [(self.root, np.zeros(len(vectors), np.float32))]
        while todo:
            node, far = todo.pop()
            if node < 0:
                out[:, -1 - node] = far
                continue
            todo += [(self.right[node], np.maximum(far, -margins[:, node])), (self.left[node], np.maximum(far, margins[:, node]))]
        return out


class Forest:
    """Trees down to regions, fitted on a sample of a table of ``rows`` vectors; regions of all trees are numbered through."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, region: int, extra: int | None, seed: int) -> None:
        rng = np.random.default_rng(seed)
        per_row = max(1.0, rows / max(1, len(sample)))
        self.trees = [Tree(sample, region / per_row, LEAST, rng) for _ in range(trees)]
        counts = [len(t.members) for t in self.trees]
        self.first = np.cumsum([0, *counts])
        #: Regions a vector asks in beside its own of every tree: the more regions a tree has, the more of them lie near.
        self.extra = int(np.sqrt(self.first[-1] / trees)) if extra is None else extra
        members = np.array([len(m) for t in self.trees for m in t.members]) * per_row
        #: Blocks the members of a region are stored in, and parts of those that ask, from the shares of the sample.
        self.blocks = np.maximum(1, np.ceil(members / BLOCK)).astype(np.int64)
        self.parts = np.ones(len(members), np.int64)
        if rows > ASKING:
            asked = np.bincount(np.concatenate([v[v >= 0] for v in (self.visits(sample[a : a + 2000]) for a in range(0, len(sample), 2000))]), minlength=len(members))
            self.parts = np.maximum(1, np.ceil(asked * per_row / ASKING)).astype(np.int64)

    def visits(self, vectors: np.ndarray) -> np.ndarray:
        """Regions each vector asks in: its own of every tree, then the ``extra`` best others, -1 for none.

        The queue of a vector holds the turns not taken, in all trees at once, by the largest distance to a
        plane crossed so far; the nearest turn is followed to its region, which adds that path's own turns.
        """
        out = np.full((len(vectors), len(self.trees) + self.extra), -1, np.int64)
        margins = [(vectors @ t.normals.T - t.shifts).tolist() if len(t.normals) else [()] * len(vectors) for t in self.trees]
        for i in range(len(vectors)):
            queue: list[tuple[float, int, int]] = []
            for t, tree in enumerate(self.trees):
                out[i, t] = self._descend(t, tree.root, 0.0, margins[t][i], queue)
            for j in range(len(self.trees), out.shape[1]):
                if not queue:
                    break
                far, t, node = heapq.heappop(queue)
                out[i, j] = self._descend(t, node, far, margins[t][i], queue)
        return out

    def _descend(self, t: int, node: int, far: float, row: list[float], queue: list[tuple[float, int, int]]) -> int:
        left, right = self.trees[t].left, self.trees[t].right
        while node >= 0:
            margin = row[node]
            if margin > 0:
                node, turn = right[node], left[node]
            else:
                node, turn, margin = left[node], right[node], -margin
            heapq.heappush(queue, (margin if margin > far else far, t, turn))
        return int(self.first[t]) - 1 - node


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """Rows of a binary column of equally long vectors."""
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, kind).reshape(len(column), -1)


def distinct_vectors(chunks: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vid, chunk_id, v, h1, h2): every chunk with a proper embedding once; ``v`` is the unit vector as float32 bytes.

    Written to the shared checkpoint folder, which fixes ``vid``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).astype(np.float64).reshape(batch.num_rows, dimensions)
            x = x / np.abs(x).max(1, keepdims=True)  # against overflow of the squares
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["chunk_id", "v"])

    proper_rows = chunks.select("chunk_id", "embedding").filter(F.col("chunk_id").isNotNull() & proper(F.col("embedding"), dimensions))
    units = proper_rows.dropDuplicates(["chunk_id"]).mapInArrow(run, "chunk_id string, v binary")
    return cut_lineage(
        units.select(F.monotonically_increasing_id().alias("vid"), "chunk_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    )


def _twins(vectors: DataFrame, k: int) -> DataFrame:
    """(vid, rep, kept) of every vector that equals one of smaller id; the first ``k`` of a group are kept as candidates.

    Of a large group every partition passes on its ``k`` smallest only, as the rank is cut at ``k``.
    """
    same = vectors.groupBy("h1", "h2").agg(F.min("vid").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    twins = vectors.select("vid", "h1", "h2").join(same.select("h1", "h2", "rep"), ["h1", "h2"]).filter("vid <> rep").select("vid", "rep")
    first = twins.withColumn("no", F.row_number().over(Window.partitionBy("rep").orderBy("vid"))).filter(F.col("no") <= k)
    last_kept = first.groupBy("rep").agg(F.max("vid").alias("last_kept"))
    return twins.join(last_kept, "rep").select("vid", "rep", (F.col("vid") <= F.col("last_kept")).alias("kept"))


def _places(vectors: DataFrame, forest: Forest) -> DataFrame:
    """(region, block, part, stored, asks, vid, v) of every place a vector is stored in or asks at; ``v`` as 16-bit floats.

    A region of several blocks stores a vector in one of them, for every part of those that ask; who asks does so at all blocks.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        trees = len(own.trees)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                vid, asks = np.asarray(piece.column(0)), np.asarray(piece.column(2).to_pylist(), bool)
                x = _matrix(piece.column(1), np.float32)
                visits = own.visits(x)
                row, column = np.nonzero((visits >= 0) & ((np.arange(visits.shape[1]) < trees) | asks[:, None]))
                region = visits[row, column]
                cells = own.blocks[region] * own.parts[region]
                pick = np.repeat(np.arange(len(row)), cells)
                cell = np.arange(len(pick)) - np.repeat(np.cumsum(cells) - cells, cells)
                row, column, region = row[pick], column[pick], region[pick]
                block, part = cell // own.parts[region], cell % own.parts[region]
                stored = (column < trees) & (block == vid[row] % own.blocks[region])
                asking = asks[row] & (part == (vid[row] // 7) % own.parts[region])
                use = stored | asking
                row, region, block, part, stored, asking = row[use], region[use], block[use], part[use], stored[use], asking[use]
                small = pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
                columns = [*map(pa.array, (region, block, part, stored, asking, vid[row])), small.take(pa.array(row))]
                yield pa.RecordBatch.from_arrays(columns, names=["region", "block", "part", "stored", "asks", "vid", "v"])

    return vectors.select("vid", "v", "asks").mapInArrow(run, "region long, block long, part long, stored boolean, asks boolean, vid long, v binary")


def best_of_region(ids: np.ndarray, x: np.ndarray, asking: np.ndarray, wanted: np.ndarray, k: int, leaf: int, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """(other, cosine), each (asking, k): the ``k`` nearest of the members that the best ``visits`` leaves of the region hold; -2 for none."""
    other, cosine = np.zeros((len(asking), k), np.int64), np.full((len(asking), k), -2.0)
    if not len(ids) or not len(asking):
        return other, cosine
    tree = Tree(x, leaf, 1, np.random.default_rng(SEED))
    stored = [(ids[m], x[m]) for m in tree.members]
    for at in range(0, len(asking), 4000):
        own, vectors = asking[at : at + 4000], wanted[at : at + 4000]
        far = tree.far(vectors)
        n = min(visits, far.shape[1])
        leaves = np.argpartition(far, n - 1, axis=1)[:, :n] if n < far.shape[1] else np.broadcast_to(np.arange(n), far.shape)
        found, score = np.zeros((len(own), n, k), np.int64), np.full((len(own), n, k), -2.0, np.float32)
        row, slot = np.divmod(np.argsort(leaves, axis=None, kind="stable"), n)
        ends = np.cumsum(np.bincount(leaves.ravel(), minlength=far.shape[1]))
        for number, (vid, v) in enumerate(stored):
            here, place = (a[ends[number - 1] if number else 0 : ends[number]] for a in (row, slot))
            if not len(here):
                continue
            near = vectors[here] @ v.T
            near[own[here, None] == vid[None, :]] = -2
            m = min(k, len(vid))
            best = np.argpartition(-near, m - 1, axis=1)[:, :m]
            found[here, place, :m], score[here, place, :m] = vid[best], np.take_along_axis(near, best, 1)
        found, score = found.reshape(len(own), -1), score.reshape(len(own), -1)
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        other[at : at + 4000], cosine[at : at + 4000] = np.take_along_axis(found, best, 1), np.take_along_axis(score, best, 1)
    # ranked in 64 bits, where sums of products of 16-bit floats are exact: equal in whatever region they are met
    order = np.argsort(ids)
    for at in range(0, len(asking), 4000):
        place = order[np.minimum(np.searchsorted(ids, other[at : at + 4000], sorter=order), len(ids) - 1)]
        exact = np.einsum("ad,akd->ak", wanted[at : at + 4000].astype(np.float64), x[place].astype(np.float64))
        cosine[at : at + 4000] = np.where(cosine[at : at + 4000] < -1.5, -2, exact)
    return other, cosine


def _ranker(k: int, leaf: int, visits: int):
    def rank(places: pa.Table) -> pa.Table:
        """The nearest stored vectors of every asking one of one block of a region."""
        stored, asks = np.asarray(places["stored"]), np.asarray(places["asks"])
        vid, x = np.asarray(places["vid"]), _matrix(places["v"], np.float16).astype(np.float32)
        by_id = np.flatnonzero(stored)[np.argsort(vid[stored])]  # the same tree however the rows arrive
        other, cosine = best_of_region(vid[by_id], x[by_id], vid[asks], x[asks], k, leaf, visits)
        ends = pa.array(np.arange(len(other) + 1) * k, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (other, -cosine.astype(np.float32))]  # the same rounding everywhere
        return pa.Table.from_arrays([pa.array(vid[asks]), *lists], names=["vid", "other", "far"])

    return rank


def nearest(
    vectors: DataFrame, k: int = K, trees: int = TREES, region: int | None = None, extra: int | None = None, leaf: int | None = None, visits: int = VISITS, sample: int = SAMPLE
) -> DataFrame:
    """(vid, near) from ``distinct_vectors``: ``near`` holds up to ``k`` (far, other), nearest first, smaller ids first on ties.

    ``far`` is the negative cosine. The forest is fitted on a sample chosen by a hash of the id, of about
    ``sample`` vectors; every vector is stored and searched. A region holds about ``region`` vectors, by default
    ``REGION_SHARE`` of the table within its bounds, and a leaf at most ``leaf``, by default ``LEAF_SHARE`` of that. An empty table gives no rows and a single vector an
    empty list. Equal vectors ask once, as the one of smallest id.
    """
    rows = vectors.count()
    share = 1.0 if rows <= sample else sample / rows
    hashed = F.pmod(F.xxhash64("chunk_id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000)
    chosen = vectors.filter(hashed).select("v").toArrow()["v"] if rows else []
    width = DIMENSIONS if not len(chosen) else len(chosen[0].as_py()) // 4
    points = _matrix(chosen, np.float32) if len(chosen) else np.empty((0, width), np.float32)
    region = region or int(min(MOST_REGION, max(LEAST_REGION, rows * REGION_SHARE)))
    leaf = leaf or int(min(MOST_LEAF, max(LEAST_LEAF, region * LEAF_SHARE)))
    forest = Forest(points, rows, trees, region, extra, SEED)
    twins = _twins(vectors, k)
    roles = (
        vectors.join(twins, "vid", "left")
        .filter(F.coalesce("kept", F.lit(True)))
        .select("vid", "v", F.col("rep").isNull().alias("asks"))
    )
    found = _places(roles, forest).groupBy("region", "block", "part").applyInArrow(_ranker(k, leaf, visits), "vid long, other array<long>, far array<float>")
    real = F.filter(F.flatten(F.collect_list("pairs")), lambda p: p.far < 1.5)
    merged = cut_lineage(  # read twice below; the search itself must run once
        found.select("vid", F.arrays_zip("far", "other").alias("pairs"))
        .groupBy("vid")
        .agg(F.slice(F.array_sort(F.array_distinct(real)), 1, k).alias("near"))
    )
    first = F.struct(F.lit(-1.0).cast("float").alias("far"), F.col("rep").alias("other"))
    for_twins = (
        twins.select(F.col("vid").alias("twin"), "rep")
        .join(merged.withColumnRenamed("vid", "rep"), "rep")
        .select(
            F.col("twin").alias("vid"),
            F.slice(F.array_sort(F.concat(F.array(first), F.filter("near", lambda p: p.other != F.col("twin")))), 1, k).alias("near"),
        )
    )
    return merged.union(for_twins)


def similar_chunks(chunks: DataFrame, k: int = K, **search: int) -> DataFrame:
    """(chunk_id, rank, other_id, cosine): the ``k`` most similar other chunks of every chunk with a proper embedding.

    Improper embeddings (null, of another length, with null, NaN or infinite numbers, all zero) take no part;
    repeated rows of a chunk count once. Cosines are those of 16-bit unit vectors, within 0.001.
    """
    vectors = distinct_vectors(chunks)
    near = nearest(vectors, k, **search).select("vid", F.posexplode("near").alias("at", "p"))
    names = vectors.select("vid", "chunk_id")
    return (
        near.select("vid", (F.col("at") + 1).alias("rank"), F.col("p.other").alias("other"), (-F.col("p.far")).alias("cosine"))
        .join(names, "vid")
        .join(names.select(F.col("vid").alias("other"), F.col("chunk_id").alias("other_id")), "other")
        .select("chunk_id", "rank", "other_id", F.round("cosine", 4).alias("cosine"))
    )


def _exact_cosine():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), np.float32).astype(np.float64) for c in (2, 3)) if batch.num_rows else (np.empty((0, 1)),) * 2
            cosine = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["chunk_a", "chunk_b", "cosine"])

    return run


def close_pairs(chunks: DataFrame, least: float = 0.92, k: int = K) -> DataFrame:
    """(chunk_a, chunk_b, cosine), chunk_a < chunk_b: pairs of at least ``least``, one among the ``k`` nearest of the other.

    The search proposes pairs a little below the limit as well, and their cosine is computed again from the
    full vectors.
    """
    vectors = distinct_vectors(chunks)
    near = nearest(vectors, k).select("vid", F.explode("near").alias("p")).filter(F.col("p.far") <= -(least - 0.002))
    pairs = near.select(F.least("vid", "p.other").alias("x"), F.greatest("vid", "p.other").alias("y")).distinct()
    side = lambda key, name, v: vectors.select(F.col("vid").alias(key), F.col("chunk_id").alias(name), F.col("v").alias(v))
    both = pairs.join(side("x", "cx", "vx"), "x").join(side("y", "cy", "vy"), "y")
    ordered = both.select(F.least("cx", "cy").alias("chunk_a"), F.greatest("cx", "cy").alias("chunk_b"), "vx", "vy")
    return ordered.mapInArrow(_exact_cosine(), "chunk_a string, chunk_b string, cosine double").filter(F.col("cosine") >= least)
