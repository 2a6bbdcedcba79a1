"""Choosing a varied subset of the candidates of each request: max-sum dispersion by local search.

All candidates of a request meet in one task, in order of preference, however many they are. A selected and an
unselected candidate are swapped while this raises the total pairwise distance, or leaves it and brings in the
better-scored one. Distances are one minus the cosine or, with ``alike``, 1 between candidates of different groups
of look-alikes and 0 within. No matrix of all pairs of a request is made: rows are compared a slice with a block at
a time, and the vectors of a large request lie in a temporary file. None of these bounds has a say in the result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.neighbours import proper

ALIKE = 0.5
#: Rows that a slice is compared with at once.
BLOCK = 2_000
#: Rows far apart around which the others are gathered, so that slices skip cells that are too far from them.
CORE = 24
#: Rows compared with all others of a task at once; a request of no more is one cell.
SLICE = 512
#: Rows of a request whose vectors a task holds in memory; those of a larger request lie in a temporary file.
LARGE = 10_000

_KINDS = {
    "query_id": pa.string(), "chunk_id": pa.string(), "score": pa.float64(), "subset_size": pa.int32(), "groups": pa.int32(), "dispersion": pa.float64(),
}
_OUT = "query_id string, chunk_id string, score double, subset_size int, groups int, dispersion double"


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # against overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(centres, radii, rows of each cell): every row is in the cell of the nearest of up to ``CORE`` rows far apart; radii are angles."""
    if len(x) <= SLICE:
        return x[:1], np.full(1, np.pi), [np.arange(len(x))]
    centres = x[spread_out(x, 0, CORE)]
    own, far = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), block):
        cosine = x[at : at + block] @ centres.T
        own[at : at + block], far[at : at + block] = cosine.argmax(1), np.arccos(np.clip(cosine.max(1), -1, 1))
    cells = [np.flatnonzero(own == k) for k in range(len(centres))]
    return centres, np.array([far[c].max(initial=0.0) for c in cells]), cells


def components(x: np.ndarray, alike: float, label: np.ndarray | None = None, block: int = BLOCK) -> np.ndarray:
    """Group number of each unit row: rows of cosine ``alike`` or more, or of the same label, and alike of alike, belong together.

    Grows one group at a time, ``SLICE`` rows against ``block`` of those not yet reached, so no matrix of all pairs is
    made. A row skips a cell whose centre is farther than the angle of ``alike`` and the cell's radius together.
    """
    n = len(x)
    group = np.full(n, -1)
    by_label: dict[object, list[int]] = {}
    for i, own in enumerate(label.tolist() if label is not None else ()):
        if own is not None:
            by_label.setdefault(own, []).append(i)
    centres, radii, cells = _cells(x, block)
    reach = radii + np.arccos(np.clip(alike, -1, 1)) + 1e-6
    within = lambda rows: np.arccos(np.clip(rows @ centres.T, -1, 1)) <= reach
    lone = np.zeros(n, bool)
    known = 0  # rows up to here have a group or were compared as a slice
    for i in range(n):
        if group[i] >= 0:
            continue
        if i >= known:  # many rows are like no other: these need no growing
            seeds = i + np.flatnonzero(group[i:] < 0)[:SLICE]
            known = seeds[-1] + 1
            own = x[seeds]
            near, mates = within(own), np.zeros(len(seeds), np.int64)
            for k in np.flatnonzero(near.any(0)):
                cells[k] = rest = cells[k][group[cells[k]] < 0]
                for at in range(0, len(rest), block):
                    mates[near[:, k]] += ((own[near[:, k]] @ x[rest[at : at + block]].T >= alike) & (seeds[near[:, k], None] != rest[at : at + block])).sum(1)
            lone[seeds] = mates == 0
        group[i] = i
        front = [np.array([i])]
        while front:
            now = front.pop()
            if len(now) > SLICE:
                front.append(now[SLICE:])
                now = now[:SLICE]
            own = x[now]
            near = within(own) & ~lone[now, None]
            for k in np.flatnonzero(near.any(0)):
                cells[k] = rest = cells[k][group[cells[k]] < 0]
                asking = own[near[:, k]]
                for at in range(0, len(rest), block):
                    part = rest[at : at + block]
                    reached = part[(asking @ x[part].T >= alike).any(0)]
                    if len(reached):
                        group[reached] = i
                        front.append(reached)
            if by_label:
                same = np.array([j for k in now for j in by_label.pop(label[k], ()) if group[j] < 0], np.int64)
                if len(same):
                    group[same] = i
                    front.append(same)
    return group


def spread_out(x: np.ndarray, first: int, size: int) -> list[int]:
    """Up to ``size`` rows, each the farthest from those before it; equal rows are not taken twice."""
    picked = [first]
    nearest = x @ x[first]
    while len(picked) < min(size, len(x)):
        nxt = int(np.argmin(nearest))
        if nearest[nxt] > 1 - 1e-9:
            break
        picked.append(nxt)
        nearest = np.maximum(nearest, x @ x[nxt])
    return picked


def search_groups(group: np.ndarray, size: int) -> np.ndarray:
    """Chosen rows under 0/1 distances between groups; rows come in order of preference.

    With c rows of its group chosen, a swap of a row leaving g and one entering h adds c[g] - c[h] - 1 to the total
    distance (0 within a group), so the best swap goes from the fullest group to the emptiest that has rows left.
    """
    n = len(group)
    size = max(0, min(size, n))
    _, number = np.unique(group, return_inverse=True)
    members = np.argsort(number, kind="stable")
    total = np.bincount(number)
    ends = np.cumsum(total)
    first = ends - total
    taken = np.bincount(number[:size], minlength=len(total))  # the chosen rows of a group are always its best ones
    while 0 < size < n:
        most = taken.max()
        free = taken < total
        least = taken[free].min()
        if most - least < 1:
            break
        full, empty = np.flatnonzero(taken == most), np.flatnonzero(free & (taken == least))
        leaves, enters = members[first[full] + most - 1], members[first[empty] + least]
        a, b = full[np.argmax(leaves)], empty[np.argmin(enters)]
        if most - least == 1 and enters.min() > leaves.max():
            break
        taken[a] -= 1
        taken[b] += 1
    return np.sort(np.concatenate([members[f : f + t] for f, t in zip(first, taken)])) if n else np.empty(0, np.int64)


def search_cosines(x: np.ndarray, size: int) -> np.ndarray:
    """Rows of a set of ``size`` unit rows that no single swap improves, distances being one minus the cosine.

    Rows come in order of preference. With v the sum of the chosen, a swap of a for b adds
    v.a - v.b - (1 - a.b) to the total distance, so only rows b with v.b below the largest v.a are looked at, in slices.
    """
    n = len(x)
    size = max(0, min(size, n))
    inside = np.zeros(n, bool)
    inside[:size] = True
    while 0 < size < n:
        along = x @ x[inside].sum(0)
        out, into = np.flatnonzero(inside), np.flatnonzero(~inside)
        into = into[np.argsort(along[into], kind="stable")]
        highest, swap = along[out].max(), None
        for at in range(0, len(into), SLICE):
            part = into[at : at + SLICE]
            if along[part[0]] > highest + 1e-9:
                break
            best, climbs = -np.inf, 0
            for start in range(0, len(out), BLOCK):
                own = out[start : start + BLOCK]
                gain = along[own][:, None] - along[part][None, :] - (1 - x[own] @ x[part].T)
                top = gain.max()
                if top < max(best, 0) - 1e-9:
                    continue
                climb = np.where(gain >= top - 1e-9, own[:, None] - part[None, :], -n)  # of the best swaps, the one that climbs most places
                a, b = np.unravel_index(np.argmax(climb), climb.shape)
                if top > best + 1e-9 or climb[a, b] > climbs:
                    best, climbs, found = max(top, best), climb[a, b], (own[a], part[b])
            if best > 1e-9 or best >= -1e-9 and climbs > 0:
                swap = found
                break
        if swap is None:
            break
        inside[swap[0]], inside[swap[1]] = False, True
    return np.flatnonzero(inside)


def total_distance(x: np.ndarray, group: np.ndarray | None) -> float:
    """Sum of the distances of all pairs of rows, from sums alone."""
    n = len(x)
    if group is not None:
        return float((n * n - (np.unique(group, return_counts=True)[1] ** 2).sum()) / 2)
    return float((n * n - (x.sum(0) ** 2).sum()) / 2)


class _Request:
    """The candidates of one request, which come in order of preference."""

    def __init__(self, query: str, size: int):
        self.query, self.size = query, size
        self.chunks: list[str] = []
        self.scores: list[float] = []
        self.vectors: list[np.ndarray] = []
        self.seen: set[str] = set()
        self.file = None

    def add(self, rows: pa.RecordBatch) -> None:
        """A candidate that comes again counts once, with its highest score."""
        names = rows.column("chunk_id").to_pylist()
        fresh = [i for i, c in enumerate(names) if not (c in self.seen or self.seen.add(c))]
        flat = np.asarray(rows.column("embedding").flatten(), np.float32).reshape(len(names), -1)
        scores = rows.column("score").to_pylist()
        self.chunks += [names[i] for i in fresh]
        self.scores += [scores[i] for i in fresh]
        self.vectors.append(unit(flat[fresh].astype(np.float64)))
        if len(self.chunks) > LARGE:
            self.file = self.file or tempfile.TemporaryFile()
            for part in self.vectors:
                self.file.write(part.tobytes())
            self.vectors = []

    def choice(self, alike: float | None, block: int) -> list[tuple]:
        if self.file:
            self.file.flush()
            x = np.memmap(self.file, np.float64, "r").reshape(len(self.chunks), -1).view(np.ndarray)
        else:
            x = np.concatenate(self.vectors)
        group = components(x, alike, block=block) if alike is not None else None
        chosen = search_groups(group, self.size) if group is not None else search_cosines(x, self.size)
        count = len(np.unique(group)) if group is not None else 0
        distance = total_distance(x[chosen], group[chosen] if group is not None else None)
        return [(self.query, self.chunks[i], self.scores[i], self.size, count, distance) for i in chosen]


def _chooser(alike: float | None, block: int):
    """Arrow map over rows sorted by query_id and preference: the choice of every request."""

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS.values())], names=list(_KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Requests come one after the other; the last of a batch may go on in the next."""
        request: _Request | None = None
        for batch in batches:
            ids, sizes = batch.column("query_id").to_pylist(), batch.column("subset_size").to_pylist()
            starts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
            out: list[tuple] = []
            for s, e in zip(starts, [*starts[1:], len(ids)]):
                if request is None or request.query != ids[s]:
                    out += request.choice(alike, block) if request else []
                    request = _Request(ids[s], sizes[s])
                request.add(batch.slice(s, e - s))
            if out:
                yield made(out)
        if request:
            yield made(request.choice(alike, block))

    return run


def eligible(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, subset_size, embedding) of every candidate row that takes part.

    Rows take part if their own faiss_score is finite and their own embedding proper, and a request with a
    size above 0 names their question. A request that comes again counts once, with its largest size.
    """
    asked = requests.filter(F.col("query_id").isNotNull() & (F.col("subset_size") > 0)).groupBy("query_id").agg(F.max("subset_size").alias("subset_size"))
    score = F.col("faiss_score").cast("double")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))
    return (
        chunks.select("query_id", "chunk_id", "faiss_score", "embedding")
        .filter(F.col("chunk_id").isNotNull() & finite & proper(F.col("embedding")))
        .join(asked, "query_id")
        .select("query_id", "chunk_id", score.alias("score"), "subset_size", "embedding")
    )


def select_varied(chunks: DataFrame, requests: DataFrame, alike: float | None = ALIKE, block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_id, score, subset_size, groups, dispersion): the chosen candidates of each request.

    With ``alike``, candidates of cosine ``alike`` or more, and alike of alike, form one group, and distances
    are between groups; with None, distances are one minus the cosine. Fewer candidates than asked for are all
    chosen. Ties go to the higher score, then to the smaller chunk_id. Requests without candidates give no rows.

    Groups and local search are those of all candidates of a request, whatever their number. ``block`` is how many
    rows a slice is compared with at once and does not change the result.
    """
    rows = eligible(chunks, requests)
    together = rows.repartition("query_id").sortWithinPartitions("query_id", F.desc("score"), "chunk_id", "embedding")
    return together.mapInArrow(_chooser(alike, block), _OUT)
