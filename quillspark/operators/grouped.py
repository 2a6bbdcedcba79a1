"""A grouped map for many small groups: one Arrow stream per task instead of one per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame


def by_group(df: DataFrame, keys: list[str], order: list[str], rows_of: Callable[[pa.Table], list[tuple]], kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Rows that ``rows_of`` makes of each group of ``keys``, which comes sorted by ``order``.

    Groups follow each other in a sorted partition; one that is cut by a batch is put together again. A group is
    held in memory, so callers bound it first. ``kinds`` names the Arrow types of the output, ``schema`` Spark's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in chain(batches, (None,)):
            if batch is not None:
                more = pa.Table.from_batches([batch])
                rest = more if rest is None else pa.concat_tables([rest, more])
            if rest is None or not rest.num_rows:
                continue
            ids = list(zip(*(rest[k].to_pylist() for k in keys)))
            starts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
            ends = [*starts[1:], len(ids)]
            if batch is not None:
                starts, ends = starts[:-1], ends[:-1]
            out = [row for a, b in zip(starts, ends) for row in rows_of(rest.slice(a, b - a))]
            rest = rest.slice(ends[-1]) if ends else rest
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], names=list(kinds))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
