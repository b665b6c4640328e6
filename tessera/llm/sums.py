"""Sums of numeric arrays over the tasks of a job, in two steps so that no task reads from every other."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import trimmed

_KIND = "part int, own int, y binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["part", "own", "y"])


def summed(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], dtype: type, parts: int = 8) -> dict[int, np.ndarray]:
    """The arrays that `partial` returns for the batches of a task, by part, added up over all tasks."""
    fan = max(1, math.isqrt(df.rdd.getNumPartitions()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() % fan
        for part, y in partial(batches).items():
            yield _batch([(part, own, y.astype(dtype).tobytes())])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, own, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by[part, own] = by.get((part, own), 0) + np.frombuffer(y, dtype)
        yield _batch([(*k, y.tobytes()) for k, y in by.items()])

    some = df.mapInArrow(trimmed(first), _KIND).repartition(parts * fan, "part", "own").mapInArrow(trimmed(total), _KIND)
    rows = some.withColumn("own", F.lit(0)).repartition(parts, "part").mapInArrow(trimmed(total), _KIND).collect()
    return {r.part: np.frombuffer(r.y, dtype) for r in rows}
