"""Fixed-size arrays that tasks fill and that are merged before the driver sees them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import fields, record_batch

#: An array travels in so many parts.
PARTS = 64
SCHEMA = "part int, data binary"


def parts(array: np.ndarray) -> list[tuple[int, bytes]]:
    """The parts of a task's array that are not all zero."""
    return [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(np.split(array, PARTS)) if x.any()]


def merged(rows: DataFrame, size: int, dtype: str, merge: Callable = np.add) -> np.ndarray:
    """The arrays of all tasks (rows of ``SCHEMA``) merged by ``merge``. Each task streams through some of the parts and holds
    one sum for each; the driver gets every part once."""
    types = fields(StructType.fromDDL(SCHEMA))

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(data), dtype)
                sums[k] = merge(sums[k], x) if k in sums else x
        if sums:
            yield record_batch({"part": list(sums), "data": [zlib.compress(x.tobytes(), 1) for x in sums.values()]}, types)

    out = np.zeros(size, dtype)
    each = size // PARTS
    for r in rows.select("part", "data").repartition("part").mapInArrow(run, SCHEMA).collect():
        out[r.part * each : (r.part + 1) * each] = np.frombuffer(zlib.decompress(r.data), dtype)
    return out
