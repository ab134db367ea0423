"""A filter of keys: two bits for each, set in tasks, merged in parts and sent to all tasks. What it lets through by chance is for
the join that follows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import gather
from .arrow import fields, record_batch
from .words import mixed


def _places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(keys.astype(np.int64).view(np.uint64))
    return (h % np.uint64(size)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def marked(keys: DataFrame, size: int) -> np.ndarray:
    """A filter of ``size`` bits, packed, that holds all values of the only column (long, no nulls) of ``keys``."""
    types = fields(StructType.fromDDL(gather.SCHEMA))

    def mark(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False), size):
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        if told := gather.parts(bits):
            yield record_batch({"part": [k for k, _ in told], "data": [x for _, x in told]}, types)

    return gather.merged(keys.mapInArrow(mark, gather.SCHEMA), size // 8, "u1", np.bitwise_or)


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` the filter may hold; all that it does hold are among them."""
    a, b = _places(keys, 8 * len(bits))
    return ((bits[a >> 3] >> (a & 7)) & (bits[b >> 3] >> (b & 7)) & 1).astype(bool)
