"""Texts to Python and columns back, by Arrow batches of bounded size; ids pass through untouched, nulls included."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Texts of so many bytes, or so many rows, are in Python at once.
MOST_BYTES, MOST_ROWS = 3 << 20, 4096


def fields(schema: StructType) -> list[tuple[str, pa.DataType]]:
    return [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]


def record_batch(columns: dict[str, list | pa.Array], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    arrays = [c if isinstance(c := columns[name], pa.Array) else pa.array(c, kind) for name, kind in types]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in types])


def slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose ``column`` (string or binary) has a bounded size, or a single row."""
    start, size = 0, 0
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= most_bytes or i + 1 - start >= MOST_ROWS:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(lengths):
        yield batch.slice(start)


def map_column(df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[list], dict[str, list]]]) -> DataFrame:
    """All columns but ``column`` stay; ``make()``, once a task, gives the function from values of ``column`` to the columns
    of ``schema``."""
    kept = [f for f in df.schema.fields if f.name != column]
    out = StructType(kept + StructType.fromDDL(schema).fields)
    types, names = fields(out), [f.name for f in kept]

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, column):
                yield record_batch({n: part.column(n) for n in names} | work(part.column(column).to_pylist()), types)

    return df.mapInArrow(run, out)
