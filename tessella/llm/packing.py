"""Hierarchical packing into windows of several context sizes."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from heapq import heapify, heapreplace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import fields, record_batch, slices
from .scratch import stored
from .token_ids import encoder

TIERS = (512, 1024, 2048, 4096)
#: Pieces that are packed together; what fills no window goes on to the next. Rests of tasks that one task packs.
ROUND, RESTS = 4096, 4096
SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: Words whose ids a worker keeps, and bytes of text whose ids are there at once.
CACHED, SLICE = 300_000, 1 << 20
#: Added to the numbers of sequences and steps of the second pass; tasks have 36 bits for their own.
SECOND, BITS = 1 << 62, 36


class Packer:
    """Packs the pieces of one task. A piece is (length, number, start); ``put`` gets full windows.

    A document goes to the smallest tier that holds it (the largest takes full windows of longer ones first). Each tier's
    window starts with one of its documents; its gap takes the largest whole documents that fit from this and shorter
    tiers, then a cut one. What fills no window is carried over, less than a window of the largest tier; ``divide`` cuts it
    into windows of powers of two.
    """

    def __init__(self, put, tiers=TIERS):
        self.put, self.tiers, self.top = put, sorted(tiers), max(tiers)
        self.rest: list[tuple[int, int, int]] = []

    def add(self, number: int, length: int) -> None:
        start = 0
        while length - start >= self.top:
            self.put([(self.top, number, start)], self.top)
            start += self.top
        if length > start:
            self.rest.append((length - start, number, start))
        if len(self.rest) >= ROUND:
            self.pack()

    def pack(self) -> None:
        pool = sorted(self.rest)
        held: list[tuple[int, int, int]] = []
        for low, size in reversed(list(zip([0, *self.tiers], self.tiers))):
            while pool and pool[-1][0] > low:
                window = [pool.pop()]
                gap = size - window[0][0]
                while gap and pool:
                    at = bisect_right(pool, (gap, 1 << 62, 0))
                    if at:
                        piece = pool.pop(at - 1)
                    else:
                        length, number, start = pool.pop(0)
                        piece = (gap, number, start)
                        insort(pool, (length - gap, number, start + gap))
                    window.append(piece)
                    gap -= piece[0]
                if gap:
                    held += window
                else:
                    self.put(window, size)
        self.rest = held

    def divide(self) -> None:
        left = sum(x[0] for x in self.rest)
        stream = self.rest[::-1]
        size = self.top
        while left:
            while size > left:
                size //= 2
            window, gap = [], size
            while gap:
                length, number, start = stream.pop()
                take = min(gap, length)
                window.append((take, number, start))
                if take < length:
                    stream.append((length - take, number, start + take))
                gap -= take
            left -= size
            self.put(window, size)
        self.rest = []


def balanced(sizes: list[int], step_tokens: int) -> list[int]:
    """A step for each window: the largest windows first, each to the step of the fewest tokens, so that steps have about
    ``step_tokens`` tokens each and windows of all sizes."""
    steps = max(1, round(sum(sizes) / step_tokens))
    heap, out = [(0, k) for k in range(steps)], [0] * len(sizes)
    heapify(heap)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        tokens, out[k] = heap[0]
        heapreplace(heap, (tokens + sizes[k], out[k]))
    return out


class _Sequences:
    """The rows of one task's windows. ``ids``: by number a piece's doc_id, ids, ids not yet in a window, start, and its document's
    number of ids."""

    def __init__(self, base: int):
        self.base, self.ids, self.docs, self.sizes = base, {}, [], []
        self.columns = {name: array("q") for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}

    def put(self, window: list[tuple[int, int, int]], size: int) -> None:
        sequence, offset = len(self.sizes), 0
        self.sizes.append(size)
        for length, number, start in window:
            doc, data, left, own_start, total = self.ids[number]
            self.docs.append(doc)
            values = (own_start + start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), total, sequence, offset)
            for column, value in zip(self.columns.values(), values, strict=True):
                column.append(value)
            offset += length
            if left == length:
                del self.ids[number]
            else:
                self.ids[number] = (doc, data, left - length, own_start, total)

    def rows(self, step_tokens: int) -> Iterator[dict]:
        steps = balanced(self.sizes, step_tokens)
        for k in range(0, len(self.docs), 20_000):
            out = {"doc_id": self.docs[k : k + 20_000]} | {name: list(x[k : k + 20_000]) for name, x in self.columns.items()}
            out["tier"] = [self.sizes[q] for q in out["sequence_id"]]
            out["step_group"] = [self.base + steps[q] for q in out["sequence_id"]]
            out["sequence_id"] = [self.base + q for q in out["sequence_id"]]
            yield out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = 32768) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text) in sequences of at most ``max(tiers)`` tokens, a power of two.

    A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the window's size), step_group
    (windows of all sizes that make about ``step_tokens`` tokens together). Null and empty texts are the end id alone; long
    ones are cut into windows. Repeated rows are packed each for itself; other columns are not looked at; an empty table
    gives no piece.

    Tasks pack their own rows, and the texts are not shuffled. What fills no window of a task, less than one window, is
    packed with the rests of other tasks in a second pass, whose own rests are divided into powers of two: every window is
    full. The rows are stored in between, so a task that runs again changes no other's rows.
    """
    schema = StructType.fromDDL(SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))
    types, with_rest = fields(schema), fields(StructType(schema.fields + StructType.fromDDL("data binary").fields))

    def run(batches):
        enc = encoder(tokenizer_path)
        enc.ids.use(CACHED)
        out, n = _Sequences(TaskContext.get().partitionId() << BITS), 0
        packer = Packer(out.put, tiers)
        for batch in batches:
            for part in slices(batch, most_bytes=SLICE):
                for doc, data in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist(), end_id), strict=True):
                    out.ids[n] = (doc, data, len(data) // 4, 0, len(data) // 4)
                    packer.add(n, len(data) // 4)
                    n += 1
        packer.pack()
        for rows in out.rows(step_tokens):
            yield record_batch(rows | {"data": pa.nulls(len(rows["start"]), pa.binary())}, with_rest)
        if packer.rest:
            rest = [(out.ids[number], length, start) for length, number, start in packer.rest]
            columns = {"doc_id": [x[0] for x, _, _ in rest], "start": [start for *_, start in rest], "length": [n for _, n, _ in rest], "doc_tokens": [x[4] for x, _, _ in rest], "data": [x[1][4 * s : 4 * (s + n)] for x, n, s in rest]}
            yield record_batch({name: columns.get(name, pa.nulls(len(rest), kind)) for name, kind in with_rest}, with_rest)

    def run_rests(batches):
        out, n = _Sequences(SECOND + (TaskContext.get().partitionId() << BITS)), 0
        packer = Packer(out.put, tiers)
        for batch in batches:
            for doc, start, data, total in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "data", "doc_tokens")), strict=True):
                out.ids[n] = (doc, data, len(data) // 4, start, total)
                packer.add(n, len(data) // 4)
                n += 1
        packer.pack()
        packer.divide()
        for rows in out.rows(step_tokens):
            yield record_batch(rows, types)

    first = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, StructType(schema.fields + StructType.fromDDL("data binary").fields))
    first = stored(first, "packing")
    rests = first.where("data is not null").select("doc_id", "start", "data", "doc_tokens")
    tasks = 1 + rests.count() // RESTS
    rests = rests.repartition(tasks, F.xxhash64("data", "start")).sortWithinPartitions("doc_id", "start", "data")
    return first.where("data is null").drop("data").union(rests.mapInArrow(run_rests, schema))
