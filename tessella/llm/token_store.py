"""Token ids in files of separately compressed documents with one shared zstandard dictionary.

A file: ``TIDS`` and a version byte, the dictionary's sha256 (32 bytes), the frames one after another, the index, then the
index's offset and the number of documents (two little-endian 64-bit integers). The index has for each document its id
(the least integer if it has none), its frame's offset and size, and its number of ids, with bit 62 set if it has no id of
its own: four little-endian 64-bit integers. The dictionary is a file beside
them, named by its hash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import MOST_BYTES, fields, record_batch, slices
from .scratch import fresh_path, stored
from .token_ids import encoder
from .words import word_hash

MAGIC = b"TIDS\x02"
#: The dictionary learns from this many documents at most, those of the smallest hashes, and of each from one run of this many
#: bytes, wherever a hash of the document puts it. Only the ratio of compression depends on them.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1500, 32_768, 112_640
#: Bytes of a file, and of texts in a range of doc_id that a task writes.
FILE_BYTES, RANGE_BYTES = 32 << 20, 256 << 20
#: Words whose ids a worker keeps.
CACHED = 800_000
#: Tasks whose files are added up together.
GROUP = 1024
#: In the index, added to the number of ids of a document without an id of its own.
NO_ID = 1 << 62


def file_system(uri: str):
    """A pyarrow file system and the path in it; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def chunk(ids: bytes, name: int) -> bytes:
    """SAMPLE_BYTES of a document's ids, or all; where they start depends on ``name``."""
    spare = len(ids) // 4 - SAMPLE_BYTES // 4
    start = 4 * (word_hash(str(name).encode()) % (spare + 1)) if spare > 0 else 0
    return ids[start : start + SAMPLE_BYTES]


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int) -> bytes:
    """A dictionary from serialized id arrays of a bounded sample; empty if there is too little to learn from."""
    import zstandard

    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    few = min((1 << 63) - 1, 4 * SAMPLE_DOCS * (1 << 63) // max(1, docs.count()))  # hashes of some four times as many documents
    names = docs.where(place <= few).select("doc_id").distinct().orderBy(place, "doc_id").limit(SAMPLE_DOCS)
    sample = docs.join(F.broadcast(names), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    types = [("doc_id", pa.int64()), ("ids", pa.binary())]

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                names = part.column("doc_id").to_pylist()
                ids = encoder(tokenizer_path).encode(part.column("text").to_pylist(), end_id)
                yield record_batch({"doc_id": names, "ids": [chunk(x, n) for x, n in zip(ids, names, strict=True)]}, types)

    rows = sample.select("doc_id", "text").mapInArrow(cut, "doc_id long, ids binary").orderBy("doc_id").collect()
    try:
        return zstandard.train_dictionary(DICT_BYTES, [bytes(r.ids) for r in rows], level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(data: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(data) if data else None
    if shared:
        shared.precompute_compress(level=3)  # else each document would digest the dictionary anew
    return zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True), zstandard.ZstdDecompressor(dict_data=shared)


class Writer:
    """Writes one file; it appears under its name only when it is whole."""

    def __init__(self, uri: str, dictionary: bytes):
        self.fs, self.path = file_system(uri)
        self.out = self.fs.open_output_stream(f"{self.path}.part")
        self.pack = _codec(dictionary)[0]
        self.index, self.at, self.ids = [], 0, 0
        self._put(MAGIC + hashlib.sha256(dictionary).digest())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.pack.compress(ids)
        name, extra = (-(1 << 63), NO_ID) if doc_id is None else (doc_id, 0)
        self.index.append((name, self.at, len(frame), len(ids) // 4 + extra))
        self.ids += len(ids) // 4
        self._put(frame)

    def close(self) -> None:
        start = self.at
        self._put(np.array(self.index, "<i8").tobytes())
        self._put(struct.pack("<qq", start, len(self.index)))
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)


class Reader:
    """Documents of one file by position or by id, without reading the others."""

    def __init__(self, uri: str, dictionary: bytes):
        self.fs, path = file_system(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        if self.file.read_at(32, len(MAGIC)) != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        start, n = struct.unpack("<qq", self.file.read_at(16, size - 16))
        self.index = np.frombuffer(self.file.read_at(32 * n, start), "<i8").reshape(n, 4)
        self.unpack = _codec(dictionary)[1]

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, k: int) -> bytes:
        _, at, size, n = self.index[k].tolist()
        data = self.unpack.decompress(self.file.read_at(size, at))
        if len(data) != 4 * (n & NO_ID - 1):
            raise ValueError("a document has another length than its index says")
        return data

    def doc_id(self, k: int) -> int | None:
        return None if self.index[k, 3] & NO_ID else int(self.index[k, 0])

    def find(self, doc_id: int) -> list[int]:
        """Positions of a document; files are in ascending order of ids."""
        names = self.index[:, 0]
        k, out = bisect_left(names, doc_id), []
        while k < len(names) and names[k] == doc_id:
            out += [k] * (self.doc_id(k) is not None)
            k += 1
        return out


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1) -> tuple[str, DataFrame]:
    """Write ``docs`` (doc_id integer, text) in ascending order of doc_id as files in ``folder``; the dictionary's path and
    the manifest (file, docs, ids, first: ids in files before it).

    Texts are shuffled once, by ranges of doc_id (and of text, where one id has many rows) as many as the table's size
    asks for. A task that runs again writes the same files again under names of its own attempt, and only the attempt that
    ended is in the manifest, which is a stored table: its sums are built up over groups of tasks, then within each.
    """
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("doc_id must be an integer")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    data = train_dictionary(rows, tokenizer_path, end_id)
    dict_uri = f"{folder}/{hashlib.sha256(data).hexdigest()}.dict"
    fs, path = file_system(dict_uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)
    shared = spark.sparkContext.broadcast(data)

    def run(batches):
        task, made, now = TaskContext.get(), [], None
        encoder(tokenizer_path).ids.use(CACHED)

        def end():
            now[1].close()
            made.append((task.partitionId(), len(made), now[0], len(now[1].index), now[1].ids))

        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder(tokenizer_path).encode(texts, end_id), strict=True):
                    if now is None:
                        uri = f"{folder}/{task.partitionId():06d}-{len(made):04d}-{task.taskAttemptId()}.tids"
                        now = (uri, Writer(uri, shared.value))
                    now[1].add(doc_id, ids)
                    if now[1].at >= FILE_BYTES:
                        end()
                        now = None
        if now is not None:
            end()
        if made:
            yield record_batch(dict(zip(("task", "nth", "file", "docs", "ids"), map(list, zip(*made)), strict=True)), types)

    schema = StructType.fromDDL("task int, nth int, file string, docs long, ids long")
    types = fields(schema)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // RANGE_BYTES, 1 << 20))
    order = ["doc_id", F.crc32("text"), F.octet_length("text")]
    dealt = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(n, *order, "nth")  # equal rows may part
    made = dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, schema)
    made = stored(made, "token-manifest").withColumn("group", F.floor(F.col("task") / GROUP))
    before = lambda column, *within: F.coalesce(F.sum("ids").over(Window.partitionBy(*within).orderBy(*column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = made.groupBy("group").agg(F.sum("ids").alias("ids")).select("group", before(["group"]).alias("outer"))
    manifest = made.withColumn("inner", before(["task", "nth"], "group")).join(groups, "group")
    return dict_uri, manifest.select("file", "docs", "ids", (F.col("outer") + F.col("inner")).cast("long").alias("first"))


def read(manifest: DataFrame, dict_uri: str, digests: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary), or with ``digests`` ids_crc32, of every
    document, a task for each file."""
    value = zlib.crc32 if digests else bytes

    def run(batches):
        fs, path = file_system(dict_uri)
        with fs.open_input_file(path) as f:
            data = f.read()
        for batch in batches:
            for uri, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                file, out, size = Reader(uri, data), [], 0
                for k in range(len(file)):
                    ids = file.ids(k)
                    out.append((file.doc_id(k), first, len(ids) // 4, value(ids)))
                    first, size = first + len(ids) // 4, size + len(ids)
                    if size >= MOST_BYTES or k + 1 == len(file):
                        yield record_batch(dict(zip((name for name, _ in types), map(list, zip(*out)), strict=True)), types)
                        out, size = [], 0

    schema = StructType.fromDDL("doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids binary"))
    types = fields(schema)
    files = min(max(1, manifest.count()), 1 << 16)
    return manifest.repartitionByRange(files, "first").mapInArrow(run, schema)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write every row of ``docs`` as files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone; rows without doc_id come first; equal ids are in the order of their texts'
    hashes; repeated rows are documents of their own; long texts are one frame each; other columns are not looked at; an
    empty table gives no file and no row; ids that are no integers are an error.
    """
    dict_uri, manifest = write(docs, fresh_path(spark, "token-ids"), tokenizer_path, end_id)
    return read(manifest, dict_uri, digests=True)
