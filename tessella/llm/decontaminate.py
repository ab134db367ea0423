"""Benchmark passages in documents, by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import fields, map_column, record_batch, slices
from .marks import holds, marked
from .scratch import free_names, stored
from .words import hashes, release, run_hashes

#: Words of a window, of a k-gram, and k-grams of which the least hash is kept: WINDOW = GRAM + SPAN - 1.
WINDOW, GRAM, SPAN = 13, 5, 9
#: A benchmark of so many bytes goes to tasks whole; fingerprints of a larger one meet those of documents in a join.
WHOLE_BYTES = 16 << 20
#: Bits of the filter of a larger benchmark's fingerprints: so many for each, but never more or less than these.
MARKED, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: A fingerprint is hot if more than one in HOT of the rows to be joined have it, so there are fewer than HOT; parts of a hot one.
HOT, SALTS = 1000, 64

# Bytes that are no word (below 0x80, but for digits and letters) become spaces; A-Z become a-z.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def least(grams: np.ndarray) -> np.ndarray:
    """For every ``SPAN`` consecutive hashes the position of the least, the last of equal ones; positions never fall.

    Any ``WINDOW`` words that two texts share have the same ``SPAN`` hashes, so both keep the same position of them.
    """
    if len(grams) < SPAN:
        return np.empty(0, np.int64)
    spans = np.lib.stride_tricks.sliding_window_view(grams, SPAN)[:, ::-1]
    return np.arange(len(spans)) + SPAN - 1 - spans.argmin(axis=1)


def winnow(grams: np.ndarray) -> np.ndarray:
    """The positions that any ``SPAN`` consecutive hashes keep."""
    return np.unique(least(grams))


class Items:
    """A whole benchmark: its fingerprints, and the hashes of its windows by the number of words."""

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        self.names = [name for name, _ in items]
        prints, windows = [], {}
        for k, (_, h) in enumerate(items):
            size = min(WINDOW, len(h))
            if size == WINDOW:
                grams = run_hashes(h, GRAM)
                prints.append(grams[winnow(grams)])
            hs = np.unique(run_hashes(h, size))
            windows.setdefault(size, []).append((hs, np.full(len(hs), k)))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)
        self.windows = {}
        for size, parts in windows.items():
            hs, ks = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ks, hs))
            self.windows[size] = (hs[order], ks[order])

    def find(self, h: np.ndarray) -> tuple[np.ndarray | None, set[str]]:
        """Which of a document's words are hit (None: none), and the items found."""
        hit, found = None, set()
        for size, (hs, ks) in self.windows.items():
            if size == WINDOW:
                grams = run_hashes(h, GRAM)
                at = winnow(grams)
                at = at[_in(grams[at], self.prints)]
                if not len(at):
                    continue
                starts = np.unique((at[:, None] - np.arange(SPAN)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(h) - WINDOW)]
                grams = run_hashes(h, WINDOW)[starts]
            else:
                grams = run_hashes(h, size)
                starts = np.arange(len(grams))
            if not len(grams):
                continue
            here = _in(grams, hs)
            if not here.any():
                continue
            hit = np.zeros(len(h) + 1, np.int64) if hit is None else hit
            np.add.at(hit, starts[here], 1)
            np.add.at(hit, starts[here] + size, -1)
            own = np.unique(grams[here])
            for lo, hi in zip(np.searchsorted(hs, own), np.searchsorted(hs, own, "right"), strict=True):
                found.update(self.names[k] for k in ks[lo:hi])
        return (None if hit is None else np.cumsum(hit)[:-1] > 0), found


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def whole(benchmark: DataFrame) -> Items | None:
    """The benchmark, if it has at most ``WHOLE_BYTES``; items without words are left out."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("item_id") + F.octet_length("text") + 16)).first()[0] or 0) > WHOLE_BYTES:
        return None
    return Items([(name, h) for name, text in items.collect() if len(h := hashes(words(text)))])


def hits(text: str, items: Items) -> tuple[int, np.ndarray, set[str]]:
    """The number of a text's words, those that are hit, and the items found."""
    h = hashes(words(text))
    hit, found = items.find(h)
    return len(h), np.empty(0, np.int64) if hit is None else np.flatnonzero(hit), found


def contaminates(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _told(n_words: int, n_hit: int, found) -> tuple:
    return n_words, n_hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), contaminates(n_words, n_hit)


_TOLD = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_()}


def _columns(rows: list[tuple]) -> dict[str, pa.Array]:
    return {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(_TOLD.items())}


def _windows(benchmark: DataFrame) -> DataFrame:
    """size, key, window, item_id of the windows of all items: words, fingerprint (of a short item: its window), hash."""
    schema = StructType.fromDDL("size int, key long, window long, item_id string")
    types = fields(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                for name, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    h = hashes(words(text))
                    if not len(h):
                        continue
                    size = min(WINDOW, len(h))
                    own = run_hashes(h, size)
                    grams = run_hashes(h, GRAM)
                    keys = grams[least(grams)] if size == WINDOW else own
                    n = len(own)
                    yield record_batch({"size": [size] * n, "key": pa.array(keys.view(np.int64)), "window": pa.array(own.view(np.int64)), "item_id": [name] * n}, types)

    return _items(benchmark).mapInArrow(run, schema)


def prints(h: np.ndarray, sizes: list[int], bits: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """size, key, start, windows of a document's fingerprints that the filter may hold: the windows from word ``start`` on that
    kept the fingerprint. A short run of words is a fingerprint of its own."""
    for size in sizes:
        own = run_hashes(h, size)
        if not len(own):
            continue
        if size < WINDOW:
            first = np.arange(len(own) + 1)
            keys = own
        else:
            grams = run_hashes(h, GRAM)
            at = least(grams)
            first = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
            keys = grams[at[first[:-1]]]
        for k in np.flatnonzero(holds(bits, keys)):
            yield size, keys[k], first[k], own[first[k] : first[k + 1]]


def _candidates(rows: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """doc_id, text_hash, n_words, size, key, start, windows: :func:`prints` of ``rows`` (doc_id, text_hash, text)."""
    kept = [rows.schema["doc_id"], rows.schema["text_hash"]]
    schema = StructType(kept + StructType.fromDDL("n_words long, size int, key long, start long, windows array<long>").fields)
    types, shared = fields(schema), rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        release()
        for batch in batches:
            for part in slices(batch):
                at, n_words, found = [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    h = hashes(words(text))
                    for row in prints(h, sizes, shared.value):
                        at.append(k)
                        n_words.append(len(h))
                        found.append(row)
                if found:
                    size, keys, starts, windows = zip(*found, strict=True)
                    offsets = np.append(0, np.cumsum([len(w) for w in windows])).astype(np.int32)
                    told = {"n_words": n_words, "size": size, "key": pa.array(np.array(keys, np.uint64).view(np.int64)), "start": pa.array(np.array(starts, np.int64))}
                    told["windows"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(windows).view(np.int64)))
                    yield record_batch(told | {c.name: part.column(c.name).take(pa.array(at, pa.int64())) for c in kept}, types)

    return rows.mapInArrow(run, schema)


def _by_join(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash and the result columns of the distinct rows of ``rows`` (doc_id, text_hash, text) that are hit.

    Fingerprints of items and documents are made in tasks. A filter of the items' fingerprints, of at most ``MOST_BITS``, goes
    to the tasks that read documents; what passes is stored, and joined with the fingerprints themselves. Then windows that
    kept a common fingerprint are compared. Fingerprints that more than one in ``HOT`` of these rows have are dealt over
    ``SALTS`` parts of the join. Items that share a window are known by a hash of their names, and each combination of
    such sets that some document has is spelt out once, so a passage of many items in many documents makes no pairs of them; the
    names of all items of one document do meet in one row, as its hash of them needs.
    """
    items = stored(_windows(benchmark), "benchmark-windows")
    keys = items.select("key").distinct()
    size = min(max(LEAST_BITS, 1 << (MARKED * keys.count()).bit_length()), MOST_BITS)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # 13 at most
    found = stored(_candidates(rows, sizes, marked(keys, size)), "fingerprints")

    total = found.count()
    hot = [r[0] for r in found.groupBy("key").count().where(F.col("count") * HOT > total).select("key").collect()]  # fewer than HOT
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    salts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    found = found.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")).otherwise(0))

    names = items.distinct().groupBy("size", "key", "window").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item_id")).alias("a"), F.bit_xor(F.xxhash64("item_id", F.lit(1))).alias("b"))
    sets = stored(names.select("size", "key", "window", F.concat_ws(":", "n", "a", "b").alias("items")), "benchmark-sets")
    common = found.join(sets.select("size", "key").distinct().withColumn("salt", salts), ["size", "key", "salt"], "left_semi")
    common = common.select("doc_id", "text_hash", "n_words", "size", "key", "salt", "start", F.posexplode("windows").alias("after", "window"))
    hit = common.join(sets.withColumn("salt", salts), ["size", "key", "window", "salt"]).select("doc_id", "text_hash", "n_words", "items", (F.col("start") + F.col("after")).alias("start"), (F.col("start") + F.col("after") + F.col("size")).alias("end"))

    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    docs = hit.withColumn("new", F.greatest(new, F.lit(0))).groupBy("doc_id", "text_hash").agg(F.first("n_words").alias("n_words"), F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("items")).alias("sets"))
    docs = stored(docs.withColumn("combination", F.sha2(F.array_join("sets", ","), 256)), "hit-documents")

    spelt = sets.groupBy("items").agg(F.min(F.struct("size", "key", "window")).alias("one")).select("items", "one.*").join(items, ["size", "key", "window"]).select("items", "item_id").distinct()
    every = docs.groupBy("combination").agg(F.first("sets").alias("sets")).select("combination", F.explode("sets").alias("items")).join(spelt, "items").select("combination", "item_id").distinct()
    told = every.groupBy("combination").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    bad = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return docs.join(told, "combination").select("doc_id", "text_hash", "n_words", "n_hit", "n_items", "items_sha256", bad.alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs`` (doc_id, text).

    A word is hit if it lies in an occurrence of a window: 13 consecutive words of an item of ``benchmark`` (item_id, text),
    or all words of a shorter one. Null and empty texts have no words and are clean; long texts are looked at whole; items
    without words are nowhere; repeated items count once by item_id, and an item without id as one named by the empty
    string; repeated rows give repeated results; other columns are not looked at; an empty table gives an empty table, and
    an empty benchmark clean documents.

    A benchmark of up to WHOLE_BYTES goes to the tasks whole, and nothing is shuffled. Fingerprints of a larger one are joined with
    those of the documents (see ``_by_join``). Equal windows are told by 64 bits of a hash: among d windows of documents and
    b of items about d * b / 2 ** 64 are wrongly equal.
    """
    items = whole(benchmark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if items is None:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))

        def unhit(texts):
            return _columns([_told(len(words(t)), 0, ()) for t in texts])

        plain = map_column(rows, "text", "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", lambda: unhit)
        both = plain.alias("p").join(_by_join(rows, benchmark).alias("f"), F.col("p.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("p.text_hash") == F.col("f.text_hash")), "left")
        return both.select(F.col("p.doc_id").alias("doc_id"), *[F.coalesce(f"f.{c}", f"p.{c}").alias(c) for c in _TOLD])
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def work(texts):
        out = []
        for t in texts:
            n_words, at, found = hits(t, shared.value)
            out.append(_told(n_words, len(at), found))
        return _columns(out)

    return map_column(rows, "text", "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", lambda: work)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, by the rule of :func:`contamination`; all columns stay as they are.

    Null and empty texts stay; texts of any length are looked at whole; repeated rows stay or go together; all columns stay,
    whatever their names; an empty table gives an empty table.
    """
    own_id, own_hash = free_names(docs, 2)
    items = whole(benchmark)
    if items is None:
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
        bad = _by_join(rows, benchmark).where("contaminated").select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
        same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own_hash))
        return docs.join(bad, same, "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        release()
        for batch in batches:
            for part in slices(batch):
                found = (hits(t or "", shared.value) for t in part.column("text").to_pylist())
                yield part.filter(pa.array([not contaminates(n_words, len(at)) for n_words, at, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
