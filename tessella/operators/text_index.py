"""A BM25 index that is kept: posting lists in blocks with bounds, added to and taken from, searched without most of its blocks.

What a task reads is dealt to ranges of RANGE documents in the order of their length, equal lengths by a hash of a few of their terms,
so that those of a range are alike. A *block* is a term's postings in one range, with its peaks: the counts and lengths of those postings that
none of the block outdoes in both, one of which weighs most whatever the average length. So a query's bounds of a range add up to a
bound of every document in it, and ranges that cannot reach the k-th score are not scored. That score is bounded from below by the
rarest terms of the query, whose blocks are read first.

Ranges in a row are a *piece*, whose blocks a task makes at once: a row has a term's blocks of one piece. A search deals out the
rows of its terms by piece, so that bounds and scores of a piece are products of matrices, and only the best leave the task.

What is added is a segment of its own; documents that go are listed, and their counts taken from the statistics. Counts and lengths
are kept, not weights, so nothing that was written changes when the corpus does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.scratch import stored
from .best import Best
from .bm25 import DOCS_AT_ONCE, QUERY_BLOCK, Bm25, idf, top, weights
from .ranks import numbered

#: Documents of a range; ranges of a piece at most, and terms with which one ends; folders by which blocks are found by term;
#: postings of a query that are read for its first bound.
RANGE, RANGES, PIECE_TERMS, BUCKETS, FIRST = 16, 256, 1 << 20, 32, 4096
#: Scores that round to the same nine digits may differ by this much.
SLACK = 1e-8
#: A term's blocks of a piece: the places of documents in the piece, their counts, and by range the peaks. The row of the piece
#: itself has no term but its documents and their lengths. ``n``: documents of the row.
ROW = "term string, piece long, slots array<int>, tfs array<int>, peak_ranges array<int>, peak_tfs array<int>, peak_dls array<int>, docs array<long>, dls array<int>, n int"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ROW from documents (doc_id, ts) in order."""
    held, docs, terms, piece = [], 0, 0, TaskContext.get().partitionId() << 33
    for batch in batches:
        ends = np.cumsum(batch.column("ts").value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            some = min(RANGE - docs % RANGE, batch.num_rows - at)
            held.append(batch.slice(at, some))
            terms += int(ends[at + some - 1] - (ends[at - 1] if at else 0))
            docs, at = docs + some, at + some
            if docs == RANGES * RANGE or docs % RANGE == 0 and terms >= PIECE_TERMS:
                yield _piece(held, piece)
                held, docs, terms, piece = [], 0, 0, piece + 1
    if held:
        yield _piece(held, piece)


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The lists that begin at ``starts``."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _piece(held: list[pa.RecordBatch], piece: int) -> pa.RecordBatch:
    whole = pa.Table.from_batches(held).combine_chunks()
    ids, ts = (whole.column(c).chunk(0) for c in ("doc_id", "ts"))
    dl = ts.value_lengths().to_numpy(zero_copy_only=False)
    kinds = ts.flatten().dictionary_encode()
    pair, tf = np.unique(kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    code, slot = pair // len(dl), pair % len(dl)
    n = len(kinds.dictionary)
    block = code * RANGES + slot // RANGE
    order = np.lexsort((-tf, dl[slot], block))  # the shortest of a block first; a peak has more than all before it
    outdone = np.maximum.accumulate(block[order] * (1 << 32) + tf[order])
    peak = order[np.flatnonzero(np.diff(outdone, prepend=-1))]
    rows, tops = np.searchsorted(code, np.arange(n)), np.searchsorted(code[peak], np.arange(n))
    ints = {"slots": (slot, rows), "tfs": (tf, rows), "peak_ranges": (slot[peak] // RANGE, tops), "peak_tfs": (tf[peak], tops), "peak_dls": (dl[slot[peak]], tops)}
    none = lambda kind, k: pa.nulls(k, pa.list_(kind))
    columns = {"term": pa.concat_arrays([kinds.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]), "piece": pa.array(np.full(n + 1, piece), pa.int64())}
    columns |= {c: pa.concat_arrays([_lists(x, at, pa.int32()), none(pa.int32(), 1)]) for c, (x, at) in ints.items()}
    columns["docs"] = pa.concat_arrays([none(pa.int64(), n), pa.ListArray.from_arrays([0, len(ids)], ids.cast(pa.int64()))])
    columns["dls"] = pa.concat_arrays([none(pa.int32(), n), _lists(dl, np.zeros(1, np.int64), pa.int32())])
    columns["n"] = pa.array(np.append(np.diff(rows, append=len(pair)), len(dl)), pa.int32())
    return pa.RecordBatch.from_pydict(columns)


def _flat(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    """The row of each element of lists of equal lengths, and the elements."""
    lists = [rows.column(c).combine_chunks() for c in columns]
    own = np.repeat(np.arange(len(rows)), lists[0].value_lengths().to_numpy(zero_copy_only=False))
    return [own, *[x.flatten().to_numpy(zero_copy_only=False) for x in lists]]


def _asked_blocks(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the queries of a piece's rows (asks: qid, side, least), some at once: their ids, least scores, the rows that have a term of
    theirs, and each row's factor for each."""
    asks = rows.column("asks").combine_chunks()
    own = np.repeat(np.arange(len(rows)), asks.value_lengths().to_numpy(zero_copy_only=False))
    asks = asks.flatten()
    side, least = (asks.field(c).to_numpy(zero_copy_only=False) for c in ("side", "least"))
    qids, first, at = np.unique(asks.field("qid").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    order = np.argsort(at, kind="stable")
    for lo in range(0, len(qids), QUERY_BLOCK):
        some = qids[lo : lo + QUERY_BLOCK]
        a, b = np.searchsorted(at[order], [lo, lo + len(some)])
        used, row = np.unique(own[order[a:b]], return_inverse=True)
        sides = np.zeros((len(used), len(some)))
        sides[row, at[order[a:b]] - lo] = side[order[a:b]]
        yield some, least[first[lo : lo + QUERY_BLOCK]], used, sides


def _open(rows: pa.Table, average: float, model: Bm25) -> Iterator[tuple]:
    """What :func:`_asked_blocks` has, and whether each range (rows of the matrix) may have one of a query's best, by the peaks; how
    many blocks of each range are of a query's terms."""
    row, at, tf, dl = _flat(rows, "peak_ranges", "peak_tfs", "peak_dls")
    block = row * RANGES + at
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    most = np.maximum.reduceat(weights(tf.astype(float), dl.astype(float), average, model), starts)
    row, at = row[starts], at[starts]
    for qids, least, used, sides in _asked_blocks(rows):
        place = np.full(len(rows), -1)
        place[used] = np.arange(len(used))
        mine = place[row] >= 0
        tops = np.zeros((RANGES, len(used)))
        tops[at[mine], place[row[mine]]] = most[mine]
        bound = tops @ sides
        yield qids, used, sides, (bound > 0) & ~(bound < least - SLACK), (tops > 0).astype(float) @ (sides > 0)


def _ranked(rows: pa.Table, docs: pa.Table, average: float, k: int, model: Bm25) -> pa.Table:
    """qid, doc_id, score of the best of a piece, from rows of terms and the documents (slot, doc_id, dl) that are ranked."""
    found = []
    if len(rows) and len(docs):
        slots = docs.column("slot").to_numpy()
        ids, dls, ranked = np.zeros(RANGES * RANGE, np.int64), np.ones(RANGES * RANGE), np.zeros(RANGES * RANGE, bool)
        ids[slots], dls[slots], ranked[slots] = docs.column("doc_id").to_numpy(), docs.column("dl").to_numpy(), True
        row, slot, tf = _flat(rows, "slots", "tfs")
        order = np.argsort(slot, kind="stable")
        order = order[ranked[slot[order]]]
        row, slot = row[order], slot[order]
        weight = weights(tf[order].astype(float), dls[slot], average, model)
        for qids, used, sides, open_, _ in _open(rows, average, model):
            best = Best(len(qids), k)
            place = np.full(len(rows), -1)
            place[used] = np.arange(len(used))
            for at in range(0, RANGES * RANGE, DOCS_AT_ONCE):
                ranges = np.repeat(open_[at // RANGE : (at + DOCS_AT_ONCE) // RANGE], RANGE, axis=0)
                if not ranges.any():
                    continue
                lo, hi = np.searchsorted(slot, [at, at + DOCS_AT_ONCE])
                mine = np.flatnonzero(place[row[lo:hi]] >= 0) + lo
                some = np.zeros((DOCS_AT_ONCE, len(used)))
                some[slot[mine] - at, place[row[mine]]] = weight[mine]
                best.add(ids[at : at + DOCS_AT_ONCE], np.where(ranges, np.round(some @ sides, 9), 0.0).T, 0.0)
            found.append((qids[best.at], best.ids, best.scores))
    qid, doc, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"qid": pa.array(qid, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.float64())})


@dataclass(frozen=True)
class TextIndex:
    """The index in the folder ``path``: ``blocks``, ``terms`` (changes of document frequencies), ``gone`` and, written last of each
    segment, ``segments`` (its number and changes of the counts). Only segments that are listed there are read."""

    spark: SparkSession
    path: str
    model: Bm25

    @staticmethod
    def create(docs: DataFrame, path: str, model: Bm25 = Bm25()) -> TextIndex:
        """A new index of ``docs`` (doc_id, text); ids are integers. An index that is there already is an error."""
        spark = docs.sparkSession
        spark.createDataFrame([tuple(asdict(model).values())], "k1 double, b double, idf_side string").write.parquet(f"{path}/model")
        made = TextIndex(spark, path, model)
        made.add(docs)
        return made

    @staticmethod
    def open(spark: SparkSession, path: str) -> TextIndex:
        return TextIndex(spark, path, Bm25(**spark.read.parquet(f"{path}/model").first().asDict()))

    def segments(self) -> DataFrame:
        return self.spark.read.schema("segment int, n_docs long, total_len long").parquet(f"{self.path}/segments")

    def _listed(self) -> list[int]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        there = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        return [r.segment for r in self.segments().select("segment").collect()] if there else []

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("segment").isin(self._listed()))

    def _rows(self) -> DataFrame:
        return self._read("blocks", f"{ROW}, segment int, bucket int")

    def blocks(self) -> DataFrame:
        """The rows of terms."""
        return self._rows().where(F.col("bucket") < BUCKETS).drop("docs", "dls")

    def documents(self) -> DataFrame:
        """segment, piece, slot, doc_id, dl of all documents that are not gone."""
        each = self._rows().where(F.col("bucket") == BUCKETS).select("segment", "piece", F.posexplode(F.arrays_zip("docs", "dls")).alias("slot", "d"))
        there = each.select("segment", "piece", "slot", F.col("d.docs").alias("doc_id"), F.col("d.dls").alias("dl")).join(self.gone(), "doc_id", "left")
        return there.where("until is null or until < segment").drop("until")

    def gone(self) -> DataFrame:
        """doc_id and until: documents of segments up to that one are gone."""
        return self._read("gone", "doc_id long, segment int").groupBy("doc_id").agg(F.max("segment").alias("until"))

    def statistics(self) -> DataFrame:
        """One row: n_docs, total_len, avg_len, of all segments together."""
        s = self.segments().agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
        return s.withColumn("avg_len", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(0.0))

    def vocabulary(self) -> DataFrame:
        """term, term_id, df. A term has the id that its first segment gave it; terms in no document any more keep theirs."""
        return self._read("terms", "term string, term_id long, df long, segment int").groupBy("term").agg(F.min("term_id").alias("term_id"), F.sum("df").alias("df"))

    def add(self, docs: DataFrame) -> int:
        """The documents become a segment, found from the moment at which it is listed; its number. Nothing written is read but the
        terms, whose ids stay; new terms are numbered after them, the most frequent first. A stopped call leaves nothing that is
        read; repeated ids are documents of their own; null texts count as empty ones."""
        number = max(self._listed(), default=-1) + 1
        ts = docs.select("doc_id", tokens(F.col("text")).alias("ts")).withColumn("size", F.floor(F.log2(1.0 + F.size("ts")) * 4))
        ts = ts.withColumn("like", F.array_min(F.transform("ts", lambda t: F.xxhash64(t)))).sortWithinPartitions("size", "like", "doc_id")
        rows = ts.select("doc_id", "ts").mapInArrow(_pieces, ROW).withColumn("segment", F.lit(number))
        rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), BUCKETS).otherwise(_bucket(F.col("term"))))
        rows.repartition("bucket", F.shiftright("piece", 33) % 16).sortWithinPartitions("segment", "bucket", "term", "piece").write.mode("append").partitionBy("segment", "bucket").parquet(f"{self.path}/blocks")
        written = self.spark.read.schema(f"{ROW}, segment int, bucket int").parquet(f"{self.path}/blocks").where(f"segment = {number}")
        new = stored(written.where(F.col("bucket") < BUCKETS).groupBy("term").agg(F.sum("n").alias("df")))
        if number:
            known = self.vocabulary()
            last = known.agg(F.max("term_id")).first()[0] or 0
            fresh = numbered(new.join(known, "term", "left_anti"), "df", "term", "term_id").withColumn("term_id", F.col("term_id") + last)
            terms = fresh.select("term", "term_id", "df").unionByName(new.join(known.select("term", "term_id"), "term").select("term", "term_id", "df"))
        else:
            terms = numbered(new, "df", "term", "term_id").select("term", "term_id", "df")
        self._write("terms", number, terms)
        self._write("gone", number, self.spark.createDataFrame([], "doc_id long"))
        own = written.where(F.col("bucket") == BUCKETS).select("n", F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x).alias("len"))
        lengths = own.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("total_len"))
        self._write("segments", number, lengths)
        return number

    def remove(self, docs: DataFrame) -> int:
        """The documents (doc_id, text as it was when they were added) go, by a segment that takes their counts back; its number.
        What is added after that under the same ids stays."""
        number = max(self._listed(), default=-1) + 1
        read = docs.select("doc_id", tokens(F.col("text")).alias("ts"))
        terms = read.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg((-F.count("*")).alias("df")).withColumn("term_id", F.lit(None).cast("long"))
        self._write("terms", number, terms.select("term", "term_id", "df"))
        self._write("gone", number, read.select("doc_id").distinct())
        self._write("segments", number, read.agg((-F.count("*")).alias("n_docs"), (-F.coalesce(F.sum(F.size("ts")), F.lit(0))).cast("long").alias("total_len")))
        return number

    def _write(self, name: str, number: int, rows: DataFrame) -> None:
        """Of the segment alone: what a stopped call has left of it is replaced."""
        out = rows.withColumn("segment", F.lit(number))
        if name == "segments":
            out.coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")
        else:
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(f"{self.path}/{name}")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """qid, term, bucket, df, side (the factor of a posting's weight)."""
        s = self.statistics().first()
        terms = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        known = self._read("terms", "term string, term_id long, df long, segment int").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        i = idf(F.lit(float(s.n_docs or 0)), F.col("df"))
        side = i * i if self.model.idf_side == "both" else i
        return stored(terms.join(known, "term").where("df > 0").select("qid", "term", _bucket(F.col("term")).alias("bucket"), "df", side.alias("side")))

    def _found(self, asked: DataFrame) -> DataFrame:
        """The rows of the terms of ``asked`` (qid, bucket, term, side, least), each with what is asked of it; the queries' terms go to all
        tasks."""
        asks = asked.groupBy("bucket", "term").agg(F.collect_list(F.struct("qid", "side", F.coalesce("least", F.lit(float("-inf"))).alias("least"))).alias("asks"))
        return self.blocks().join(F.broadcast(asks), ["bucket", "term"]).drop("bucket", "term", "n")

    def _best(self, asked: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
        """qid, doc_id, score, rank of the ``k`` best by the terms ``asked``."""
        average, model = float(self.statistics().first().avg_len), self.model
        docs = self.documents()
        if allowed is not None:
            docs = docs.join(allowed.select("doc_id"), "doc_id", "left_semi")
        rows = self._found(asked).groupBy("segment", "piece")
        found = rows.cogroup(docs.groupBy("segment", "piece")).applyInArrow(lambda a, b: _ranked(a, b, average, k, model), "qid long, doc_id long, score double")
        return top(found, k)

    def least(self, asked: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """qid and least: a bound below its k-th score, by the blocks of its rarest terms, of FIRST postings at most if the rarest has no
        more; only queries with k such documents."""
        order = Window.partitionBy("qid").orderBy("df", "term")
        rare = asked.withColumn("before", F.sum("df").over(order) - F.col("df")).withColumn("nth", F.row_number().over(order)).where(f"nth = 1 or before + df <= {FIRST}")
        best = self._best(rare.withColumn("least", F.lit(None).cast("double")), k, allowed)
        return best.where(f"rank = {k}").select("qid", F.col("score").alias("least"))

    def top(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """qid, doc_id, score, rank of the ``k`` best documents of every query (qid, text), as all scores would rank them: ties by doc_id.
        ``allowed`` (doc_id) limits what is ranked, not the statistics. Queries without a known term have no rows.

        Each piece is bounded by its peaks, and only ranges that may have one of a query's best are scored.
        """
        asked = self._asked(queries)
        least = stored(self.least(asked, k, allowed))
        return self._best(asked.join(least, "qid", "left"), k, allowed).select("qid", "doc_id", "score", "rank")

    def blocks_read(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, blocks (of its terms), read (of them, those whose postings :meth:`top` scores beyond the first bound)."""
        average, model = float(self.statistics().first().avg_len), self.model
        asked = self._asked(queries)

        def run(rows: pa.Table) -> pa.Table:
            parts = [(qids, n.sum(axis=0), (n * open_).sum(axis=0)) for qids, _, _, open_, n in _open(rows, average, model)]
            qid, blocks, read = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.table({"qid": qid, "blocks": blocks.astype(np.int64), "read": read.astype(np.int64)})

        heads = self._found(asked.join(self.least(asked, k), "qid", "left")).drop("slots", "tfs")
        return heads.groupBy("segment", "piece").applyInArrow(run, "qid long, blocks long, read long").groupBy("qid").agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read"))
