"""Longest-processing-time scheduling of groups of equal texts to shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heapreplace
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import forget, stored

#: Groups of one size are told apart by this many salts; rows of one shard are numbered in parts of about so many rows.
SALTS, PART_ROWS = 64, 1 << 18
#: Weights are told apart by this many leading bits.
BITS = 16
#: The driver hands over its schedule in parts of so many runs.
RUNS = 50_000


def schedule(sizes: list[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """Longest processing time over (size, number of groups) in any order: runs (size, from, to, order) over the groups of
    each size, numbered from 0. The shards of ``order`` take equal parts of a run, one after another.

    Every group goes to the least-loaded shard, the largest first, ties by shard number. A long run of equal groups is
    dealt in whole rounds once the loads are closer than one size, which is what the heap would do one by one; steps of one
    width that follow each other are one run.
    """
    heap = [(0, s) for s in range(shards)]
    for size, count in sorted(sizes, reverse=True):
        at, start, width, order = 0, 0, 0, []
        while at < count:
            low, high = heap[0][0], max(load for load, _ in heap)
            rounds = (count - at) // shards
            if high - low < size and rounds > 1:
                takers, take = [s for _, s in sorted(heap)], rounds
                heap = [(load + rounds * size, s) for load, s in heap]
                heapify(heap)
            else:
                load, s = heap[0]
                behind = min((x for x in heap[1:]), default=(1 << 62, 0))
                take = min(count - at, max(1, -(-(behind[0] - load) // size))) if behind[0] > load else 1
                takers = [s]
                heapreplace(heap, (load + take * size, s))
            if order and take != width:
                yield size, start, at, order
                start, order = at, []
            width, order = take, order + takers
            at += take * len(takers)
            if len(order) >= 2 * shards:
                yield size, start, at, order
                start, order = at, []
        if order:
            yield size, start, at, order


def size_class(weight: str) -> Column:
    """The weight (a column's name) with all bits after its first BITS cleared: itself if it is below 2 ** BITS, else less than
    0.01 % smaller."""
    spare = f"greatest(length(bin({weight})) - {BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({weight}, {spare}), {spare})")


def _tables(spark: SparkSession, runs: Iterator[tuple]) -> DataFrame:
    """The runs of a schedule as a table; the driver holds RUNS of them at a time."""
    schema, parts = "weight long, run_from long, run_to long, order array<int>", []
    while (part := list(islice(runs, RUNS))) or not parts:
        table = spark.createDataFrame(part, schema)
        parts.append(table if len(part) < RUNS and not parts else stored(table, "sharding-runs"))
    return reduce(DataFrame.unionAll, parts)


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with a shard, under the law of near equal bytes.

    Gives doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('bytes'), shard, slot (gapless from 0 in each
    shard), grown_shard (null). Rows of equal texts stay together, null and empty ones as one group; a group's weight is the
    sum of its sizes. Repeated rows each have a slot; long texts are taken whole; other columns are not looked at; an empty
    table gives none.

    Rows are reduced to id, size and a 128-bit key of the text, and written once. Groups are counted before they are
    shuffled. The driver schedules over classes of weights (:func:`size_class`), of which there are at most some 1.3 million
    whatever the table, and its runs, two or three a class, leave it in parts of RUNS; groups and rows get their shard by joins whose hot keys Spark splits; equal rows are counted and
    then numbered within salts of a shard, as many as the rows ask for, never in one task for a shard.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32("text").alias("text_crc32"), F.unhex(F.md5("text")).alias("key"))
    rows = stored(rows, "sharding-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("weight")).select("key", size_class("weight").alias("weight"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    groups = stored(groups, "sharding-groups")
    counts = groups.groupBy("weight", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("weight").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "sharding-counts")
    sizes = [(r.weight, r.n) for r in counts.groupBy("weight").agg(F.sum("n").alias("n")).toLocalIterator()]
    runs = _tables(spark, schedule(sizes, shards))
    nth = F.row_number().over(Window.partitionBy("weight", "salt").orderBy("key")) - 1
    by_weight = runs.groupBy("weight").agg(F.array_sort(F.collect_list(F.struct("run_to", "run_from", "order"))).alias("runs"))
    numbered = groups.withColumn("nth", nth).join(counts.select("weight", "salt", "first"), ["weight", "salt"]).withColumn("nth", F.col("nth") + F.col("first"))
    numbered = numbered.join(by_weight, "weight").select("key", "nth", F.filter("runs", lambda r: r["run_to"] > F.col("nth"))[0].alias("run"))
    placed = numbered.select("key", F.expr("run.order[CAST((nth - run.run_from) * size(run.order) DIV (run.run_to - run.run_from) AS INT)]").alias("shard"))
    salts = 1 + rows.count() // (shards * PART_ROWS)
    placed = rows.join(placed, "key").groupBy("shard", "doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    placed = stored(placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(salts))), "sharding-placed")
    forget(groups, counts)
    parts = placed.groupBy("shard", "salt").agg(F.sum("times").alias("n"))
    parts = parts.select("shard", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    upto = Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("nth", F.sum("times").over(upto) - F.col("times")).join(parts, ["shard", "salt"])
    out = out.withColumn("again", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") + F.col("first") + F.col("again")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
