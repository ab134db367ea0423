"""Positions in the order of a whole table without one task that sorts it."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import stored

#: Parts into which a range of values is divided in one pass.
PARTS = 4096


def value_at(rows: DataFrame, column: str, position: int) -> float | None:
    """The value at ``position`` (from 1) of the ascending numbers in a column; nulls and NaN don't count.

    Each pass counts values in PARTS equal parts of a range and goes on in the part that has the position, until only one
    value is left in it; a handful of passes, each with a result of bounded size.
    """
    rows = rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    lo, hi = rows.agg(F.min("v"), F.max("v")).first()
    while lo is not None and lo < hi:
        width, middle = (hi - lo) / PARTS, lo / 2 + hi / 2
        if 0 < width < math.inf:
            part = F.least(F.floor((F.col("v") - lo) / width), F.lit(PARTS - 1))
        else:  # values too close together, or too far apart, for equal parts
            part = (F.col("v") > (middle if lo <= middle < hi else lo)).cast("long")
        found = rows.where(F.col("v").between(lo, hi)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in found.orderBy("part").collect():
            if position <= r.n:
                break
            position -= r.n
        lo, hi = r.lo, r.hi
    return lo


def ranked_values(rows: DataFrame, column: str, fractions: dict[str, float], *within: str) -> DataFrame:
    """The nearest-rank percentiles of all groups (``within``, null being a group of its own) at once: n, the number of values, and
    for each name the value at position round-half-even(fraction * n), 1 at least. Nulls and NaN don't count; a group of nothing
    else has no row.

    All groups narrow together: a pass counts each group's open ranges in PARTS parts and goes on in those that have the
    positions, until each range is one value. Counts are made in tasks before they are shuffled, a window has PARTS rows at
    most, and a hot group is as many rows as any other; no group is sorted.
    """
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(within)]
    names = [f"__k{i}" for i in range(len(within))]
    values = rows.select(*keys, F.col(column).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    ends = values.groupBy(*names).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(f)).alias("f")) for name, f in fractions.items()]))
    place = F.greatest(F.lit(1), F.least(F.col("n"), F.rint(F.col("w.f") * F.col("n")).cast("long")))
    state = stored(ends.select(*names, "n", "lo", "hi", wanted.alias("w")).select(*names, "n", F.col("w.name").alias("name"), place.alias("at"), "lo", "hi"))
    done = []
    while True:
        done.append(state.where("lo = hi").select(*names, "n", "name", F.col("lo").alias("value")))
        left = state.where("lo < hi")
        if left.isEmpty():
            break
        ranges = left.select(*[F.col(k).alias(f"o{k}") for k in names], "lo", "hi").distinct()
        same = [F.col(k).eqNullSafe(F.col(f"o{k}")) for k in names]
        inside = values.join(ranges, [*same, F.col("__v").between(F.col("lo"), F.col("hi"))]).select(*names, "lo", "hi", "__v")
        width, middle = (F.col("hi") - F.col("lo")) / PARTS, F.col("lo") / 2 + F.col("hi") / 2
        halves = (F.col("__v") > F.when((F.col("lo") <= middle) & (middle < F.col("hi")), middle).otherwise(F.col("lo"))).cast("long")
        equal = F.least(F.try_divide(F.col("__v") - F.col("lo"), width).try_cast("long"), F.lit(PARTS - 1))
        part = F.when((width > 0) & (width < float("inf")), equal).otherwise(halves)
        parts = inside.groupBy(*names, "lo", "hi", part.alias("part")).agg(F.count("*").alias("c"), F.min("__v").alias("a"), F.max("__v").alias("b"))
        upto = F.sum("c").over(Window.partitionBy(*names, "lo", "hi").orderBy("part"))
        parts = parts.withColumn("upto", upto).select(*[F.col(k).alias(f"o{k}") for k in names], F.col("lo").alias("olo"), F.col("hi").alias("ohi"), "c", "upto", "a", "b")
        met = left.join(parts, [*same, F.col("lo") == F.col("olo"), F.col("hi") == F.col("ohi"), F.col("at") <= F.col("upto"), F.col("at") > F.col("upto") - F.col("c")])
        state = stored(met.select(*names, "n", "name", (F.col("at") - F.col("upto") + F.col("c")).alias("at"), F.col("a").alias("lo"), F.col("b").alias("hi")))
    found = reduce(DataFrame.unionByName, done).groupBy(*names, "n").pivot("name", list(fractions)).agg(F.max("value"))
    return found.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(within)], "n", *fractions)


def numbered(rows: DataFrame, count: str, term: str, name: str, prefix: int = 3) -> DataFrame:
    """``rows`` with their place from 1 in the order of ``count`` descending, then ``term``.

    Rows are numbered within a count and the first characters of the term; how many rows come before such a group is summed
    over groups only, first over counts (of which there are few), then within each.
    """
    rows = rows.withColumn("__at", F.substring(term, 1, prefix))
    groups = rows.groupBy(count, "__at").agg(F.count("*").alias("__n"))
    within = groups.withColumn("__inner", F.sum("__n").over(Window.partitionBy(count).orderBy("__at")) - F.col("__n"))
    counts = groups.groupBy(count).agg(F.sum("__n").alias("__all"))
    before = counts.select(count, (F.sum("__all").over(Window.orderBy(F.desc(count))) - F.col("__all")).alias("__outer"))
    place = F.row_number().over(Window.partitionBy(count, "__at").orderBy(term))
    return rows.withColumn("__place", place).join(within, [count, "__at"]).join(before, count).withColumn(name, F.col("__outer") + F.col("__inner") + F.col("__place")).drop("__at", "__n", "__inner", "__outer", "__place")


def placed(rows: DataFrame, hash: str, key: str, digits: int = 4) -> DataFrame:
    """``rows`` with their ``place`` from 0 in the order of a column of hex digits, ties by ``key``: numbered within the rows that share
    the first ``digits``, after how many rows have lesser ones."""
    rows = rows.withColumn("__at", F.substring(hash, 1, digits))
    groups = rows.groupBy("__at").agg(F.count("*").alias("__n"))
    before = groups.select("__at", (F.sum("__n").over(Window.orderBy("__at")) - F.col("__n")).alias("__before"))  # 16 ** digits rows at most
    nth = F.row_number().over(Window.partitionBy("__at").orderBy(hash, key)) - 1
    return rows.withColumn("__nth", nth).join(before, "__at").withColumn("place", F.col("__before") + F.col("__nth")).drop("__at", "__nth", "__before")


def ordered_hash(rows: DataFrame, key: str, width: int = 1000, levels: int = 2) -> DataFrame:
    """One row: n and ``hash``, an MD5 that depends on all columns of all rows and on their order by an integer key. Rows are hashed as
    canonical JSON, their hashes in order within ranges of ``width`` keys, those of ranges within ranges of ranges, and so on."""
    plain = [F.col(c) for c in sorted(rows.columns)]
    at = rows.select(F.col(key).alias("at"), F.md5(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})).alias("h"), F.lit(1).cast("long").alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
    for _ in range(levels - 1):
        at = at.groupBy(F.floor(F.col("at") / width).alias("at")).agg(F.md5(joined).alias("h"), F.sum("n").alias("n"))
    return at.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.md5(joined).alias("hash"))
