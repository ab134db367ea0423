"""What a library has of its catalogue, what its rows count, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(catalogue: DataFrame, library: DataFrame, key: str) -> DataFrame:
    """One row: n (rows of the catalogue), n_has (of them, those with a key that the library has; null has none) and pct, null of an
    empty catalogue."""
    has = library.select(F.col(key).alias("__has")).where("__has is not null").distinct()
    both = catalogue.select(F.col(key).alias("__key")).join(has, F.col("__key") == F.col("__has"), "left")
    return both.agg(F.count("*").alias("n"), F.count("__has").alias("n_has")).withColumn("pct", F.round(F.try_divide(F.lit(100.0) * F.col("n_has"), "n"), 2))


def counters(rows: DataFrame, **counted: Column) -> DataFrame:
    """One row: n, and how many rows each condition holds for (null does not)."""
    return rows.agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in counted.items()])


def kinds(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """n rows and distinct keys of each kind; null is one."""
    each = rows.groupBy(kind, key).agg(F.count("*").alias("c"))  # a hot kind is dealt by its keys first
    return each.groupBy(kind).agg(F.sum("c").alias("n"), F.count(key).alias("keys"))


def list_sizes(rows: DataFrame, column: str) -> DataFrame:
    """One row on the sizes of a list (null has none): mean, upper median, nearest-rank p90 and the share of none. Rows meet as counts
    of sizes."""
    size = F.coalesce(F.array_size(column), F.lit(0)).cast("long")
    sizes = rows.select(size.alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    w = sizes.select("n", "c", F.sum("c").over(Window.orderBy("n")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("all"))  # over the distinct sizes
    reaches = lambda at: F.min(F.when(F.col("upto") >= at, F.col("n")))
    p90 = F.greatest(F.lit(1), F.least(F.col("all"), F.rint(0.9 * F.col("all")).cast("long")))
    none = F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("c"))), F.lit(0))
    return w.agg(F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 6).alias("mean"), reaches(F.floor(F.col("all") / 2) + 1).alias("median"), reaches(p90).alias("p90"), F.round(none / F.sum("c"), 6).alias("empty"))


def resume(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The keys that are wanted and not done, each once."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(done.select(key), key, "left_anti")


def targets(terms: DataFrame, pages: int, done: DataFrame | None = None) -> DataFrame:
    """term and page (1 to ``pages``) of each term, without those that are ``done`` (term, page)."""
    rows = terms.select("term", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(pages).cast("long"))).alias("page"))
    return rows if done is None else rows.join(done.select("term", "page"), ["term", "page"], "left_anti")
