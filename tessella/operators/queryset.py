"""Query sets: terms chosen from a catalogue, and checks of designed ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.scratch import stored


#: Tokens of the most documents, which tasks have at hand.
HEAD = 10_000


def match(terms: DataFrame, frequency: DataFrame) -> DataFrame:
    """key, match of ``terms`` (key, term): the most documents that one of its tokens has (``frequency``: term, df); 0 if none.

    The HEAD most frequent tokens go to the tasks. A term that has one of them has its match there, since no other token has more;
    only tokens of the other terms meet the whole ``frequency`` in a join.
    """
    frequency = stored(frequency.select("term", F.col("df").cast("long").alias("df")))
    head = frequency.orderBy(F.desc("df"), "term").limit(HEAD).toArrow()
    names, most = head["term"].combine_chunks(), np.append(head["df"].to_numpy(), 0)

    @F.arrow_udf("long")
    def of_head(lists: pa.Array) -> pa.Array:
        at = pa.compute.index_in(lists.flatten(), names).fill_null(len(names)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        found = np.maximum.reduceat(np.append(most[at], 0), np.append(0, ends[:-1])) if len(ends) else np.empty(0, np.int64)
        found[np.diff(ends, prepend=0) == 0] = 0  # reduceat gives the next list's first value for an empty one
        return pa.array(found, pa.int64(), mask=found == 0)

    found = terms.select("key", T.tokens(F.col("term")).alias("ts")).withColumn("df", of_head("ts"))
    own = stored(found.select("key", "df", F.when(F.col("df").isNull(), F.array_distinct("ts")).alias("ts")))
    rest = own.where("df is null").select("key", F.explode_outer("ts").alias("term")).join(frequency, "term", "left").select("key", "df")
    return own.where("df is not null").select("key", "df").unionByName(rest).groupBy("key").agg(F.coalesce(F.max("df"), F.lit(0)).alias("match"))


def choose(terms: DataFrame, frequency: DataFrame, order: Column, each: int = 30) -> DataFrame:
    """term, match, band: of distinct terms that are no junk, the first ``each`` of every band in the order of a hash."""
    plain = terms.select("term").where("term is not null").distinct().where(~T.is_junk(F.col("term"))).withColumn("key", F.col("term"))
    rows = match(plain, frequency).withColumnRenamed("key", "term").withColumn("band", T.band(F.col("match"))).where("band is not null")
    place = F.row_number().over(Window.partitionBy("band").orderBy(order, "term"))
    return rows.withColumn("place", place).where(F.col("place") <= each).select("term", "match", "band")


def faults(designed: DataFrame, facets: list[str], hard: list[str], difficulties: list[str], languages: list[str]) -> DataFrame:
    """text and fault of designed queries (text, category, lang, difficulty, facets, hard: arrays of names) that break a rule."""
    known = lambda column, names: F.size(F.array_except(column, F.array(*[F.lit(x) for x in names]))) == 0
    rules = {
        "facet": known("facets", facets),
        "hard": known("hard", hard),
        "difficulty": F.col("difficulty").isin(*difficulties),
        "language": F.col("lang").isin(*languages) & (T.language(F.col("text")) == F.col("lang")),
        "composition": (F.col("category") != "composition") | (F.size("facets") >= 2),
    }
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return designed.select("text", F.explode(found).alias("fault"))


def counts_differ(designed: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """category, n, wanted where a category has not as many queries as it should."""
    spark = designed.sparkSession
    plan = spark.createDataFrame(list(wanted.items()), "category string, wanted long")
    n = designed.groupBy("category").agg(F.count("*").alias("n"))
    both = n.join(plan, "category", "full_outer").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("wanted", F.lit(0)).alias("wanted"))
    return both.where("n <> wanted")
