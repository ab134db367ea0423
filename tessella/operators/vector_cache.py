"""Vectors that are kept by the content they are of: what was embedded once is read again."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import stored
from .providers import Provider, embed


class VectorCache:
    """The vectors of one provider in a folder, in buckets by the content's 128-bit hash, so that a request is shuffled to the cache and
    the cache stays where it is.

    Only contents that are not there yet are embedded, each once however many rows have it, and appended; Spark's commit makes an
    append whole or not at all. Two writers at once may both append a content: readers take one vector of each.
    """

    def __init__(self, spark: SparkSession, path: str, provider: Provider, buckets: int = 64):
        self.spark, self.provider = spark, provider
        self.table = "vectors_" + hashlib.md5(f"{path}|{provider.model_id}|{provider.size}|{buckets}".encode()).hexdigest()[:16]
        where = f"{path.rstrip('/')}/{self.table}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (content STRING, embedding ARRAY<FLOAT>) USING parquet CLUSTERED BY (content) INTO {int(buckets)} BUCKETS LOCATION '{where}'")
        self.buckets = int(buckets)

    def rows(self) -> DataFrame:
        """content and embedding, one row of each content."""
        return self.spark.table(self.table).groupBy("content").agg(F.first("embedding").alias("embedding"))

    def owed(self, rows: DataFrame) -> DataFrame:
        """content and text of what ``rows`` (text) ask for and the cache lacks, each once; null is the empty text."""
        text = F.coalesce("text", F.lit(""))
        wanted = rows.select(F.md5(text).alias("content"), text.alias("text")).groupBy("content").agg(F.first("text").alias("text"))
        return wanted.join(self.spark.table(self.table).select("content"), "content", "left_anti")

    def fill(self, rows: DataFrame) -> int:
        """Embeds what is owed; how many contents that were."""
        fresh = stored(embed(self.owed(rows), self.provider, "content").select("content", "embedding"))
        n = fresh.count()
        if n:
            fresh.repartition(self.buckets, "content").write.mode("append").insertInto(self.table)
            self.spark.catalog.refreshTable(self.table)
        return n

    def get(self, rows: DataFrame, key: str = "doc_id") -> DataFrame:
        """key and embedding of ``rows`` (key, text), after :meth:`fill`."""
        self.fill(rows)
        asked = rows.select(F.col(key).alias("__key"), F.md5(F.coalesce("text", F.lit(""))).alias("content"))
        return asked.join(self.rows(), "content").select(F.col("__key").alias(key), "embedding")
