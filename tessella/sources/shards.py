"""Files read in tasks, of which those that are broken go to a table of failures in place of ending the read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sitemap import entries

#: What a shard of a sitemap has at its end when it is whole.
END = r"</(?:urlset|sitemapindex)>\s*$"


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """name and data of files, one a row."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.col("content").alias("data"))


def _text(data: bytes | None) -> tuple[str | None, str | None]:
    """The text of bytes that may be gzip (of several members, too), or why there is none."""
    if not data:
        return None, "empty"
    try:
        if data[:2] == b"\x1f\x8b":
            parts, rest = [], data
            while rest:
                member = zlib.decompressobj(wbits=31)
                parts.append(member.decompress(rest))
                if not member.eof:
                    return None, "cut short"
                rest = member.unused_data.lstrip(b"\0")
            data = b"".join(parts)
        return data.decode("utf-8"), None
    except zlib.error:
        return None, "not gzip"
    except UnicodeDecodeError:
        return None, "not UTF-8"


def decoded(files: DataFrame, name: str = "name") -> DataFrame:
    """name, text, reason of ``files`` (name, data): text of those that are whole, else the reason: 'empty' (null, too), 'cut short',
    'not gzip', 'not UTF-8'. One file is held at a time by a task, in batches as Spark sends them."""
    kind = files.schema[name].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_text(d) for d in batch["data"]]
            yield pd.DataFrame({"name": batch["name"], "text": [t for t, _ in found], "reason": [r for _, r in found]})

    return files.select(F.col(name).alias("name"), "data").mapInPandas(run, f"name {kind}, text string, reason string")


def sitemap_shards(files: DataFrame, name: str = "name") -> DataFrame:
    """:func:`decoded`, where a text that does not end as a sitemap does has the reason 'not a sitemap'."""
    rows = decoded(files, name)
    wrong = F.when(F.col("text").isNotNull() & ~F.col("text").rlike(END), "not a sitemap")
    reason = F.coalesce("reason", wrong)
    return rows.select("name", F.when(reason.isNull(), F.col("text")).alias("text"), reason.alias("reason"))


def split(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries (name, at, loc, lastmod) of whole shards, and the failures (name, reason) of the others."""
    return entries(shards.where("reason is null").withColumnRenamed("text", "xml"), "name"), shards.where("reason is not null").select("name", "reason")
