"""Sitemaps: shards of an index, items and terms of a shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_decoded


def entries(xml: DataFrame, *keep: str) -> DataFrame:
    """``keep``, at (from 0), loc, lastmod of every <url> or <sitemap> element of ``xml`` (xml)."""
    blocks = xml.select(*keep, F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))).alias("at", "block"))
    value = lambda tag: F.nullif(F.trim(F.regexp_extract("block", rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    return blocks.select(*keep, "at", value("loc").alias("loc"), value("lastmod").alias("lastmod")).where("loc is not null")


def video_items(rows: DataFrame, path: str = "video") -> DataFrame:
    """item_id, slug, lastmod of locations .../<path>/<slug>-<digits>/; others drop out."""
    pattern = rf"/{path}/([^/]+?)-(\d+)/?$"
    return rows.where(F.col("loc").rlike(pattern)).select(F.regexp_extract("loc", pattern, 2).cast("long").alias("item_id"), F.regexp_extract("loc", pattern, 1).alias("slug"), "lastmod")


def search_terms(rows: DataFrame, path: str = "search/videos") -> DataFrame:
    """term, lastmod of locations .../<path>/<term>/, decoded and trimmed; blank ones drop out."""
    pattern = rf"/{path}/([^/]+)/?$"
    term = F.regexp_replace(url_decoded(F.regexp_extract("loc", pattern, 1)), r"(?U)^\s+|\s+$", "")
    return rows.where(F.col("loc").rlike(pattern)).select(term.alias("term"), "lastmod").where("term <> ''")


def shards(index: DataFrame, most: int | None = None) -> DataFrame:
    """at, loc, lastmod of the shards that a sitemap index lists, in its order, the first ``most`` of them."""
    found = entries(index)
    return found if most is None else found.where(F.col("at") < most)
