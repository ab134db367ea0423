"""Queries over what arrives: pages of a feed, shards of which some are broken, values held for a time, vectors that are kept."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F

from ..functions import tables as N
from ..operators import providers as P
from ..operators.ranks import ranked_values
from ..operators.vector_cache import VectorCache
from ..sources import feed, shards
from ..streaming import events as E
from ..streaming import lifetime
from . import library as L
from .library import table
from .scratch import folder

#: How long a value is held.
DAY = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def day_pages(s, d):
    """Events as pages of a feed, one a day."""
    e = table(s, d, "events")
    return e.select(F.date_format("ts", "yyyyMMdd").alias("cursor"), F.to_json(F.struct("event_id", "event_type", "user_id")).alias("value"))


def fed(s, d):
    """A feed that is read when half of its days are there, and again, from where it ended, when all are."""
    path, pages = folder(s), day_pages(s, d)
    for half in ("cursor < '20240115'", "cursor >= '20240115'"):
        pages.where(half).write.mode("append").partitionBy("cursor").text(f"{path}/feed")
        E.drain(feed.read_stream(s, f"{path}/feed"), f"{path}/rows", f"{path}/checkpoint")
    item = F.from_json("item", "event_id long, event_type string, user_id long")
    return s.read.parquet(f"{path}/rows").select("cursor", item.alias("x")).select("cursor", "x.*")


def fed_since(s, d):
    path = folder(s)
    day_pages(s, d).write.partitionBy("cursor").text(f"{path}/feed")
    return feed.read(s, f"{path}/feed", "20240120").groupBy("cursor").agg(F.count("*").alias("n"))


def shard_files(s, d):
    """Pages as shards of a sitemap with two entries: compressed or plain, and of nine some broken in one of five ways."""

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: gzip.compress(v, mtime=0))

    p = table(s, d, "pages").select("page_id", (F.col("page_id") % 9).alias("kind"))
    url = lambda n: F.concat(F.lit("<url><loc>https://x.org/video/a-"), (F.col("page_id") * 2 + n).cast("string"), F.lit("/</loc></url>"))
    text = F.concat(F.lit("<urlset>"), url(0), url(1), F.lit("</urlset>\n"))
    plain = text.cast("binary")
    zipped = packed(plain)
    data = (
        F.when(F.col("kind") == 0, F.substring(zipped, 1, 40)).when(F.col("kind") == 1, F.unhex(F.lit("1f8bffff00"))).when(F.col("kind") == 2, F.lit(None).cast("binary"))
        .when(F.col("kind") == 3, F.unhex(F.lit("3c75ff"))).when(F.col("kind") == 4, F.substring(plain, 1, 30)).when(F.col("kind") < 7, zipped).otherwise(plain)
    )
    return p.select(F.col("page_id").alias("name"), data.alias("data"))


def kept_entries(s, d):
    rows, _ = shards.split(shards.sitemap_shards(shard_files(s, d)))
    return rows.select("name", F.col("at").cast("long").alias("at"), "loc")


def held(s, d):
    before = s.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        path = folder(s)
        stream = E.read(s, f"{d}/events.parquet*", table(s, d, "events").schema)
        E.drain(lifetime.held(stream, DAY), f"{path}/rows", f"{path}/checkpoint")
    finally:
        s.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else s.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return s.read.parquet(f"{path}/rows")


def kept_vectors(s, d):
    """How many texts are embedded of two thirds of the documents, of all, and of all again."""
    cache, docs = VectorCache(s, folder(s), P.hash_provider(64)), L.docs(s, d)
    counts = [cache.fill(rows) for rows in (docs.where("doc_id % 3 <> 0"), docs, docs)]
    n = cache.get(docs).count()
    return s.createDataFrame([(i, c, n) for i, c in enumerate(counts)], "pass long, embedded long, vectors long")


def by_sql(s, d, call):
    N.register(s)
    table(s, d, "documents").createOrReplaceTempView("__texts")
    return s.sql(f"SELECT doc_id, p.* FROM __texts, LATERAL {call} p")


QUERIES = {
    "feed_stream": fed,
    "feed_since": fed_since,
    "shard_entries": kept_entries,
    "shard_failures": lambda s, d: shards.split(shards.sitemap_shards(shard_files(s, d)))[1],
    "value_lifetime": held,
    "vector_cache_kept": kept_vectors,
    "latency_by_type": lambda s, d: ranked_values(table(s, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type"),
    "latency_by_user": lambda s, d: ranked_values(table(s, d, "events"), "value", {"p50": 0.5, "p90": 0.9}, "user_id", "event_type"),
    "sql_postings": lambda s, d: by_sql(s, d, "postings(text)"),
    "sql_positions": lambda s, d: by_sql(s, d, "positions(text)"),
}


def rank_sql(names: dict[str, float], *within: str) -> str:
    at = lambda f: f"max(value) FILTER (pos = greatest(1, least(n, round_even({f}e0 * n, 0))))"
    keys = ", ".join(within)
    return f"WITH v AS (SELECT {keys}, value, row_number() OVER (PARTITION BY {keys} ORDER BY value) AS pos, count(*) OVER (PARTITION BY {keys}) AS n FROM events WHERE value IS NOT NULL) SELECT {keys}, n, {', '.join(f'{at(f)} AS {name}' for name, f in names.items())} FROM v GROUP BY {keys}, n"


ORACLES = {
    "feed_stream": "SELECT strftime(ts, '%Y%m%d') AS cursor, event_id, event_type, user_id FROM events",
    "feed_since": "SELECT strftime(ts, '%Y%m%d') AS cursor, count(*) AS n FROM events WHERE strftime(ts, '%Y%m%d') > '20240120' GROUP BY ALL",
    "shard_entries": "SELECT page_id AS name, n AS at, 'https://x.org/video/a-' || (page_id * 2 + n) || '/' AS loc FROM pages, range(0, 2) AS r(n) WHERE page_id % 9 > 4",
    "shard_failures": "SELECT page_id AS name, CASE page_id % 9 WHEN 0 THEN 'cut short' WHEN 1 THEN 'not gzip' WHEN 2 THEN 'empty' WHEN 3 THEN 'not UTF-8' ELSE 'not a sitemap' END AS reason FROM pages WHERE page_id % 9 < 5",
    "value_lifetime": """WITH RECURSIVE m AS (SELECT user_id, min(ts) AS ts FROM events WHERE user_id IS NOT NULL GROUP BY user_id
UNION ALL SELECT m.user_id, min(e.ts) FROM m JOIN events e ON e.user_id = m.user_id AND e.ts >= m.ts + INTERVAL 24 HOUR GROUP BY m.user_id, m.ts),
f AS (SELECT user_id, ts, min(event_id) AS event_id FROM events JOIN m USING (user_id, ts) GROUP BY ALL)
SELECT user_id, event_id, f.event_id IS NOT NULL AS fresh FROM events LEFT JOIN f USING (user_id, event_id) WHERE user_id IS NOT NULL AND events.ts IS NOT NULL""",
    "vector_cache_kept": "WITH a AS (SELECT coalesce(text, '') AS t, min(CASE WHEN doc_id % 3 <> 0 THEN 0 ELSE 1 END) AS first, count(*) AS n FROM documents GROUP BY ALL) SELECT p AS pass, (SELECT count(*) FROM a WHERE first = p) AS embedded, (SELECT sum(n)::BIGINT FROM a) AS vectors FROM range(0, 3) AS r(p)",
    "latency_by_type": rank_sql({"p50": 0.5, "p95": 0.95}, "event_type"),
    "latency_by_user": rank_sql({"p50": 0.5, "p90": 0.9}, "user_id", "event_type"),
    "sql_postings": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({L.TOKENS}) AS term FROM documents) GROUP BY ALL",
    "sql_positions": f"SELECT doc_id, unnest({L.TOKENS}) AS term, unnest(range(0, len({L.TOKENS})))::INT AS nth FROM documents",
}
