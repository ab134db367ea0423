"""Queries over tables that come and go: merges, gaps, coverage, ingest, normalising, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import coverage as V
from ..operators import loops as P
from ..operators import materials as X
from ..operators import merge as M
from ..operators import search as S
from ..sources import sitemap, spool
from .library import table

def now():
    return F.lit("2024-06-01").cast("date")


CUSTOMERS = "c AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer)"


def customers(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def buyers(s, d):
    """Customers with orders, but for every fifth."""
    return table(s, d, "orders").where("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("id")).distinct()


def old_orders(s, d):
    """Two of three orders as they were."""
    o = table(s, d, "orders").where("o_orderkey % 3 <> 0")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit("2024-01-01").cast("date").alias("first_seen_at"), F.lit("2024-01-01").cast("date").alias("updated_at"))


def new_orders(s, d):
    """Half of the orders, some changed."""
    o = table(s, d, "orders").where("o_orderkey % 2 = 0")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").alias("price"))


def parts(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("description"), F.split(F.concat_ws(" ", "p_type", "p_brand"), " ").alias("tags"), F.col("p_size").alias("duration"), F.floor(F.col("p_retailprice") * 4).cast("int").alias("width"), F.when(F.col("p_size") % 4 != 0, F.element_at(F.array(F.lit("landscape"), F.lit("portrait"), F.lit("square")), (F.col("p_size") % 4).cast("int"))).alias("orientation"))


PARTS = "p AS (SELECT p_partkey AS id, p_name AS title, string_split(p_type || ' ' || p_brand, ' ') AS tags, p_size AS duration, floor(p_retailprice * 4)::INT AS width, CASE p_size % 4 WHEN 1 THEN 'landscape' WHEN 2 THEN 'portrait' WHEN 3 THEN 'square' END AS orientation FROM part)"


def captions(s, d):
    """Captions of four of five parts."""
    return parts(s, d).where("id % 5 <> 0").select("id", F.concat(F.lit("a picture of "), "title").alias("text"))


def odd_parts(s, d):
    """Parts of which some lack title or tags."""
    p = parts(s, d)
    return p.withColumn("title", F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("id") % 3 == 1, F.lit("  ")).otherwise(F.col("title"))).withColumn("tags", F.when(F.col("id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.col("tags")))


def first_seen(s, d):
    """Events of five users seen before, then all; the first event of each user counts."""
    e = table(s, d, "events").select("user_id", "event_id", "event_type")
    old = e.where("user_id < 5").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))
    return M.append_first(old, e, "user_id", "event_id")


def records(s, d):
    """Events as spooled records: lists, single items, and failures."""
    e = table(s, d, "events")
    single = F.concat(F.lit('{"key":"id-'), F.col("event_id"), F.lit('","attributes":{"id":'), F.col("event_id"), F.lit("}}"))
    many = F.concat(F.lit('{"key":"p","body":{"data":[{"attributes":{"id":'), F.col("event_id"), F.lit('}},{"attributes":{}},{"attributes":{"id":-'), F.col("event_id") + 1, F.lit("}}]}}"))
    gone = F.concat(F.lit('{"key":"id-'), F.col("event_id"), F.lit('","error":"404 missing_medium"}'))
    other = F.concat(F.lit('{"key":"id-'), F.col("event_id"), F.lit('","error":"timeout"}'))
    empty = F.concat(F.lit('{"key":"p","attributes":{"slug":"x"},"body":{"data":[{"attributes":{"id":'), F.col("event_id"), F.lit('}},7,{"attributes":{"id":null}}]}}'))
    kind = F.col("event_id") % 4
    return e.select("event_id", F.when(F.col("event_id") % 12 == 3, empty).when(kind == 0, single).when(kind == 1, many).when(kind == 2, gone).otherwise(other).alias("record"))


def watermark(s, d):
    e = table(s, d, "events").select("event_id", F.col("event_type").alias("kind"), "ts")
    floors = s.createDataFrame([("click", "2024-01-10 00:00:00"), ("view", "2024-01-20 00:00:00")], "kind string, floor string").select("kind", F.col("floor").cast("timestamp_ntz").alias("floor"))
    return spool.since(e, floors, "ts").select("event_id", "kind")


def sitemap_rows(s, d):
    """Pages as a sitemap of videos and searches."""
    p = table(s, d, "pages").select("page_id")
    loc = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://x.org/video/4k-drone-shot-"), F.col("page_id"), F.lit("/"))).otherwise(F.concat(F.lit("https://x.org/search/videos/a+b%20n%C3%A9"), F.col("page_id"), F.lit("/")))
    return sitemap.entries(p.select(F.concat(F.lit("<urlset><url><loc>"), loc, F.lit("</loc><lastmod>2024-01-01</lastmod></url></urlset>")).alias("xml")))


def stream(s, d, shape):
    from tessella.streaming import events as E

    from .scratch import folder

    out = folder(s)
    schema = table(s, d, "events").schema
    source = E.read(s, f"{d}/events.parquet*", schema)
    mode = "append"
    E.drain(shape(E, source), f"{out}/rows", f"{out}/checkpoint", mode)
    return s.read.parquet(f"{out}/rows")


def daily_stream(s, d):
    """Counts by day as the stream has them at its end, days that no later event has closed included."""
    from tessella.streaming import events as E

    from .scratch import folder

    out = folder(s)
    counts = E.daily(E.read(s, f"{d}/events.parquet*", table(s, d, "events").schema)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")
    return E.latest_of_windows(counts, ["day", "event_type"], f"{out}/rows", f"{out}/checkpoint")


def odd_tags(s, d):
    """Tags of parts as JSON: texts with blanks, empty ones, nulls, objects of both kinds."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size")
    many = F.concat(F.lit('[" '), "p_brand", F.lit(' ", "", null, {"name": "n'), "p_size", F.lit('"}, {"search_term": " s'), "p_size", F.lit(' "}]'))
    one = F.concat(F.lit('[{"name": "", "search_term": "t'), "p_size", F.lit('"}]'))
    return p.select("id", F.when(F.col("id") % 3 == 0, many).when(F.col("id") % 3 == 1, F.lit("[]")).otherwise(one).alias("tags"))


def stored_objects(s, d):
    """Tag lists of which every other has objects stored as text."""
    p = table(s, d, "part")
    named = F.array(F.col("p_brand"), F.concat(F.lit('{"name": "n'), "p_size", F.lit('"}')), F.lit('{"search_term": "c"}'), F.lit('{"name": ""}'))
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, named).otherwise(F.array("p_brand", F.lit(""))).alias("tags"))


SOURCES = {"raw": "raw", "caption": "caption", "title": "raw-title", "title_desc": "raw-title-desc", "df5": "raw-tags-df5", "df10": "raw-tags-df10"}

QUERIES = {
    "catalog_gap_id": lambda s, d: M.gap(customers(s, d), buyers(s, d), "id").select("id", "name"),
    "catalog_gap_lastmod": lambda s, d: P.worklist(M.gap(customers(s, d), buyers(s, d), "id").withColumn("lastmod", F.when(F.col("id") % 2 == 0, F.col("balance"))), "id", "lastmod", 200).select("id", "lastmod"),
    "catalog_gap_newest": lambda s, d: P.worklist(M.gap(customers(s, d), buyers(s, d), "id"), "id", "id", 20).select("id"),
    "catalog_gap_random": lambda s, d: P.worklist(M.gap(customers(s, d), buyers(s, d), "id"), "id", "random", 20, "7").select("id"),
    "mark_missing": lambda s, d: M.mark_missing(customers(s, d).withColumn("missing_since", F.when(F.col("id") % 7 == 0, F.lit("2024-02-02").cast("date"))), M.gap(customers(s, d), buyers(s, d), "id"), "id", now()).select("id", F.col("missing_since").cast("string").alias("missing_since")),
    "coverage_pct": lambda s, d: V.coverage(customers(s, d), buyers(s, d), "id").select("pct"),
    "coverage_counts": lambda s, d: V.coverage(customers(s, d), buyers(s, d), "id").select("n", "n_has"),
    "library_stats": lambda s, d: V.counters(table(s, d, "events"), n_value=F.col("value").isNotNull(), n_large=F.get_json_object("props", "$.k").cast("long") > 50),
    "upsert_changed": lambda s, d: M.upsert(old_orders(s, d), new_orders(s, d), "id", ["status", "price"], "status", now()).select("id", "status", "price", F.col("first_seen_at").cast("string").alias("first_seen_at"), F.col("updated_at").cast("string").alias("updated_at")),
    "upsert_catalog": lambda s, d: M.refresh(old_orders(s, d).withColumnRenamed("updated_at", "last_seen_at"), new_orders(s, d), "id", ["status"], now()).select("id", "status", F.col("first_seen_at").cast("string").alias("first_seen_at"), F.col("last_seen_at").cast("string").alias("last_seen_at")),
    "coalesce_update": lambda s, d: M.fill(old_orders(s, d).select("id", "status", "price"), new_orders(s, d).select("id", F.nullif("status", F.lit("X")).alias("status")), "id", ["status"]),
    "append_first_wins": first_seen,
    "ingest_since_watermark": watermark,
    "tagged_union_attributes": lambda s, d: records(s, d).select("event_id", F.explode(spool.items(F.col("record"))).alias("a")).select("event_id", F.get_json_object("a", "$.id").cast("long").alias("id")),
    "missing_ids": lambda s, d: records(s, d).select(spool.missing_id(F.col("record")).alias("id")).where("id is not null"),
    "events_props_extract": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "url_slug_id": lambda s, d: sitemap.video_items(sitemap_rows(s, d)),
    "url_decode_terms": lambda s, d: sitemap.search_terms(sitemap_rows(s, d)),
    "page_title": lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title")),
    "term_slug": lambda s, d: table(s, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug")),
    "normalize_orientation": lambda s, d: table(s, d, "part").select("p_partkey", T.orientation(F.nullif("p_size", F.lit(7)), F.lit(25)).alias("orientation")),
    "user_name_fallback": lambda s, d: table(s, d, "customer").select("c_custkey", T.person(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" "), F.when(F.col("c_custkey") % 3 == 0, " x "), F.col("c_name")).alias("name")),
    "tag_normalize": lambda s, d: odd_tags(s, d).select("id", F.array_join(T.tag_texts(F.col("tags")), "|").alias("tags")),
    "tag_repair": lambda s, d: stored_objects(s, d).select("id", F.array_join(T.repaired_tags(F.col("tags")), "|").alias("tags")),
    "embed_text": lambda s, d: parts(s, d).select("id", T.canonical(F.col("title"), F.col("description"), F.col("tags")).alias("text")),
    "generic_tags": lambda s, d: X.generic_tags(parts(s, d), 0.05),
    **{f"text_source_{name}": lambda s, d, name=name: X.texts(parts(s, d).withColumn("description", F.col("orientation")), SOURCES[name], captions(s, d)) for name in SOURCES},
    "hard_filter": lambda s, d: S.hard_filter(parts(s, d), "portrait", 10, 40, 3610).select("id"),
    "hard_filter_unknown": lambda s, d: S.hard_filter(parts(s, d), "unknown", 10, unknown=True).select("id"),
    "embeddable_rows": lambda s, d: odd_parts(s, d).where((F.trim(F.coalesce("title", F.lit(""))) != "") | (F.size("tags") > 0)).agg(F.count("*").alias("n")),
    "backfill_owed_shard": lambda s, d: P.owed(table(s, d, "orders"), F.col("o_orderpriority"), "1-URGENT", "o_orderkey", 1, 3).orderBy("o_orderkey").limit(1000).select("o_orderkey"),
    "fetch_targets": lambda s, d: V.targets(table(s, d, "nation").select(F.col("n_name").alias("term")), 3),
    "stream_dedup": lambda s, d: stream(s, d, lambda E, e: E.distinct(e.unionByName(e)).select("event_id", "event_type")),
    "stream_daily_counts": daily_stream,
}

GAP = "SELECT * FROM c WHERE id % 5 = 0 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.id)"
OLD = "o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 0)"
GENERIC = PARTS + ", tg AS (SELECT DISTINCT id, unnest(list_transform(tags, lambda x: lower(x))) AS tag FROM p), gt AS (SELECT tag, count(*) AS df FROM tg GROUP BY ALL)"
ORACLES = {
    "catalog_gap_id": f"WITH {CUSTOMERS} SELECT id, name FROM ({GAP})",
    "catalog_gap_lastmod": f"WITH {CUSTOMERS} SELECT id, CASE WHEN id % 2 = 0 THEN balance END AS lastmod FROM ({GAP}) ORDER BY lastmod DESC NULLS LAST, id DESC LIMIT 200",
    "catalog_gap_newest": f"WITH {CUSTOMERS} SELECT id FROM ({GAP}) ORDER BY id DESC LIMIT 20",
    "catalog_gap_random": f"WITH {CUSTOMERS} SELECT id FROM ({GAP}) ORDER BY md5('7|' || id), id LIMIT 20",
    "mark_missing": f"WITH {CUSTOMERS} SELECT id, CASE WHEN id % 7 = 0 THEN '2024-02-02' WHEN id % 5 = 0 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.id) THEN '2024-06-01' END AS missing_since FROM c",
    "coverage_pct": "SELECT round(100.0e0 * (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 5 <> 0) / (SELECT count(*) FROM customer), 2) AS pct",
    "coverage_counts": "SELECT (SELECT count(*) FROM customer) AS n, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 5 <> 0) AS n_has",
    "library_stats": "SELECT count(*) AS n, count(value) AS n_value, coalesce(sum(CASE WHEN (props->>'$.k')::BIGINT > 50 THEN 1 ELSE 0 END), 0)::BIGINT AS n_large FROM events",
    "upsert_changed": f"WITH {OLD} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL AND o.status IS DISTINCT FROM n.status THEN n.status ELSE o.status END AS status, CASE WHEN n.id IS NOT NULL AND o.status IS DISTINCT FROM n.status THEN n.price ELSE o.price END AS price, CASE WHEN o.id IS NULL THEN '2024-06-01' ELSE '2024-01-01' END AS first_seen_at, CASE WHEN n.id IS NOT NULL AND o.status IS DISTINCT FROM n.status THEN '2024-06-01' ELSE '2024-01-01' END AS updated_at FROM o FULL JOIN n ON o.id = n.id",
    "upsert_catalog": f"WITH {OLD} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN o.id IS NULL THEN '2024-06-01' ELSE '2024-01-01' END AS first_seen_at, CASE WHEN n.id IS NULL THEN '2024-01-01' ELSE '2024-06-01' END AS last_seen_at FROM o FULL JOIN n ON o.id = n.id",
    "coalesce_update": f"WITH {OLD} SELECT o.id, coalesce(nullif(n.status, 'X'), o.status) AS status, o.price FROM o LEFT JOIN n ON o.id = n.id",
    "append_first_wins": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "ingest_since_watermark": "SELECT event_id, event_type AS kind FROM events WHERE (event_type <> 'click' OR ts > TIMESTAMP '2024-01-10') AND (event_type <> 'view' OR ts > TIMESTAMP '2024-01-20')",
    "tagged_union_attributes": "SELECT event_id, event_id AS id FROM events WHERE event_id % 4 IN (0, 1) OR event_id % 12 = 3 UNION ALL SELECT event_id, -(event_id + 1) FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 12 = 3",
    "missing_ids": "SELECT event_id AS id FROM events WHERE event_id % 4 = 2",
    "events_props_extract": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "url_slug_id": "SELECT page_id AS item_id, '4k-drone-shot' AS slug, '2024-01-01' AS lastmod FROM pages WHERE page_id % 2 = 0",
    "url_decode_terms": "SELECT 'a+b né' || page_id AS term, '2024-01-01' AS lastmod FROM pages WHERE page_id % 2 = 1",
    "page_title": "SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages",
    "term_slug": "SELECT p_partkey, coalesce(nullif(left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 60), ''), 'term') AS slug FROM part",
    "normalize_orientation": "SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL WHEN p_size = 25 THEN 'square' WHEN p_size < 25 THEN 'portrait' ELSE 'landscape' END AS orientation FROM part",
    "user_name_fallback": "SELECT c_custkey, coalesce(nullif(concat_ws(' ', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN 'x' END), ''), c_name) AS name FROM customer",
    "tag_normalize": "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_brand || '|n' || p_size || '|s' || p_size WHEN 1 THEN '' ELSE 't' || p_size END AS tags FROM part",
    "tag_repair": "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|n' || p_size ELSE p_brand || '|' END AS tags FROM part",
    "embed_text": f"WITH {PARTS} SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) || ' — ' || array_to_string(tags, ', ') AS text FROM p",
    "generic_tags": f"WITH {GENERIC} SELECT tag, df FROM gt WHERE df >= 0.05 * (SELECT count(*) FROM p)",
    "hard_filter": f"WITH {PARTS} SELECT id FROM p WHERE orientation = 'portrait' AND duration BETWEEN 10 AND 40 AND width >= 3610",
    "hard_filter_unknown": f"WITH {PARTS} SELECT id FROM p WHERE orientation IS NULL AND duration >= 10",
    "embeddable_rows": "SELECT count(*) AS n FROM part WHERE p_partkey % 3 = 2 OR p_partkey % 2 <> 0",
    "backfill_owed_shard": "SELECT o_orderkey FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT' AND o_orderkey % 3 = 1 ORDER BY o_orderkey LIMIT 1000",
    "fetch_targets": "SELECT n_name AS term, unnest(range(1, 4)) AS page FROM nation",
    "stream_dedup": "SELECT event_id, event_type FROM events",
    "stream_daily_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}


def text_sql(*parts: str) -> str:
    """Parts that are not blank, joined."""
    listed = ", ".join(f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')" for x in parts)
    return f"concat_ws(' — ', {listed})"


def without_generic(share: str) -> str:
    return f"WITH {GENERIC}, g AS (SELECT coalesce(list(tag), []) AS all_tags FROM gt WHERE df >= {share} * (SELECT count(*) FROM p)) SELECT id, " + text_sql("title", "orientation", "array_to_string(list_filter(tags, lambda x: NOT list_contains(all_tags, lower(x))), ', ')") + " AS text FROM p, g"


ORACLES |= {
    "text_source_raw": f"WITH {PARTS} SELECT id, {text_sql('title', 'orientation', chr(39).join(('array_to_string(tags, ', ', ', ')')))} AS text FROM p",
    "text_source_caption": f"WITH {PARTS} SELECT id, CASE WHEN id % 5 <> 0 THEN 'a picture of ' || title ELSE '' END AS text FROM p",
    "text_source_title": f"WITH {PARTS} SELECT id, {text_sql('title')} AS text FROM p",
    "text_source_title_desc": f"WITH {PARTS} SELECT id, {text_sql('title', 'orientation')} AS text FROM p",
    "text_source_df5": without_generic("0.05"),
    "text_source_df10": without_generic("0.10"),
}
