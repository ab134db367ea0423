"""Queries over lookups, normalised records, query sets, judging passes, caches, windows and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25 as B
from ..operators import coverage as K
from ..operators import judging as J
from ..operators import merge as M
from ..operators import metrics as X
from ..operators import providers as P
from ..operators import queryset as Q
from ..operators import search as S
from ..operators.library import urls_of
from ..operators.ranks import ordered_hash
from ..sources import files
from . import evaluation as E
from . import library as L
from .catalogue import PARTS, parts
from .library import table
from .scratch import stored


def media_records(s, d):
    """Parts as raw media records, of which some lack fields or have odd ones."""
    p = table(s, d, "part")
    video = F.when(F.col("p_size") % 5 == 0, F.lit("null")).when(F.col("p_size") % 5 == 1, F.concat(F.lit('{"thumbnail":"t'), "p_partkey", F.lit('","download_link":"d"}'))).when(F.col("p_size") % 5 == 2, F.lit('{"thumbnail":{"small":"s","medium":"","large":null},"video_files":[{"width":2160,"height":3840}]}')).when(F.col("p_size") % 5 == 3, F.lit('{"thumbnail":{"large":"","tiny":"y"},"preview_src":"p","video_files":{}}')).otherwise(F.lit('{"preview_src":"p","video_files":[{"width":1920,"height":1080},{"width":1280,"height":720}]}'))
    width = F.when(F.col("p_size") % 3 == 0, F.lit("null")).otherwise(F.col("p_size").cast("string"))
    return p.select(F.concat(F.lit('{"id":'), "p_partkey", F.lit(',"title":"'), "p_name", F.lit('","tags":["'), "p_brand", F.lit('",{"name":"x"},null," "],"duration":'), "p_size", F.lit(',"width":'), width, F.lit(',"height":20,"user":{"username":"u"},"video":'), video, F.lit("}")).alias("record"))


def media(s, d):
    rows = T.media_rows(media_records(s, d), "feed")
    return rows.select("item_id", "title", F.array_join("tags", "|").alias("tags"), "duration", "width", "orientation", "user_name", "thumbnail_url", "download_link", T.has_uhd(F.col("video_files")).alias("uhd"))


def answers(s, d):
    """Turns of conversations as parts of a model's answer, some with an echo of the task."""
    c = table(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    kind = F.col("turn") % 3
    head = F.when(kind == 0, F.lit("Task: describe\n* Constraints: none\n- Subject: a cat")).when(kind == 1, F.lit("**  A dog\n\n# runs")).otherwise(F.lit("Task: x\nit rains"))
    return c.select("conv_id", "turn", F.array(head, F.lit(""), F.concat(F.lit("end"), F.col("turn").cast("string"))).alias("parts"))


def queries_table(s, d):
    """The benchmark as a query set with all columns of an export."""
    return E.query_set(s, d)


def judgment_records(s, d):
    """All that is kept of each judgment of the pool."""
    rows = E.labels(s, d).join(E.query_set(s, d).select("qid", F.col("text").alias("query_text")), "qid").join(L.docs(s, d).select("doc_id", F.md5("text").alias("doc_hash"), F.col("text").alias("doc_text")), "doc_id")
    return rows.withColumn("key", E.hashed("qid", "doc_id")).withColumn("reason", F.concat(F.lit("because "), F.col("doc_id").cast("string"))).withColumn("status", F.when(F.col("grade").isNull(), "unparsed").otherwise("ok")).withColumn("ts", F.lit("2024-06-01"))


def blind_worksheet(s, d):
    """Of every grade the quota, without what the judge said; the order is that of BLAKE2b, so the rows are compared by grade."""
    records = stored(judgment_records(s, d))
    sheet = J.worksheet_rows(records, {1: 15, 2: 10, 0: 10, 3: 5}, blind=True)
    return sheet.join(records.select(F.col("key").alias("pair_id"), "grade"), "pair_id").groupBy("grade").agg(F.count("*").alias("n"), F.count_if(F.expr("human_grade = '' AND notes = ''")).alias("open"))


def designed(s, d):
    q = table(s, d, "benchmark")
    k = F.col("item_id") % 4
    return q.select(F.col("item_id").cast("string").alias("text"), F.when(k == 0, "composition").otherwise("facet").alias("category"), F.when(k == 1, "zh").otherwise("en").alias("lang"), F.when(k == 2, "odd").otherwise("easy").alias("difficulty"), F.array(F.when(k == 3, "what").otherwise("motion")).alias("facets"), F.array(F.lit("orientation")).alias("hard"))


def terms_to_choose(s, d):
    return Q.choose(E.terms(s, d), B.document_counts(L.docs(s, d)), E.hashed("term"), 30)


def judged(s, d):
    pooled = stored(E.pool_of(E.two(s, d)))
    old = E.with_mock(pooled).where("qid % 2 = 0")
    h = F.conv(F.substring(E.hashed("qid", "doc_id"), 1, 1), 16, 10).cast("int")
    return J.judge_counts(pooled, old, J.judge(pooled, old, F.when(h != 0, h % 4)))


def budgeted(run):
    return J.judge(J.pool([run], 10), run.where("qid % 2 = 0"), F.lit(1), 25)


def filled_worksheet(s, d):
    """Labels as people graded them: the quality, left blank for some, with pairs that the judge never saw."""
    rows = table(s, d, "labels")
    sheet = rows.select(F.col("doc_id").cast("string").alias("pair_id"), F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("quality").cast("string"))).alias("human_grade"))
    judge = rows.where("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("key"), (1 - F.col("toxic")).alias("grade"))
    return J.calibration(sheet, judge)


def run_versions(s, d):
    """Runs as manifests: a part's brand is the version of materials, its size that of queries."""
    m = table(s, d, "part").select(F.col("p_partkey").alias("run_id"), F.col("p_brand").alias("materials"), F.col("p_size").alias("queries"))
    first = m.agg(F.min_by(F.struct("materials", "queries"), "run_id").alias("v")).select("v.*")
    return J.one_version(m.join(F.broadcast(first), ["materials", "queries"], "left_semi"), "materials", "queries").select("run_id")


def vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"), "embedding")


def vector_upsert(s, d):
    v = vectors(s, d)
    old = v.where("vec_id % 3 <> 0").withColumn("kept", F.lit(True))
    new = v.where("vec_id % 2 = 0").withColumn("embedding", F.reverse("embedding"))
    return M.upsert_vectors(old, new, ["vec_id", "model"]).select("vec_id", "model", "kept", T.vector_literal(F.col("embedding")).alias("embedding"))


def cache_split(s, d):
    v = vectors(s, d)
    request = v.select("vec_id", "model").union(v.select("vec_id", "model"))
    hit, owed = M.cached_and_owed(request, v.where("vec_id % 3 = 0"), ["vec_id", "model"])
    return hit.select("vec_id", F.lit("cached").alias("state"), T.vector_literal(F.col("embedding")).alias("embedding")).unionByName(owed.select("vec_id", F.lit("owed").alias("state"), F.lit(None).cast("string").alias("embedding")))


def freeze(s, d):
    """May captions (documents with text of 200 characters or more) of pictures (all documents) be frozen?"""
    rows = table(s, d, "documents").select((F.length("text") >= 200).alias("done"), (F.col("doc_id") % 40 == 0).alias("failed"))
    n = rows.agg(F.count("*").alias("pictures"), F.count_if("done").alias("captions"), F.count_if(F.expr("failed AND NOT coalesce(done, false)")).alias("failed"))
    return n.withColumn("frozen", (F.col("captions") + F.col("failed") >= F.col("pictures")) & (F.col("failed") <= 0.05 * F.col("pictures")))


def facet_arms(s, d):
    """One arm for each half of the labels of vectors, fused."""
    v, q = L.vecs(s, d), L.every_20th(L.vecs(s, d))
    return L.hits(S.fuse({name: S.dense_top(q, v.where(where), S.DEPTH) for name, where in (("low", "label < 5"), ("high", "label >= 5"))}, 10))


def zoned(s, d):
    return table(s, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


def window_rows(rows):
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def batches(s, d):
    from ..streaming import events
    from .scratch import folder

    out = folder(s)
    events.count_batches(events.read(s, f"{d}/events.parquet*", table(s, d, "events").schema), f"{out}/rows", f"{out}/checkpoint")
    return s.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.sum("n").alias("n"))


def streaming():
    from ..streaming import events

    return events


def shapes(s, d):
    """Texts as vectors that SQL can count: their length, blanks and letters e."""
    provider = P.Provider("shape-3", 3, lambda texts: [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts], max_batch=7)
    return P.embed(L.docs(s, d), provider).select("doc_id", *[F.element_at("embedding", k + 1).cast("long").alias(name) for k, name in enumerate(("length", "blanks", "es"))], "model")


def excluded_pages(s, d):
    """Pages of which no URL (the page, its picture, its renditions) is one that every seventh page has."""
    p = table(s, d, "pages")
    files = F.concat(F.lit('[{"link":"f'), F.col("page_id") % 50, F.lit('"},{"width":3},{"link":""}]'))
    urls = p.select(F.col("page_id").alias("doc_id"), F.explode(urls_of(F.col("url"), F.concat("url", F.lit("/thumb")), files)).alias("url"))
    shut = p.where("page_id % 7 = 0").select("url").union(p.where("page_id < 3").select(F.concat("url", F.lit("/thumb")))).union(s.createDataFrame([("f11",)], "url string"))
    bad = urls.join(shut.distinct(), "url", "left_semi").select(F.col("doc_id").alias("page_id")).distinct()
    return p.join(bad, "page_id", "left_anti").select("page_id")


QUERIES = {
    "multi_get": lambda s, d: table(s, d, "customer").join(F.broadcast(s.createDataFrame([(3,), (1,), (999_999_999,)], "c_custkey long")), "c_custkey", "left_semi").select("c_custkey", "c_name").orderBy("c_custkey"),
    "composite_lookup": lambda s, d: vectors(s, d).where("vec_id = 7 AND model IN ('m0', 'm1')").select("vec_id", "model"),
    "normalize_media": media,
    "caption_cleanup": lambda s, d: answers(s, d).select("conv_id", "turn", T.caption(F.col("parts")).alias("caption")),
    "clean_terms": lambda s, d: E.terms(s, d).where(T.is_clean(F.col("term"))).select("doc_id", "nth", "term"),
    "url_quote": lambda s, d: table(s, d, "part").select("p_partkey", T.url_quoted(F.concat("p_name", F.lit(" a~b*c d/e+%\u00e9_."))).alias("q")),
    "page_url": lambda s, d: table(s, d, "part").select("p_partkey", T.page_url("https://x.org/video/", F.when(F.col("p_partkey") % 2 == 0, T.slug(F.col("p_name"))), F.col("p_partkey")).alias("url")),
    "cursor_crossed": lambda s, d: table(s, d, "events").select("event_id", T.crossed(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("2024-01-15 12:00:00")).alias("crossed"), T.crossed(F.col("event_type"), F.lit("error")).alias("by_text")),
    "judge_versions": lambda s, d: table(s, d, "events").select(T.judge_version(F.col("event_type"), F.lit("prompt-v1")).alias("version")).distinct(),
    "saturation": lambda s, d: table(s, d, "part").select("p_partkey", F.round(480.0 * F.pow(1.0 - F.col("p_size") / 100.0, 2), 6).alias("new_a_term")),
    "exclude_urls": excluded_pages,
    "pending_thumbnails": lambda s, d: table(s, d, "orders").where("o_orderstatus = 'O' AND o_orderpriority IS NOT NULL").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey"),
    "match_proxy": lambda s, d: Q.match(E.terms(s, d).select(F.struct("doc_id", "nth").alias("key"), "term"), B.document_counts(L.docs(s, d))).select("key.doc_id", "key.nth", "match"),
    "choose_queries": terms_to_choose,
    "designed_faults": lambda s, d: Q.faults(designed(s, d), ["motion", "place"], ["orientation"], ["easy", "hard"], ["en", "zh"]),
    "designed_counts": lambda s, d: Q.counts_differ(designed(s, d), {"facet": 1, "concept": 0, "filter": 5}),
    "judge_pass": judged,
    "judge_budget": lambda s, d: budgeted(E.run(s, d)).select("qid", "doc_id", "status"),
    "calibration_score": filled_worksheet,
    "runs_of_version": run_versions,
    "pairwise_wins": lambda s, d: X.pairwise_wins(stored(E.scored_runs(s, d))),
    "export_queries": lambda s, d: files.query_rows(queries_table(s, d)),
    "export_judgments": lambda s, d: files.judgment_rows(judgment_records(s, d)),
    "calibration_worksheet": blind_worksheet,
    "vector_upsert": vector_upsert,
    "vector_cache_split": cache_split,
    "caption_freeze": freeze,
    "facet_fusion": facet_arms,
    "content_hash": lambda s, d: ordered_hash(table(s, d, "documents").select("doc_id", "lang", F.md5("text").alias("text")), "doc_id", 100),
    "kind_counts": lambda s, d: K.kinds(table(s, d, "events"), "event_type", "user_id"),
    "resume_keys": lambda s, d: K.resume(table(s, d, "events").where("event_type = 'view'"), table(s, d, "events").where("event_type = 'error' AND user_id % 3 = 0"), "user_id"),
    "head_marker": lambda s, d: streaming().after_marker(zoned(s, d), zoned(s, d).where("event_type = 'signup'").agg(F.max("ts").alias("marker"))).select("event_id"),
    "window_tumbling": lambda s, d: window_rows(streaming().tumbling(zoned(s, d), "1 day")),
    "window_sliding": lambda s, d: window_rows(streaming().tumbling(zoned(s, d), "2 days", "1 day")),
    "window_session": lambda s, d: streaming().sessions(zoned(s, d), "12 hours").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest")),
    "stream_incremental_counts": batches,
    "provider_embed": shapes,
    "strategy_rrf": lambda s, d: L.hits(P.strategy("rrf", P.hash_provider(256)).hits(L.items(s, d), L.docs(s, d), 10)),
}



def arm_sql(number: int, where: str) -> str:
    """The best 100 of one arm, as e1 or e2."""
    sql = L.dense_sql(100, L.COSINE, where=where)
    return sql.replace("d AS (SELECT a.", f"d{number} AS (SELECT a.").replace("de AS (", f"e{number} AS (").replace("FROM d)", f"FROM d{number})")


JUNK = f"""lower(term) LIKE '%http%' OR lower(term) LIKE '%www%' OR len(t) NOT BETWEEN 1 AND 6 OR len(list_filter(t, lambda x: NOT regexp_full_match(x, '[0-9]+'))) = 0
  OR len(list_filter(t, lambda x: regexp_full_match(x, '[a-z]{{2,}}'))) = 0 OR len(list_filter(t, lambda x: x NOT IN {T.STOPWORDS})) = 0"""
DAY = "strftime(date_trunc('day', ts), '%Y-%m-%d')"
V = "v AS (SELECT vec_id, 'm' || label % 2 AS model, embedding FROM embeddings)"


def literal_sql(vector: str) -> str:
    return f"'[' || array_to_string(list_transform({vector}, lambda x: printf('%.6g', x::DOUBLE)), ',') || ']'"


ORACLES = {
    "multi_get": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 3)",
    "composite_lookup": f"WITH {V} SELECT vec_id, model FROM v WHERE vec_id = 7",
    "normalize_media": "SELECT p_partkey AS item_id, p_name AS title, p_brand || '|x' AS tags, p_size AS duration, CASE WHEN p_size % 3 <> 0 THEN p_size END AS width, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size = 20 THEN 'square' WHEN p_size < 20 THEN 'portrait' ELSE 'landscape' END AS orientation, 'u' AS user_name, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 't' || p_partkey WHEN 2 THEN 's' WHEN 3 THEN 'y' ELSE 'p' END AS thumbnail_url, CASE WHEN p_size % 5 = 1 THEN 'd' END AS download_link, p_size % 5 = 2 AS uhd FROM part",
    "caption_cleanup": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Subject: a cat' WHEN 1 THEN 'A dog runs' ELSE 'it rains' END || ' end' || turn AS caption FROM conversations",
    "clean_terms": f"WITH {E.TERMS} SELECT doc_id, nth, term FROM tm WHERE regexp_full_match(term, '[a-z][a-z ]{{2,40}}')",
    "url_quote": "SELECT p_partkey, replace(url_encode(p_name), '*', '%2A') || '%20a~b%2Ac%20d%2Fe%2B%25%C3%A9_.' AS q FROM part",
    "page_url": "SELECT p_partkey, 'https://x.org/video/' || CASE WHEN p_partkey % 2 = 0 THEN coalesce(nullif(left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 60), ''), 'term') ELSE 'video' END || '-' || p_partkey || '/' AS url FROM part",
    "cursor_crossed": "SELECT event_id, date_trunc('second', ts) <= TIMESTAMP '2024-01-15 12:00:00' AS crossed, event_type <= 'error' AS by_text FROM events",
    "judge_versions": "SELECT DISTINCT event_type || '@prompt-v1' AS version FROM events",
    "saturation": "SELECT p_partkey, round(480e0 * (1e0 - p_size / 100e0) ** 2, 6) AS new_a_term FROM part",
    "exclude_urls": "WITH x AS (SELECT url FROM pages WHERE page_id % 7 = 0 UNION SELECT url || '/thumb' FROM pages WHERE page_id < 3 UNION SELECT 'f11') SELECT page_id FROM pages WHERE url NOT IN (FROM x) AND url || '/thumb' NOT IN (FROM x) AND 'f' || page_id % 50 NOT IN (FROM x)",
    "pending_thumbnails": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IS NOT NULL ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "match_proxy": f"WITH {L.COUNTS}, {E.TERMS}, {E.MATCH} SELECT doc_id, nth, match FROM m",
    "choose_queries": f"WITH {L.COUNTS}, {E.TERMS}, tt AS (SELECT term, regexp_extract_all(lower(term), '[a-z0-9]+') AS t FROM (SELECT DISTINCT term FROM tm)), ok AS (SELECT * FROM tt WHERE NOT ({JUNK})), mt AS (SELECT x.term, coalesce(max(df), 0) AS match FROM (SELECT term, unnest(t) AS token FROM ok) x LEFT JOIN df ON df.term = token GROUP BY ALL), bd AS (SELECT *, CASE WHEN match >= 1000 THEN 'head' WHEN match >= 100 THEN 'torso' WHEN match >= 2 THEN 'tail' END AS band FROM mt) SELECT term, match, band FROM bd WHERE band IS NOT NULL QUALIFY row_number() OVER (PARTITION BY band ORDER BY md5(term), term) <= 30",
    "designed_faults": "SELECT item_id::VARCHAR AS text, unnest(CASE item_id % 4 WHEN 0 THEN ['composition'] WHEN 1 THEN ['language'] WHEN 2 THEN ['difficulty'] ELSE ['facet'] END) AS fault FROM benchmark",
    "designed_counts": "SELECT category, n, wanted FROM (SELECT 'facet' AS category, count(*) FILTER (item_id % 4 <> 0) AS n, 1 AS wanted FROM benchmark UNION ALL SELECT 'composition', count(*) FILTER (item_id % 4 = 0), 0 FROM benchmark UNION ALL SELECT 'filter', 0, 5) WHERE n <> wanted",
    "judge_pass": f"WITH {E.RUNS},\n{E.MOCK} SELECT count(*) AS pool, count(*) FILTER (qid % 2 = 0) AS cached, count(*) FILTER (qid % 2 <> 0) AS judged, count(*) FILTER (qid % 2 <> 0 AND grade IS NULL) AS unparsed FROM lb",
    "judge_budget": f"WITH {L.bm25_sql(10)} SELECT qid, doc_id, 'ok' AS status FROM bm WHERE qid % 2 <> 0 ORDER BY qid, doc_id LIMIT 25",
    "calibration_score": "WITH x AS (SELECT quality AS b, 1 - toxic AS a, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS good FROM labels), c AS (SELECT count(*) FILTER (NOT good) AS n_skipped, count(*) FILTER (good)::DOUBLE AS n, avg(CASE WHEN a = b THEN 1e0 ELSE 0 END) FILTER (good) AS po, sum(a) FILTER (good) AS sa, sum(b) FILTER (good) AS sb FROM x), k AS (SELECT *, (sa * sb + (n - sa) * (n - sb)) / n ** 2 AS pe FROM c) SELECT n::BIGINT AS n_graded, n_skipped, round(po, 9) AS agreement, round((po - pe) / (1 - pe), 9) AS kappa, (po - pe) / (1 - pe) >= 0.4 AS passed FROM k",
    "runs_of_version": "SELECT p_partkey AS run_id FROM part WHERE (p_brand, p_size) = (SELECT (p_brand, p_size) FROM part ORDER BY p_partkey LIMIT 1)",
    "export_queries": f"WITH {E.SPLIT} SELECT qid, CASE WHEN qid % 6 = 0 THEN text || ' \u7530\u91ce' ELSE text END AS text, source, category, lang, array_to_string(facets, ';') AS facets, CASE WHEN hard THEN '{{\"orientation\":\"portrait\"}}' ELSE '' END AS hard, difficulty, match_docs, split FROM sp JOIN benchmark ON item_id = qid",
    "export_judgments": f"WITH {E.RUNS},\n{E.MOCK} SELECT qid, CASE WHEN qid % 6 = 0 THEN b.text || ' \u7530\u91ce' ELSE b.text END AS query_text, doc_id, md5(d.text) AS doc_hash, d.text AS doc_text, coalesce(grade::VARCHAR, '') AS grade, 'because ' || doc_id AS reason, CASE WHEN grade IS NULL THEN 'unparsed' ELSE 'ok' END AS status, '2024-06-01' AS ts FROM lb JOIN benchmark b ON item_id = qid JOIN documents d USING (doc_id)",
    "calibration_worksheet": f"WITH {E.RUNS},\n{E.MOCK}, g AS (SELECT grade, count(*) AS c FROM lb WHERE grade IS NOT NULL GROUP BY ALL) SELECT grade, least(c, CASE grade WHEN 1 THEN 15 WHEN 3 THEN 5 ELSE 10 END) AS n, least(c, CASE grade WHEN 1 THEN 15 WHEN 3 THEN 5 ELSE 10 END) AS open FROM g",
    "vector_upsert": f"WITH {V} SELECT vec_id, model, CASE WHEN vec_id % 3 <> 0 THEN true END AS kept, {literal_sql('CASE WHEN vec_id % 2 = 0 THEN list_reverse(embedding) ELSE embedding END')} AS embedding FROM v WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0",
    "vector_cache_split": f"SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'cached' ELSE 'owed' END AS state, CASE WHEN vec_id % 3 = 0 THEN {literal_sql('embedding')} END AS embedding FROM embeddings",
    "caption_freeze": "WITH n AS (SELECT count(*) AS pictures, count(*) FILTER (length(text) >= 200) AS captions, count(*) FILTER (doc_id % 40 = 0 AND NOT coalesce(length(text) >= 200, false)) AS failed FROM documents) SELECT *, captions + failed >= pictures AND failed <= 0.05 * pictures AS frozen FROM n",
    "facet_fusion": f"WITH {arm_sql(1, 'label < 5')},\n{arm_sql(2, 'label >= 5')},\nf AS (SELECT qid, doc_id, round(sum(1e0 / (60 + rank)), 9) AS score FROM (SELECT qid, doc_id, rank FROM e1 UNION ALL SELECT qid, doc_id, rank FROM e2) GROUP BY ALL),\n{L.ranked('r', 'f', 10)} {L.HITS} FROM r",
    "content_hash": """WITH r AS (SELECT doc_id, md5('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"text":' || coalesce('"' || md5(text) || '"', 'null') || '}') AS h FROM documents),
g AS (SELECT doc_id // 100 AS k, md5(string_agg(h, '' ORDER BY doc_id, h)) AS h, count(*) AS n FROM r GROUP BY ALL) SELECT sum(n)::BIGINT AS n, md5(string_agg(h, '' ORDER BY k)) AS hash FROM g""",
    "kind_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS keys FROM events GROUP BY ALL",
    "resume_keys": "SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 3 = 0)",
    "head_marker": "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup')",
    "window_tumbling": f"SELECT {DAY} AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "window_sliding": "SELECT strftime(start, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts) - to_days(unnest([0, 1])::INT) AS start FROM events) GROUP BY ALL",
    "window_session": "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 12 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT user_id, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM k GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM n GROUP BY ALL",
    "stream_incremental_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY ALL",
    "provider_embed": "SELECT doc_id, length(coalesce(text, '')) AS length, len(coalesce(text, '')) - len(replace(coalesce(text, ''), ' ', '')) AS blanks, len(coalesce(text, '')) - len(replace(coalesce(text, ''), 'e', '')) AS es, 'shape-3' AS model FROM documents",
    "pairwise_wins": f"WITH {E.RUNS},\n{E.MOCK},\n{E.metric_sql(chr(32).join(('SELECT', chr(39) + 'query' + chr(39), 'AS run_id, * FROM bm UNION ALL SELECT', chr(39) + 'both' + chr(39) + ', * FROM bb')))}, d AS (SELECT round(x.ndcg10, 9) - round(y.ndcg10, 9) AS d FROM mq x JOIN mq y USING (qid) WHERE x.run_id = 'both' AND y.run_id = 'query') SELECT 'both' AS a, 'query' AS b, count(*) AS n, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties FROM d",
}
