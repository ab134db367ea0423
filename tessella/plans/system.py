"""Queries over whole paths: library search with its log, models and runs that are kept, samples and query sets as they are built."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25 as B
from ..operators import library as Y
from ..operators import loops as O
from ..operators import materials as X
from ..operators import runs as U
from ..sources import files
from . import catalogue as C
from . import evaluation as E
from . import library as L
from . import more
from .library import table
from .scratch import folder

WHERE = Y.Filter(orientation="portrait", min_duration=200)
SHUT = ["s/src1", "s/src2", "s/src3", "p5", "p7", "f9"]


def media(s, d):
    """Documents as media with vectors; two of three are portrait."""
    docs = table(s, d, "documents").join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    renditions = F.concat(F.lit('[{"link":"f'), F.col("doc_id") % 30, F.lit('"}]'))
    urls = Y.urls_of(F.concat(F.lit("p"), F.col("doc_id").cast("string")), F.concat(F.lit("s/"), "source"), renditions)
    return docs.select("doc_id", "text", "embedding", F.when(F.col("doc_id") % 3 == 0, "landscape").otherwise("portrait").alias("orientation"), F.col("n_chars").alias("duration"), F.lit(4000).alias("width"), F.lit("free").alias("license"), urls.alias("urls"), "source")


def asked(s, d):
    return L.items(s, d).join(L.item_vectors(s, d), "qid", "left")


def found(s, d):
    shut = s.createDataFrame([(u,) for u in SHUT], "url string")
    return Y.search_library(asked(s, d), media(s, d), 10, where=WHERE, excluded=shut)


def logged(s, d):
    rows = Y.log_rows(asked(s, d), found(s, d), 10, WHERE, len(SHUT))
    return rows.select("q", "k", "orientation", "min_duration", "exclude", F.col("arms.dense").alias("dense"), F.col("arms.sparse").alias("sparse"), F.size("top").alias("n_top"))


def reranked(s, d):
    """The first hits again in the order of their ids, odd ones behind."""
    hits = L.hits(L.bm25_hits(s, d))
    again = hits.where("doc_id % 2 = 0").select("qid", "doc_id", (-F.col("doc_id")).cast("double").alias("score"))
    return Y.rerank(hits, again, 8).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"))


def model_again(s, d):
    """Weights by a model that was written and read."""
    path = f"{folder(s)}/model"
    B.save(L.docs(s, d), path)
    fitted = B.load(s, path)
    return fitted.sparse_text(L.docs(s, d)).join(fitted.vocabulary, "term_id").select("doc_id", "term", F.round("weight", 6).alias("weight"))


def query_weights(s, d):
    path = f"{folder(s)}/model"
    B.save(L.docs(s, d), path)
    fitted = B.load(s, path)
    return fitted.query_weights(L.items(s, d)).join(fitted.vocabulary, "term_id").select("qid", "term", F.round("weight", 6).alias("weight"))


def kept_runs(s, d):
    """Hits of the runs of one version, of three that were kept."""
    path, hits, times = folder(s), E.two(s, d), E.timings(s, d)
    for name, materials in (("query", "m1"), ("both", "m1"), ("both", "m2")):
        U.save(hits.where(F.col("run_id") == name), times.where(F.col("run_id") == name), path, f"{name}-{materials}", {"strategy": f"bm25-{name}"}, materials, "q1")
    return U.hit_rows(U.load(s, path, U.find(s, path, "m1", "q1"))[0], U.find(s, path, "m1", "q1"))


def sampled(s, d):
    return X.build(C.parts(s, d), 800, E.hashed("id"), 20)


def designed(s, d):
    q = table(s, d, "benchmark")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return q.select("text", F.lit("facet").alias("category"), F.lit("en").alias("lang"), F.lit("easy").alias("difficulty"), F.array(F.lit("motion")).alias("facets"), none.alias("hard"))


def built(s, d):
    terms = E.terms(s, d).select("term")
    rows = X.query_set(terms, B.document_counts(L.docs(s, d)), designed(s, d), F.md5("term"))
    return rows.select("text", "source", "category", "lang", "difficulty", "match_docs", "split")


def fresh(s, d):
    terms = E.terms(s, d).select("term")
    done = terms.where(F.md5("term") < "8").select(T.slug(F.col("term")).alias("slug"))
    return O.fresh_terms(terms, done, F.md5("term"), 40)


def unpacked(s, d):
    """Pages of which every other came compressed."""

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else gzip.compress(v))

    raw = F.col("html").cast("binary")
    data = F.when(F.col("page_id") % 2 == 0, pack(raw)).otherwise(raw)
    return table(s, d, "pages").select("page_id", data.alias("data")).select("page_id", F.md5(files.gunzipped(F.col("data"))).alias("digest"))


def page_data(s, d):
    """Data of pages in usable and other shapes."""
    p = table(s, d, "pages").select("page_id", (F.col("page_id") % 5).alias("kind"))
    medium = lambda inner: F.concat(F.lit('{"pageProps":{"medium":{"attributes":'), inner, F.lit("}}}"))
    payload = F.when(F.col("page_id") % 10 == 0, medium(F.lit('{"id":null}'))).when(F.col("kind") == 0, medium(F.concat(F.lit('{"id":'), "page_id", F.lit("}")))).when(F.col("kind") == 1, medium(F.lit('{"name":1}'))).when(F.col("kind") == 2, medium(F.lit("[1]"))).when(F.col("kind") == 3, F.lit('{"pageProps":7}')).otherwise(F.lit("no json"))
    return p.select("page_id", T.page_attributes(payload).alias("found")).where("found is not null").select("page_id", F.get_json_object("found", "$.id").cast("long").alias("id"))


QUERIES = {
    "search_library": lambda s, d: found(s, d).hits.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "source"),
    "search_log": logged,
    "rerank": reranked,
    "bm25_model_saved": model_again,
    "bm25_query_weights": query_weights,
    "runs_kept": kept_runs,
    "materials_sample": lambda s, d: sampled(s, d)[0].select("id", "embed_text"),
    "materials_cells": lambda s, d: sampled(s, d)[1],
    "query_set": built,
    "fresh_terms": fresh,
    "gunzip_magic": unpacked,
    "page_attributes": page_data,
}

KEPT = "doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND n_chars >= 200)"
ARMS = f"{L.bm25_sql(100, 'w * idf * idf', KEPT)},\n{L.dense_sql(100, L.COSINE, L.BY_ITEM, KEPT.replace('doc_id IN', 'vec_id IN', 1))},\n{L.FUSED}"
BAD = "b AS (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3') OR doc_id IN (5, 7) OR doc_id % 30 = 9)"
SLUG = "coalesce(nullif(left(trim(regexp_replace(lower(term), '[^a-z0-9]+', '-', 'g'), '-'), 60), ''), 'term')"
ORACLES = {
    "search_library": f"WITH {ARMS},\n{BAD},\n{L.ranked('r', 'f', 16)},\nx AS (SELECT qid, doc_id, score FROM r WHERE doc_id NOT IN (FROM b)),\n{L.ranked('z', 'x', 10)} {L.HITS}, source FROM z JOIN documents USING (doc_id)",
    "search_log": f"""WITH {ARMS},\n{BAD},\n{L.ranked('r', 'f', 16)},\nx AS (SELECT qid, least(10, count(*)) AS n FROM r WHERE doc_id NOT IN (FROM b) GROUP BY ALL)
SELECT text AS q, 10 AS k, 'portrait' AS orientation, 200 AS min_duration, 6 AS exclude, (SELECT count(*) FROM de WHERE qid = item_id) AS dense, (SELECT count(*) FROM bm WHERE qid = item_id) AS sparse, coalesce((SELECT n FROM x WHERE qid = item_id), 0) AS n_top FROM benchmark""",
    "rerank": f"WITH {L.bm25_sql(10)} SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 8 AND doc_id % 2 = 0 THEN -doc_id END DESC NULLS LAST, rank) AS rank FROM bm",
    "bm25_model_saved": f"WITH {L.WEIGHTS} SELECT doc_id, term, round(w * idf, 6) AS weight FROM w",
    "bm25_query_weights": f"WITH {L.WEIGHTS},\n{L.QUERY_TERMS}, i AS (SELECT DISTINCT term, idf FROM w) SELECT qid, term, round(idf, 6) AS weight FROM q JOIN i USING (term)",
    "runs_kept": f"WITH {E.RUNS} SELECT run_id || '-m1' AS run_id, 'bm25-' || run_id AS strategy, qid, rank, doc_id, printf('%.6f', round(score, 6)) AS score FROM ({E.RUN_ROWS})",
    "materials_sample": f"WITH {C.PARTS}, {E.QUOTA} SELECT id, {C.text_sql('title', chr(39).join(('array_to_string(tags, ', ', ', ')')))} AS embed_text FROM pk JOIN qu USING (side, uhd, length) JOIN p USING (id) WHERE place <= quota",
    "materials_cells": f"WITH {C.PARTS}, {E.QUOTA} SELECT side, uhd, length, n AS population, quota, count(place) AS sampled, max(md5(id::VARCHAR)) AS cutoff_hash, arg_max(id, md5(id::VARCHAR)) AS cutoff_id FROM qu LEFT JOIN (SELECT pk.* FROM pk JOIN qu USING (side, uhd, length) WHERE place <= quota) USING (side, uhd, length) GROUP BY ALL",
    "query_set": f"""WITH {L.COUNTS}, r AS (SELECT term AS text, 'catalog' AS source, 'real' AS category, 'en' AS lang, 'medium' AS difficulty, match AS match_docs FROM ({more.ORACLES['choose_queries']})),
t2 AS (SELECT text, unnest({L.TOKENS}) AS term FROM benchmark), e AS (SELECT text, 'designed' AS source, 'facet' AS category, 'en' AS lang, 'easy' AS difficulty, coalesce(max(df), 0) AS match_docs FROM t2 LEFT JOIN df USING (term) GROUP BY text), u AS (FROM r UNION ALL FROM e)
SELECT *, CASE WHEN row_number() OVER (PARTITION BY category, lang ORDER BY md5(text), text) - 1 < round_even(0.7e0 * count(*) OVER (PARTITION BY category, lang), 0) THEN 'train' ELSE 'holdout' END AS split FROM u""",
    "fresh_terms": f"WITH {E.TERMS}, t1 AS (SELECT DISTINCT term, {SLUG} AS slug FROM tm), dn AS (SELECT slug FROM t1 WHERE md5(term) < '8'), c AS (SELECT slug, min_by(term, md5(term)) AS term FROM t1 WHERE regexp_full_match(term, '[a-z][a-z ]{{2,40}}') AND slug NOT IN (FROM dn) GROUP BY slug) SELECT term, slug FROM c ORDER BY md5(term), term LIMIT 40",
    "gunzip_magic": "SELECT page_id, md5(html) AS digest FROM pages",
    "page_attributes": "SELECT page_id, CASE WHEN page_id % 10 <> 0 THEN page_id END AS id FROM pages WHERE page_id % 5 = 0",
}
