"""Queries over text and vectors: tokens, BM25, dense and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.hashing import blake2b_hex
from ..operators import bm25 as B
from ..operators import report as R
from ..operators import search as S

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
COUNTS = f"""t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT doc_id, len({TOKENS}) AS dl FROM documents),
st AS (SELECT count(*) AS n, sum(dl) AS total, sum(dl)::DOUBLE / count(*) AS average FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)"""
WEIGHTS = COUNTS + """,
w AS (SELECT doc_id, term, tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / average)) AS w,
  ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf FROM tf JOIN dl USING (doc_id) JOIN df USING (term), st)"""
QUERY_TERMS = f"q AS (SELECT DISTINCT item_id AS qid, unnest({TOKENS}) AS term FROM benchmark)"


def ranked(name: str, source: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k})"


def bm25_sql(k: int, weight: str = "w * idf", where: str = "true") -> str:
    scored = f"s AS (SELECT qid, doc_id, round(sum({weight}), 9) AS score FROM w JOIN q USING (term) WHERE {where} GROUP BY ALL)"
    return f"{WEIGHTS},\n{QUERY_TERMS},\n{scored},\n{ranked('bm', 's', k)}"


def dense_sql(k: int, score: str, queries: str = "vec_id % 20 = 0", where: str = "true") -> str:
    scored = f"d AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round({score}, 9) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE {queries}) a, (SELECT vec_id, embedding::DOUBLE[] AS y FROM embeddings WHERE {where}) b)"
    return f"{scored},\n{ranked('de', 'd', k)}"


COSINE = "list_cosine_similarity(x, y)"
BY_ITEM = "vec_id IN (SELECT item_id FROM benchmark)"
FUSED = "f AS (SELECT qid, doc_id, round(sum(1e0 / (60 + rank)), 9) AS score FROM (SELECT qid, doc_id, rank FROM bm UNION ALL SELECT qid, doc_id, rank FROM de) GROUP BY ALL)"
HITS = "SELECT qid, doc_id, rank, round(score, 6) AS score"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vecs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def hits(df):
    return df.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def every_20th(v):
    return v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "embedding")


def item_vectors(spark, d):
    names = items(spark, d).select(F.col("qid").alias("doc_id"))
    return vecs(spark, d).join(names, "doc_id", "left_semi").select(F.col("doc_id").alias("qid"), "embedding")


def bm25_hits(spark, d, k=10, **model):
    return B.top_hits(items(spark, d), docs(spark, d), k, B.Bm25(**model))


def english(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id")


def fused(spark, d, k, allowed=None):
    scored = B.top_hits(items(spark, d), docs(spark, d), S.DEPTH, allowed=allowed)
    v = vecs(spark, d) if allowed is None else vecs(spark, d).join(allowed, "doc_id", "left_semi")
    return S.fuse({"sparse": scored, "dense": S.dense_top(item_vectors(spark, d), v, S.DEPTH)}, k)


def hash_weights(spark, d):
    """Counts of tokens by a hash of them: the offline stand-in for an embedding."""
    counts = B.term_counts(docs(spark, d))
    bucket = F.conv(blake2b_hex(F.col("term"), 4), 16, 10).cast("long") % 1_000_000_000
    return counts.withColumn("bucket", bucket).groupBy("doc_id", "bucket").agg(F.sum("tf").alias("weight"))


def exclude_backfill(spark, d):
    """The first ten hits whose source is not shut out: all scores are there, so no number of excluded hits leaves a gap."""
    shut = spark.createDataFrame([("src0",), ("src1",)], "url string")
    urls = table(spark, d, "documents").select("doc_id", F.col("source").alias("url"))
    return hits(S.exclude(B.scores(items(spark, d), docs(spark, d)), urls, shut, 10))


DOC_WEIGHT = {"query": "w", "doc": "w * idf", "both": "w * idf"}
QUERIES = {
    "tokenize_terms": lambda s, d: B.term_counts(docs(s, d)).select("doc_id", "term", "tf"),
    "term_doc_freq": lambda s, d: B.document_frequency(B.term_counts(docs(s, d))),
    "bm25_stats": lambda s, d: B.statistics(docs(s, d)).withColumn("avg_len", F.round("avg_len", 6)),
    "bm25_vocab": lambda s, d: B.vocabulary(docs(s, d)).select("term", F.col("term_id").cast("long").alias("term_id"), "df", F.round("idf", 6).alias("idf")),
    **{f"bm25_doc_weights_{side}": lambda s, d, side=side: B.postings(docs(s, d), B.Bm25(idf_side=side)).select("doc_id", "term", F.round("weight", 6).alias("weight")) for side in DOC_WEIGHT},
    "bm25_topk": lambda s, d: hits(bm25_hits(s, d)),
    "bm25_topk_both": lambda s, d: hits(bm25_hits(s, d, idf_side="both")),
    "bm25_topk_filtered": lambda s, d: hits(B.top_hits(items(s, d), docs(s, d), 10, allowed=english(s, d))),
    "bm25_topk_postings": lambda s, d: hits(B.top(B.scores(items(s, d), docs(s, d)), 10)),
    "dense_cosine_topk": lambda s, d: hits(S.dense_top(every_20th(vecs(s, d)), vecs(s, d), 10)),
    "dense_l2_topk": lambda s, d: hits(S.dense_top(every_20th(vecs(s, d)), vecs(s, d), 10, "l2")),
    "dense_ip_topk": lambda s, d: hits(S.dense_top(every_20th(vecs(s, d)), vecs(s, d), 10, "inner")),
    "dense_topk_filtered": lambda s, d: hits(S.dense_top(every_20th(vecs(s, d)), vecs(s, d).where("label < 5"), 10)),
    "dense_normalize": lambda s, d: vecs(s, d).select("doc_id", F.posexplode(V.unit(F.col("embedding"))).alias("at", "x")).select("doc_id", F.col("at").cast("long").alias("at"), F.round("x", 6).alias("x")),
    "rrf_fusion": lambda s, d: hits(fused(s, d, 10)),
    "hybrid_search": lambda s, d: S.hydrate(hits(fused(s, d, 10, english(s, d))), table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")),
    "hybrid_exclude_backfill": exclude_backfill,
    "hydrate_ranked": lambda s, d: S.hydrate(hits(bm25_hits(s, d)), table(s, d, "documents").select("doc_id", "source", "n_chars")),
    "hash_sparse_weights": hash_weights,
    "hash_dense_topk": lambda s, d: hits(S.dense_top(hash_dense(items(s, d).withColumnRenamed("qid", "doc_id")).withColumnRenamed("doc_id", "qid"), hash_dense(docs(s, d)), 10)),
    "export_hits": lambda s, d: R.hit_rows(hits(bm25_hits(s, d))),
    "detect_lang": lambda s, d: docs(s, d).select("doc_id", T.language(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" \u7530\u91ce"))).otherwise(F.col("text"))).alias("lang")),
    "vector_literal": lambda s, d: vecs(s, d).select("doc_id", T.vector_literal(F.col("embedding")).alias("literal"), F.size(T.parsed_vector(T.vector_literal(F.col("embedding")))).cast("long").alias("n")),
    "sparse_literal": lambda s, d: vecs(s, d).select("doc_id", T.sparse_literal(F.filter(F.transform("embedding", lambda x, i: F.struct((i * 7 % 67).alias("number"), x.alias("weight"))), lambda p: p["weight"] > 0), 67).alias("literal")),
}


def hash_dense(rows: DataFrame, size: int = 256) -> DataFrame:
    """doc_id and embedding: counts of tokens by hash buckets; a text without tokens is a zero vector."""
    bucket = (F.conv(F.substring(blake2b_hex(F.col("term"), 8), 1, 8), 16, 10).cast("long") % size).cast("int")
    counts = B.term_counts(rows).withColumn("bucket", bucket).groupBy("doc_id", "bucket").agg(F.sum("tf").cast("float").alias("n"))
    maps = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float"))
    return rows.select("doc_id").join(maps, "doc_id", "left").select("doc_id", vector.alias("embedding"))


ORACLES = {
    "tokenize_terms": f"WITH {COUNTS} SELECT doc_id, term, tf FROM tf",
    "term_doc_freq": f"WITH {COUNTS} SELECT term, df FROM df",
    "bm25_stats": f"WITH {COUNTS} SELECT n AS n_docs, total::BIGINT AS total_len, round(average, 6) AS avg_len FROM st",
    "bm25_vocab": f"WITH {COUNTS} SELECT term, row_number() OVER (ORDER BY df DESC, term) AS term_id, df, round(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)), 6) AS idf FROM df, st",
    **{f"bm25_doc_weights_{side}": f"WITH {WEIGHTS} SELECT doc_id, term, round({w}, 6) AS weight FROM w" for side, w in DOC_WEIGHT.items()},
    "bm25_topk": f"WITH {bm25_sql(10)} {HITS} FROM bm",
    "bm25_topk_both": f"WITH {bm25_sql(10, 'w * idf * idf')} {HITS} FROM bm",
    "bm25_topk_filtered": f"WITH {bm25_sql(10, where=chr(39).join(('doc_id IN (SELECT doc_id FROM documents WHERE lang = ', 'en', ')')))} {HITS} FROM bm",
    "dense_cosine_topk": f"WITH {dense_sql(10, COSINE)} {HITS} FROM de",
    "dense_l2_topk": f"WITH {dense_sql(10, '0 - list_distance(x, y)')} {HITS} FROM de",
    "dense_ip_topk": f"WITH {dense_sql(10, 'list_inner_product(x, y)')} {HITS} FROM de",
    "dense_topk_filtered": f"WITH {dense_sql(10, COSINE, where='label < 5')} {HITS} FROM de",
    "dense_normalize": "SELECT vec_id AS doc_id, i - 1 AS at, round(x[i] / sqrt(list_inner_product(x, x)), 6) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "rrf_fusion": f"WITH {bm25_sql(100)},\n{dense_sql(100, COSINE, BY_ITEM)},\n{FUSED},\n{ranked('r', 'f', 10)} {HITS} FROM r",
    "hybrid_search": f"WITH {bm25_sql(100, where=chr(39).join(('doc_id IN (SELECT doc_id FROM documents WHERE lang = ', 'en', ')')))},\n{dense_sql(100, COSINE, BY_ITEM, 'vec_id IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')')},\n{FUSED},\n{ranked('r', 'f', 10)} {HITS}, lang, source, n_chars FROM r JOIN documents USING (doc_id)",
    "hybrid_exclude_backfill": f"WITH {bm25_sql(1000000000)},\nx AS (SELECT qid, doc_id, score FROM s WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source IN ('src0', 'src1'))),\n{ranked('r', 'x', 10)} {HITS} FROM r",
    "hydrate_ranked": f"WITH {bm25_sql(10)} {HITS}, source, n_chars FROM bm JOIN documents USING (doc_id)",
    "export_hits": f"WITH {bm25_sql(10)} SELECT qid, doc_id, rank, printf('%.6f', round(score, 6)) AS score FROM bm",
    "bm25_topk_postings": f"WITH {bm25_sql(10)} {HITS} FROM bm",
    "detect_lang": "SELECT doc_id, CASE WHEN text IS NOT NULL AND doc_id % 7 = 0 OR regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' ELSE 'en' END AS lang FROM documents",
    "vector_literal": "SELECT vec_id AS doc_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6g', x::DOUBLE)), ',') || ']' AS literal, len(embedding) AS n FROM embeddings",
    "sparse_literal": "SELECT vec_id AS doc_id, '{' || array_to_string(list_transform(list_sort(list_filter(list_transform(range(0, len(embedding)), lambda i: {'n': i * 7 % 67, 'w': embedding[i + 1]}), lambda p: p.w > 0)), lambda p: p.n || ':' || printf('%.6g', p.w::DOUBLE)), ',') || '}/67' AS literal FROM embeddings",
}
