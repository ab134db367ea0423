"""Queries that sample, judge and score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25 as B
from ..operators import coverage as V
from ..operators import judging as J
from ..operators import materials as X
from ..operators import metrics as M
from ..operators import queryset as Q
from ..operators import runs as U
from ..operators import sampling as P
from . import library as L
from .catalogue import PARTS, parts
from .library import table
from .scratch import stored

STRATUM = "SELECT *, CASE WHEN orientation IS NULL THEN 'unknown' ELSE orientation END AS side, coalesce(width >= 3840, false) AS uhd, CASE WHEN duration IS NULL THEN 'unknown' WHEN duration < 5 THEN '<5' WHEN duration <= 15 THEN '5-15' WHEN duration <= 60 THEN '15-60' ELSE '>60' END AS length FROM p"
CELL = ["side", "uhd", "length"]


def hashed(*columns):
    """The hex MD5 of columns as text, which SQL has everywhere."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def strata(s, d):
    p = parts(s, d)
    return p.select("id", "title", *P.stratum(F.col("orientation"), F.col("width"), F.col("duration")))


def quota_rows(s, d, total=800, floor=20):
    cells = {tuple(r)[:3]: r.n for r in strata(s, d).groupBy(*CELL).agg(F.count("*").alias("n")).collect()}
    return s.createDataFrame([(*k, n) for k, n in P.quotas(cells, total, floor).items()], "side string, uhd boolean, length string, quota long")


def sample(s, d):
    return P.first_of_each(strata(s, d), CELL, hashed("id"), quota_rows(s, d), "id")


def terms(s, d):
    """Whole documents as query terms of three words each: doc_id, nth (from 0), term."""
    split = table(s, d, "documents").select("doc_id", F.split("text", " ").alias("words"))  # once a text, not once a term of it
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 3).cast("int")), lambda k: F.array_join(F.slice("words", k * 3 + 1, 3), " "))
    return split.select("doc_id", F.posexplode(cut).alias("nth", "term")).withColumn("nth", F.col("nth").cast("long"))


def banded(s, d):
    """Each term's band, by the largest number of documents that one of its tokens has."""
    found = Q.match(terms(s, d).select(F.struct("doc_id", "nth").alias("key"), "term"), B.document_counts(L.docs(s, d)))
    return found.select("key.doc_id", "key.nth", "match", T.band(F.col("match")).alias("band"))


MODELS = {"query": B.Bm25(), "both": B.Bm25(idf_side="both")}


def two(s, d):
    """The hits of both runs (run_id), found in one pass and written once."""
    found = B.top_hits(L.items(s, d), L.docs(s, d), 10, MODELS)
    return stored(found.select("run_id", "qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score")))


def run(s, d, hits=None):
    hits = two(s, d) if hits is None else hits
    return hits.where("run_id = 'query'").drop("run_id")


def pool_of(hits):
    return J.pool([hits], 10)


def with_mock(pooled):
    """A grade 0 to 3 of each pair from a hash; the hash's zero of sixteen is a grade that could not be read."""
    h = F.conv(F.substring(hashed("qid", "doc_id"), 1, 1), 16, 10).cast("int")
    return pooled.select("qid", "doc_id", F.when(h != 0, h % 4).alias("grade"))


def labels(s, d, hits=None):
    return with_mock(pool_of(two(s, d) if hits is None else hits))


def scored(s, d):
    hits = two(s, d)
    return M.per_query(run(s, d, hits), labels(s, d, hits))


def query_set(s, d):
    """The benchmark as a query set: some Chinese ones, three categories, facets and conditions."""
    q = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    qid, text = F.col("qid"), F.when(F.col("qid") % 6 == 0, F.concat("text", F.lit(" \u7530\u91ce"))).otherwise(F.col("text"))
    some = F.map_from_arrays(F.array(F.lit("orientation")), F.array(F.lit("portrait")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    category = F.element_at(F.array(F.lit("facet"), F.lit("concept"), F.lit("composition")), (qid % 3 + 1).cast("int"))
    facets = F.when(qid % 3 == 2, F.array(F.lit("motion"), F.lit("place"))).when(qid % 3 == 0, F.array(F.lit("motion"))).otherwise(F.array().cast("array<string>"))
    source, difficulty = F.when(qid % 4 == 0, "designed").otherwise("catalog"), F.when(qid % 2 == 0, "easy").otherwise("medium")
    q = q.select("qid", text.alias("text"), source.alias("source"), category.alias("category"), T.language(text).alias("lang"), facets.alias("facets"), F.when(qid % 5 == 0, some).otherwise(none).alias("hard"), difficulty.alias("difficulty"), (qid * 37 % 1500).alias("match_docs"))
    return P.split(q, ["category", "lang"], hashed("qid"), "qid")


def scored_runs(s, d):
    hits = two(s, d)
    return U.score(hits, labels(s, d, hits))


def cuts(s, d):
    """Mean nDCG of each run in the holdout by category, language, source, difficulty, conditions and facets."""
    return U.cuts(scored_runs(s, d), query_set(s, d), "holdout").select("run_id", "cut", F.round("mean", 6).alias("ndcg10"), "n")


def split_means(s, d):
    rows = scored(s, d).join(query_set(s, d).select("qid", "split"), "qid")
    return rows.rollup("split").agg(F.count("*").alias("n"), F.round(F.avg("ndcg10"), 6).alias("ndcg10"), F.round(F.avg("mrr10"), 6).alias("mrr10")).select(F.coalesce("split", F.lit("all")).alias("split"), "n", "ndcg10", "mrr10")


def pairs(s, d):
    return table(s, d, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))


def bootstrap(s, d):
    rows = U.pairwise(stored(scored_runs(s, d)), query_set(s, d), "all", hashed=True)
    return rows.select("pair", "n", *[F.round(c, 6).alias(c) for c in ("mean_diff", "low", "high")], "win")


def run_table(s):
    return s.createDataFrame([(name, f"bm25-{name}", "{}", f"hash-{name}") for name in MODELS], "run_id string, strategy string, spec string, config_hash string")


def timings(s, d):
    """Of each run and query a search and an embedding time, from a hash."""
    h = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", "run_id", F.col("qid").cast("string"), F.lit(salt))), 1, 4), 16, 10).cast("double")
    names = F.explode(F.array(*[F.lit(name) for name in MODELS])).alias("run_id")
    return L.items(s, d).select("qid", names).select("run_id", "qid", (h("s") / 100).alias("search_ms"), (h("e") / 1000).alias("embed_ms"))


def board(s, d):
    found = U.leaderboard(stored(scored_runs(s, d)), timings(s, d), run_table(s), query_set(s, d), "holdout")
    numbers = ("ndcg10_split", "ndcg10_full", "recall10", "mrr10", "search_ms_p50", "search_ms_p95", "embed_ms_p50", "embed_ms_p95")
    return found.select(F.col("place").cast("long").alias("place"), "run_id", "strategy", "config_hash", *[F.round(c, 6).alias(c) for c in numbers], "null_grade_top10", "judge_coverage")


def split_summary(s, d):
    rows = U.by_split(stored(scored_runs(s, d)), query_set(s, d))
    return rows.select("run_id", "split", "metric", *[F.round(c, 6).alias(c) for c in ("mean", "median", "min", "max")], "n")


def unjudged_pairs(s, d):
    hits = two(s, d)
    return J.unjudged(pool_of(hits), run(s, d, hits))


def judge_answers(s, d):
    """A judge's answers about each part: whole JSON, JSON in a sentence, several objects, odd grades, none."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 6).cast("string").alias("g"), "p_name")
    kinds = [
        F.concat(F.lit('{"grade": '), "g", F.lit(', "reason": "'), "p_name", F.lit('", "more": {"a": 1}}')), F.concat(F.lit('so {"grade": " '), "g", F.lit(' "} it is')), F.concat(F.lit('{"grade": 9, "reason": "a"} {"grade": '), "g", F.lit(', "reason": "b"}')),
        F.lit('{"grade": true}'), F.col("p_name"), F.concat(F.lit('{"grade": '), "g", F.lit('.0}')), F.concat(F.lit('{"grade": '), "g", F.lit(", broken} {no")),
    ]
    return p.select("id", F.element_at(F.array(*kinds), (F.col("id") % 7 + 1).cast("int")).alias("answer"))


def asked(s, d):
    """Requests: a coarse query, blank or missing for some, and terms."""
    p = table(s, d, "part")
    coarse = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(F.col("p_partkey") % 3 == 1, F.lit("  "))
    terms = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat("p_brand", F.lit(" ")), F.lit(" "), F.col("p_type"))).otherwise(F.array().cast("array<string>"))
    return p.select(F.col("p_partkey").alias("id"), coarse.alias("coarse"), terms.alias("terms"))


def label_records(s, d):
    """Events as labels: the same pair again and again."""
    return table(s, d, "events").select((F.col("user_id") % 20).alias("qid"), "user_id", F.col("event_id").alias("at"), F.col("event_type").alias("version"), "ts", F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 4).alias("grade")).withColumnRenamed("user_id", "doc_id")


QUERIES = {
    "stratum_counts": lambda s, d: strata(s, d).groupBy(*CELL).agg(F.count("*").alias("n")),
    "stratum_quota": quota_rows,
    "stratum_quota_scaled": lambda s, d: quota_rows(s, d, 150),
    "stratified_sample": lambda s, d: sample(s, d).select("id", *CELL, F.col("place").cast("long").alias("place")),
    "sample_cutoffs": lambda s, d: sample(s, d).withColumn("h", hashed("id")).groupBy(*CELL).agg(F.max(F.struct("h", "id")).alias("m")).select(*CELL, "m.h", "m.id"),
    "tags_stats": lambda s, d: V.list_sizes(parts(s, d), "tags"),
    "junk_terms": lambda s, d: terms(s, d).select("doc_id", "nth", T.is_junk(F.col("term")).alias("junk")),
    "query_bands": banded,
    "split_70_30": lambda s, d: query_set(s, d).select("qid", "split"),
    "queryset_counts": lambda s, d: X.counters(query_set(s, d)),
    "pool_union": lambda s, d: pool_of(two(s, d)),
    "pool_negatives": lambda s, d: J.negatives(stored(J.pool([run(s, d)], 10)), table(s, d, "documents"), "v1", 3),
    "missing_judgments": unjudged_pairs,
    "mock_grades": labels,
    "labels_latest": lambda s, d: J.latest_labels(label_records(s, d), "view"),
    "latest_judge_version": lambda s, d: J.latest_version(label_records(s, d)),
    "per_query_metrics": lambda s, d: scored(s, d).select("qid", *[F.round(c, 6).alias(c) for c in ("ndcg10", "recall1", "recall5", "recall10", "mrr10")], "n_relevant", "n_judged", "null_grade_top10"),
    "split_aggregates": split_means,
    "cut_report": cuts,
    "latency_percentiles": lambda s, d: M.nearest_rank(table(s, d, "events"), "value", {"p50": 0.5, "p95": 0.95}),
    "leaderboard": board,
    "split_summary": split_summary,
    "bootstrap_pairwise": bootstrap,
    "cohens_kappa": lambda s, d: M.kappa(pairs(s, d)).select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa")),
    "confusion_matrix": lambda s, d: M.confusion(pairs(s, d)),
    "calibration_sample": lambda s, d: J.worksheet(labels(s, d).withColumn("key", hashed("qid", "doc_id")), {1: 15, 2: 10, 0: 10, 3: 5}, F.col("key"), "key").select("qid", "doc_id", "grade"),
    "parse_grade": lambda s, d: judge_answers(s, d).select("id", T.graded(F.col("answer")).alias("g")).select("id", "g.grade", "g.reason"),
    "resolve_query": lambda s, d: asked(s, d).select("id", T.query_text(F.col("coarse"), F.col("terms")).alias("q")),
}

BOTH = "sb AS (SELECT qid, doc_id, round(sum(w * idf * idf), 9) AS score FROM w JOIN q USING (term) GROUP BY ALL)"
RUNS = f"{L.bm25_sql(10)},\n{BOTH},\n{L.ranked('bb', 'sb', 10)},\npl AS (SELECT DISTINCT qid, doc_id FROM (SELECT qid, doc_id FROM bm UNION ALL SELECT qid, doc_id FROM bb))"
MOCK = "h16 AS (SELECT qid, doc_id, position(left(md5(qid || '|' || doc_id), 1) IN '0123456789abcdef') - 1 AS h FROM pl), lb AS (SELECT qid, doc_id, CASE WHEN h <> 0 THEN h % 4 END AS grade FROM h16)"


def metric_sql(runs: str) -> str:
    """Per-query metrics of ``runs`` (run_id, qid, doc_id, rank)."""
    gain = "(2e0 ** coalesce(grade, 0) - 1)"
    return f"""hr AS (SELECT r.*, grade FROM ({runs}) r LEFT JOIN lb USING (qid, doc_id) WHERE rank <= 10),
hq AS (SELECT run_id, qid, sum({gain} / log2(rank + 1)) AS dcg, count(*) FILTER (grade >= 2 AND rank <= 1) AS g1, count(*) FILTER (grade >= 2 AND rank <= 5) AS g5, count(*) FILTER (grade >= 2) AS g10,
  coalesce(1e0 / min(rank) FILTER (grade >= 2), 0) AS mrr10, count(*) FILTER (grade IS NULL) AS null_grade_top10 FROM hr GROUP BY ALL),
po AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce(grade, 0) DESC, doc_id) AS place FROM lb),
pq AS (SELECT qid, sum(CASE WHEN place <= 10 THEN {gain} / log2(place + 1) ELSE 0 END) AS ideal, count(*) FILTER (grade >= 2) AS n_relevant, count(*) AS n_judged FROM po GROUP BY ALL),
mq AS (SELECT run_id, qid, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg10, CASE WHEN n_relevant > 0 THEN g1 / n_relevant ELSE 0 END AS recall1, CASE WHEN n_relevant > 0 THEN g5 / n_relevant ELSE 0 END AS recall5,
  CASE WHEN n_relevant > 0 THEN g10 / n_relevant ELSE 0 END AS recall10, mrr10, n_relevant, n_judged, null_grade_top10 FROM hq JOIN pq USING (qid))"""


SCORED = f"{RUNS},\n{MOCK},\n{metric_sql('SELECT 0 AS run_id, * FROM bm')}"
SET = """qs AS (SELECT item_id AS qid, CASE WHEN item_id % 4 = 0 THEN 'designed' ELSE 'catalog' END AS source, ['facet', 'concept', 'composition'][item_id % 3 + 1] AS category, CASE WHEN item_id % 6 = 0 THEN 'zh' ELSE 'en' END AS lang,
  CASE item_id % 3 WHEN 2 THEN ['motion', 'place'] WHEN 0 THEN ['motion'] ELSE [] END AS facets, item_id % 5 = 0 AS hard, CASE WHEN item_id % 2 = 0 THEN 'easy' ELSE 'medium' END AS difficulty, item_id * 37 % 1500 AS match_docs FROM benchmark)"""
SPLIT = SET + """,
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY category, lang ORDER BY md5(qid::VARCHAR), qid) - 1 < round_even(0.7e0 * count(*) OVER (PARTITION BY category, lang), 0) THEN 'train' ELSE 'holdout' END AS split FROM qs)"""
TERMS = "tm AS (SELECT doc_id, nth, array_to_string(ws[nth * 3 + 1:nth * 3 + 3], ' ') AS term FROM (SELECT doc_id, ws, unnest(range(0, (len(ws) - 1) // 3 + 1)) AS nth FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL)))"
MATCH = "m AS (SELECT doc_id, nth, coalesce(max(df), 0) AS match FROM (SELECT doc_id, nth, unnest(CASE WHEN len(x) = 0 THEN [''] ELSE x END) AS term FROM (SELECT doc_id, nth, regexp_extract_all(lower(term), '[a-z0-9]+') AS x FROM tm)) LEFT JOIN df USING (term) GROUP BY ALL)"
BANDS = "CASE WHEN match >= 1000 THEN 'head' WHEN match >= 100 THEN 'torso' WHEN match >= 2 THEN 'tail' END"
RUN_ROWS = "SELECT 'query' AS run_id, * FROM bm UNION ALL SELECT 'both', * FROM bb"
BOTH_SCORED = f"{RUNS},\n{MOCK},\n{metric_sql(RUN_ROWS)}"
#: Quotas of 800 rows of at least 20 each: shares of the rest by rows, then of the excess by room; ties by the cell.
QUOTA = f"""ce AS (SELECT side, uhd, length, count(*) AS n FROM ({STRATUM}) GROUP BY ALL), lo AS (SELECT *, least(20, n) AS low FROM ce),
s1 AS (SELECT *, (800 - sum(low) OVER ()) * n / (sum(n) OVER ())::DOUBLE AS ex, 800 - sum(low) OVER () AS total FROM lo),
s2 AS (SELECT *, floor(ex) + (row_number() OVER (ORDER BY floor(ex) - ex, side, uhd, length) <= total - sum(floor(ex)) OVER ())::INT + low AS q FROM s1),
s3 AS (SELECT *, least(q, n) AS q1, greatest(0, n - q) AS room, sum(greatest(0, q - n)) OVER () AS over FROM s2), s4 AS (SELECT *, over * room / nullif(sum(room) OVER (), 0)::DOUBLE AS ex2 FROM s3),
qu AS (SELECT side, uhd, length, n, (q1 + CASE WHEN room > 0 THEN floor(ex2) + (row_number() OVER (ORDER BY room = 0, floor(ex2) - ex2, side, uhd, length) <= over - sum(floor(ex2)) OVER ())::INT ELSE 0 END)::BIGINT AS quota FROM s4),
pk AS (SELECT id, side, uhd, length, row_number() OVER (PARTITION BY side, uhd, length ORDER BY md5(id::VARCHAR), id) AS place FROM ({STRATUM}))"""
KAPPA = "x AS (SELECT quality AS a, 1 - toxic AS b FROM labels)"
ORACLES = {
    "stratum_quota": f"WITH {PARTS}, {QUOTA} SELECT side, uhd, length, quota FROM qu",
    "stratum_quota_scaled": f"WITH {PARTS}, {QUOTA}, x AS (SELECT *, 150 * low / (sum(low) OVER ())::DOUBLE AS e FROM lo) SELECT side, uhd, length, (floor(e) + (row_number() OVER (ORDER BY floor(e) - e, side, uhd, length) <= 150 - sum(floor(e)) OVER ())::INT)::BIGINT AS quota FROM x",
    "stratified_sample": f"WITH {PARTS}, {QUOTA} SELECT id, side, uhd, length, place FROM pk JOIN qu USING (side, uhd, length) WHERE place <= quota",
    "sample_cutoffs": f"WITH {PARTS}, {QUOTA} SELECT side, uhd, length, max(md5(id::VARCHAR)) AS h, arg_max(id, md5(id::VARCHAR)) AS id FROM pk JOIN qu USING (side, uhd, length) WHERE place <= quota GROUP BY ALL",
    "stratum_counts": f"WITH {PARTS} SELECT side, uhd, length, count(*) AS n FROM ({STRATUM}) GROUP BY ALL",
    "junk_terms": f"""WITH {TERMS} SELECT doc_id, nth, lower(term) LIKE '%http%' OR lower(term) LIKE '%www%' OR len(t) NOT BETWEEN 1 AND 6 OR len(list_filter(t, lambda x: NOT regexp_full_match(x, '[0-9]+'))) = 0
  OR len(list_filter(t, lambda x: regexp_full_match(x, '[a-z]{{2,}}'))) = 0 OR len(list_filter(t, lambda x: x NOT IN {T.STOPWORDS})) = 0 AS junk
  FROM (SELECT doc_id, nth, term, regexp_extract_all(lower(term), '[a-z0-9]+') AS t FROM tm)""",
    "query_bands": f"WITH {L.COUNTS}, {TERMS}, {MATCH} SELECT doc_id, nth, match, {BANDS} AS band FROM m",
    "tags_stats": f"WITH {PARTS}, z AS (SELECT list_sort(list(len(tags))) AS z, avg(len(tags)) AS mean, count(*) AS n, count(*) FILTER (len(tags) = 0) AS none FROM p) SELECT round(mean, 6) AS mean, z[n // 2 + 1] AS median, z[greatest(1, least(n, round_even(0.9e0 * n, 0)::BIGINT))] AS p90, round(none / n, 6) AS empty FROM z",
    "split_70_30": f"WITH {SPLIT} SELECT qid, split FROM sp",
    "queryset_counts": f"""WITH {SPLIT}, v AS (SELECT unnest([{{'d': 'source', 'v': source}}, {{'d': 'category', 'v': category}}, {{'d': 'lang', 'v': lang}}, {{'d': 'split', 'v': split}}, {{'d': 'difficulty', 'v': difficulty}},
  {{'d': 'real_band', 'v': CASE WHEN source = 'catalog' THEN coalesce({BANDS.replace('match', 'match_docs')}, 'none') END}}]) AS x FROM sp) SELECT x.d AS dimension, x.v AS value, count(*) AS n FROM v WHERE x.v IS NOT NULL GROUP BY ALL""",
    "pool_union": f"WITH {RUNS} SELECT qid, doc_id FROM pl",
    "pool_negatives": f"""WITH {L.bm25_sql(10)}, ord AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents), sq AS (SELECT DISTINCT qid, ('0x' || left(md5(qid || '|v1'), 15))::BIGINT AS h FROM bm),
  o AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY (place - h % ord.n + ord.n) % ord.n) AS pos FROM sq, ord WHERE (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM bm)) SELECT qid, doc_id FROM o WHERE pos <= 3""",
    "missing_judgments": f"WITH {RUNS} SELECT qid, doc_id FROM pl ANTI JOIN bm USING (qid, doc_id)",
    "mock_grades": f"WITH {RUNS},\n{MOCK} SELECT qid, doc_id, grade FROM lb",
    "labels_latest": "SELECT qid, doc_id, CASE WHEN pos % 5 <> 0 THEN pos % 4 END AS grade FROM (SELECT user_id % 20 AS qid, user_id AS doc_id, max(event_id) AS pos FROM events WHERE event_type = 'view' GROUP BY ALL)",
    "latest_judge_version": "SELECT event_type AS version FROM events ORDER BY ts DESC, event_id DESC LIMIT 1",
    "per_query_metrics": f"WITH {SCORED} SELECT qid, round(ndcg10, 6) AS ndcg10, round(recall1, 6) AS recall1, round(recall5, 6) AS recall5, round(recall10, 6) AS recall10, round(mrr10, 6) AS mrr10, n_relevant, n_judged, null_grade_top10 FROM mq",
    "split_aggregates": f"WITH {SCORED},\n{SPLIT} SELECT coalesce(split, 'all') AS split, count(*) AS n, round(avg(round(ndcg10, 9)), 6) AS ndcg10, round(avg(round(mrr10, 9)), 6) AS mrr10 FROM mq JOIN sp USING (qid) GROUP BY ROLLUP (split)",
    "cut_report": f"""WITH {BOTH_SCORED},\n{SPLIT}, cu AS (SELECT run_id, unnest(['category=' || category, 'lang=' || lang, 'source=' || source, 'difficulty=' || difficulty, CASE WHEN hard THEN 'hard=yes' ELSE 'hard=no' END] || list_transform(facets, lambda f: 'facet:' || f || '=yes')) AS cut,
  round(ndcg10, 9) AS ndcg10 FROM mq JOIN sp USING (qid) WHERE split = 'holdout') SELECT run_id, cut, round(avg(ndcg10), 6) AS ndcg10, count(*) AS n FROM cu GROUP BY ALL""",
    "latency_percentiles": "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) AS pos, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT max(value) FILTER (pos = greatest(1, least(n, round_even(0.5e0 * n, 0)))) AS p50, max(value) FILTER (pos = greatest(1, least(n, round_even(0.95e0 * n, 0)))) AS p95 FROM v",
    "leaderboard": f"""WITH {BOTH_SCORED},\n{SPLIT},
tt AS (SELECT run_id, qid, ('0x' || left(md5(run_id || '|' || qid || '|s'), 4))::BIGINT / 100e0 AS s, ('0x' || left(md5(run_id || '|' || qid || '|e'), 4))::BIGINT / 1000e0 AS e FROM (SELECT unnest(['query', 'both']) AS run_id), (SELECT item_id AS qid FROM benchmark)),
tr AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s) AS rs, row_number() OVER (PARTITION BY run_id ORDER BY e) AS re, count(*) OVER (PARTITION BY run_id) AS n FROM tt),
lt AS (SELECT run_id, {', '.join(f"max({c}) FILTER ({r} = greatest(1, least(n, round_even({f}e0 * n, 0)))) AS {name}_p{p}" for c, r, name in (('s', 'rs', 'search_ms'), ('e', 're', 'embed_ms')) for f, p in ((0.5, 50), (0.95, 95)))} FROM tr GROUP BY ALL),
mm AS (SELECT run_id, avg(round(ndcg10, 9)) FILTER (split = 'holdout') AS a, avg(round(ndcg10, 9)) AS f, avg(round(recall10, 9)) FILTER (split = 'holdout') AS r, avg(round(mrr10, 9)) FILTER (split = 'holdout') AS m, sum(null_grade_top10)::BIGINT AS z, count(*) AS c FROM mq JOIN sp USING (qid) GROUP BY ALL)
SELECT row_number() OVER (ORDER BY round(a, 9) DESC, run_id) AS place, run_id, 'bm25-' || run_id AS strategy, 'hash-' || run_id AS config_hash, round(round(a, 9), 6) AS ndcg10_split, round(round(f, 9), 6) AS ndcg10_full, round(round(r, 9), 6) AS recall10, round(round(m, 9), 6) AS mrr10,
  round(search_ms_p50, 6) AS search_ms_p50, round(search_ms_p95, 6) AS search_ms_p95, round(embed_ms_p50, 6) AS embed_ms_p50, round(embed_ms_p95, 6) AS embed_ms_p95, z AS null_grade_top10, c AS judge_coverage FROM mm JOIN lt USING (run_id)""",
    "split_summary": f"""WITH {BOTH_SCORED},\n{SPLIT}, lg AS (SELECT run_id, split, unnest([{', '.join(f"{{'k': '{m}', 'v': round({m}, 9)}}" for m in U.METRICS)}]) AS x FROM mq JOIN sp USING (qid)), al AS (FROM lg UNION ALL SELECT run_id, 'all', x FROM lg)
SELECT run_id, split, x.k AS metric, round(avg(x.v), 6) AS mean, round(median(x.v), 6) AS median, round(min(x.v), 6) AS min, round(max(x.v), 6) AS max, count(*) AS n FROM al GROUP BY run_id, split, x.k""",
    "bootstrap_pairwise": f"""WITH {BOTH_SCORED}, df2 AS (SELECT qid, round(a.ndcg10, 9) - round(b.ndcg10, 9) AS d, row_number() OVER (ORDER BY qid) - 1 AS place, count(*) OVER () AS n FROM mq a JOIN mq b USING (qid) WHERE a.run_id = 'both' AND b.run_id = 'query'),
dr AS (SELECT r, ('0x' || left(md5(r || '|' || place), 15))::BIGINT % n AS pick FROM df2, (SELECT unnest(range(1000)) AS r)), me AS (SELECT r, round(avg(d), 9) AS m FROM dr JOIN df2 ON pick = place GROUP BY ALL), so AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS k FROM me)
SELECT 'both-query' AS pair, (SELECT count(*) FROM df2) AS n, (SELECT round(round(avg(d), 9), 6) FROM df2) AS mean_diff, round(max(m) FILTER (k = 25), 6) AS low, round(max(m) FILTER (k = 974), 6) AS high, (max(m) FILTER (k = 25) > 0)::INT - (max(m) FILTER (k = 974) < 0)::INT AS win FROM so""",
    "cohens_kappa": f"WITH {KAPPA}, c AS (SELECT count(*)::DOUBLE AS n, avg(CASE WHEN a = b THEN 1e0 ELSE 0 END) AS po, (sum(a) * sum(b) + (count(*) - sum(a)) * (count(*) - sum(b)))::DOUBLE / count(*) ** 2 AS pe FROM x) SELECT n::BIGINT AS n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM c",
    "confusion_matrix": f"WITH {KAPPA} SELECT a, b, count(*) AS n FROM x GROUP BY ALL",
    "calibration_sample": f"WITH {RUNS},\n{MOCK}, o AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY md5(qid || '|' || doc_id)) AS place FROM lb) SELECT qid, doc_id, grade FROM o WHERE place <= CASE grade WHEN 1 THEN 15 WHEN 2 THEN 10 WHEN 0 THEN 10 WHEN 3 THEN 5 ELSE 0 END",
    "parse_grade": """WITH a AS (SELECT p_partkey AS id, p_partkey % 7 AS k, p_size % 6 AS g, p_name FROM part), t AS (SELECT *, CASE k WHEN 0 THEN '{"grade": ' || g || ', "reason": "' || p_name || '", "more": {"a": 1}}' WHEN 1 THEN 'so {"grade": " ' || g || ' "} it is' WHEN 2 THEN '{"grade": 9, "reason": "a"} {"grade": ' || g || ', "reason": "b"}'
  WHEN 3 THEN '{"grade": true}' WHEN 4 THEN p_name WHEN 5 THEN '{"grade": ' || g || '.0}' ELSE '{"grade": ' || g || ', broken} {no' END AS answer FROM a)
  SELECT id, CASE WHEN k < 3 AND g <= 3 THEN g END AS grade, CASE WHEN k < 3 AND g <= 3 THEN CASE k WHEN 0 THEN p_name WHEN 1 THEN '' ELSE 'b' END ELSE left(answer, 200) END AS reason FROM t""",
    "resolve_query": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN p_brand || ' ' || p_type ELSE '' END AS q FROM part",
}
