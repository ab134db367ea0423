"""Whole paths, state and rules, by hand and against plain versions."""

import json
import random
import urllib.parse
from hashlib import blake2b

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import hashing, text
from tessella.operators import best, bm25, judging, library, loops, materials, metrics, providers, ranks, report, runs, sampling, search
from tessella.sources import files, sitemap, spool


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_quotas_give_excess_back_by_room():
    rows = {("a",): 100, ("b",): 150, ("c",): 1000}
    assert sampling.quotas(rows, 600, 100) == {("a",): 100, ("b",): 136, ("c",): 364}
    assert sampling.quotas({("a",): 4, ("b",): 3}, 1000, 2) == {("a",): 4, ("b",): 3}
    assert sampling.largest_remainder({("a",): 0, ("b",): 0, ("c",): 0}, 4) == {("a",): 2, ("b",): 1, ("c",): 1}


def test_bootstrap_is_the_plain_one(spark):
    r = random.Random(5)
    rows = [(f"p{p}", q, r.random(), r.random()) for p in range(2) for q in range(40)]
    found = {x.pair: x for x in metrics.paired_bootstrap(spark.createDataFrame(rows, "pair string, qid long, a double, b double"), 400).collect()}
    for pair, x in found.items():
        d = [a - b for p, _, a, b in rows if p == pair]
        rng = random.Random(int.from_bytes(blake2b(b"bootstrap", digest_size=8).digest(), "big"))
        means = sorted(sum(d[rng.randrange(40)] for _ in range(40)) / 40 for _ in range(400))
        assert (x.n, x.mean_diff) == (40, sum(d) / 40) and abs(x.low - means[10]) < 1e-12 and abs(x.high - means[389]) < 1e-12
    assert metrics.resampled([]) == (0.0, 0.0)


def test_hashed_bootstrap_tells_better_from_equal(spark):
    rows = [("better", q, 0.9, 0.1) for q in range(9)] + [("same", q, q % 2 * 1.0, 1.0 - q % 2) for q in range(10)]
    found = {r.pair: r.win for r in metrics.hashed_bootstrap(spark.createDataFrame(rows, "pair string, qid long, a double, b double"), 200).collect()}
    assert found == {"better": 1, "same": 0}


def test_sitemaps(spark):
    rows = spark.createDataFrame([("https://x/video/4k-drone-shot-12345/",), ("https://x/video/12345/",), ("https://x/video/a/b-7/",), ("https://x/video/a-8",)], "loc string").withColumn("lastmod", F.lit(None).cast("string"))
    assert sorted((r.item_id, r.slug) for r in sitemap.video_items(rows).collect()) == [(8, "a"), (12345, "4k-drone-shot")]
    terms = ["a%20b+c", "100%", "%zz%41", "%20%20", "caf%C3%A9", "%FFx", "%E4%BD%A0"]
    rows = spark.createDataFrame([(f"https://x/search/videos/{t}/",) for t in terms], "loc string").withColumn("lastmod", F.lit("m"))
    assert [r.term for r in sitemap.search_terms(rows).collect()] == [t for t in (urllib.parse.unquote(x).strip() for x in terms) if t]
    index = spark.createDataFrame([("<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc><lastmod>x</lastmod></sitemap></sitemapindex>",)], "xml string")
    assert [r.loc for r in sitemap.shards(index).orderBy("at").collect()] == ["a", "b"] and sitemap.shards(index, 1).count() == 1


#: Answers of a judge, and the grade and reason that they hold.
GRADED = {
    '{"grade": 2, "reason": "x"}': (2, "x"), '{"grade": 9} {"grade": 2}': (2, ""), 'so {"grade": " 3 "} it is': (3, ""), '{"grade": true}': (None, '{"grade": true}'), '{"grade": 1.0}': (None, '{"grade": 1.0}'), "no": (None, "no"),
    '{"grade": -1}': (None, '{"grade": -1}'), '{"more": {"grade": 1}, "grade": 0, "reason": "' + "r" * 600 + '"}': (0, "r" * 500), "[1]": (None, "[1]"), "x" * 300: (None, "x" * 200),
    '{"reason": "a"} {"grade": "02"}': (2, ""), '{"grade": 2': (None, '{"grade": 2'), "": (None, ""), '{"grade": null} {"grade": 1, "reason": "é"}': (1, "é"),
}


def test_grades(spark):
    rows = spark.createDataFrame([(a,) for a in GRADED], "answer string").select("answer", text.graded(F.col("answer")).alias("g")).collect()
    assert {r.answer: (r.g.grade, r.g.reason) for r in rows} == GRADED


def test_items_of_odd_records(spark):
    records = ['{"attributes": {"slug": "x"}, "body": {"data": [{"attributes": {"id": 3}}, 7, {"attributes": {"id": null}}, {"attributes": [1]}]}}', '{"attributes": {"id": null}}', '{"attributes": 5}', '{"body": {"data": {"id": 1}}}', "no", None]
    rows = spark.createDataFrame(list(enumerate(records)), "k long, record string").select("k", spool.items(F.col("record")).alias("items")).collect()
    assert {r.k: [json.loads(x)["id"] for x in r["items"]] for r in rows} == {0: [3, None], 1: [None], 2: [], 3: [], 4: [], 5: []}
    pages = ['{"pageProps":{"medium":{"attributes":{"id":null}}}}', '{"pageProps":{"medium":{"attributes":{"ID":1}}}}', '{"pageProps":{"medium":{"attributes":"id"}}}']
    assert [one(spark, text.page_attributes(F.lit(p))) is not None for p in pages] == [True, False, False]


def test_quoting(spark):
    texts = ["a~b*c d/e", "+%", "café 你", "", "_.-~", "()!'"]
    assert [one(spark, text.url_quoted(F.lit(t))) for t in texts] == [urllib.parse.quote(t, safe="") for t in texts]


def test_marks_are_never_away(spark, tmp_path):
    path = f"{tmp_path}/marks.json"
    for k in range(3):
        spool.save_marks(spark, path, {"a": k})
        assert spool.load_marks(spark, path) == {"a": k}
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["marks.json"]


def test_negatives_differ_by_query(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"))
    pooled = spark.createDataFrame([(q, i) for q in range(6) for i in range(q)], "qid long, doc_id long").union(spark.createDataFrame([(9, i) for i in range(198)], "qid long, doc_id long"))
    rows = judging.negatives(pooled, docs, "v1", 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.qid, set()).add(r.doc_id)
    assert all(len(by[q]) == 5 and not by[q] & set(range(q)) for q in range(1, 6)) and by[9] == {198, 199}
    assert len({frozenset(by[q]) for q in range(1, 6)}) == 5
    assert sorted(map(tuple, judging.negatives(pooled, docs, "v1", 5).collect())) == sorted(map(tuple, rows)) != sorted(map(tuple, judging.negatives(pooled, docs, "v2", 5).collect()))
    assert judging.negatives(pooled, docs.limit(0), "v1", 5).count() == 0


def test_ordered_hash(spark):
    rows = [(k, f"t{k}") for k in range(50)]
    hashed = lambda r: ranks.ordered_hash(spark.createDataFrame(r, "id long, t string"), "id", 10).first().hash
    swapped = [(0, "t1"), (1, "t0"), *rows[2:]]
    assert len({hashed(rows), hashed(swapped), hashed([*rows, rows[3]]), hashed([*rows, rows[3], rows[3]]), hashed(rows[:-1])}) == 5
    assert hashed(rows[::-1]) == hashed(rows)


def test_placed(spark):
    rows = spark.range(300).select("id", F.md5(F.col("id").cast("string")).alias("h"))
    found = {r.id: r.place for r in ranks.placed(rows, "h", "id", 1).collect()}
    assert [i for i, _ in sorted(found.items(), key=lambda x: x[1])] == [r.id for r in rows.orderBy("h").collect()]


def test_best():
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 6, (4, 200)).astype(float), rng.permutation(200)
    kept = best.Best(4, 7)
    for k in range(0, 200, 30):
        kept.add(ids[k : k + 30], scores[:, k : k + 30], 0.0)
    for q in range(4):
        plain = sorted(((-s, i) for s, i in zip(scores[q], ids, strict=True) if s > 0))[:7]
        assert [(-s, i) for i, s in zip(kept.ids[kept.at == q], kept.scores[kept.at == q], strict=True)] == [(s, i) for s, i in plain]


def test_ranking_by_products_is_that_of_postings(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{k}" for k in range(30)] + ["the"] * 30
    docs = spark.createDataFrame([(k, " ".join(r.choices(words, k=r.randint(0, 40))) if k % 9 else None) for k in range(120)], "doc_id long, text string")
    queries = spark.createDataFrame([(k, " ".join(r.choices(words, k=5))) for k in range(7)] + [(8, "unknown"), (9, None)], "qid long, text string")
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 3)
    allowed = docs.where("doc_id % 4 <> 0").select("doc_id")
    for side in ("query", "doc", "both"):
        for limit in (None, allowed):
            rows = lambda df: sorted((x.qid, x.doc_id, round(x.score, 6), x["rank"]) for x in df.collect())
            model = bm25.Bm25(idf_side=side)
            assert rows(bm25.top_hits(queries, docs, 5, model, limit)) == rows(bm25.top(bm25.scores(queries, docs, model, limit), 5))
    assert bm25.top_hits(queries, docs.limit(0), 5).count() == bm25.top_hits(queries.limit(0), docs, 5).count() == 0


def test_dense_ties_and_zero_vectors(spark):
    docs = spark.createDataFrame([(k, [1.0, 0.0] if k != 3 else [0.0, 0.0]) for k in range(40)] + [(99, None)], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "qid long, embedding array<float>")
    rows = search.dense_top(queries, docs, 4).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id, r.score) for r in rows] == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (1, 4, 1.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.0), (2, 3, 0.0)]


def test_model_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red cat cat"), (2, "blue dog"), (3, "")], "doc_id long, text string")
    bm25.save(docs, f"{tmp_path}/m", bm25.Bm25(idf_side="doc"))
    fitted = bm25.load(spark, f"{tmp_path}/m")
    assert (fitted.model, fitted.n_docs, fitted.total_len, fitted.model_id, round(fitted.avg_len, 6)) == (bm25.Bm25(idf_side="doc"), 3, 5, "local-bm25-doc-v1", 1.666667)
    provider = providers.provider("bm25", spark, f"{tmp_path}/m")
    assert provider.sparse(docs).count() == 4 and fitted.query_weights(docs.select(F.col("doc_id").alias("qid"), "text")).where("weight <> 1").count() == 0
    with pytest.raises(ValueError):
        providers.embed(docs, provider)
    bm25.save(docs.limit(0), f"{tmp_path}/none")
    assert bm25.load(spark, f"{tmp_path}/none").avg_len == 0
    for bad in ({"supports": frozenset()}, {"supports": frozenset({"smell"})}, {"size": 0}, {"max_batch": 0}, {"supports": frozenset({"dense_image"})}):
        with pytest.raises(ValueError):
            providers.Provider(**({"model_id": "m", "size": 3, "dense": providers.hash_vectors} | bad))
    pictures = providers.Provider("p", 1, image=lambda xs: [[float(len(x))] for x in xs], supports=frozenset({"dense_image"}))
    rows = providers.embed_images(spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "doc_id long, picture binary"), pictures).collect()
    assert [(r.doc_id, r.embedding) for r in rows] == [(1, [3.0])]
    prefixed = providers.Provider("l", 2, lambda texts: [[float(len(t)), 0.0] for t in texts])
    assert providers.embed_queries(spark.createDataFrame([(1, "ab")], "qid long, text string"), prefixed, "query: ").first().embedding == [1.0, 0.0]


def test_numbers_are_short(spark):
    values = [0.0, 0.5, -1.25, 1e-7, 123456789.0, 0.1, 1 / 3, 100000.0, 1e6, 12345.678, -2.5e-5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.short_number(F.col("v")).alias("s")).collect()
    assert [r.s for r in rows] == [f"{v:.6g}" for v in values]
    pairs = F.array(F.struct(F.lit(9).alias("number"), F.lit(0.5).alias("weight")), F.struct(F.lit(2).alias("number"), F.lit(1.0).alias("weight")))
    assert one(spark, text.sparse_literal(pairs, 30)) == "{2:1,9:0.5}/30"


def test_keys(spark):
    digest = lambda *p, size=8: blake2b("|".join(map(str, p)).encode(), digest_size=size).hexdigest()
    assert one(spark, hashing.query_id(F.lit("red cat"))) == "q" + digest("red cat")[:12]
    assert one(spark, hashing.label_key(F.lit("q"), F.lit(5), F.lit("h"), "m", "v1")) == digest("q", 5, "h", "m", "v1") == hashing.hash_hex("q", 5, "h", "m", "v1")
    assert one(spark, hashing.mock_grade(F.lit("k"))) == int(digest("mock", "k")[:2], 16) % 4
    assert hashing.canonical_json({"b": [1, "é"], "a": None}) == '{"a":null,"b":[1,"é"]}'
    assert hashing.content_hash({"a": 1}) == blake2b(b'{"a":1}', digest_size=16).hexdigest()


def test_search_leaves_excluded_out_and_fills_up(spark):
    rows = [(k, "red cat" if k < 8 else "dog", [1.0, k / 10], "portrait" if k % 2 else "landscape", 10 + k, 4000, "free", [f"u{k}"]) for k in range(12)]
    media = spark.createDataFrame(rows, "doc_id long, text string, embedding array<float>, orientation string, duration int, width int, license string, urls array<string>")
    queries = spark.createDataFrame([(1, "red cat", [1.0, 0.0]), (2, "unknown", [0.0, 1.0])], "qid long, text string, embedding array<float>")
    plain = library.search_library(queries, media, 3)
    assert [r.doc_id for r in plain.hits.where("qid = 1").orderBy("rank").collect()] == [0, 1, 2]
    shut = spark.createDataFrame([("u0",), ("u2",)], "url string")
    found = library.search_library(queries, media, 3, excluded=shut)
    for rows in (found.hits, found.arms):  # the arms are ranked once, not again for all that reads them
        assert "MapIn" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in found.hits.where("qid = 1").orderBy("rank").collect()] == [1, 3, 4]
    assert {r.qid: (r.dense, r.sparse) for r in found.arms.collect()} == {1: (12, 8), 2: (12, 0)}
    assert library.search_library(queries, media, 3, where=library.Filter(min_width=5000)).hits.count() == 0
    assert {r.doc_id % 2 for r in library.search_library(queries, media, 3, where=library.Filter(orientation="portrait", max_duration=18)).hits.collect()} == {1}
    files_ = F.lit('[{"link":"l"},{"link":""},{"x":1}]')
    assert one(spark, library.urls_of(F.lit("p"), F.lit(None).cast("string"), files_)) == ["p", "l"]


def test_log(spark, tmp_path):
    found = library.Found(spark.createDataFrame([(1, 7, 1), (1, 5, 2)], "qid long, doc_id long, rank int"), spark.createDataFrame([(1, 3, 2)], "qid long, dense long, sparse long"))
    rows = library.log_rows(spark.createDataFrame([(1, "cat")], "qid long, text string"), found, 30, library.Filter(min_duration=5), 2)
    assert library.append_log(rows, f"{tmp_path}/log") and library.append_log(rows, f"{tmp_path}/log") and not library.append_log(rows, f"{tmp_path}/log", False)
    back = spark.read.json(f"{tmp_path}/log").collect()
    assert len(back) == 2 and (back[0].q, back[0].k, back[0].exclude, back[0].top, back[0].arms.dense) == ("cat", 30, 2, [7, 5], 3)
    assert not library.append_log(rows, "nowhere://x/y")


def test_runs(spark, tmp_path):
    hits = spark.createDataFrame([(1, 10, 1, 2.0), (1, 11, 2, 1.0), (2, 12, 1, 1.0)], "qid long, doc_id long, rank int, score double")
    times = spark.createDataFrame([(1, 5.0, 1.0), (2, 7.0, 2.0)], "qid long, search_ms double, embed_ms double")
    for name, version in (("a", "m1"), ("b", "m1"), ("c", "m2")):
        runs.save(hits if name != "b" else hits.where("doc_id <> 10"), times, str(tmp_path), name, providers.strategy("bm25-query").manifest(materials.TextSource()), version, "q1")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        runs.save(hits, times, str(tmp_path), "a", providers.strategy("bm25-query").manifest(materials.TextSource()), "m1", "q1")
    found = runs.find(spark, str(tmp_path), "m1", "q1")
    assert sorted(r.run_id for r in found.collect()) == ["a", "b"] and found.first().config_hash == materials.version_hash(providers.strategy("bm25-query").manifest(materials.TextSource()))
    hits, times = runs.load(spark, str(tmp_path), found)
    labels = spark.createDataFrame([(1, 10, 3), (1, 11, 0), (2, 12, 2)], "qid long, doc_id long, grade int")
    queries = spark.createDataFrame([(1, "holdout"), (2, "train")], "qid long, split string")
    scored = runs.score(hits, labels)
    board = runs.leaderboard(scored, times, found, queries).orderBy("place").collect()
    assert [(r.run_id, r.ndcg10_split, r.ndcg10_full, r.search_ms_p50, r.search_ms_p95, r.judge_coverage) for r in board] == [("a", 1.0, 1.0, 5.0, 7.0, 2), ("b", 0.0, 0.5, 5.0, 7.0, 2)]
    split = {(r.run_id, r.split): (r["mean"], r.median, r.n) for r in runs.by_split(scored, queries, ("ndcg10",)).collect()}
    assert split["b", "all"] == (0.5, 0.5, 2) and split["b", "holdout"] == (0.0, 0.0, 1)
    assert runs.of_split(queries, "all").count() == 2
    full = spark.createDataFrame([(1, "holdout", "x", "en", "s", "easy", {"o": "p"}, ["f", "f"]), (2, "train", "x", "zh", "s", "hard", {}, [])], "qid long, split string, category string, lang string, source string, difficulty string, hard map<string,string>, facets array<string>")
    cuts = {r.cut: (r["mean"], r.n) for r in runs.cuts(scored, full).where("run_id = 'b'").collect()}
    assert cuts == {"category=x": (0.5, 2), "lang=en": (0.0, 1), "lang=zh": (1.0, 1), "source=s": (0.5, 2), "difficulty=easy": (0.0, 1), "difficulty=hard": (1.0, 1), "hard=yes": (0.0, 1), "hard=no": (1.0, 1), "facet:f=yes": (0.0, 1)}
    pairs = runs.pairwise(scored, queries, "all")
    table = runs.leaderboard(scored, times, found, queries).drop("spec")
    assert report.csv(table).split("\n")[1].startswith("a,") and ",5.000,7.000," in report.csv(table)
    assert "| a-b | +0.5000 |" in report.pair_table(pairs, "a")
    assert "0.5000 (n=2)" in report.cut_table(runs.cuts(scored, full), ["category=x", "lang=fr"]) and "| - |" in report.cut_table(runs.cuts(scored, full), ["category=x", "lang=fr"])
    data = json.loads(report.summary(table, pairs, runs.cuts(scored, full), judge="j"))
    assert data["judge"] == "j" and [r["run_id"] for r in data["runs"]] == ["a", "b"] and len(data["pairwise"]) == 1
    page = report.page(table, "T", queries=spark.createDataFrame([("</script>",)], "text string"))
    assert page.count("</script>") == 1 and "<\\/script>" in page
    assert text.file_safe("a/b@c") == "a_b_at_c"


def test_materials(spark):
    rows = spark.createDataFrame([(1, "t", "d", ["A", "b"]), (2, " ", None, ["a"]), (3, "u", "", [])], "id long, title string, description string, tags array<string>")
    of = lambda *a: {r.id: r.text for r in materials.texts(rows, *a).collect()}
    assert of("raw") == {1: "t — d — A, b", 2: "a", 3: "u"} and of("raw-title") == {1: "t", 2: "", 3: "u"} and of("raw-title-desc") == {1: "t — d", 2: "", 3: "u"}
    assert of("raw-tags-df10") == {1: "t — d", 2: "", 3: "u"} and of("caption", spark.createDataFrame([(1, "c")], "id long, text string")) == {1: "c", 2: "", 3: ""}
    for bad in ("none", "caption"):
        with pytest.raises(ValueError):
            materials.texts(rows, bad)
    for bad in (lambda: providers.strategy("dense"), lambda: providers.strategy("none"), lambda: materials.TextSource("none")):
        with pytest.raises(ValueError):
            bad()
    captions = materials.TextSource("caption", captions_version="v1")
    assert captions.label == "caption:v1" and materials.TextSource("caption", captions_version="v1", captions_model="m").label == "caption:m" and materials.TextSource("raw-title").label == "raw-title"
    assert providers.strategy("bm25-both").manifest(materials.TextSource()) == {"strategy": "bm25-both", "text_source": "raw", "idf_side": "both", "k1": 1.2, "b": 0.75}
    assert providers.strategy("hash-dense").manifest(materials.TextSource()) == {"strategy": "hash-dense", "text_source": "raw", "provider": "local-hash-1024"}
    assert providers.strategy("rrf", providers.hash_provider(8), "query: ").manifest(captions) == {"strategy": "rrf", "text_source": "caption", "captions_version": "v1", "model": "local-hash-8", "dim": 8, "query_prefix": True, "rrf_k": 60, "arm_depth": 100, "arms": ["bm25-query", "dense"]}
    assert materials.cache_key("a/b", 8, "raw", "0123456789abcdefXYZ") == "a_b-8-raw-0123456789abcdef"
    full = rows.select("*", F.lit("portrait").alias("orientation"), F.lit(100).alias("width"), F.lit(7).alias("duration"))
    sample, cells = materials.build(full, 2, F.md5(F.col("id").cast("string")), 1)
    assert sample.count() == 2 and cells.first().population == 3
    told = materials.manifest(sample, "v1", 2, cells, "c0", 1)
    assert (told["n"], told["population_total"], told["stratum_floor"], told["code"], len(told)) == (2, 3, 1, "c0", 12)
    assert [(c["population"], c["quota"], c["sampled"]) for c in told["cells"]] == [(3, 2, 2)] and told["tags_stats"] == materials.tag_statistics(sample)
    assert materials.tag_statistics(rows) == {"n_docs": 3, "n_tags": 3, "distinct": 2, "mean": 1.0, "median": 1.0, "p90": 2.0}
    designed = spark.createDataFrame([("red cat", "facet", "en", "easy", ["x"], {"a": "b"})], "text string, category string, lang string, difficulty string, facets array<string>, hard map<string,string>")
    frequency = spark.createDataFrame([("red", 5), ("dog", 300)], "term string, df long")
    terms = spark.createDataFrame([("big dog",)], "term string")
    made = materials.query_set(terms, frequency, designed, F.md5("term"))
    assert {r.text: (r.source, r.match_docs) for r in made.collect()} == {"big dog": ("catalog", 300), "red cat": ("designed", 5)}
    counts = {(r.dimension, r.value): r.n for r in materials.counters(made).collect()}
    assert counts["real_band", "torso"] == 1 and counts["source", "designed"] == 1
    with pytest.raises(ValueError):
        materials.query_set(spark.createDataFrame([("red cat",)], "term string"), frequency, designed, F.md5("term"))


def test_judge_is_asked_again(spark):
    owed = spark.createDataFrame([(k, q, k, "doc", "h") for k, q in enumerate(["good", "odd", "down", "late"])], "qid long, query_text string, doc_id long, doc_text string, doc_hash string").coalesce(1)
    tries = {}

    def answer(query, doc):
        tries[query] = tries.get(query, 0) + 1
        if query == "down" or (query == "late" and tries[query] < 3):
            raise OSError("away")
        return "no idea" if query == "odd" else '{"grade": 2, "reason": "r"}'

    rows = {r.query_text: r for r in judging.ask(owed, answer, "m").collect()}
    assert {q: (r.grade, r.status) for q, r in rows.items()} == {"good": (2, "ok"), "odd": (None, "unparsed"), "down": (None, "error"), "late": (2, "ok")}
    assert rows["good"].key == hashing.hash_hex("good", 0, "h", "m", "v1") and rows["good"].version == "m@prompt-v1" and rows["good"].reason == "r"


def test_spool_and_marks(spark, tmp_path):
    folder, marks = f"file://{tmp_path}/spool", f"file://{tmp_path}/marks.json"
    spool.write_record(spark, folder, "ids", "id-1", "u", {"attributes": {"id": 1}})
    spool.write_record(spark, folder, "feed", "p1", "u", {"body": {"data": [{"attributes": {"id": 2}}]}})
    seen = []
    take = lambda df: seen.append(sorted(r.path.rsplit("/", 1)[1] for r in df.collect()))

    def fail(df):
        raise RuntimeError("sink")

    assert spool.load_marks(spark, marks) == {}
    with pytest.raises(RuntimeError):
        spool.ingest(spark, folder, marks, fail)
    assert spool.load_marks(spark, marks) == {}
    assert spool.ingest(spark, folder, marks, take) == ["feed", "ids"] and seen[-1] == ["id-1.json", "p1.json"]
    assert spool.ingest(spark, folder, marks, take) == [] and seen[-1] == []
    import time

    time.sleep(1.1)
    spool.write_record(spark, folder, "ids", "id-2", "u", {})
    assert spool.ingest(spark, folder, marks, take) == ["ids"] and seen[-1] == ["id-2.json"]
    assert spool.ingest(spark, folder, marks, take, full=True) == ["feed", "ids"]
    (tmp_path / "marks.json").write_text("{broken")
    (tmp_path / ".marks.json.crc").unlink(missing_ok=True)
    assert spool.load_marks(spark, marks) == {}
    spool.save_marks(spark, marks, {"a": 5})
    assert spool.load_marks(spark, marks) == {"a": 5} and not [p for p in tmp_path.rglob("*.part")]


def test_bytes_that_are_packed(spark, tmp_path):
    import gzip

    (tmp_path / "a.bin").write_bytes(gzip.compress("é <x>".encode()))
    (tmp_path / "b.bin").write_bytes(b"plain")
    assert sorted(r.text for r in files.read_bytes(spark, f"file://{tmp_path}/*.bin").collect()) == ["plain", "é <x>"]


def test_loops(spark):
    batches = [3, 2, 0, 5]
    assert loops.drain(lambda: batches.pop(0)) == [3, 2] and loops.drain(lambda: 1, 4) == [1] * 4
    stop = loops.Stop(target=90, floor=50, empty=3)
    assert [stop.reason(10, 400, 4), stop.reason(95, 400, 4), stop.reason(10, 100, 4)] == [None, "coverage", "novelty"]
    stop = loops.Stop(empty=2)
    assert [stop.reason(1, n) for n in (0, 5, 0, 0)] == [None, None, None, "empty"]
    pages = [[("d", "4"), ("c", "3")], [("b", "2"), ("a", "1")], []]
    assert loops.head(lambda k: pages[k], "2") == ([("d", "4"), ("c", "3")], "4")
    assert loops.head(lambda k: pages[k], None) == (pages[0], "4")
    assert loops.head(lambda k: pages[k], "0", 1) == (pages[0], "0")
    done = {("t", 1)}
    assert loops.fetch_pages(["t", "u"], lambda t, p: [p] if p < 3 else [], 5, done) == {("t", 2): [2], ("t", 3): [], ("u", 1): [1], ("u", 2): [2], ("u", 3): []} and len(done) == 6
    now, made = [0.0], []
    recent = loops.Recent(lambda k: made.append(k) or k.upper(), 10, 2, lambda: now[0])
    assert [recent.get(k) for k in "aab"] == ["A", "A", "B"] and made == ["a", "b"]
    now[0] = 5
    recent.get("c")
    assert set(recent.held) == {"b", "c"}
    now[0] = 20
    recent.get("c")
    assert made == ["a", "b", "c", "c"]
    order = []
    assert loops.in_order({"z": (["a"], lambda: order.append("z")), "a": ([], lambda: order.append("a"))}) and order == ["a", "z"]
    with pytest.raises(ValueError):
        loops.in_order({"a": (["b"], int), "b": (["a"], int)})
    rows = spark.createDataFrame([(1, "old"), (2, None), (3, "new"), (4, "old")], "id long, v string")
    assert [r.id for r in loops.owed(rows, F.col("v"), "new", "id").collect()] == [1, 2, 4] and [r.id for r in loops.owed(rows, F.col("v"), "new", "id", 0, 2).collect()] == [2, 4]
    with pytest.raises(ValueError):
        loops.owed(rows, F.col("v"), "new", "id", 2, 2)
    with pytest.raises(ValueError):
        loops.worklist(rows, "id", "none")


def test_entry_without_the_corpus_package(tmp_path):
    """The folders and the pipeline away, or a library that they need: the other queries still come."""
    import shutil
    import subprocess
    import sys

    from conftest import ROOT

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1') for n in q), set(e.oracle_sql()) <= set(q))"
    run = lambda d, c: subprocess.run([sys.executable, "-c", c], cwd=d, capture_output=True, text=True, timeout=120).stdout.split()
    assert run(tmp_path / "r", code)[1:] == ["False", "True"]
    assert run(ROOT, "import sys; sys.modules['public_tokenizers'] = None\n" + code)[1:] == ["False", "True"]
