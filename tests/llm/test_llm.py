"""Each operator against a plain version, and on odd tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import SF

import tessella.llm.queries as Q
from tessella.llm import components, decontaminate, jaccard, language, lm, ogg, packing, sharding, token_counts, token_store, warc

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, token long, shard int, score double"
LONG = " ".join(f"w{k % 977}" for k in range(30000))
ODD = [
    (1, None, None), (2, "", "en"), (3, "one two three four five six seven eight", "en"), (4, "one two three four five six seven eight", "en"),
    (4, "one two three four five six seven eight", "en"), (5, LONG, "de"), (6, LONG + " extra", None), (7, "  x\t\n ", "fr"), (8, "<|endoftext|> é ́ Σας ▁ a", "es"), (None, "no id", "en"), (9, "12 !!", "en"), (9007199254740993, "big id", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, "s", 1, 7, 7, 7, 0.5) for i, t, g in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_of_odd_rows(odd):
    for r in language.held_out_languages(odd).collect():
        text = next(t for i, t, _ in ODD if i == r.doc_id)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r.score <= 1


def test_groups_of_odd_rows(odd):
    rows = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_groups(odd).collect())
    long = len(jaccard.shingles(LONG))
    assert rows == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 4, 3): 1, (4, 4, 3): 2, (5, long, 5): 1, (6, len(jaccard.shingles(LONG + " extra")), 5): 1, (7, 1, 7): 1, (8, 2, 8): 1, (None, 1, None): 1, (9, 1, 9): 1, (9007199254740993, 1, 9007199254740993): 1})


OPERATORS = {
    "language": language.held_out_languages,
    "sharding": sharding.assign,
    "token_counts": lambda d: token_counts.count_tokens(d, PIECES),
    "jaccard": jaccard.join_groups,
    "lm": lm.held_out_scores,
    "packing": lambda d: packing.pack(d, WORDS),
    "token_store": lambda d: token_store.round_trip(d.sparkSession, d, WORDS),
    "ogg": ogg.text_round_trip,
    "decontaminate": lambda d: decontaminate.contamination(d, d.selectExpr("doc_id AS item_id", "text").where("doc_id = 3")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, odd, name):
    rows = OPERATORS[name](odd).collect()
    assert len(rows) == len(ODD) if name != "packing" else len(rows) >= len(ODD)
    assert 9007199254740993 in [r.doc_id for r in rows]
    assert OPERATORS[name](odd.limit(0)).count() == 0


def crc_of(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


def test_languages(spark, docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.held_out_languages(docs).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if crc_of(i, 4) == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_sample_is_bounded(spark):
    rows = spark.createDataFrame([(1, f"text {k}", "en") for k in range(50)] + [(None, "no id", "en"), (2, "zwei", "de")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, language.sampled(rows).collect())) == [("de", 2, "zwei"), ("en", 1, "text 0")]


def test_language_sample_counts_documents(spark):
    first = spark.range(1, 41).selectExpr("min_by(id, xxhash64(id))").first()[0]
    rows = [(i, f"text {i}", "en") for i in range(1, 41)] + [(first, f"again {k}", "en") for k in range(700)] + [(None, f"ohne {k % 30}", "de") for k in range(60)]
    found = language.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(r.doc_id for r in found if r.lang == "en") == list(range(1, 41))
    assert sorted(r.text for r in found if r.lang == "de") == sorted(f"ohne {k}" for k in range(30))


def foreign():
    """Texts of languages that no row is labelled with, letter salad, and codes."""
    import random

    r = random.Random(3)
    return [
        " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(60)), "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(600)),
        "Быстрая коричневая лиса прыгает через ленивую собаку и убегает в тёмный лес.", "Szybki brązowy lis przeskakuje nad leniwym psem i ucieka do ciemnego lasu, gdzie mieszkają wilki i niedźwiedzie.",
        "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee pimeään metsään, jossa asuvat sudet ja karhut.", "これは日本語の文章です。", "a" * 500, None, "", "12 34 !?",
    ]


def test_unknown_languages_go(spark, docs):
    rows = docs.unionByName(spark.createDataFrame([(10**9 + k, t, None, "s", 1) for k, t in enumerate(foreign())], docs.schema)).withColumn("score", docs["doc_id"] * 0.5)
    left = language.with_known_language(rows)
    assert left.columns == rows.columns and left.schema == rows.schema
    left = {r.doc_id for r in left.collect()}
    assert left == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}


def test_known_language_of_odd_tables(spark, odd):
    left = language.with_known_language(odd)
    assert left.schema == odd.schema
    rows = Counter(r.doc_id for r in left.collect())
    assert (rows[3], rows[4]) in ((0, 0), (1, 2)) and rows and not {1, 2, 9} & set(rows)
    assert language.with_known_language(odd.withColumn("lang", odd["lang"].substr(9, 1)).where("false")).count() == 0
    unlabelled = odd.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert language.with_known_language(unlabelled).count() == 0


def plain_ftrl(rows, classes):
    """Follow the regularised leader, one weight at a time, from its sums."""
    z, n = {}, {}

    def weight(i, k):
        a, b = z.get((i, k), 0.0), n.get((i, k), 0.0)
        return 0.0 if abs(a) <= language.L1 else -(a - math.copysign(language.L1, a)) / ((language.BETA + math.sqrt(b)) / language.ALPHA + language.L2)

    for _ in range(language.EPOCHS):
        for at, x, label in rows:
            w = {(i, k): weight(i, k) for i in at for k in range(classes)}
            s = [sum(w[i, k] * v for i, v in zip(at, x, strict=True)) for k in range(classes)]
            e = [math.exp(v - max(s)) for v in s]
            for i, v in zip(at, x, strict=True):
                for k in range(classes):
                    g = v * (e[k] / sum(e) - (k == label))
                    was = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / language.ALPHA * w[i, k]
                    n[i, k] = was + g * g
    return {key: weight(*key) for key in z}


def test_regression_is_the_plain_one():
    texts = ["the cat sat", "der hund lief", "le chat dort", "a dog ran the", "die katze und", "le chien et la"]
    idf = np.linspace(1, 2, language.BUCKETS)
    rows = []
    for k, t in enumerate(texts):
        at, n = language.counts(t)
        x = np.array([(1 + math.log(c)) * idf[i] for i, c in zip(at.tolist(), n.tolist(), strict=True)])
        assert np.allclose(language.tf_idf(at, n, idf), x / math.sqrt((x**2).sum()))
        rows.append((at.tolist(), (x / math.sqrt((x**2).sum())).tolist(), k % 3))
    w = language.train([(np.array(a), np.array(x), y) for a, x, y in rows], 3)
    plain = plain_ftrl(rows, 3)
    assert all(abs(w[i, k] - v) < 1e-9 for (i, k), v in plain.items()) and abs(w).sum() > 0 and (w == 0).any()
    logits, labels = np.random.default_rng(1).normal(size=(200, 3)) * 4, np.random.default_rng(2).integers(0, 3, 200)

    def loss(t):
        p = np.log(np.exp(logits / t) / np.exp(logits / t).sum(axis=1, keepdims=True))
        return -((1 - language.DOUBT) * p[np.arange(200), labels] + language.DOUBT * p.mean(axis=1)).mean()

    assert loss(language.temperature(logits, labels)) <= min(loss(t) for t in np.geomspace(0.03, 40, 400)) + 1e-6


def plain_loads(sizes, shards):
    """Longest processing time, one group at a time."""
    import heapq

    heap = [(0, s) for s in range(shards)]
    for size in sorted((w for w, n in sizes for _ in range(n)), reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(heap)


@pytest.mark.parametrize("seed", range(40))
def test_schedule_is_the_plain_heap(seed):
    import random

    r = random.Random(seed)
    sizes = [(w, r.choice((1, 1, 2, 5, 40, 300))) for w in r.sample(range(1, r.choice((20, 400, 9000))), r.randint(1, 15))]
    shards, loads, covered = r.randint(1, 9), Counter(), Counter()
    for size, a, b, order in sharding.schedule(sizes, shards):
        part, rest = divmod(b - a, len(order))
        assert rest == 0 and len(order) < 3 * shards
        for s in order:
            loads[s] += size * part
        covered.update({(size, k): 1 for k in range(a, b)})
    assert covered == Counter({(w, k): 1 for w, n in sizes for k in range(n)})
    assert sorted(loads[s] for s in range(shards)) == [load for load, _ in plain_loads(sizes, shards)]


def test_whole_rounds_are_one_run():
    import random

    r = random.Random(5)
    sizes = [(w, r.randint(1, 200)) for w in r.sample(range(1, 65536), 3000)]
    runs = sum(1 for _ in sharding.schedule(sizes, 16))
    assert runs < 4 * len(sizes), runs / len(sizes)


def test_runs_in_parts(spark, docs, monkeypatch):
    whole = sorted(map(tuple, sharding.assign(docs).collect()))
    monkeypatch.setattr(sharding, "RUNS", 7)
    assert sorted(map(tuple, sharding.assign(docs).collect())) == whole


def test_size_classes(spark):
    weights = [1, 2, 65535, 65536, 65537, 70001, 131071, 131073, 10**9 + 7, 2**40 + 12345, 2**62 + 1]
    found = [r.c for r in spark.createDataFrame([(w,) for w in weights], "w long").select(sharding.size_class("w").alias("c")).collect()]
    assert found == [w >> max(0, w.bit_length() - 16) << max(0, w.bit_length() - 16) for w in weights]


def test_shards(docs, odd):
    for table in (docs, odd):
        rows, texts = sharding.assign(table).collect(), {r.doc_id: r.text or "" for r in table.collect()}
        for s in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        by_text, weights = {}, Counter()
        for r in rows:
            assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()))
            by_text.setdefault(texts[r.doc_id], set()).add(r.shard)
            weights[texts[r.doc_id]] += r.size
        assert all(len(s) == 1 for s in by_text.values()) and Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in table.collect())
        load = Counter({s: 0 for s in range(16)})
        for r in rows:
            load[r.shard] += r.size
        plain = plain_loads([(w, 1) for w in weights.values()], 16)
        assert all(abs(a - b) <= 0.001 * b + 1 for a, (b, _) in zip(sorted(load.values()), plain, strict=True))


def test_token_counts(docs, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for table in (docs, odd):
        texts = {r.doc_id: r.text or "" for r in table.collect()}
        for r in token_counts.count_tokens(table, PIECES).collect():
            assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(sp.encode(texts[r.doc_id])))
            assert r.over_limit == (r.n_tokens > 4096)


def plain_groups(rows):
    sets = [jaccard.shingles(r.text or "") for r in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(np.intersect1d(a, b))
            if common and 100 * common >= 75 * (len(a) + len(b) - common):
                top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted((r.doc_id, len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def test_jaccard_groups(spark, docs):
    made = [(10_000 + k, " ".join(f"a{i}" for i in range(60) if i != k)) for k in range(40)] + [(20_000 + k, " ".join(f"b{i}" for i in range(8 + k))) for k in range(6)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    assert sorted(map(tuple, jaccard.join_groups(table).collect())) == plain_groups(table.collect())


def test_blocks_decide_what_heads_miss():
    sets = [np.arange(a, a + 20, dtype=np.uint64).tobytes() for a in (0, 2, 4, 100)]
    out = jaccard.decide(np.array([1, 2, 3, 4, 1]), np.array([1, 2, 3, 4, 1]), [*sets, sets[0]])
    assert {frozenset(x) for x in out} == {frozenset((1, 2)), frozenset((2, 3))}


def test_names_that_several_sets_share(spark, docs, monkeypatch):
    """With first names of four bits nearly all sets go by their second name."""
    whole = sorted(map(tuple, jaccard.join_groups(docs.limit(150)).collect()))
    import types

    names = jaccard.names_of
    short = lambda s: (names(s)[0] % 16, names(s)[1])
    own = types.FunctionType(jaccard._sets.__code__, {**vars(jaccard), "names_of": short}, "own_sets")
    own.__module__ = "__main__"  # so that it goes to workers as it is
    monkeypatch.setattr(jaccard, "names_of", short)
    monkeypatch.setattr(jaccard, "_sets", own)
    assert sorted(map(tuple, jaccard.join_groups(docs.limit(150)).collect())) == whole


@pytest.mark.parametrize("held", [1, 3, 128])
def test_many_groups_in_one_list(spark, monkeypatch, held):
    """Sets of many sizes share most of their shingles with each other, but only neighbours are linked."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "HELD", held)
    common = [f"c{k}" for k in range(40)]
    rows = [(100 * g + k, " ".join(common[: 6 + 3 * g] + [f"g{g}x{j}" for j in range(3 + g)] + [f"k{k}"])) for g in range(10) for k in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join_groups(table).collect())) == plain_groups(table.collect())


@pytest.mark.parametrize("held", [1, 2, 128])
def test_block_pairs(spark, monkeypatch, held):
    """Blocks of a list meet, whichever way, if sizes and partners allow it; lists of the same blocks are looked at once."""
    monkeypatch.setattr(jaccard, "HELD", held)
    blocks = {1: (None, 10, 10, 11), 2: (None, 10, 13, 20), 3: (7, 12, 12, 12), 4: (7, 11, 12, 16), 5: (8, 40, 50, 60), 6: (None, 30, 30, 39), 7: (None, 20, 20, 18)}
    lists = {1: [1, 2, 3], 2: [1, 2, 3], 3: [3, 4, 5, 6], 4: [7], 5: [2, 7], 6: [1, 2, 3]}
    rows = [(k, b, *blocks[b]) for k, bs in lists.items() for b in bs]
    out = jaccard._block_pairs(spark.createDataFrame(rows, "key long, block long, pure long, lo long, hi long, most long")).collect()

    def could(a, b):
        (p, lo, hi, most), (q, low, high, largest) = blocks[a], blocks[b]
        return (p is None or p != q) and 100 * high >= 75 * lo and 100 * hi >= 75 * low and low <= most and lo <= largest

    assert sorted(map(tuple, out)) == sorted({(a, b) for bs in lists.values() for a in bs for b in bs if a <= b and could(a, b)})


def test_sets_by_a_join_or_a_small_filter(spark, docs, odd, monkeypatch):
    """Above a size documents meet what is wanted by doc_id; a filter that is nearly full lets too much through, which changes nothing."""
    whole = [sorted(map(str, jaccard.join_groups(t).collect())) for t in (docs, odd)]
    monkeypatch.setattr(jaccard, "MOST_BITS", 0)
    assert [sorted(map(str, jaccard.join_groups(t).collect())) for t in (docs, odd)] == whole
    monkeypatch.setattr(jaccard, "FILTER_BITS", 1024)
    monkeypatch.setattr(jaccard, "MOST_BITS", 1 << 26)
    monkeypatch.setattr(jaccard, "MARKED", 1)
    assert [sorted(map(str, jaccard.join_groups(t).collect())) for t in (docs, odd)] == whole


@pytest.mark.parametrize("seed", range(2))
def test_groups_of_random_texts(spark, monkeypatch, seed):
    """Texts on either side of the threshold, of pieces that many share, with small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "HELD", 2)
    rng = np.random.default_rng(seed)
    pieces = [[f"p{p}x{k}" for k in range(int(rng.integers(10, 40)))] for p in range(5)]
    rows = []
    for k in range(150):
        words = [w for p in rng.permutation(5)[: rng.integers(1, 3)] for w in pieces[p]]
        words += [f"own{k}x{j}" for j in range(int(rng.integers(0, 14)))]
        rows.append((k, " ".join(words[int(rng.integers(0, 6)) :])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join_groups(table).collect())) == plain_groups(table.collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101)]
    rows = components.components(spark.createDataFrame(chain, "u long, v long")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet".replace("0.001", "0.01"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    counts = Counter(w for i, ws in words.items() if crc_of(i, 5) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = lm.held_out_scores(docs).collect()
    for r in rows:
        ws = words[r.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(base - r.base_score) < 1e-6 * len(ws) + 1e-6
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_of_odd_texts():
    texts = [None, "", " a\tB\x0b\n", "É\u00a0x \u2003 y", "\r\n", "one", "  Two  two\x0c", "a\x1cb\x85c"]
    which, kinds, lengths = lm.split(pa.array(texts))
    found, at = [kinds[k] for k in which], 0
    for t, n in zip(texts, lengths, strict=True):
        assert found[at : at + n] == (t or "").encode().lower().split()
        at += n
    c, before, after, starts = lm._numbered(pa.array(texts), lm.Table(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), lm.code_of(lm.END) | 1 << 62, 0, 0))
    assert len(c) == len(found) + len(texts) and (c >= 1 << 62).all() and starts.tolist() == [0, *np.cumsum(lengths + 1)[:-1].tolist()]
    assert all(before[s].tolist() == [lm.BEGIN] * 2 for s in starts) and (before[starts[6] + 1].tolist()[0] == lm.BEGIN)


def test_every_position_is_learnt_from(spark, monkeypatch):
    texts = [None, "a", "b c", *(f"w{k} x y z" for k in range(400))]
    table = lm.table_of(lm.count(spark.createDataFrame([(t,) for t in texts], "text string")))
    seen, shares = [], lm.shares_of(table)
    monkeypatch.setattr(lm.Trainer, "step", lambda self, before, after: seen.extend(zip(before.tolist(), after.tolist(), strict=True)))
    lm.Trainer(lm.Net.start(shares), shares, 0).learn(pa.array(texts), table)
    assert len(seen) == table.total
    assert sum(before == [lm.BEGIN] * 2 for before, _ in seen) == len(texts)


def test_model_tells_rarer_words_apart(spark):
    """ay follows ax and by follows bx; all four are beyond the 900 most frequent words."""
    fill, pairs = " ".join(f"f{k} " * 100 for k in range(900)), [f"{w} {a}" for w in range(60) for a in ("ax ay", "bx by")]
    table = lm.table_of(lm.count(spark.createDataFrame([(t,) for t in [fill, *pairs]], "text string")))
    shares = lm.shares_of(table)
    ax, ay, bx, by = ids = lm._numbered(pa.array(["ax ay bx by"]), table)[0][:4].tolist()
    assert min(ids) > 900 and max(ids) < len(shares) - 1
    trainer = lm.Trainer(lm.Net.start(shares), shares, 0)
    for _ in range(40):
        trainer.learn(pa.array(pairs * 8), table)
    own, odd, own_b, odd_b = trainer.net.log_probabilities(np.array([[lm.BEGIN, ax], [lm.BEGIN, ax], [lm.BEGIN, bx], [lm.BEGIN, bx]]), np.array([ay, by, by, ay]))
    assert own > odd + 1 and own_b > odd_b + 1
    assert abs(np.exp(trainer.net.log_probabilities(np.array([[ax, ay]] * len(shares)), np.arange(len(shares)))).sum() - 1) < 1e-4


def plain_log_probability(net, before, after):
    """One word at a time, over all choices of each level."""
    q = np.append(net.context[before[0]] * net.place[0] + net.context[before[1]] * net.place[1], 1)
    head = min(lm.HEAD, net.words - 1)
    if after < head or after == net.words - 1:
        path = [(0, len(net.choices[0]), 0, after if after < head else len(net.choices[0]) - 1)]
    else:
        t, w = after - head, lm.WIDTH
        path = [(0, len(net.choices[0]), 0, head + t // w**2), (t // w**2 * w, w, 1, t // w), (t // w * w, w, 2, t)]
    total = 0.0
    for low, n, level, own in path:
        z = net.choices[level].astype(float) @ q
        total += z[own] - np.log(np.exp(z[low : low + n]).sum())
    return total


def test_score_is_a_plain_normalised_sum(spark, docs):
    some = docs.limit(40)

    def plain_words(text):
        return [*(text or "").encode().lower().split(), lm.END]

    table = lm.table_of(lm.count(docs))
    net = lm.train(some, table)
    counted = lm.count(docs)
    number_of = dict(zip(table.hashes.tolist(), table.numbers.tolist(), strict=True))
    numbers = lambda w: number_of.get(lm.code_of(w))
    n_of = {r.word: r.n for r in counted.collect()}
    for r in lm.score(some.select("doc_id", "text"), table, net, counted).join(some.select("doc_id", "text"), "doc_id").limit(6).collect():
        before, total = [lm.BEGIN, lm.BEGIN], 0.0
        for w in plain_words(r.text):
            k = numbers(w)
            total += plain_log_probability(net, before, len(table.counts) if k is None else k) / math.log(10)
            if k is None:
                total += math.log10((n_of[lm.code_of(w)] + 0.5) / table.rest)
            before = [before[1], len(table.counts) if k is None else k]
        assert abs(total - r.score) < 1e-3 * r.n_tokens


def test_gradient_of_noise_contrast():
    shares = np.random.default_rng(1).random(5000)
    shares /= shares.sum()
    trainer = lm.Trainer(lm.Net.start(shares), shares, 0)
    rng = np.random.default_rng(2)
    for level, sizes in enumerate(lm.level_shares(shares)):
        vectors = trainer.net.choices[level] = trainer.net.choices[level].astype(float)
        q, to, noise = np.column_stack([rng.normal(size=(6, lm.SIZE)), np.ones(6)]), rng.integers(0, len(sizes), 6), rng.integers(0, len(sizes), 4)
        offset = trainer.offsets[level].astype(float)

        def likelihood(q, vectors):
            good = (q * vectors[to]).sum(axis=1) - offset[to]
            bad = q @ vectors[noise].T - offset[noise]
            return -np.log1p(np.exp(-good)).sum() - np.log1p(np.exp(bad)).sum()

        dq, d_to, d_noise = trainer.gradient(level, q, to, noise)
        full = np.zeros_like(vectors)
        np.add.at(full, to, d_to)
        np.add.at(full, noise, d_noise)
        for i, j in ((0, 0), (3, 5), (5, lm.SIZE)):
            step = np.zeros_like(q)
            step[i, j] = 1e-5
            assert abs((likelihood(q + step, vectors) - likelihood(q - step, vectors)) / 2e-5 - dq[i, j]) < 1e-4
            step = np.zeros_like(vectors)
            step[to[i], j] = 1e-5
            assert abs((likelihood(q, vectors + step) - likelihood(q, vectors - step)) / 2e-5 - full[to[i], j]) < 1e-4


def test_noise_of_many_steps_is_drawn_at_once():
    shares = np.random.default_rng(1).random(5000)
    shares /= shares.sum()
    trainer, calls = lm.Trainer(lm.Net.start(shares), shares, 0), []
    rng, draw = np.random.default_rng(3), trainer.rng

    class Counted:
        def random(self, *size):
            calls.append(size)
            return draw.random(*size)

    trainer.rng = Counted()
    for _ in range(30):
        after = np.sort(rng.integers(0, 5000, 64))
        trainer.step(rng.integers(0, 5000, (64, 2)), after)
    assert len(calls) == 3  # one a level; before, one a level and step
    for level, own in enumerate(lm.level_shares(shares)):
        drawn = np.concatenate([trainer._noise(level) for _ in range(2000)])
        assert len(drawn) == 2000 * lm.NOISE and abs(np.bincount(drawn // 48, minlength=2)[:2] / len(drawn) - [own[:48].sum() / own.sum(), own[48:96].sum() / own.sum()]).max() < 0.02


def test_shares_of_large_products_are_normalised():
    """Products of 200 and -200 are too large, and too small, for single precision."""
    vectors = np.array([[200, 0], [199, 0], [-1, 0]], np.float32)
    for q in ([1, 1], [-1, 1], [0.5, 1], [0, 1]):
        z = vectors @ np.array(q, np.float32)
        plain = z - z.max() - np.log(np.exp(z - z.max(), dtype=float).sum())
        assert np.allclose(lm._log_share(np.array([q] * 3, np.float32), vectors, np.arange(3)), plain, atol=1e-4)
    low = np.array([[-200, 0], [-201, 0]], np.float32)
    assert abs(np.exp(lm._log_share(np.ones((2, 2), np.float32), low, np.arange(2))).sum() - 1) < 1e-5


def test_sums_of_rows():
    rng = np.random.default_rng(4)
    for n, kinds in ((0, 5), (1, 5), (50, 1), (50, 1000), (400, 90)):
        ids, g = rng.integers(0, kinds, n), rng.normal(size=(n, 3)).astype(np.float32)
        plain = np.zeros((kinds, 3))
        np.add.at(plain, ids, g)
        for order in "CF":
            rows, sums = lm._by_row(ids, np.asarray(g, order=order))
            assert rows.tolist() == sorted(set(ids.tolist())) and np.allclose(sums, plain[rows], atol=1e-5)


@pytest.mark.parametrize("at_once", [0, 3, 1 << 20])
def test_counts_that_leave_a_task_in_parts(spark, at_once):
    texts = [None, "", "a B a", "b", *(f"w{k % 7} x" for k in range(5000))]
    plain = Counter(w for t in texts for w in [*(t or "").encode().lower().split(), lm.END])
    found = lm.count(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), at_once).collect()
    assert {r.word: r.n for r in found} == {lm.code_of(w): n for w, n in plain.items()} and len(found) == len(plain)


def test_model_is_normalised():
    shares = np.full(lm.WORDS, 1 / lm.WORDS)
    net = lm.Net.start(shares)
    before = np.array([[lm.BEGIN, 3]] * lm.WORDS)
    assert abs(np.exp(net.log_probabilities(before, np.arange(lm.WORDS))).sum() - 1) < 1e-4


def library_ids(text, end):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing(docs, odd):
    for table in (docs.limit(60), odd):
        texts = table.collect()
        pieces = packing.pack(table, WORDS).collect()
        ids = {}
        for r in texts:
            ids.setdefault(r.doc_id, library_ids(r.text, 2))
        sequences, covered = {}, {i: np.zeros(len(x) + 1, int) for i, x in ids.items()}
        for p in pieces:
            own = ids[p.doc_id]
            assert p.doc_tokens == len(own) and p.length > 0 and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
            sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.tier, p.step_group))
            covered[p.doc_id][p.start] += 1
            covered[p.doc_id][p.start + p.length] -= 1
        times = Counter(r.doc_id for r in texts)
        assert all((np.cumsum(c)[:-1] == times[i]).all() for i, c in covered.items())
        small, tasks = 0, 1
        for parts in sequences.values():
            at = 0
            for offset, length, tier, step in sorted(parts):
                assert offset == at and step == parts[0][3]
                at += length
            assert at == tier and at & (at - 1) == 0 and at <= 4096
            small += at < 512
        assert small <= 9


def test_steps_are_balanced():
    sizes = [4096] * 37 + [2048] * 11 + [1024] * 25 + [512] * 60
    steps = packing.balanced(sizes, 32768)
    tokens, mixed = Counter(), {}
    for size, step in zip(sizes, steps, strict=True):
        tokens[step] += size
        mixed.setdefault(step, Counter())[size] += 1
    assert len(tokens) == round(sum(sizes) / 32768) and max(tokens.values()) - min(tokens.values()) <= 512
    assert all(mixed[step][4096] in (5, 6, 7) and len(mixed[step]) >= 3 for step in mixed)


def test_token_files(spark, docs, odd, tmp_path):
    for table in (docs.limit(80), odd):
        rows = token_store.round_trip(spark, table, WORDS).collect()
        at, texts = 0, {r.doc_id: r.text for r in table.collect()}
        rows = sorted(rows, key=lambda r: r.start)
        for r in rows:
            own = library_ids(texts[r.doc_id], 1)
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
            at += len(own)
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in table.collect()), key=lambda i: (i is not None, i or 0))
    uri = f"file://{tmp_path}/a.tids"
    w = token_store.Writer(uri, b"")
    for name in (None, -(1 << 63), 5):
        w.add(name, b"\1\0\0\0" * 9)
    w.close()
    r = token_store.Reader(uri, b"")
    assert r.find(5) == [2] and r.find(4) == [] and r.find(-(1 << 63)) == [1] and r.ids(0) == r.ids(2) == b"\1\0\0\0" * 9 and [r.doc_id(k) for k in range(3)] == [None, -(1 << 63), 5]
    with pytest.raises(ValueError):
        token_store.Reader(uri, b"other")
    with pytest.raises(ValueError):
        token_store.round_trip(spark, docs.selectExpr("cast(doc_id as string) as doc_id", "text"), WORDS)


def test_chunks_come_from_anywhere():
    ids = np.arange(100_000, dtype="<u4").tobytes()
    starts = [np.frombuffer(token_store.chunk(ids, k), "<u4")[0] for k in range(200)]
    assert all(len(token_store.chunk(ids, k)) == token_store.SAMPLE_BYTES for k in range(5)) and max(starts) > 80_000 and min(starts) < 15_000
    assert token_store.chunk(ids[:40], 3) == ids[:40]


def test_ogg(docs, odd):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in ogg.text_round_trip(odd).collect():
        payload = texts[r.doc_id].encode()
        payload += b"\0" * (64 * max(1, -(-len(payload) // 64)) - len(payload))
        assert r.n_bytes == len(texts[r.doc_id].encode())
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.payload_bytes % 64 == 0 and r.payload_bytes > 0 and r.media_sha256 == hashlib.sha256(ogg.encode(texts[r.doc_id])).hexdigest()
    pages = ogg.stream_pages(7, [(b"h", 0), (b"z" * 200000, 5), (b"", 6), (b"y" * 255, 9)])
    streams, broken = ogg.demultiplex(b"junk".join(pages))
    assert [len(p) for p in streams[7].packets] == [1, 200000, 0, 255] and broken == 0 and ogg.times(streams[7], 9)[-1] == 1
    other = ogg.stream_pages(7, [(b"h", 0), (b"second", 3)])
    chained, broken = ogg.demultiplex(b"".join(pages + other))
    assert [len(p) for p in chained[7].packets] == [1, 200000, 0, 255] and chained[(7, 1)].packets == [b"h", b"second"] and chained[7].lost == chained[(7, 1)].lost == broken == 0
    between = ogg.Stream(1, [b"head", b"a" * 10, b"b" * 30, b"c" * 5, b"d"], [0, -1, 80, 90, -1])
    assert ogg.times(between, 10) == [0.0, 2.0, 8.0, 9.0, None]
    streams, broken = ogg.demultiplex(b"".join(pages[:2] + pages[3:]))
    assert [len(p) for p in streams[7].packets] == [1, 0, 255]
    bad = bytearray(b"".join(pages))
    bad[60] ^= 1
    assert ogg.demultiplex(bytes(bad))[1] == 1


def plain_contamination(text, items):
    words = decontaminate.words(text or "")
    hit, found = [False] * len(words), set()
    for name, own in items:
        n = min(13, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in windows:
                found.add(name)
                hit[k : k + n] = [True] * n
    return len(words), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_contamination(spark, docs):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(900, "the and"), (901, None), (902, "!!")], "item_id long, text string"))
    items = [(str(r.item_id), decontaminate.words(r.text or "")) for r in benchmark.collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = decontaminate.contamination(docs, benchmark).collect()
    assert any(r.contaminated for r in rows)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == plain_contamination(texts[r.doc_id], items)
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    clean = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert clean == {r.doc_id for r in rows if not r.contaminated}


@pytest.mark.parametrize("hot", [1000, 50])
def test_large_benchmark_is_joined(spark, docs, monkeypatch, hot):
    """The way of a benchmark too large for tasks: the same rows, also with short, repeated and shared items, no ids and hot windows."""
    odd = [("s1", "the and"), ("s2", "the"), (None, "of the"), ("n", None), ("w", "!! ?"), ("t1", "The AND"), ("t1", "the and")]
    real = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("cast(item_id AS string) item_id", "text")
    benchmark = real.union(spark.createDataFrame(odd, "item_id string, text string")).union(real.selectExpr("concat(item_id, 'copy')", "text"))
    whole = sorted(map(tuple, decontaminate.contamination(docs, benchmark).collect()))
    bad = {r[0] for r in whole if r[5]}
    for name, value in (("WHOLE_BYTES", 10), ("HOT", hot), ("SALTS", 5), ("LEAST_BITS", 1024), ("MARKED", 1)):
        monkeypatch.setattr(decontaminate, name, value)
    assert decontaminate.whole(benchmark) is None
    assert sorted(map(tuple, decontaminate.contamination(docs, benchmark).collect())) == whole
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in whole} - bad
    if hot == 50:
        return
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0
    twice = docs.where("doc_id < 3").union(docs.where("doc_id < 3")).withColumn("text_hash", docs["n_chars"])
    assert Counter(map(tuple, decontaminate.contamination(twice, benchmark).collect())) == Counter({r: 2 for r in whole if r[0] < 3})


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_contamination_of_odd_rows(spark, odd, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "WHOLE_BYTES", most)
    items = [("a", decontaminate.words("one two three four five six seven eight"))]
    benchmark = spark.createDataFrame([("a", "one two three four five six seven eight"), (None, "!!"), ("b", None)], "item_id string, text string")
    for r in decontaminate.contamination(odd, benchmark).collect():
        text = next(t for i, t, _ in ODD if i == r.doc_id)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == plain_contamination(text, items) and r.contaminated == (r.doc_id in (3, 4))
    assert Counter(r.doc_id for r in decontaminate.clean(odd, benchmark).collect()) == Counter(i for i, *_ in ODD if i not in (3, 4))
    assert not any(r.contaminated for r in decontaminate.contamination(odd, benchmark.limit(0)).collect())


def plain_records(data):
    """By the standard library: members, then header lines as of a mail."""
    import gzip
    from email.parser import HeaderParser

    data, out = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        headers = HeaderParser().parsestr(head.decode().partition("\r\n")[2])
        n = int(headers["Content-Length"])
        block, end, data = data[:n], data[n : n + 4], data[n + 4 :]
        assert head.startswith(b"WARC/1.1\r\n") and len(block) == n and end == b"\r\n\r\n"
        out.append((headers, block))
    return out


def sha1(data):
    import base64

    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_page_text(html):
    """By the standard library's parser."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden, self.title, self.links = [], [], None, []

        def handle_starttag(self, tag, attrs):
            if tag == "body":
                self.hidden.clear()
            if tag in ("script", "style", "noscript", "template", "head", "svg"):
                self.hidden.append(tag)
            if tag == "title":
                self.title = ""
            self.links += [v for k, v in attrs if (tag, k) == ("a", "href") and v]
            self.out.append("\n" if tag in warc._BLOCKS else "")

        def handle_endtag(self, tag):
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
            self.out.append("\n" if tag in warc._BLOCKS else "")

        def handle_data(self, data):
            if self.lasttag == "title" and self.title == "":
                self.title = " ".join(data.split())
            elif not self.hidden:
                self.out.append(data)

    p = Text()
    p.feed(html)
    p.close()
    return "\n".join(x for x in (" ".join(x.split()) for x in "".join(p.out).split("\n")) if x), p.title or "", p.links


@pytest.mark.parametrize("packed", [False, True])
def test_warc_records(packed):
    html = "<head><title>T &amp; u</title></head><body><p>a<script>x</script>b <a href='l'>c</a>"
    (headers, block), = plain_records(warc.response("http://x", html, packed))
    assert block.endswith(b"\r\n\r\n" + html.encode()) and headers["WARC-Payload-Digest"] == sha1(html.encode()) and headers["WARC-Block-Digest"] == sha1(block)
    data, whole = warc.derive(warc.response("http://x", html, packed), packed)
    (meta, facts), (converted, text) = plain_records(data)
    assert whole and text.decode() == "ab c" and converted["WARC-Block-Digest"] == sha1(text) and meta["WARC-Block-Digest"] == sha1(facts)
    assert meta["WARC-Refers-To"] == converted["WARC-Refers-To"] == headers["WARC-Record-ID"] and converted["WARC-Concurrent-To"] == meta["WARC-Record-ID"]
    assert meta["WARC-Refers-To-Target-URI"] == "http://x" and meta["WARC-Refers-To-Date"] == headers["WARC-Date"]
    assert f"source-payload-digest: {sha1(html.encode())}" in facts.decode().split("\r\n") and "title: T & u" in facts.decode().split("\r\n")
    assert len({meta["WARC-Record-ID"], converted["WARC-Record-ID"], headers["WARC-Record-ID"]}) == 3


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = warc.page_derivatives(pages).collect()
    html = {r.page_id: r for r in pages.collect()}
    assert len(rows) == len(html)
    for r in rows:
        page = html[r.page_id]
        text, title, links = plain_page_text(page.html)
        assert (r.target_uri, r.source_payload_digest, r.source_status) == (page.url, sha1(page.html.encode()), "HTTP/1.1 200 OK")
        assert (r.title, r.n_links, r.n_text_bytes) == (title, len(links), len(text.encode()))
        assert (r.text_sha256, r.text_digest, r.whole) == (hashlib.sha256(text.encode()).hexdigest(), sha1(text.encode()), True)


def test_warc_odd_pages(spark):
    rows = [(1, None, None), (2, "u", "<p>a<script>b</script>"), (2, "u", "<p>a<script>b</script>"), (None, "v", "x" * 3_000_000), (4, "w", ""), (5, "a\r\nb", "\r\n\r\n<p")]
    odd = spark.createDataFrame([(*r, 1, "t", True, "n") for r in rows], "page_id long, url string, html string, warc int, title string, whole boolean, page string")
    out = warc.page_derivatives(odd).collect()
    assert Counter((r.page_id, r.n_text_bytes) for r in out) == Counter([(1, 0), (2, 1), (2, 1), (None, 3_000_000), (4, 0), (5, 0)])
    assert len({r.metadata_id for r in out if r.page_id == 2}) == 1
    assert warc.page_derivatives(odd.limit(0)).count() == 0


def test_files_that_are_not_whole(spark):
    good = warc.response("http://x", "<p>hello")
    other = warc.record([("WARC-Type", "warcinfo")], b"who")
    files = {1: other, 2: b"", 3: good[:-20], 4: other + good + b"junk", 5: good.replace(b"Content-Length: ", b"Content-Length: z", 1), 6: None, 7: b"\x1f\x8bno gzip", 8: warc.response("u", "x", True)[:-9]}
    table = spark.createDataFrame(list(files.items()), "page_id long, warc binary")
    rows = {r.page_id: r for r in warc.summary(warc.derivatives(table)).collect()}
    assert [k for k, r in rows.items() if r.whole] == [1, 2, 6] and [k for k, r in rows.items() if r.metadata_id] == [4]
    assert rows[4].n_text_bytes == 5 and all(rows[k].text_digest is None for k in files if k != 4)


def test_page_text():
    cases = {
        "<title>t<p>x": ("x", "t", []), "<p title='a>b'>q<a href=x>l</a><A HREF='u&amp;v'>m": ("qlm", "", ["x", "u&v"]), "a < b <3 &lt;": ("a < b <3 <", "", []),
        "<!-- c": ("", "", []), '<p title="never ends>a': ("", "", []), "<svg/>t<svg>x</svg>u<head>h<body>b": ("tub", "", []), "x<script>a</scriptb>y": ("x", "", []), "<a data-href=no>z": ("z", "", []),
    }
    for html, found in cases.items():
        assert warc.plain_text(html) == found


def test_broken_response_has_no_conversion():
    import gzip

    plain = gzip.decompress(warc.response("http://x", "<p>hello", True)).replace(b"hello", b"jello")
    kinds = [warc.get(h, "WARC-Type") for h, _ in warc.records(warc.derive(plain)[0])]
    assert kinds == ["metadata"]


def test_pipeline(spark, docs, odd):
    import corpus_pipeline

    kept = docs
    kept = kept.unionByName(spark.createDataFrame([(10**9 + k, t, None, "s", 1) for k, t in enumerate(foreign())], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.collect(), stage(spark, kept, SF)
        assert kept.columns == docs.columns
        left = {r.doc_id for r in kept.collect()}
        if name == "language":
            assert left == {r.doc_id for r in before if r.doc_id < 10**9 and any(c.isalpha() for c in r.text or "")}
        if name == "near_copies":
            assert left == {c for _, _, c in plain_groups(before)}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == left
    twice = odd.where("doc_id in (3, 4)")
    assert [r.doc_id for r in jaccard.one_of_each(twice).collect()] == [3]
    assert jaccard.one_of_each(odd.where("doc_id = 4")).count() == 1


def test_one_row_of_each_component(spark):
    def text(word):
        return " ".join(f"{word}{k}" for k in range(30))

    rows = [
        (None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (1, text("c")), (None, text("d") + " more"), (None, text("d")),
        (2, text("e")), (2, text("f")), (2, text("f")), (3, text("f") + " more"), (None, None), (None, ""), (None, ""),
    ]
    kept = [tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    for own in ([(None, text("d"))], [(None, text("d") + " more")]):
        if own[0] in kept:
            kept.remove(own[0])
            break
    assert Counter(kept) == Counter([(None, text("a")), (None, text("b")), (1, text("c")), (2, text("e")), (2, text("f")), (None, None), (None, "")])


def test_queries_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    import oracle

    oracle.compare(spark, oracle.connect(SF), Q.queries()[name], Q.oracle_sql()[name], SF)


def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    docs = odd.selectExpr("doc_id", "text", "lang", "source", "n_chars")
    for name, table in (("odd", docs), ("empty", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "five six seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    left = {p.doc_id for p in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()}
    assert left <= {i for i, t, _ in ODD if any(c.isalpha() for c in t or "")} - {4, 6}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
