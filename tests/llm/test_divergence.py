"""Sources held against one another, by all terms in Python's whole numbers, and on odd rows."""

import random
import re
from collections import Counter, defaultdict

from tessella.llm import divergence


def plain(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)), g or "", s or "") for t, g, s in rows]
    had, groups = defaultdict(Counter), defaultdict(Counter)
    for ts, g, s in docs:
        had[g].update(set(ts))
        groups[g, s].update(ts)
    out = []
    for (g, s), n in groups.items():
        kept = [t for t, k in had[g].items() if k >= 3]
        chance = lambda c, kept=kept: {t: 1 + 1000000000 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = chance(n), chance(sum((c for (h, _), c in groups.items() if h == g), Counter()))
        pairs = []
        for (h, s2), other in groups.items():
            if h == g and s2 != s:
                r = chance(other)
                pairs.append((-sum((p[t] - r[t]) ** 2 // r[t] for t in kept), s2.encode()))
        terms = sorted((-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[t] and p[t] > q[t])
        out += [(g, s, "pair", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(pairs), 1)]
        out += [(g, s, "term", i.decode(), -v, k) for k, (v, i) in enumerate(terms[:200], 1)]
    return sorted(out)


def test_random_documents(spark, monkeypatch):
    r = random.Random(2)
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}É" for k in range(400)] + ["Zz", "ZZ", "über", "ÜBER"]
    rows = [(" ".join(r.choice(words[: r.choice([5, 50, 404])]) for _ in range(r.randrange(60))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", None])) for _ in range(150)]
    rows += [("common " * 5000, "en", "hot")] * 40
    monkeypatch.setattr(divergence, "HELD", 50)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "a"), ("12 !!", "en", "b"), ("one two", "fr", "a"), ("one", "fr", "b"), ("x" * 100_000, "de", "a"), ("ONE one\tone", "fr", "b"), ("one", "fr", "b"), ("one\x00two", "fr", "a")]
    docs = spark.createDataFrame([(*r, 1, "n", 2.0) for r in rows], "text string, lang string, source string, n int, term string, value double")
    got = sorted(map(tuple, divergence.audit(docs).collect()))
    assert got == plain(rows) and ("en", "a", "pair", "b", 0, 1) in got
    assert divergence.audit(docs.limit(0)).count() == 0


def test_whole_numbers_beyond_longs(spark):
    rows = spark.createDataFrame([(9_000_000_000_000, 10_000_000_000_000, 5)], "n long, total long, kept long")
    assert rows.select(divergence._probability("n", "total", "kept")).first()[0] == 1 + 1000000000 * 9_000_000_000_001 // 10_000_000_000_005
