"""Repeated passages against all windows, on texts of few words and on odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import repeats

W = repeats.WINDOW


def by_windows(texts):
    split = [(t or "").encode().split() for t in texts]
    times = Counter(tuple(ws[i : i + W]) for ws in split for i in range(len(ws) - W + 1))
    out = []
    for ws in split:
        gone = {j for i in range(len(ws) - W + 1) if times[tuple(ws[i : i + W])] > 1 for j in range(i, i + W)}
        kept = b" ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def pasted(r, alphabet, n):
    """Texts of ``alphabet`` words with passages of one another, some cut and some changed."""
    texts = [[f"w{r.randrange(alphabet)}" for _ in range(r.randrange(10, 120))] for _ in range(n)]
    for _ in range(n):
        a, b = r.choice(texts), r.choice(texts)
        at, size = r.randrange(len(a)), r.choice([20, 34, 35, 36, 50, 90])
        b[(k := r.randrange(len(b))) : k] = a[at : at + size]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("alphabet", [1, 2, 4, 1000])
def test_random_texts(spark, alphabet):
    texts = pasted(random.Random(alphabet), alphabet, 60)
    rows = repeats.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == by_windows(texts)


def test_periods_and_runs(spark):
    texts = ["a " * 200, "a " * 34 + "b", "b " + "a " * 36 + "c", "x y " * 40, "z " + "y x " * 18, "p q r " * 30 + "end", "p q r " * 11 + "p q"]
    rows = repeats.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == by_windows(texts)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(40000))
    texts = [None, "", "  \t\n", "one two", "one two", long, "x " + long, long.replace(" ", " \x0b"), "é ü " * 40]
    rows = [(k if k else None, t, "c", 1, 2, "k") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string, first long, key long, __key string")
    got = repeats.without_repeats(docs).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got] == by_windows(texts)
    assert [r["__key"] for r in got] == ["k"] * len(texts) and got[5].name == "c"
    assert repeats.repeats(docs).count() == len(texts) and repeats.repeats(docs.limit(0)).count() == 0


def test_equal_windows_have_equal_names():
    r = random.Random(5)
    shared = [f"s{r.randrange(300)}" for _ in range(60)]
    texts = [" ".join([*(f"u{r.random()}" for _ in range(r.randrange(50))), *shared, *(f"v{r.random()}" for _ in range(r.randrange(50)))]) for _ in range(8)]
    h, lengths = repeats._numbered(texts)
    name, first, n = repeats.stretches(h, lengths)
    of = {int(i): int(x) for x, a, k in zip(name, first, n, strict=True) for i in range(a, a + k)}
    starts = np.cumsum(lengths) - lengths
    at = [s + t.split().index(shared[0]) if t.split().count(shared[0]) == 1 else s + next(i for i in range(len(t.split())) if t.split()[i : i + 60] == shared) for s, t in zip(starts, texts, strict=True)]
    assert all(len({of[int(a) + k] for a in at}) == 1 for k in range(60 - W + 1))
    assert len(of) == sum(max(0, x - W + 1) for x in lengths)
