"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties, then calibrated by one temperature.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import gather
from .arrow import fields, map_column, record_batch, slices
from .words import release

#: N-grams of 1 to 3 characters go to this many buckets.
BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
#: The regression is fitted on this many labelled documents of a language at most, those of the smallest hashes of doc_id; every
#: CALIBRATE-th of them fits the temperature instead. Document frequencies cover all training rows.
SAMPLE, CALIBRATE, EPOCHS = 600, 5, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
NO_LETTER, DOUBT = "und", 0.01
#: What a text must have to be of a known language: of the way from a blind guess to certainty, and n-grams that COMMON of the
#: learnt texts of some language have: this share of its own, or SLACK times that of nearly all labelled texts if they have less.
SURE, KNOWN, COMMON, SLACK = 0.1, 0.85, 0.01, 0.9
_LETTER = regex.compile(r"\p{L}").search
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code of the basic plane, itself if it is a letter, else a space; read off Python's own character data."""
    if not _letters:
        _letters.append(np.array([i if chr(i).isalpha() else 32 for i in range(1 << 16)], np.uint32))
    return _letters[0]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each occurs. Runs of what is no letter are one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes < 1 << 16, _letter_table()[codes & 0xFFFF], codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    found = []
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            x = h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            found.append((x >> np.uint32(16)).astype(np.int64))
    all_counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    at = np.flatnonzero(all_counts)
    return at, all_counts[at]


def tf_idf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(1e-12, math.sqrt(float(x @ x)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (buckets x classes) by FTRL-Proximal over rows of (buckets, values, class)."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(z, n):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for at, x, label in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[label] -= 1
            g = np.outer(x, p)
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section on its logarithm.

    Of each label's weight, DOUBT goes to all languages alike: labels may be wrong, and rows that are all predicted right
    would ask for certainty.
    """
    if not len(labels):
        return 1.0

    def loss(t):
        p = np.log(softmax(logits / math.exp(t)) + 1e-300)
        return -((1 - DOUBT) * p[np.arange(len(labels)), labels] + DOUBT * p.mean(axis=1)).mean()

    lo, hi, ratio = math.log(0.02), math.log(50), (math.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float
    known: np.ndarray
    least_known: float

    def accepts(self, text: str | None) -> bool:
        """Whether a text is of one of the languages: its best one is likelier than a blind guess would be by SURE of what is left,
        and its n-grams are known ones. Without a letter, or without a model, it is not."""
        if not text or not self.languages or not _LETTER(text):
            return False
        at, n = counts(text)
        chance = 1 / len(self.languages)
        return self.shares(at, n).max() >= chance + SURE * (1 - chance) and share_known(at, n, self.known) >= self.least_known

    def shares(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return softmax(tf_idf(at, n, self.idf) @ self.weights[at] / self.heat)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated probability; 'und' and 0 for a text without letters, or without a model."""
        if not text or not self.languages or not _LETTER(text):
            return NO_LETTER, 0.0
        p = self.shares(*counts(text))
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def share_known(at: np.ndarray, n: np.ndarray, known: np.ndarray) -> float:
    return float(n[known[at]].sum() / n.sum())


def common_ngrams(rows: list[tuple[np.ndarray, int]], classes: int) -> np.ndarray:
    """For each bucket, whether COMMON of the texts of some class have it, of rows of (buckets, class)."""
    known = np.zeros(BUCKETS, bool)
    for label in range(classes):
        own = [at for at, y in rows if y == label]
        if own:
            known |= np.bincount(np.concatenate(own), minlength=BUCKETS) >= max(1, COMMON * len(own))
    return known


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``; 0 without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor, F.lit(0))


def sampled(docs: DataFrame) -> DataFrame:
    """lang, doc_id, text of SAMPLE documents of each language at most, those of the least hashes: one text of a doc_id, the least.
    Rows without doc_id are documents by their text, and only of languages that have no other.

    How many leading zeros a hash must have is found from counts first, so what meets by language is some 2 * SAMPLE names.
    """
    named = docs.where("doc_id is not null").select("lang", "doc_id", F.lit(None).cast("long").alias("own"))
    names = named.union(docs.where("doc_id is null").select("lang", "doc_id", F.xxhash64("text").alias("own"))).distinct()
    names = names.withColumn("none", F.col("doc_id").isNull()).withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", "own"), 1))
    names = names.withColumn("zeros", F.floor(63 - F.log2(F.col("hash") + 1.0)))
    counts = names.groupBy("lang", "none", "zeros").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang", "none").orderBy(F.desc("zeros")))
    cuts = counts.withColumn("enough", F.when(upto >= SAMPLE, F.col("zeros"))).groupBy("lang", "none").agg(F.coalesce(F.max("enough"), F.lit(0)).alias("least"))
    cuts = cuts.withColumn("first", F.min("none").over(Window.partitionBy("lang"))).where("none = first").drop("first")
    names = names.join(cuts, ["lang", "none"]).where("zeros >= least")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id", "own"))
    names = names.withColumn("nth", nth).where(F.col("nth") <= SAMPLE)
    names = F.broadcast(names.select(*[F.col(c).alias(f"__{c}") for c in ("lang", "doc_id", "own")]))  # no more than the rows that the driver gets
    docs = docs.withColumn("own", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    same = (F.col("lang") == F.col("__lang")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("own").eqNullSafe(F.col("__own"))
    return docs.join(names, same, "left_semi").groupBy("lang", "doc_id", "own").agg(F.min("text").alias("text")).drop("own")


def fit(docs: DataFrame) -> Model:
    """A model from the rows of ``docs`` (doc_id, text, lang) whose text and lang are not null."""
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    types = fields(StructType.fromDDL(gather.SCHEMA))

    def count(batches):
        df = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    df[counts(text)[0]] += 1
        if told := gather.parts(df):
            yield record_batch({"part": [k for k, _ in told], "data": [x for _, x in told]}, types)

    df = gather.merged(docs.select("text").mapInArrow(count, gather.SCHEMA), BUCKETS, "u4")
    n = docs.count()
    sample = sampled(docs)

    def features(texts):
        found = [counts(t) for t in texts]
        return {"at": [a.astype("<u2").tobytes() for a, _ in found], "n": [c.astype("<u4").tobytes() for _, c in found]}

    rows = map_column(sample, "text", "at binary, n binary", lambda: features).orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "at", "n").collect()
    idf = np.log((1 + n) / (1.0 + df)) + 1
    languages = sorted({r.lang for r in rows})
    data, occurrences = [], []
    for r in rows:
        at, times = np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4")
        data.append((at, tf_idf(at, times, idf), languages.index(r.lang)))
        occurrences.append(times)
    held = list(range(0, len(data), CALIBRATE)) if len(data) >= 10 * CALIBRATE else []
    learnt = [x for k, x in enumerate(data) if k % CALIBRATE or not held]
    w = train(learnt, len(languages)) if languages else np.zeros((BUCKETS, 0))
    heat = temperature(np.array([data[k][1] @ w[data[k][0]] for k in held]), np.array([data[k][2] for k in held], int)) if held else 1.0
    known = common_ngrams([(at, y) for at, _, y in learnt], len(languages))
    usual = [share_known(data[k][0], occurrences[k], known) for k in held]
    return Model(languages, idf, w.astype(np.float32), heat, known, min(KNOWN, SLACK * float(np.quantile(usual, 0.01))) if usual else 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs``, with lang_pred and score instead of text. No shuffle; the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        release()
        found = [shared.value.predict(t) for t in texts]
        return {"lang_pred": [x for x, _ in found], "score": [p for _, p in found]}

    return map_column(docs, "text", "lang_pred string, score double", lambda: work)


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang), by a model of the rows whose crc32
    of doc_id is not 2 modulo 4.

    A null text, or one without a letter, is 'und' with score 0, as are all if there is nothing to learn from. Rows without
    doc_id are not held out; repeated rows have equal results; other columns are not looked at; an empty table gives an
    empty table. Texts are read whole.
    """
    model = fit(docs.where(remainder(4) != 2))
    return identify(docs.select("doc_id", (remainder(4) == 2).alias("held_out"), "text"), model)


def with_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is of a language that a model of the labelled rows knows (:meth:`Model.accepts`).

    Texts that are null, empty or without a letter go, as do all if no row is labelled; labels of the rows themselves are
    learnt from but not looked at to decide; texts are read whole; repeated rows stay or go together; all columns stay as
    they are; an empty table gives an empty table.
    """
    model = fit(docs.where(remainder(4) != 2))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches):
        release()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([shared.value.accepts(t) for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
