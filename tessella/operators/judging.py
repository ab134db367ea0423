"""Pools of judged documents, labels, worksheets."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import blake2b_hex, hash_hex
from ..functions.text import graded
from .metrics import kappa
from .ranks import placed


#: The revision of the judge's instructions.
PROMPT = "v1"


def pool(runs: list[DataFrame], depth: int) -> DataFrame:
    """qid, doc_id that any run has among its first ``depth``."""
    return reduce(DataFrame.union, [r.where(F.col("rank") <= depth).select("qid", "doc_id") for r in runs]).distinct()


def negatives(pooled: DataFrame, docs: DataFrame, version: str, k: int) -> DataFrame:
    """For each query ``k`` documents outside its pool, or all if there are fewer: the next ones in the order of the documents' MD5,
    round and round, from a place that the MD5 of qid and ``version`` gives. So each query draws its own, and always the same.

    Documents are numbered in that order without a task that sorts them all; a query meets as many as its pool has, and ``k``.
    """
    ordered = placed(docs.select("doc_id").distinct().withColumn("hash", F.md5(F.col("doc_id").cast("string"))), "hash", "doc_id")
    n = ordered.count()
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("qid").cast("string"), F.lit(version))), 1, 15), 16, 10).cast("long") % max(n, 1)
    own = pooled.groupBy("qid").agg(F.count("*").alias("n")).withColumn("start", start)
    steps = own.select("qid", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n") + k, F.lit(n)) - 1)).alias("step")) if n else own.select("qid", "start", F.lit(0).alias("step")).limit(0)
    met = steps.withColumn("place", (F.col("start") + F.col("step")) % max(n, 1)).join(ordered, "place").join(pooled, ["qid", "doc_id"], "left_anti")
    return met.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy("step"))).where(F.col("at") <= k).select("qid", "doc_id")


def unjudged(pooled: DataFrame, labels: DataFrame) -> DataFrame:
    return pooled.join(labels, ["qid", "doc_id"], "left_anti")


def latest_labels(records: DataFrame, version: str) -> DataFrame:
    """qid, doc_id, grade of one version of the judge: the last record of each pair, its null kept."""
    own = records.where(F.col("version") == version)
    return own.groupBy("qid", "doc_id").agg(F.max_by(F.struct("grade"), "at").alias("r")).select("qid", "doc_id", "r.grade")


def latest_version(records: DataFrame) -> DataFrame:
    return records.agg(F.max_by("version", F.struct("ts", "at")).alias("version"))


def worksheet(labels: DataFrame, quota: dict[int, int], order: Column, key: str) -> DataFrame:
    """So many labels of each grade, in the order of a hash."""
    place = F.row_number().over(Window.partitionBy("grade").orderBy(order, key))
    wanted = F.coalesce(*[F.when(F.col("grade") == g, n) for g, n in quota.items()], F.lit(0))
    return labels.withColumn("place", place).where(F.col("place") <= max(quota.values(), default=0)).where(F.col("place") <= wanted)


def judge(pooled: DataFrame, labels: DataFrame, grade: Column, budget: int | None = None) -> DataFrame:
    """qid, doc_id, grade, status of the pairs of the pool that ``labels`` lacks; with a ``budget``, the first so many by query
    and document. A null grade is an answer that could not be read."""
    owed = unjudged(pooled, labels)
    if budget is not None:
        owed = owed.orderBy("qid", "doc_id").limit(budget)
    return owed.withColumn("grade", grade).withColumn("status", F.when(F.col("grade").isNull(), "unparsed").otherwise("ok"))


def ask(owed: DataFrame, answer: Callable[[str, str], str], model: str, retries: int = 2) -> DataFrame:
    """Records of the pairs ``owed`` (qid, query_text, doc_id, doc_text, doc_hash), graded by a judge: ``answer`` of query and document
    is asked again, ``retries`` times at most, while it fails or cannot be read. Columns of ``owed`` and key, grade, reason, status
    ('ok', 'unparsed' or 'error'), judge_model, version."""
    schema = f"{', '.join(f'{c} {t}' for c, t in owed.dtypes)}, key string, answer string, failed boolean"
    version = f"{model}@prompt-{PROMPT}"

    def one(query: str, doc: str) -> tuple[str, bool]:
        text, failed = "", True
        for _ in range(retries + 1):
            try:
                text, failed = answer(query, doc), False
            except Exception as e:  # a judge that is out of reach must not end the pass
                text, failed = str(e), True
            if not failed and readable(text):
                break
        return text, failed

    def run(batches):
        for batch in batches:
            found = [one(q, d) for q, d in zip(batch["query_text"], batch["doc_text"], strict=True)]
            keys = [hash_hex(q, i, h, model, PROMPT) for q, i, h in zip(batch["query_text"], batch["doc_id"], batch["doc_hash"], strict=True)]
            yield batch.assign(key=keys, answer=[t for t, _ in found], failed=[f for _, f in found])

    rows = owed.mapInPandas(run, schema).withColumn("told", graded(F.col("answer")))
    grade = F.when(~F.col("failed"), F.col("told.grade"))
    status = F.when(F.col("failed"), "error").when(grade.isNull(), "unparsed").otherwise("ok")
    return rows.select(*owed.columns, "key", grade.alias("grade"), F.col("told.reason").alias("reason"), status.alias("status"), F.lit(model).alias("judge_model"), F.lit(version).alias("version"))


def readable(answer: str) -> bool:
    """Whether an answer has a grade, roughly; :func:`tessella.functions.text.graded` decides."""
    return bool(re.search(r'"grade"\s*:\s*"?\s*0*[0-3]\s*"?\s*[,}]', answer))


def worksheet_rows(records: DataFrame, quota: dict[int, int], blind: bool = False) -> DataFrame:
    """A worksheet for people from judged records (key, query_text, doc_id, doc_text, grade, reason, status): by grade the first of the
    quota in the order of the key's BLAKE2b; ``blind`` leaves the judge's grade and reason out."""
    picked = worksheet(records.where("status = 'ok'").withColumn("__order", blake2b_hex(F.col("key"))), quota, F.col("__order"), "key")
    told = [] if blind else [F.col("grade").alias("judge_grade"), F.col("reason").alias("judge_reason")]
    return picked.orderBy("key").select(F.col("key").alias("pair_id"), "query_text", "doc_id", "doc_text", *told, F.lit("").alias("human_grade"), F.lit("").alias("notes"))


def judge_counts(pooled: DataFrame, labels: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: pool, cached, judged, unparsed."""
    rows = pooled.join(labels.select("qid", "doc_id", F.lit(True).alias("old")).distinct(), ["qid", "doc_id"], "left").join(judged.select("qid", "doc_id", "status"), ["qid", "doc_id"], "left")
    return rows.agg(F.count("*").alias("pool"), F.count("old").alias("cached"), F.count("status").alias("judged"), F.count_if(F.col("status") == "unparsed").alias("unparsed"))


def one_version(runs: DataFrame, *columns: str) -> DataFrame:
    """``runs``, if they are of one version of each of ``columns``; else a ValueError."""
    n = runs.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    if mixed := [c for c in columns if n[c] > 1]:
        raise ValueError(f"runs of several versions: {', '.join(mixed)}")
    return runs


def calibration(worksheet: DataFrame, labels: DataFrame, gate: float = 0.4) -> DataFrame:
    """One row: n_graded, n_skipped, agreement, kappa, passed of a worksheet (pair_id, human_grade as text) that people filled
    in, against ``labels`` (key, grade). Rows without a grade 0 to 3, or of unknown pairs, are skipped."""
    rows = worksheet.select(F.trim("pair_id").alias("key"), F.trim("human_grade").alias("h")).join(labels.where("grade is not null").select("key", "grade"), "key", "left")
    good = F.coalesce(F.col("h").rlike("^[0-3]$"), F.lit(False)) & F.col("grade").isNotNull()
    skipped = rows.agg(F.count_if(~good).alias("n_skipped"))
    found = kappa(rows.where(good).select(F.col("grade").cast("int").alias("a"), F.col("h").try_cast("int").alias("b")))
    return found.crossJoin(skipped).select(F.col("n").alias("n_graded"), "n_skipped", "agreement", "kappa", (F.col("kappa") >= gate).alias("passed"))
