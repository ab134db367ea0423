"""JSON lines and CSV, read and written."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """Records of a JSON-lines folder by a schema; lines that are no JSON drop out, nulls become ``defaults``."""
    lines = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in (defaults or {}) else F.col(c) for c in rows.columns])


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A row a line, columns in the order of their names, without blanks."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode(mode).text(path)


def gunzipped(data: Column) -> Column:
    """Bytes that begin as gzip does, decompressed; others, and null, as they are."""

    @F.pandas_udf("binary")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(lambda v: gzip.decompress(v) if v is not None and v[:2] == b"\x1f\x8b" else v)

    return plain(data)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path and text of files that may be compressed, whatever their names."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode(gunzipped(F.col("content")), "utf-8").alias("text"))


def judgment_rows(records: DataFrame) -> DataFrame:
    """Judged records as they are exported, by query and document; a missing grade is empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return records.orderBy("qid", "doc_id").select("qid", "query_text", "doc_id", "doc_hash", "doc_text", text("grade"), text("reason"), text("status"), text("ts"))


def query_rows(queries: DataFrame) -> DataFrame:
    """Queries as they are exported: lists joined by semicolons, conditions as JSON or empty."""
    hard = F.when(F.size("hard") > 0, F.to_json("hard")).otherwise("")
    return queries.select("qid", "text", "source", "category", "lang", F.array_join("facets", ";").alias("facets"), hard.alias("hard"), "difficulty", "match_docs", "split")


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text."""
    return spark.read.option("header", True).option("escape", '"').csv(path)
