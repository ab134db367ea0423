"""Spooled JSON records: incremental reading by modification time, items, proofs of absence."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from ..functions.text import has_id


def records(spark: SparkSession, folder: str) -> DataFrame:
    """kind, path, modified, record (JSON text) of every file ``folder/kind/*.json``; files that are no JSON drop out."""
    files = spark.read.option("wholetext", True).text(f"{folder}/*/*.json").select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("kind"), "path", "modified", "record").where(F.try_parse_json("record").isNotNull())


def since(rows: DataFrame, floors: DataFrame, time: str = "modified") -> DataFrame:
    """Rows of each kind after its floor (kind, floor), the floor itself left out; kinds without floor are whole."""
    return rows.join(floors, "kind", "left").where(F.col("floor").isNull() | (F.col(time) > F.col("floor"))).drop("floor")


def items(record: Column) -> Column:
    """The attribute objects of a record (JSON texts): its own if it has an id, else those in body.data that have one. An id that is
    null is an id."""
    single = F.get_json_object(record, "$.attributes")
    many = F.transform(F.from_json(F.get_json_object(record, "$.body.data"), "array<string>"), lambda d: F.get_json_object(d, "$.attributes"))
    listed = F.filter(F.coalesce(many, F.array().cast("array<string>")), has_id)
    return F.when(has_id(single), F.array(single)).otherwise(listed)


def missing_id(record: Column) -> Column:
    """The id that a record proves absent: no attributes, a key of the form id-<n>, and an error that names a missing medium."""
    key = F.regexp_extract(F.get_json_object(record, "$.key"), r"^id-(\d+)$", 1)
    proof = F.get_json_object(record, "$.attributes").isNull() & F.get_json_object(record, "$.error").contains("missing_medium")
    return F.when(proof & (key != ""), key.try_cast("long"))


def _path(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop knows them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Under another name first, which then takes the place of the old file: a reader sees one of the two, whole."""
    target, fs = _path(spark, path)
    part, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(text.encode())
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, target, over)


def write_record(spark: SparkSession, folder: str, kind: str, key: str, url: str, payload: dict) -> str:
    """One record as ``folder/kind/key.json``; its path."""
    path = f"{folder}/{kind}/{key}.json"
    record = {"key": key, "url": url, "fetched_at": datetime.now(timezone.utc).timestamp(), **payload}
    _write_text(spark, path, json.dumps(record, ensure_ascii=False))
    return path


def load_marks(spark: SparkSession, path: str) -> dict[str, int]:
    """The floors (microseconds) of each kind, empty if there is no such file or it is broken; values that are no integers drop out."""
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return {}
    text = "".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    try:
        marks = json.loads(text)
    except ValueError:
        return {}
    return {k: v for k, v in marks.items() if isinstance(v, int) and not isinstance(v, bool)} if isinstance(marks, dict) else {}


def save_marks(spark: SparkSession, path: str, marks: dict[str, int]) -> None:
    _write_text(spark, path, json.dumps(marks, sort_keys=True))


def ingest(spark: SparkSession, folder: str, marks_path: str, sink: Callable[[DataFrame], None], full: bool = False) -> list[str]:
    """Hands ``sink`` the records (kind, path, modified, record) that changed since each kind's floor; the kinds it had.

    Floors move to when this pass began, and only after ``sink`` is done with all: a pass that fails is done again, so the
    sink must take a record twice. ``full`` looks at all records and leaves the floors.
    """
    began = int(datetime.now(timezone.utc).timestamp() * 1_000_000)
    marks = {} if full else load_marks(spark, marks_path)
    schema = StructType([StructField("kind", StringType()), StructField("floor", TimestampType())])
    floors = spark.createDataFrame([(k, datetime.fromtimestamp(v / 1_000_000, timezone.utc)) for k, v in marks.items()], schema)
    fresh = since(records(spark, folder), floors)
    kinds = sorted(r.kind for r in fresh.select("kind").distinct().collect())
    sink(fresh)
    if not full:
        save_marks(spark, marks_path, marks | dict.fromkeys(kinds, began))
    return kinds
