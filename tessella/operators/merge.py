"""Merges of tables without a lakehouse format: the new table as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], guard: str, now) -> DataFrame:
    """``new`` merged into ``old`` (key, columns, first_seen_at, updated_at): a row is replaced, and its updated_at moved,
    only if ``guard`` differs, null counting as a value."""
    o, n = old.alias("o"), new.select(key, *columns, F.lit(True).alias("__new")).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there, given = F.col(f"o.{key}").isNotNull(), F.coalesce(F.col("n.__new"), F.lit(False))
    take = given & (~there | ~F.col(f"o.{guard}").eqNullSafe(F.col(f"n.{guard}")))
    kept = [F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *kept, F.coalesce("o.first_seen_at", now).alias("first_seen_at"), F.when(take, now).otherwise(F.col("o.updated_at")).alias("updated_at"))


def refresh(old: DataFrame, new: DataFrame, key: str, columns: list[str], now) -> DataFrame:
    """A catalogue's rows: what is seen again gets new columns and last_seen_at, always."""
    o, n = old.alias("o"), new.select(key, *columns, F.lit(True).alias("__new")).alias("n")
    seen = F.coalesce(F.col("n.__new"), F.lit(False))
    kept = [F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *kept, F.coalesce("o.first_seen_at", now).alias("first_seen_at"), F.when(seen, now).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"))


def fill(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where there are any; a null keeps the old one."""
    n = new.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    kept = [F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns]
    return old.join(n, F.col(key) == F.col("__key"), "left").select(*kept)


def mark_missing(catalogue: DataFrame, missing: DataFrame, key: str, now) -> DataFrame:
    """missing_since is set for keys in ``missing`` that have none yet."""
    gone = missing.select(F.col(key).alias("__key")).distinct()
    since = F.when(F.col("missing_since").isNull() & F.col("__key").isNotNull(), now).otherwise(F.col("missing_since"))
    return catalogue.join(gone, F.col(key) == F.col("__key"), "left").withColumn("missing_since", since).drop("__key")


def append_first(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``new`` rows of keys not in ``old``, the first of each, after ``old``."""
    cols = [c for c in new.columns if c != key]
    fresh = new.join(old, key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("r")).select(key, "r.*")
    return old.unionByName(fresh)


def gap(catalogue: DataFrame, library: DataFrame, key: str) -> DataFrame:
    """What the catalogue has and the library lacks."""
    return catalogue.join(library, key, "left_anti")


def upsert_vectors(old: DataFrame, new: DataFrame, key: list[str], vector: str = "embedding") -> DataFrame:
    """``old`` with the vectors of ``new`` (keys such as item and model): only the vector is replaced."""
    n = new.select(*key, F.col(vector).alias("__new"))
    rest = [c for c in old.columns if c not in (*key, vector)]
    return old.join(n, key, "full_outer").select(*key, *rest, F.coalesce("__new", vector).alias(vector))


def cached_and_owed(request: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a cache has of the requested keys, and the keys that it lacks, each once."""
    wanted = request.select(*key).distinct()
    return cache.join(wanted, key, "left_semi"), wanted.join(cache, key, "left_anti")


def write_version(rows: DataFrame, path: str) -> None:
    """A version is written once; writing it again fails."""
    rows.write.mode("errorifexists").parquet(path)
