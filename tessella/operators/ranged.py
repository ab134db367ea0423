"""A table that is changed in place: rows in ranges of their key, of which a merge rewrites those that change and no others.

Bounds of the ranges are set once, when the table is made. A merge finds what changes first, against the ranges that its keys fall
into alone, writes the new rows of ranges with a change aside, and puts these in place of the old folders. Done again, it finds
nothing to change and writes nothing; stopped in between, it is done again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges of a table at most: so many bounds go to the tasks, and so many names of folders to the driver.
RANGES = 256


@dataclass(frozen=True)
class Ranged:
    """The table in the folder ``path``, by the integer column ``key``; ``part`` is its range."""

    spark: SparkSession
    path: str
    key: str
    bounds: list[int] = field(repr=False)

    @staticmethod
    def create(rows: DataFrame, path: str, key: str, ranges: int = RANGES) -> Ranged:
        """Rows with a null key are an error of the caller's: they have no place."""
        spark = rows.sparkSession
        shares = [k / ranges for k in range(1, ranges)]
        bounds = sorted({int(b) for b in rows.approxQuantile(key, shares, 1 / (4 * ranges)) if b is not None}) if shares else []
        spark.createDataFrame([(key, bounds)], "key string, bounds array<long>").coalesce(1).write.parquet(f"{path}/bounds")
        made = Ranged(spark, path, key, bounds)
        made._placed(rows).repartition("part").write.partitionBy("part").parquet(f"{path}/rows")
        return made

    @staticmethod
    def open(spark: SparkSession, path: str) -> Ranged:
        r = spark.read.parquet(f"{path}/bounds").first()
        return Ranged(spark, path, r.key, list(r.bounds))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their range: how many bounds are not above the key."""
        bounds = F.array(*[F.lit(b).cast("long") for b in self.bounds]).cast("array<long>")
        return rows.withColumn("part", F.size(F.filter(bounds, lambda b: b <= F.col(self.key).cast("long"))))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("part")

    def _of(self, parts: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("part").isin(parts))

    def merge(self, new: DataFrame, guard: list[str], now: Column | None = None, keep: tuple[str, ...] = (), aside: str | None = None) -> list[int]:
        """Rows of ``new`` (the key and any of the table's columns; one row a key) replace those of their keys, or are added; the ranges
        that were written.

        A row that is there is replaced only if one of ``guard`` differs, null counting as a value; columns in ``keep`` then stay
        as they were, columns that ``new`` has not become null, and updated_at and, of new keys, first_seen_at are ``now``, if
        the table has them. ``aside``: where the ranges are written before they replace the old ones.
        """
        stored, given = self.spark.read.parquet(f"{self.path}/rows"), [c for c in new.columns if c != self.key]
        types = {f.name: f.dataType for f in stored.schema.fields}
        wanted = self._placed(new)
        asked = sorted(r.part for r in wanted.select("part").distinct().collect())
        o, n = self._of(asked).alias("o"), wanted.withColumn("__new", F.lit(True)).alias("n")
        there, come = F.col(f"o.{self.key}").isNotNull(), F.coalesce(F.col("n.__new"), F.lit(False))
        differs = ~F.lit(True) if not guard else ~F.array_min(F.array(*[F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}").cast(types[c])) for c in guard]))
        take = come & (~there | differs)
        same = (F.col(f"o.{self.key}") == F.col(f"n.{self.key}")) & (F.col("o.part") == F.col("n.part"))

        def value(c: str) -> Column:
            if now is not None and c == "updated_at":
                return F.when(take, now).otherwise(F.col("o.updated_at"))
            if now is not None and c == "first_seen_at":
                return F.coalesce(F.col("o.first_seen_at"), now)
            new_value = F.col(f"n.{c}").cast(types[c]) if c in given else F.lit(None).cast(types[c])
            return F.col(f"o.{c}") if c in keep and c not in given else F.when(take, F.when(there & F.lit(c in keep), F.col(f"o.{c}")).otherwise(new_value)).otherwise(F.col(f"o.{c}"))

        both = o.join(n, same, "full_outer").withColumn("__take", take)
        changed = sorted(r.part for r in both.where("__take").select(F.coalesce("n.part", "o.part").alias("part")).distinct().collect())
        if not changed:
            return []
        columns = [value(c).alias(c) for c in stored.columns if c not in (self.key, "part")]
        part = F.coalesce("o.part", "n.part").alias("part")
        merged = both.where(F.coalesce("o.part", "n.part").isin(changed)).select(F.coalesce(f"o.{self.key}", f"n.{self.key}").alias(self.key), *columns, part)
        self._replace(merged, aside)
        return changed

    def delete(self, keys: DataFrame, aside: str | None = None) -> list[int]:
        """Rows of the ``keys`` (key) go; the ranges that were written."""
        gone = self._placed(keys.select(self.key).distinct())
        asked = sorted(r.part for r in gone.select("part").distinct().collect())
        hit = self._of(asked).join(gone, [self.key, "part"], "left_semi")
        changed = sorted(r.part for r in hit.select("part").distinct().collect())
        if changed:
            self._replace(self._of(changed).join(gone, [self.key, "part"], "left_anti"), aside, changed)
        return changed

    def _replace(self, rows: DataFrame, aside: str | None, parts: list[int] = []) -> None:
        """The ranges of ``rows`` are written aside and then over the old ones; of ``parts``, those without rows are emptied."""
        aside = aside or f"{self.path}/aside"
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(aside)
        ready = self.spark.read.schema(rows.schema).parquet(aside)
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/rows")
        jvm = self.spark.sparkContext._jvm
        left = {r.part for r in ready.select("part").distinct().collect()} if parts else set()
        for part in set(parts) - left:
            target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/part={part}")
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
