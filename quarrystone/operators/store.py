"""Append-only stores: insert if absent, drift, staged publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_rows(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """The incoming rows whose key is not stored yet, one for each key."""
    return incoming.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def drift(incoming: DataFrame, existing: DataFrame, key: list[str], immutable: list[str]) -> DataFrame:
    """Keys that are stored with other immutable values, and the columns that differ. Null-safe."""
    old = existing.select(*key, *[F.col(c).alias(f"old_{c}") for c in immutable])
    changed = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(c)) for c in immutable]), lambda x: x.isNotNull())
    return incoming.join(old, key).select(*key, changed.alias("changed")).where(F.size("changed") > 0)


def classified(incoming: DataFrame, existing: DataFrame, key: list[str], immutable: list[str]) -> DataFrame:
    """Every incoming row with outcome created, reused or drifted: one join."""
    old = existing.select(*key, F.lit(True).alias("_stored"), *[F.col(c).alias(f"old_{c}") for c in immutable])
    same = F.lit(True)
    for c in immutable:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    outcome = F.when(F.col("_stored").isNull(), "created").when(same, "reused").otherwise("drifted")
    return incoming.join(old, key, "left").select(*incoming.columns, outcome.alias("outcome"))


def append(incoming: DataFrame, path: str, key: list[str], immutable: list[str], dry_run: bool = False) -> DataFrame:
    """Validates all rows first; drift refuses the whole batch; then one append of what is new. Returns outcomes by count.

    Plain Parquet has no transactions: one writer at a time, and readers see the batch when its files are committed.
    """
    spark = incoming.sparkSession
    try:
        existing = spark.read.schema(incoming.schema).parquet(path)
        existing.limit(0).count()
    except Exception as why:  # the first batch finds no store
        if "PATH_NOT_FOUND" not in str(why):
            raise
        existing = spark.createDataFrame([], incoming.schema)
    plan = classified(incoming.dropDuplicates(key), existing, key, immutable)
    counts = {r["outcome"]: r["count"] for r in plan.groupBy("outcome").count().collect()}
    if counts.get("drifted"):
        raise ValueError(f"{counts['drifted']} stored rows have other immutable values; nothing was written")
    if not dry_run and counts.get("created"):
        plan.where("outcome = 'created'").select(*incoming.columns).write.mode("append").parquet(path)
    return spark.createDataFrame([(counts.get("created", 0), counts.get("reused", 0), not dry_run)], "created long, reused long, persisted boolean")


def is_replay(created: int, reused: int) -> bool:
    return created == 0 and reused > 0
