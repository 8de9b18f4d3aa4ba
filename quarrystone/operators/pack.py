"""Context packs: token estimates, budget fitting, authority, citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import strength_rank

# What is dropped, in this order; authorities from the strongest.
DROP_ORDER = ("VERBOSE_SUMMARY", "LOW_RELEVANCE_ARTIFACTS", "OLDER_EVENTS", "WEAKER_EVIDENCE", "SECONDARY_PROCEDURAL_REFS")
AUTHORITIES = ("ENVIRONMENT_FACT", "MEASURED_OWN_EXECUTION", "VALIDATED_PATTERN", "HUMAN_APPROVED_CORRECTION", "OFFICIAL_DOCS", "EXTERNAL_WORKFLOW_ANALYZED", "TUTORIAL", "COMMUNITY", "MODEL_INFERENCE")


def text_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def list_tokens(texts: Column) -> Column:
    """2 for the list and the tokens of its texts."""
    return F.coalesce(F.aggregate(texts, F.lit(2).cast("long"), lambda n, t: n + text_tokens(t)), F.lit(0).cast("long"))


def struct_tokens(**fields: Column) -> Column:
    """2 for the object, its keys and the given sizes of its values."""
    return reduce(lambda a, b: a + b, [F.lit(-(-len(k) // 4)) + v for k, v in fields.items()], F.lit(2).cast("long"))


def fitted(sizes: Column, budget: Column) -> Column:
    """struct<step, size, minimum>: sizes after 0, 1, ... drop steps; a step that does not shrink is taken back; the first that fits is chosen."""
    running = F.aggregate(sizes, F.array().cast("array<bigint>"), lambda a, s: F.concat(a, F.array(F.when(F.size(a) == 0, s).otherwise(F.least(s, F.element_at(a, -1))))))
    first = F.array_position(F.transform(running, lambda s: s <= budget), True)
    return F.struct(F.when(first > 0, first.cast("int") - 1).alias("step"), F.when(first > 0, F.get(running, first.cast("int") - 1)).alias("size"), F.array_min(running).alias("minimum"))


def strongest_quarter(evidence: DataFrame, pack: str = "pack_id") -> DataFrame:
    """For each pack the strongest quarter of its evidence, one at least."""
    order = Window.partitionBy(pack).orderBy(strength_rank(F.col("strength")), "evidence_id")
    rows = evidence.withColumns({"n": F.row_number().over(order), "total": F.count("*").over(Window.partitionBy(pack))})
    return rows.where(F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("total") / 4))).drop("n", "total")


def authority(status: Column, kind: Column) -> Column:
    return (
        F.when(status == "MEASURED", "MEASURED_OWN_EXECUTION").when(kind.isin("PATTERN", "CHECKLIST") & (status == "OBSERVED"), "VALIDATED_PATTERN")
        .when(kind.isin("FIX", "ANTI_PATTERN", "WARNING"), "HUMAN_APPROVED_CORRECTION").when(status == "DECLARED", "TUTORIAL")
        .when(status.isin("INFERRED", "HYPOTHESIS", "ESTIMATED"), "MODEL_INFERENCE").otherwise("COMMUNITY")
    )


def ordered(items: DataFrame, limit: int = 12) -> DataFrame:
    """items(authority, relevance, id): by authority, relevance down, id; the rest is counted in n_omitted."""
    rank = F.array_position(F.array(*map(F.lit, AUTHORITIES)), F.col("authority"))
    total = items.agg(F.count("*").alias("total"))
    top = items.orderBy(rank, F.desc("relevance"), "id").limit(limit)
    return top.join(F.broadcast(total), F.lit(True)).withColumn("n_omitted", F.greatest(F.col("total") - limit, F.lit(0))).drop("total")


def citation(source: Column, locator: Column) -> Column:
    """source#key=value;... with keys sorted."""
    entries = F.array_sort(F.map_entries(locator))
    return F.concat(source, F.when(F.size(entries) > 0, F.concat(F.lit("#"), F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";"))).otherwise(""))
