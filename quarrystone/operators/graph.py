"""Bounded expansion over claims as edges, and reads that assemble state and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """edges(src, dst), seeds(node) -> (node, depth) of the nodes reached in at most `depth` steps, without the seeds.

    One join for each step: the frontier is small beside the edges, so the edges are pruned by it, never scanned twice
    for a step; nodes seen before do not go on.
    """
    frontier = seeds.select("node").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        reached = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier = reached.join(seen, "node", "left_anti")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
    return seen.where("depth > 0")


def active_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions that are ACTIVE, name no successor and are named as predecessor by no other decision."""
    named = decisions.where("supersedes is not null").select(F.col("supersedes").alias("decision_id")).distinct()
    rows = decisions.where("status = 'ACTIVE'")
    rows = rows.where("superseded_by is null") if "superseded_by" in decisions.columns else rows
    return rows.join(named, "decision_id", "left_anti")


def supersession_faults(decisions: DataFrame) -> DataFrame:
    """(decision_id, code): a predecessor that is missing or still ACTIVE."""
    old = decisions.select(F.col("decision_id").alias("supersedes"), F.col("status").alias("old_status"))
    both = decisions.where("supersedes is not null").select("decision_id", "supersedes").join(old, "supersedes", "left")
    code = F.when(F.col("old_status").isNull(), "SUPERSEDES_BROKEN_REFERENCE").when(F.col("old_status") == "ACTIVE", "SUPERSEDED_DECISION_STILL_ACTIVE")
    return both.select("decision_id", code.alias("code")).where("code is not null")


def contradictions(claims: DataFrame) -> DataFrame:
    """Active claims that give one subject and predicate several values: counted in parts, so hot subjects do not gather."""
    return (
        claims.where("status = 'ACTIVE'").groupBy("subject_id", "predicate", "value").agg(F.count("*").alias("n"))
        .groupBy("subject_id", "predicate").agg(F.sum("n").alias("n_claims"), F.count("*").alias("n_values")).where("n_claims > 1 and n_values > 1")
    )


def version_conflicts(items: DataFrame) -> DataFrame:
    """items(node, version, status) -> a row for each conflict of a node: several versions, DEPRECATED beside other items."""
    rows = items.groupBy("node").agg(F.count_distinct("version").alias("n_versions"), F.count_if(F.col("status") == "DEPRECATED").alias("n_deprecated"), F.count("*").alias("n_items"))
    both = F.col("n_deprecated").between(1, F.col("n_items") - 1)
    kinds = F.array_compact(F.array(F.when(F.col("n_versions") > 1, "VERSION_CONFLICT"), F.when(both, "DEPRECATED_BESIDE_CURRENT")))
    return rows.withColumn("kind", F.explode(kinds))


def changed_since(since: Column, *stamps: str) -> Column:
    """Any of the time stamps is later than since; without a since everything has changed."""
    return F.when(since.isNull(), True).otherwise(F.coalesce(F.greatest(*[F.col(s) for s in stamps], F.lit(None).cast("timestamp")) > since, F.lit(False)))


def coverage(since: Column, earliest: Column) -> Column:
    """Does the record reach back to since?"""
    return F.when(earliest.isNull(), "NO_RECORD").when(since.isNull() | (earliest <= since), "COVERED").otherwise("PARTIAL_NO_RECORD_BEFORE")


def freshness(newest: Column, as_of: Column, days: int = 90) -> Column:
    return F.when(newest.isNull(), "UNKNOWN_FRESHNESS").when(as_of - newest > F.make_dt_interval(F.lit(days)), "STALE").otherwise("FRESH")


def late(occurred: Column, recorded: Column, days: int = 30) -> Column:
    """Whole days between an event and its record, where they are more than days; late records are noted, never dropped."""
    gap = F.floor((F.unix_micros(recorded) - F.unix_micros(occurred)) / 86_400_000_000).cast("long")
    return F.when(F.unix_micros(recorded) - F.unix_micros(occurred) > days * 86_400_000_000, gap)


def latest(journal: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key of an append-only journal: a maximum, not a sort."""
    rest = [c for c in journal.columns if c != key and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("r")
    return journal.groupBy(key).agg(best).select(key, *[F.col(f"r.{c}").alias(c) for c in (*order, *rest)])


def versions(sources: DataFrame, key: str, order: list[str]) -> DataFrame:
    """version 1, 2, ... of each logical key."""
    return sources.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def next_learning(hypotheses: DataFrame, unknowns: DataFrame) -> DataFrame:
    """One row: what the first open hypothesis by id states that states anything, else `resolve: ` and the unknown of the highest priority."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW"))), F.col("priority")), F.lit(0)), F.lit(9))
    h = hypotheses.where("next_best_learning <> ''").agg(F.min(F.struct("hypothesis_id", "next_best_learning")).alias("h"))
    u = unknowns.agg(F.min(F.struct(rank.alias("rank"), "unknown_id", "statement")).alias("u"))
    return h.join(u, F.lit(True)).select(F.coalesce("h.next_best_learning", F.concat(F.lit("resolve: "), F.col("u.statement"))).alias("next_best_learning"))
