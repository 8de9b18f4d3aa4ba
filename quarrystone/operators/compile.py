"""Analysed workflows as knowledge items, their rules, and their records for the store.

An item holds structure and findings, never a parameter's content. Everything is aggregated by workflow, whose
size is bounded by the guard on its file.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from . import analyze as A
from .checks import violations
from .snapshots import Batch, Drift, Snapshots

SCHEMA_VERSION = "0.1"
MAX_LABEL, MAX_ITEM_BYTES = 256, 5 * 1024 * 1024
# Which learning scope each role has.
ROLE_SCOPES = {"REFERENCE": "structure_and_metadata", "STRUCTURE_ONLY": "structure_only", "QUARANTINED": "review_only", "SECURITY_EXAMPLE": "security_only"}


def label(value: Column) -> Column:
    """An untrusted label, at most MAX_LABEL characters."""
    return F.substring(F.coalesce(value, F.lit("")), 1, MAX_LABEL)


def safe_findings(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, severity, rule_id, node_name, node_type, json_path): evidence and messages never leave the analysis."""
    named = nodes.select("path", "n", F.col("name").alias("node_name"), F.col("type").alias("node_type"))
    return hits.select("path", "n", "severity", "rule_id", "json_path").join(named, ["path", "n"], "left").select("path", "severity", "rule_id", "node_name", "node_type", "json_path")


def _sorted_by_path(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def items(found: DataFrame, nodes: DataFrame, leaves: DataFrame, edges: DataFrame, hits: DataFrame, repo: str, commit: str) -> DataFrame:
    """One closed item for each file that parses; parts are sorted, so equal files give equal items."""
    reports = A.reports(found, nodes, hits).where("parse_error is null")
    told = A.admission(F.col("risk_decision"), F.col("max_severity"))
    records = nodes.select("path", label(F.col("type")).alias("type"), label(F.col("name")).alias("name_untrusted"), F.array_sort("credential_types").alias("credential_types"))
    links = edges.select("path", label(F.col("source")).alias("source_name_untrusted"), F.col("output").alias("source_output_index"), label(F.col("channel")).alias("channel"), label(F.col("target")).alias("target_name_untrusted"), F.col("input").alias("target_input_index"))
    owned = A.material(leaves).join(nodes.select("path", "n", label(F.col("name")).alias("node_name"), label(F.col("type")).alias("node_type")), ["path", "n"])
    parts = [
        _sorted_by_path(records, "nodes", "type", "name_untrusted", "credential_types"), _sorted_by_path(links, "edges", *[c for c in links.columns if c != "path"]),
        _sorted_by_path(safe_findings(hits, nodes), "security_findings", "severity", "rule_id", "node_name", "json_path", "node_type"),
        _sorted_by_path(owned.where("kind = 'text'"), "untrusted_text", "node_name", "json_path", "sha256", "node_type", "char_count", "preview"),
        _sorted_by_path(owned.where("kind = 'executable'"), "executable", "node_name", "json_path", "sha256", "node_type", "reason", "language", "char_count"),
    ]
    rows = reduce(lambda a, b: a.join(b, "path", "left"), parts, reports)
    lists = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in rows.dtypes if c in ("nodes", "edges", "security_findings", "untrusted_text", "executable")]
    return rows.withColumn("told", told).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("UNTRUSTED_SOURCE_DATA").alias("source_content_trust"), F.lit(repo).alias("source_repo"), F.lit(commit).alias("source_commit"),
        F.col("path").alias("source_path"), "sha256", F.coalesce("node_count", F.lit(0)).cast("long").alias("node_count"), F.coalesce("trigger_types", F.array().cast("array<string>")).alias("trigger_types"),
        F.array_sort(F.coalesce(F.map_keys("node_types"), F.array().cast("array<string>"))).alias("integrations"), *lists, "risk_decision", "max_severity",
        F.col("told.role").alias("knowledge_role"), F.col("told.learning_scope").alias("learning_scope"), F.col("told.structure_allowed").alias("structure_reference_allowed"),
        F.lit(False).alias("implementation_reference_allowed"), F.lit(False).alias("validated"),
    )


def item_rules() -> dict[str, Column]:
    """What every item must fulfil before it is stored, by name."""
    c = F.col
    pair = reduce(lambda a, b: a | b, [(c("knowledge_role") == r) & (c("learning_scope") == s) for r, s in ROLE_SCOPES.items()])
    path = c("source_path")
    return {
        "SCHEMA_VERSION": c("schema_version") == SCHEMA_VERSION, "CONTENT_TRUST": c("source_content_trust") == "UNTRUSTED_SOURCE_DATA",
        "SHA256": c("sha256").rlike(r"^[0-9a-f]{64}\z"), "COMMIT": c("source_commit").rlike(r"^[0-9a-f]{40}\z"),
        "PATH": (F.length(path).between(1, 1024)) & ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), ".."),
        "NODE_COUNT": c("node_count") == F.size("nodes"), "SEVERITY": c("max_severity").isin(*A.SEVERITIES), "ROLE_SCOPE": pair,
        "NO_IMPLEMENTATION": ~c("implementation_reference_allowed"), "NOT_VALIDATED": ~c("validated"),
        "STRUCTURE_ALLOWED": ~c("structure_reference_allowed") | c("knowledge_role").isin("REFERENCE", "STRUCTURE_ONLY"),
        "LABELS": ~F.exists("nodes", lambda x: (F.length(x["name_untrusted"]) > MAX_LABEL) | (F.length(x["type"]) > MAX_LABEL)),
        "DIGESTS": ~F.exists(F.concat(F.transform("untrusted_text", lambda x: x["sha256"]), F.transform("executable", lambda x: x["sha256"])), lambda x: ~x.rlike(r"^[0-9a-f]{64}\z")),
        "SIZE": F.octet_length(F.to_json(F.struct("nodes", "edges", "security_findings", "untrusted_text", "executable"))) <= MAX_ITEM_BYTES,
    }


def item_faults(rows: DataFrame) -> DataFrame:
    """(source_path, code) for each rule that an item breaks."""
    return violations(rows, "source_path", item_rules())


def records(rows: DataFrame, analyzer_version: str) -> dict[str, DataFrame]:
    """The three tables' rows of valid items; a row's key is the digest of its natural key, and each refers to the one before."""
    keyed = rows.withColumn("source_id", I.digest("source_repo", "source_commit", "source_path", "sha256"))
    keyed = keyed.withColumn("analyzer_version", F.lit(analyzer_version)).withColumn("analysis_id", I.digest("source_id", "analyzer_version"))
    keyed = keyed.withColumn("item_id", I.digest("analysis_id", "schema_version"))
    return {
        "sources": keyed.select("source_id", "source_repo", "source_commit", "source_path", "sha256"),
        "analyses": keyed.select("analysis_id", "source_id", "analyzer_version", "risk_decision", "max_severity", "security_findings"),
        "items": keyed.select("item_id", "analysis_id", "schema_version", "source_content_trust", "knowledge_role", "learning_scope", "node_count", "trigger_types", "integrations", "nodes", "edges", "untrusted_text", "executable", "structure_reference_allowed", "implementation_reference_allowed", "validated"),
    }


KEYS = {"sources": "source_id", "analyses": "analysis_id", "items": "item_id"}


def _batches(rows: DataFrame, analyzer_version: str) -> dict[str, Batch]:
    return {name: Batch(frame, [KEYS[name]]) for name, frame in records(rows, analyzer_version).items()}


def publish(rows: DataFrame, folder: str, analyzer_version: str, dry_run: bool = False) -> dict[str, tuple[int, int]]:
    """Publishes the three tables' new rows in one commit; any fault or drift refuses all of them. (created, reused) of each."""
    faults = item_faults(rows).limit(1).collect()
    if faults:
        raise ValueError(f"refused: {faults[0]['code']}")
    held, batches = Snapshots(rows.sparkSession, folder), _batches(rows, analyzer_version)
    if not dry_run:
        return {name: (told["created"], told["reused"]) for name, told in held.commit(batches).counts.items()}
    told = {(r["table"], r["outcome"]): r["n"] for r in held.plan(batches).collect()}
    if drifted := {name: told.get((name, "drifted"), 0) for name in batches if told.get((name, "drifted"))}:
        raise Drift(drifted)
    return {name: (told.get((name, "created"), 0), told.get((name, "reused"), 0)) for name in batches}


def ingested(rows: DataFrame, folder: str, analyzer_version: str, version: int | None = None) -> DataFrame:
    """A row for each item of a batch beside a snapshot: which of its three records the snapshot lacks, and whether any differs."""
    held, batches = Snapshots(rows.sparkSession, folder), _batches(rows, analyzer_version)
    manifest = held.manifest(version)
    keyed = records(rows, analyzer_version)
    told = {name: held.classified(name, b, manifest).select(KEYS[name], F.col("outcome").alias(name)) for name, b in batches.items()}
    named = keyed["items"].select("item_id", "analysis_id").join(keyed["analyses"].select("analysis_id", "source_id"), "analysis_id").join(keyed["sources"].select("source_id", "source_path", "sha256"), "source_id")
    for name, outcome in told.items():
        named = named.join(outcome, KEYS[name])
    made = [(F.col(name) == "created").alias(f"{name}_created") for name in KEYS]
    drifted = (F.col("sources") == "drifted") | (F.col("analyses") == "drifted") | (F.col("items") == "drifted")
    return named.select("source_path", "sha256", *made, drifted.alias("drifted"))


def corpus_gate(reports: DataFrame, required: list[str], column: Callable[[], Column] = lambda: F.explode("rules")) -> DataFrame:
    """(value) of the required rules that no report names: an empty result passes."""
    spark = reports.sparkSession
    named = reports.select(column().alias("value")).distinct()
    return spark.createDataFrame([(r,) for r in required], "value string").join(named, "value", "left_anti")


def most_common(rows: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """(value, n) of the most frequent values, ties by value."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)
