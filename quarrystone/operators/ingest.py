"""Manifest-gated ingestion: plan, manifest rules, re-verification, report choice, sinks, profiles, SQL vocabularies."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.units import flatten, safe_relative
from .checks import violations

ITEM = "source_path string, sha256 string, risk_decision string, knowledge_role string, node_count int, untrusted_text_count int, finding_rules array<string>"
# Keys of a manifest and of its items, and what a manifest may hold.
MANIFEST_KEYS = ("manifest_version", "source_repo", "source_commit", "analyzer_version", "selection_profile", "items")
ALLOWED_RULES, MAX_ITEMS = ("NETWORK_REQUEST",), 4
# What gives a secret away in a profile, by path or by value.
PROFILE_SECRET = r"(?i)(api[_-]?key|token|password|passwd|secret|authorization|bearer\s+\S{8,}|eyJ[A-Za-z0-9_-]{10,}\.)"


def load_manifest(text: str) -> dict:
    """A manifest with exactly its keys, or ValueError that names a fault and echoes no value."""
    held = json.loads(text)
    if not isinstance(held, dict) or set(held) != set(MANIFEST_KEYS):
        raise ValueError("manifest keys")
    items = held["items"]
    if not isinstance(items, list) or not 1 <= len(items) <= MAX_ITEMS:
        raise ValueError("manifest item count")
    names = {c.split(" ")[0] for c in ITEM.split(", ")}
    if any(not isinstance(x, dict) or set(x) != names for x in items):
        raise ValueError("manifest item keys")
    return held


def manifest_faults(items: DataFrame) -> DataFrame:
    """(source_path, code) over the items of manifests: unsafe or repeated paths, rules out of order or not allowed, forms."""
    rules = {
        "UNSAFE_PATH": safe_relative(F.col("source_path")), "SHA256_FORMAT": F.col("sha256").rlike(r"^[0-9a-f]{64}\z"), "NODE_COUNT": F.col("node_count") >= 0,
        "RULES_SORTED_UNIQUE": F.col("finding_rules") == F.array_sort(F.array_distinct("finding_rules")), "RULES_ALLOWED": F.size(F.array_except("finding_rules", F.array(*map(F.lit, ALLOWED_RULES)))) == 0,
    }
    twice = items.groupBy("source_path").count().where("count > 1").select("source_path", F.lit("REPEATED_PATH").alias("code"))
    return violations(items, "source_path", rules).unionByName(twice)


def rebuilt_drift(manifest: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(source_path, column) where a rebuilt item is missing or differs from the reviewed one; null-safe."""
    columns = [c.split(" ")[0] for c in ITEM.split(", ")][1:]
    new = rebuilt.select("source_path", F.lit(True).alias("_found"), *[F.col(c).alias(f"new_{c}") for c in columns])
    both = manifest.join(new, "source_path", "left")
    changed = F.array(F.when(F.col("_found").isNull(), F.lit("missing")), *[F.when(F.col("_found") & ~F.col(c).eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in columns])
    return both.select("source_path", F.explode(F.filter(changed, lambda c: c.isNotNull())).alias("column"))


def _normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^(\\./)+", "")


def matching_reports(reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(path) -> the reports whose path is it or ends with it, with how many match; exactly one is right.

    Suffixes of each report's path make it an equi-join: no comparison of every pair.
    """
    parts = F.split(_normal_path(F.col("source_path")), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "/"))
    found = reports.withColumn("path", F.explode(F.array_distinct(suffixes)))
    rows = wanted.select(_normal_path(F.col("path")).alias("path")).distinct()
    counts = rows.join(found.select("path", "source_path"), "path", "left").groupBy("path").agg(F.count("source_path").alias("n_matches"), F.min("source_path").alias("source_path"))
    return counts.withColumn("source_path", F.when(F.col("n_matches") == 1, F.col("source_path")))


def has_credentials(credential_types: Column) -> Column:
    """Any node with credentials; malformed nodes count as having some."""
    return F.coalesce(F.exists(credential_types, lambda c: F.size(c) > 0), F.lit(True))


def controlled_structure(item: dict[str, Column]) -> Column:
    """May an item's structure be taken in: only allowed findings, no executable parts, nodes, no credentials."""
    rules = F.forall(item["rules"], lambda r: r.isin(*ALLOWED_RULES))
    return F.coalesce(rules & (item["n_executable"] == 0) & (item["node_count"] > 0) & ~has_credentials(item["credential_types"]), F.lit(False))


def write_reports(reports: DataFrame, summary: DataFrame, folder: str) -> None:
    """Two JSON-lines folders, published when both are written."""
    reports.write.mode("errorifexists").json(f"{folder}/reports")
    summary.write.mode("errorifexists").json(f"{folder}/summary")


def canonical_json(row: Column) -> Column:
    """A struct as JSON; its fields are sorted by whoever builds it, null fields are left out."""
    return F.to_json(row)


def sorted_struct(names: list[str]) -> Column:
    return F.struct(*sorted(names))


def profile_faults(text: str) -> list[str]:
    """Paths of a profile whose name or value looks like a secret; a profile with any is refused."""
    pattern = re.compile(PROFILE_SECRET)
    return sorted({p for p, kind, v in flatten(text, keys=True) if pattern.search(p if kind == "key" else v)})


def sanitised_url(url: Column) -> Column:
    """Scheme, host and port only."""
    return F.regexp_extract(F.regexp_replace(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1"), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def sql_vocabularies(scripts: DataFrame) -> DataFrame:
    """scripts(path, text) -> the last `check (column in (...))` of each column over scripts in path order: (column, values)."""
    found = F.regexp_extract_all("text", F.lit(r"(?is)check\s*\(\s*([a-z_]+\s+in\s*\([^)]*\))"), F.lit(1))
    rows = scripts.select("path", F.posexplode(found).alias("pos", "held"))
    column = F.lower(F.regexp_extract("held", r"(?i)^([a-z_]+)\s+in", 1))
    values = F.array_sort(F.regexp_extract_all("held", F.lit("'([^']*)'"), F.lit(1)))
    return rows.select(column.alias("column"), values.alias("values"), "path", "pos").groupBy("column").agg(F.max_by("values", F.struct("path", "pos")).alias("values"))


def capabilities(spark: SparkSession, table: DataFrame, columns: list[str], functions: list[str]) -> DataFrame:
    """(name, kind, present) of columns and functions that a plan may choose by."""
    rows = [(c, "column", c in table.columns) for c in columns] + [(f, "function", spark.catalog.functionExists(f)) for f in functions]
    return spark.createDataFrame(rows, "name string, kind string, present boolean")


def fail_closed(rows: DataFrame, scope: str) -> DataFrame:
    """A store without scopes answers nobody but the global scope."""
    return rows if {"scope_type", "scope_id"} <= set(rows.columns) or scope.startswith("GLOBAL") else rows.limit(0)


def preview(text: Column) -> Column:
    return T.redacted(text, 240, newlines=True)
