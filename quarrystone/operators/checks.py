"""Validators, audits and gates as relational queries that return violation rows (code, id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Knowledge statuses, and what none of them may silently become.
STATUSES = ("OBSERVED", "DECLARED", "MEASURED", "INFERRED", "HYPOTHESIS", "ESTIMATED", "UNKNOWN", "CONFLICTING", "INVALIDATED")
FORBIDDEN_PROMOTIONS = {
    "INFERRED": ("MEASURED", "OBSERVED"),
    "DECLARED": ("OBSERVED", "MEASURED"),
    "HYPOTHESIS": ("OBSERVED", "MEASURED", "DECLARED"),
    "ESTIMATED": ("MEASURED", "OBSERVED"),
    "UNKNOWN": ("OBSERVED", "MEASURED", "DECLARED", "INFERRED", "ESTIMATED"),
}
NEED_PROVENANCE = ("OBSERVED", "MEASURED")
# The seven preconditions in their order.
PRECONDITIONS = (
    "deterministic_validation", "validate_workflow", "static_analyzer", "side_effect_classification",
    "prepare_workflow_pin_data", "pin_data_inspected", "privileged_nodes_pinned",
)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code) for each named predicate that a row breaks; a null predicate counts as broken. One pass for all rules."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]), lambda c: c.isNotNull())
    return rows.select(key, F.explode(broken).alias("code"))


def assert_empty(rows: DataFrame, what: str) -> None:
    first = rows.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")


def stored_item_rules() -> dict[str, Column]:
    """The constraints of stored analyses, by name."""
    c = F.col
    roles = F.struct("knowledge_role", "learning_scope")
    legal = [("REFERENCE", "structure_and_metadata"), ("STRUCTURE_ONLY", "structure_only"), ("QUARANTINED", "review_only"), ("SECURITY_EXAMPLE", "security_only")]
    pair = reduce(lambda a, b: a | b, [(c("knowledge_role") == r) & (c("learning_scope") == s) for r, s in legal])
    return {
        "sha256_format": c("sha256").rlike(r"^[0-9a-f]{64}\z"), "commit_format": c("source_commit").rlike(r"^[0-9a-f]{40}\z"),
        "path_length": F.length("source_path").between(1, 1024), "decision_known": c("risk_decision").isin("SAFE_FOR_LEARNING", "REVIEW_REQUIRED", "BLOCKED"),
        "severity_known": c("max_severity").isin("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"), "role_scope_pair": pair & roles.isNotNull(),
        "no_implementation": ~c("implementation_reference_allowed"), "node_count": c("node_count") >= 0,
    }


def provenance_missing(claims: DataFrame) -> DataFrame:
    """Claims whose status needs provenance and that have none, nor a source."""
    some = F.exists("provenance", lambda p: p["source_id"].isNotNull()) | (F.size("source_ids") > 0)
    return claims.where(F.col("epistemic_status").isin(*NEED_PROVENANCE)).where(~F.coalesce(some, F.lit(False))).select(F.col("claim_id").alias("id"), F.lit("EPISTEMIC_PROVENANCE_REQUIRED").alias("code"))


def promotion(before: Column, after: Column) -> Column:
    """NEW, UNCHANGED, ALLOWED or FORBIDDEN; a new object promotes nothing."""
    bad = reduce(lambda a, b: a | b, [(before == k) & after.isin(*v) for k, v in FORBIDDEN_PROMOTIONS.items()])
    return F.when(before.isNull(), "NEW").when(before == after, "UNCHANGED").when(bad, "FORBIDDEN").otherwise("ALLOWED")


def missing_references(rows: DataFrame, key: str, reference: str, known: DataFrame, code: str) -> DataFrame:
    """Rows that refer to something unknown: an anti join."""
    return rows.where(F.col(reference).isNotNull()).join(known.select(F.col(known.columns[0]).alias(reference)).distinct(), reference, "left_anti").select(F.col(key).alias("id"), F.col(reference).cast("string").alias("detail"), F.lit(code).alias("code"))


def cross_scope(rows: DataFrame, key: str, reference: str, entities: DataFrame) -> DataFrame:
    """rows(scope_type, scope_id, ref) whose entity is neither global, nor of the row's scope, or is missing."""
    named = entities.select(F.col("entity_id").alias(reference), F.col("scope_type").alias("e_type"), F.col("scope_id").alias("e_id"))
    both = rows.join(named, reference, "left")
    same = (F.col("scope_type") == F.col("e_type")) & (F.col("scope_id") == F.col("e_id"))
    code = F.when(F.col("e_type").isNull(), "MISSING_ENTITY").when(~(same | (F.col("e_type") == "GLOBAL") | (F.col("scope_type") == "GLOBAL")), "CROSS_SCOPE_REFERENCE")
    return both.select(F.col(key).alias("id"), code.alias("code")).where("code is not null")


def secret_references(rows: DataFrame, key: str, references: str, levels: DataFrame) -> DataFrame:
    """Rows that are not secret and name something secret: levels(ref, level)."""
    named = rows.where("coalesce(level, 'INTERNAL') <> 'SECRET'").select(F.col(key).alias("id"), F.explode(references).alias("ref"))
    return named.join(levels.where("level = 'SECRET'").select("ref"), "ref", "left_semi").select("id", "ref").distinct()


def crossing(own_type: Column, own_id: Column, its_type: Column, its_id: Column) -> Column:
    """The code of a reference into another scope that is not global, or null; from client to client it is worse."""
    other = (own_type != its_type) | (own_id != its_id)
    return F.when(other & (its_type != "GLOBAL"), F.when((own_type == "CLIENT") & (its_type == "CLIENT"), "CROSS_CLIENT_REFERENCE").otherwise("CROSS_SCOPE_REFERENCE"))


def evidence_faults(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, code): support that is missing, of another scope, or too general to ground an observation."""
    named = claims.select("claim_id", "epistemic_status", F.col("scope_type").alias("c_type"), F.col("scope_id").alias("c_scope"), F.explode("supporting_evidence_ids").alias("evidence_id"))
    both = named.join(evidence.select("evidence_id", F.col("scope_type").alias("e_type"), F.col("scope_id").alias("e_scope"), "evidence_type", F.col("subject_entity_id").alias("e_subject"), F.lit(True).alias("known")), "evidence_id", "left")
    observed = F.col("epistemic_status").isin(*NEED_PROVENANCE)
    codes = F.array(
        F.when(F.col("known").isNull(), F.lit("CLAIM_BROKEN_EVIDENCE_REFERENCE")),
        F.when(F.col("known"), crossing(F.col("c_type"), F.col("c_scope"), F.col("e_type"), F.col("e_scope"))),
        F.when(F.col("known") & observed & (F.col("evidence_type") == "PUBLIC_RESEARCH"), F.lit("PUBLIC_RESEARCH_CANNOT_GROUND_OBSERVATION")),
        F.when(F.col("known") & observed & (F.col("e_type") == "GLOBAL") & (F.col("c_type") != "GLOBAL") & (F.coalesce("e_subject", F.lit("")) == ""), F.lit("GENERIC_EVIDENCE_CANNOT_GROUND_ENTITY_OBSERVATION")),
    )
    return both.select("claim_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code")).distinct()


def pack_faults(packs: DataFrame, objects: DataFrame) -> DataFrame:
    """packs(pack_id, scope_type, scope_id, refs, provenance_ids) against objects(object_id, level, scope_type, scope_id, asserts)."""
    refs = packs.select("pack_id", "scope_type", F.col("scope_id").alias("p_scope"), "provenance_ids", F.explode("refs").alias("object_id"))
    both = refs.join(objects.select("object_id", "level", F.col("scope_type").alias("o_type"), F.col("scope_id").alias("o_scope"), "asserts"), "object_id")
    codes = F.array(
        F.when(F.col("level") == "SECRET", F.lit("SECRET_IN_CONTEXT_PACK")),
        F.when(F.col("scope_type").isNotNull(), crossing(F.col("scope_type"), F.col("p_scope"), F.col("o_type"), F.col("o_scope"))),
        F.when(F.col("asserts") & ~F.coalesce(F.array_contains("provenance_ids", F.col("object_id")), F.lit(False)), F.lit("CONTEXT_PACK_MISSING_PROVENANCE")),
    )
    found = both.select("pack_id", "object_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
    unscoped = packs.where("scope_type is null or scope_id is null").select("pack_id", F.lit(None).cast("string").alias("object_id"), F.lit("PACK_SCOPE_MISSING").alias("code"))
    return found.withColumn("object_id", F.col("object_id").cast("string")).unionByName(unscoped)


def projection_faults(projections: DataFrame, decisions: DataFrame) -> DataFrame:
    """projections(id, active_decision_ids) against decisions(decision_id, status): (id, decision_id, code) of ids that are unknown or not ACTIVE."""
    named = projections.select("id", F.explode("active_decision_ids").alias("decision_id"))
    both = named.join(decisions.select("decision_id", "status", F.lit(True).alias("known")), "decision_id", "left")
    code = F.when(F.col("known").isNull(), "PROJECTION_BROKEN_DECISION_REFERENCE").when(~F.col("status").eqNullSafe("ACTIVE"), "SUPERSEDED_DECISION_PRESENTED_AS_ACTIVE")
    return both.select("id", "decision_id", code.alias("code")).where("code is not null")


def provenance_faults(packs: DataFrame) -> DataFrame:
    """packs(pack_id, claim_ids, evidence_ids, provenance map<object_id, array<source_id>>): assertions without an entry, entries without a source."""
    none = F.array().cast("array<string>")
    asserted = packs.select("pack_id", F.explode(F.array_except(F.array_union(F.coalesce("claim_ids", none), F.coalesce("evidence_ids", none)), F.coalesce(F.map_keys("provenance"), none))).alias("object_id"), F.lit("CONTEXT_PACK_MISSING_PROVENANCE").alias("code"))
    entries = packs.select("pack_id", F.explode("provenance").alias("object_id", "sources"))
    named = F.coalesce(F.size(F.filter("sources", lambda x: x.isNotNull() & (x != ""))) > 0, F.lit(False))
    return asserted.unionByName(entries.where(~named).select("pack_id", "object_id", F.lit("CONTEXT_PACK_EMPTY_PROVENANCE_ENTRY").alias("code")))


def stored_promotions(claims: DataFrame) -> DataFrame:
    """claims(claim_id, supersedes, epistemic_status): (claim_id, code) where the one that is replaced is missing or its status forbids the new one."""
    old = claims.select(F.col("claim_id").alias("supersedes"), F.col("epistemic_status").alias("before"), F.lit(True).alias("known"))
    both = claims.where("supersedes is not null").select("claim_id", "supersedes", "epistemic_status").join(old, "supersedes", "left")
    code = F.when(F.col("known").isNull(), "SUPERSEDES_MISSING_CLAIM").when(promotion(F.col("before"), F.col("epistemic_status")) == "FORBIDDEN", "FORBIDDEN_PROMOTION")
    return both.select("claim_id", code.alias("code")).where("code is not null")


#: Columns of a pack that name objects.
REFERENCES = ("entity_ids", "state_projection_ids", "decision_ids", "claim_ids", "evidence_ids", "hypothesis_ids", "unknown_ids", "event_ids")


def referenced_ids(packs: DataFrame, key: str = "context_pack_id") -> DataFrame:
    """(key, object_id) of every object that a pack names, once."""
    none = F.array().cast("array<string>")
    return packs.select(key, F.explode(F.array_distinct(F.concat(*[F.coalesce(c, none) for c in REFERENCES if c in packs.columns]))).alias("object_id"))


# Phases of a run in their order, and how often it may be tried before a person is needed.
PHASES, MAX_ATTEMPTS = ("PLANNING", "DRAFT", "VALIDATING", "AWAITING_APPROVAL", "TESTING", "DEBUGGING", "PASSED", "BLOCKED", "ABORTED"), 4


def run_faults(journal: DataFrame) -> DataFrame:
    """journal(run_id, phase, attempts, environment, scope_type, scope_id): (run_id, code) of rows that the journal refuses."""
    rules = {
        "PHASE": F.col("phase").isin(*PHASES), "ATTEMPTS": F.col("attempts").between(0, MAX_ATTEMPTS),
        "NO_PRODUCTION_MUTATION": F.col("environment") != "PRODUCTION", "SCOPE_SHAPE": (F.col("scope_type") == "GLOBAL") == (F.col("scope_id") == "GLOBAL"),
    }
    return violations(journal, "run_id", rules)


def two_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of what only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def tool_audit(tools: DataFrame, permissions: DataFrame) -> DataFrame:
    """tools(tool, writes), permissions(tool, bucket): unlisted tools, writers that are allowed, tools in several buckets, dead rules."""
    held = permissions.groupBy("tool").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    both = tools.join(held, "tool", "full_outer")
    codes = F.array(
        F.when(F.col("writes").isNull(), F.lit("DEAD_RULE")), F.when(F.col("buckets").isNull(), F.lit("UNCLASSIFIED")),
        F.when(F.size("buckets") > 1, F.lit("SEVERAL_BUCKETS")), F.when(F.col("writes") & F.array_contains("buckets", "allow"), F.lit("WRITER_ALLOWED")),
    )
    return both.select("tool", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def first_failure(*checks: tuple[str, Column]) -> Column:
    """The first precondition that does not hold, or null; null evidence does not hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks], F.lit(None).cast("string"))


def test_gate(evidence: DataFrame) -> DataFrame:
    """evidence(run_id, validated, workflow_valid, risk_decision, n_nodes, n_classified, verdict, pins_prepared, pinned, needing) -> decision and first failure."""
    c = F.col
    checks = [
        c("validated"), c("workflow_valid"), c("risk_decision") == "SAFE_FOR_LEARNING",
        (c("n_classified") > 0) & (c("n_nodes").isNull() | (c("n_nodes") == c("n_classified"))) & (c("verdict") == "ALLOWED"),
        c("pins_prepared"), c("pinned").isNotNull(), F.size(F.array_except("needing", "pinned")) == 0,
    ]
    failed = first_failure(*zip(PRECONDITIONS, checks, strict=True))
    return evidence.select("run_id", F.when(failed.isNull(), "PROCEED").otherwise("REFUSE").alias("decision"), failed.alias("failed"))


def credential_anomalies(bindings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Bindings (workflow, node, credential) that no allowlist names."""
    return bindings.join(F.broadcast(allowed.select("credential")), "credential", "left_anti").withColumn("code", F.lit("ANOMALY"))


def vocabulary_state(stored: DataFrame, old: tuple[str, ...], new: tuple[str, ...]) -> str:
    """LEGACY_EXACT, V1_EXACT, MISSING or DRIFT for a stored vocabulary (value); decided before anything is appended."""
    held = {r[0] for r in stored.select("value").distinct().limit(len(old) + len(new) + 1).collect()}
    return "MISSING" if not held else "V1_EXACT" if held == set(new) else "LEGACY_EXACT" if held == set(old) else "DRIFT"


def doctor(found: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Checks (name, severity FAIL or WARN, violations) -> (check, status, n): one row each."""
    rows = [v.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.when(F.col("n") > 0, severity).otherwise("OK").alias("status"), "n") for name, severity, v in found]
    return reduce(DataFrame.unionByName, rows)


def overall(status: Column) -> Column:
    """Aggregate: BLOCKED over LIMITS over READY."""
    rank = F.max(F.when(status == "FAIL", 2).when(status == "WARN", 1).otherwise(0))
    return F.when(rank == 2, "BLOCKED").when(rank == 1, "LIMITS").otherwise("READY")


def relation(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant relation."""
    return spark.createDataFrame(rows, schema)


#: What an id is made of; a serialised pack is taken apart at everything else.
ID_TOKEN = "[A-Za-z0-9][A-Za-z0-9_-]*"


def leaked_ids(packs: DataFrame, objects: DataFrame, pack: str = "pack_id", text: str = "text") -> DataFrame:
    """packs(pack_id, scope_type, scope_id, text), objects(object_id, scope_type, scope_id) -> (pack_id, object_id): ids in a pack's text that its scope may not see.

    The text is taken apart into the words that ids are, each once for a pack, and joined with the ids: as many rows as
    packs have words, never packs times ids. An id that several objects have leaks if none of them may be seen. Ids of
    other characters are found by no word.
    """
    words = packs.select(pack, "scope_type", "scope_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(ID_TOKEN), F.lit(0)))).alias("object_id"))
    held = objects.select("object_id", F.col("scope_type").alias("of_type"), F.col("scope_id").alias("of_id"))
    seen = F.coalesce((F.col("of_type") == "GLOBAL") | ((F.col("of_type") == F.col("scope_type")) & (F.col("of_id") == F.col("scope_id"))), F.lit(False))
    both = words.join(held, "object_id").groupBy(pack, "object_id").agg(F.bool_or(seen).alias("seen"))
    return both.where("not seen").select(pack, "object_id")
