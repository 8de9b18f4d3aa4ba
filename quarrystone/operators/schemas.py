"""The twelve object types as closed schemas, and the vocabularies that their columns keep to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import STATUSES, violations
from .scope import SCOPE_TYPES, TIERS, valid_scope

_SCOPE = "scope_type string, scope_id string"
_PROVENANCE = "array<struct<source_id:string,fragment_id:string,locator:map<string,string>,observed_at:timestamp,captured_at:timestamp,content_hash:string>>"
_COMMON = "contract_version string, object_type string"
#: Names, columns and kinds of the objects; open values keep their JSON text.
SCHEMAS = {
    "entity": f"entity_id string, entity_type string, canonical_name string, aliases array<string>, {_SCOPE}, level string, data_classes array<string>, status string, created_at timestamp, last_updated_at timestamp, {_COMMON}",
    "source": f"source_id string, source_type string, title string, origin string, created_at timestamp, captured_at timestamp, ingested_at timestamp, {_SCOPE}, level string, data_classes array<string>, trust_class string, instruction_authority string, content_hash string, status string, metadata string, {_COMMON}",
    "fragment": f"fragment_id string, source_id string, fragment_type string, content string, content_hash string, created_at timestamp, provenance {_PROVENANCE}, {_COMMON}",
    "claim": f"claim_id string, subject_entity_id string, predicate string, object_value string, object_entity_id string, epistemic_status string, verification_state string, {_SCOPE}, level string, data_classes array<string>, source_ids array<string>, provenance {_PROVENANCE}, supporting_evidence_ids array<string>, counter_evidence_ids array<string>, valid_from timestamp, valid_until timestamp, supersedes string, superseded_by string, status string, created_at timestamp, last_updated_at timestamp, {_COMMON}",
    "evidence": f"evidence_id string, source_id string, fragment_ids array<string>, {_SCOPE}, subject_entity_id string, evidence_type string, direction string, strength string, epistemic_status string, verification_state string, level string, data_classes array<string>, provenance {_PROVENANCE}, observed_at timestamp, created_at timestamp, {_COMMON}",
    "hypothesis": f"hypothesis_id string, {_SCOPE}, statement string, status string, supporting_evidence_ids array<string>, counter_evidence_ids array<string>, falsification_criteria string, next_best_learning string, created_at timestamp, last_updated_at timestamp, {_COMMON}",
    "unknown": f"unknown_id string, {_SCOPE}, statement string, priority string, status string, related_hypothesis_ids array<string>, related_question_ids array<string>, created_at timestamp, last_updated_at timestamp, {_COMMON}",
    "decision": f"decision_id string, {_SCOPE}, title string, decision string, rationale string, status string, effective_from timestamp, effective_until timestamp, supersedes string, superseded_by string, source_ids array<string>, created_at timestamp, approved_by string, {_COMMON}",
    "candidate": f"candidate_id string, candidate_type string, payload string, {_SCOPE}, source_ids array<string>, provenance {_PROVENANCE}, created_by string, created_at timestamp, status string, proposed_epistemic_status string, reason string, {_COMMON}",
    "event": f"event_id string, event_type string, {_SCOPE}, occurred_at timestamp, recorded_at timestamp, actor string, source_ids array<string>, agent_run_id string, metadata string, {_COMMON}",
    "state_projection": f"state_projection_id string, {_SCOPE}, as_of timestamp, summary string, active_decision_ids array<string>, claim_ids array<string>, open_hypothesis_ids array<string>, open_unknown_ids array<string>, conflicts array<string>, next_best_learning string, derived_from_ids array<string>, freshness_status string, {_COMMON}",
    "context_pack": f"context_pack_id string, version int, objective string, mode string, {_SCOPE}, entity_ids array<string>, state_projection_ids array<string>, claim_ids array<string>, evidence_ids array<string>, decision_ids array<string>, hypothesis_ids array<string>, unknown_ids array<string>, event_ids array<string>, generated_at timestamp, gaps array<string>, constraints array<string>, procedural_refs array<string>, token_budget int, level string, data_classes array<string>, provenance_summary array<string>, freshness_status string, {_COMMON}",
}
OWN_ID = {"entity": "entity_id", "source": "source_id", "fragment": "fragment_id", "claim": "claim_id", "evidence": "evidence_id", "hypothesis": "hypothesis_id", "unknown": "unknown_id", "decision": "decision_id", "candidate": "candidate_id", "event": "event_id", "state_projection": "state_projection_id", "context_pack": "context_pack_id"}
# Vocabularies by object and column.
VOCABULARIES = {
    ("entity", "entity_type"): ("COMPANY", "PERSON", "PROJECT", "VERTICAL", "PRODUCT", "PROCESS", "SYSTEM", "OFFER", "CLIENT", "PROSPECT", "INTERNAL_UNIT"),
    ("entity", "status"): ("ACTIVE", "INACTIVE", "MERGED", "ARCHIVED"),
    ("source", "source_type"): ("DOCUMENT", "MESSAGE", "TRANSCRIPT", "WEB_PAGE", "REPOSITORY", "WORKFLOW", "DATASET", "MEDIA", "HUMAN_STATEMENT", "SYSTEM_RECORD"),
    ("source", "status"): ("ACTIVE", "SUPERSEDED", "WITHDRAWN", "QUARANTINED"),
    ("source", "trust_class"): ("FIRST_PARTY", "CLIENT_PROVIDED", "THIRD_PARTY", "PUBLIC", "UNTRUSTED"),
    ("source", "instruction_authority"): ("NONE", "REFERENCE", "POLICY"),
    ("fragment", "fragment_type"): ("TEXT", "MESSAGE", "TRANSCRIPT_INTERVAL", "PAGE", "FRAME", "OCR_BLOCK", "TABLE", "CODE"),
    ("claim", "status"): ("ACTIVE", "SUPERSEDED", "RETRACTED", "DISPUTED"),
    ("claim", "epistemic_status"): STATUSES,
    ("claim", "verification_state"): ("UNREVIEWED", "REVIEWED", "APPROVED", "REJECTED", "SUPERSEDED"),
    ("evidence", "evidence_type"): ("DIRECT_STATEMENT", "MEASUREMENT", "ARTIFACT", "OBSERVATION", "PUBLIC_RESEARCH", "DERIVED_ANALYSIS"),
    ("evidence", "epistemic_status"): STATUSES,
    ("evidence", "verification_state"): ("UNREVIEWED", "REVIEWED", "APPROVED", "REJECTED", "SUPERSEDED"),
    ("evidence", "direction"): ("SUPPORTS", "CONTRADICTS", "NEUTRAL"),
    ("evidence", "strength"): ("WEAK", "MODERATE", "STRONG"),
    ("hypothesis", "status"): ("OPEN", "PARTIALLY_SUPPORTED", "CONFLICTING", "INVALIDATED", "SUPPORTED", "ARCHIVED"),
    ("unknown", "status"): ("OPEN", "PARTIALLY_RESOLVED", "RESOLVED", "NO_LONGER_RELEVANT"),
    ("unknown", "priority"): ("LOW", "MEDIUM", "HIGH", "CRITICAL"),
    ("decision", "status"): ("DRAFT", "ACTIVE", "SUPERSEDED", "REVOKED"),
    ("candidate", "candidate_type"): ("CLAIM", "ENTITY", "EVIDENCE", "HYPOTHESIS", "UNKNOWN", "RELATION"),
    ("candidate", "status"): ("PENDING", "APPROVED", "REJECTED", "MERGED", "CONFLICTING"),
    ("candidate", "proposed_epistemic_status"): STATUSES,
    ("event", "event_type"): ("INGESTION", "REVIEW", "DECISION_MADE", "AGENT_RUN", "BUILD", "OUTCOME_OBSERVED", "CORRECTION"),
    ("state_projection", "freshness_status"): ("FRESH", "STALE", "UNKNOWN_FRESHNESS"),
    ("context_pack", "mode"): ("OPERATIONAL", "RESEARCH", "BUILD", "AUDIT", "STRATEGY"),
}
#: Statuses of hypotheses that must say what to learn next.
NEED_NEXT_LEARNING = ("OPEN", "CONFLICTING")
# Columns that every object of a type has, beside contract_version and object_type.
REQUIRED = {
    "entity": ("entity_id", "entity_type", "canonical_name", "aliases", "scope_type", "scope_id", "status", "created_at", "last_updated_at"),
    "source": ("source_id", "source_type", "title", "origin", "captured_at", "ingested_at", "scope_type", "scope_id", "level", "data_classes", "trust_class", "instruction_authority", "status", "metadata"),
    "fragment": ("fragment_id", "source_id", "fragment_type", "content", "content_hash", "created_at", "provenance"),
    "claim": ("claim_id", "subject_entity_id", "predicate", "epistemic_status", "scope_type", "scope_id", "source_ids", "supporting_evidence_ids", "counter_evidence_ids", "status", "created_at", "last_updated_at"),
    "evidence": ("evidence_id", "source_id", "fragment_ids", "scope_type", "scope_id", "evidence_type", "direction", "strength", "epistemic_status", "created_at"),
    "hypothesis": ("hypothesis_id", "scope_type", "scope_id", "statement", "status", "supporting_evidence_ids", "counter_evidence_ids", "falsification_criteria", "created_at", "last_updated_at"),
    "unknown": ("unknown_id", "scope_type", "scope_id", "statement", "priority", "status", "related_hypothesis_ids", "related_question_ids", "created_at", "last_updated_at"),
    "decision": ("decision_id", "scope_type", "scope_id", "title", "decision", "status", "effective_from", "source_ids", "created_at"),
    "candidate": ("candidate_id", "candidate_type", "payload", "scope_type", "scope_id", "source_ids", "created_by", "created_at", "status", "proposed_epistemic_status"),
    "event": ("event_id", "event_type", "scope_type", "scope_id", "occurred_at", "recorded_at", "actor", "source_ids", "metadata"),
    "state_projection": ("state_projection_id", "scope_type", "scope_id", "as_of", "summary", "active_decision_ids", "claim_ids", "open_hypothesis_ids", "open_unknown_ids", "conflicts", "derived_from_ids", "freshness_status"),
    "context_pack": ("context_pack_id", "version", "objective", "mode", "scope_type", "scope_id", "entity_ids", "generated_at", "state_projection_ids", "decision_ids", "evidence_ids", "hypothesis_ids", "unknown_ids", "event_ids", "gaps", "constraints", "token_budget", "level", "data_classes", "provenance_summary"),
}


def structural_rules(kind: str) -> dict[str, Column]:
    """Named predicates of one object type: required columns, vocabularies, the form of its scope, versions, lengths."""
    rules = {f"REQUIRED_{c.upper()}": F.col(c).isNotNull() for c in (*REQUIRED[kind], "contract_version", "object_type")}
    for (owner, column), values in VOCABULARIES.items():
        if owner == kind:
            rules[f"VOCABULARY_{column.upper()}"] = F.col(column).isNull() | F.col(column).isin(*values)
    if "scope_type" in SCHEMAS[kind]:
        rules["SCOPE"] = valid_scope(F.col("scope_type"), F.col("scope_id"))
    if " level string" in SCHEMAS[kind]:
        rules["LEVEL"] = F.col("level").isNull() | F.col("level").isin(*TIERS)
    rules["CONTRACT_VERSION"] = F.col("contract_version").rlike(r"^\d+\.\d+\.\d+\z")
    if kind == "claim":
        rules["CLAIM_OBJECT"] = F.col("object_value").isNotNull() | F.col("object_entity_id").isNotNull()
    if kind == "hypothesis":
        rules["NEXT_LEARNING"] = ~F.col("status").isin(*NEED_NEXT_LEARNING) | F.col("next_best_learning").isNotNull()
    if kind == "context_pack":
        rules["BUDGET"] = F.col("token_budget") >= 1
    return rules


def structural_faults(rows: DataFrame, kind: str) -> DataFrame:
    """(id, code) of structural faults, with repeated ids."""
    own = OWN_ID[kind]
    found = violations(rows, own, structural_rules(kind)).withColumnRenamed(own, "id")
    twice = rows.groupBy(F.col(own).alias("id")).count().where("count > 1").select("id", F.lit("DUPLICATE_ID").alias("code"))
    return found.unionByName(twice)


def vocabulary_table() -> list[tuple[str, str]]:
    """(vocabulary, value) of all layers, for parity checks."""
    rows = [(f"{o}.{c}", v) for (o, c), vs in VOCABULARIES.items() for v in vs]
    return rows + [("scope_type", v) for v in SCOPE_TYPES] + [("level", v) for v in TIERS]
