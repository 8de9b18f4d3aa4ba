"""What objects mean together: every rule of the contract beyond structure, as one relation (object_type, id, code)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checks as C
from . import graph as G
from .schemas import OWN_ID
from .scope import TIERS

# Classes of data, the answer that says that nothing was found, names of fields that no object may carry.
DATA_CLASSES, NOT_FOUND = ("PII",), "NO_EVIDENCE_FOUND"
FORBIDDEN_FIELDS = (
    "sql", "raw_sql", "query_sql", "shell", "command", "cmd", "exec", "script", "secret", "token", "access_token", "refresh_token",
    "api_key", "apikey", "password", "passwd", "dsn", "database_url", "connection_string", "cookie", "authorization", "credential", "credentials", "private_key",
)
#: Columns that keep JSON text, by type.
OPEN_COLUMNS = {"claim": ("object_value",), "candidate": ("payload",), "source": ("metadata",), "event": ("metadata",)}


def has_forbidden_field(text: Column) -> Column:
    """Does JSON text have a forbidden key at any depth? It is normalised first, so escapes and spaces hide none; other text has no keys."""
    plain = F.to_json(F.try_parse_json(text))
    return F.coalesce(plain.rlike(r'(?i)[{,]"(' + "|".join(FORBIDDEN_FIELDS) + r')":'), F.lit(False))


def rules(kind: str, columns: list[str]) -> dict[str, Column]:
    """Named predicates of one object alone."""
    found: dict[str, Column] = {}
    if {"level", "data_classes"} <= set(columns):
        apart = ~F.col("level").isin(*DATA_CLASSES) & ~F.arrays_overlap(F.col("data_classes"), F.array(*map(F.lit, TIERS)))
        found["SENSITIVITY_AXIS_CONFLATED"] = F.coalesce(apart, ~F.col("level").isin(*DATA_CLASSES), F.lit(True))
    if kind in ("claim", "evidence", "candidate"):
        status = F.col("proposed_epistemic_status" if kind == "candidate" else "epistemic_status")
        sources = F.array_compact(F.array("source_id")) if kind == "evidence" else F.col("source_ids")
        told = F.coalesce(F.exists("provenance", lambda p: F.coalesce(p["source_id"] != "", F.lit(False))), F.lit(False)) | F.coalesce(F.size(sources) > 0, F.lit(False))
        asserts = F.coalesce(status.isin(*C.NEED_PROVENANCE), F.lit(False))
        if kind == "candidate":
            found["CANDIDATE_PROPOSES_UNSOURCED_OBSERVATION"] = ~(asserts & F.col("status").eqNullSafe("PENDING")) | told
        else:
            found["EPISTEMIC_PROVENANCE_REQUIRED"] = ~asserts | told
    if kind == "claim":
        unknown, value = F.col("epistemic_status").eqNullSafe("UNKNOWN"), F.btrim(F.coalesce("object_value", F.lit("")), F.lit('"'))
        found["NO_EVIDENCE_FOUND_MISLABELLED"] = (value != NOT_FOUND) | unknown
        found["NO_EVIDENCE_SERIALIZED_AS_FALSE"] = ~unknown | (F.coalesce("object_value", F.lit("")) != "false")
    if kind == "context_pack":
        found["GAP_SERIALIZED_AS_BOOLEAN"] = ~F.coalesce(F.exists("gaps", lambda g: F.coalesce(g.isin("true", "false"), F.lit(False))), F.lit(False))
    if kind in OPEN_COLUMNS:
        found["FORBIDDEN_FIELD"] = ~reduce(lambda a, b: a | b, [has_forbidden_field(F.col(c)) for c in OPEN_COLUMNS[kind]])
    return found


def of_objects(rows: DataFrame, kind: str) -> DataFrame:
    """(id, code) of one type's objects, each rule in the same pass."""
    return C.violations(rows, OWN_ID[kind], rules(kind, rows.columns)).withColumnRenamed(OWN_ID[kind], "id")


def across(frames: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
    """(object_type, (id, code)) of the rules between objects."""
    claims, evidence, decisions = frames["claim"], frames["evidence"], frames["decision"]
    seen = [frames[k].select(F.col(OWN_ID[k]).alias("object_id"), "level" if "level" in frames[k].columns else F.lit(None).cast("string").alias("level"), "scope_type", "scope_id", F.lit(k in ("claim", "evidence")).alias("asserts")) for k in ("entity", "claim", "evidence", "decision", "hypothesis", "unknown", "event", "state_projection")]
    named = C.referenced_ids(frames["context_pack"]).groupBy("context_pack_id").agg(F.collect_list("object_id").alias("refs"))  # a pack's own lists, which its budget bounds
    packs = frames["context_pack"].join(named, "context_pack_id", "left").select(F.col("context_pack_id").alias("pack_id"), "scope_type", "scope_id", "refs", F.col("provenance_summary").alias("provenance_ids"))
    return [
        ("claim", C.evidence_faults(claims, evidence).select(F.col("claim_id").alias("id"), "code")),
        ("claim", C.stored_promotions(claims).where("code = 'FORBIDDEN_PROMOTION'").select(F.col("claim_id").alias("id"), F.lit("INVALID_EPISTEMIC_PROMOTION").alias("code"))),
        ("decision", G.supersession_faults(decisions).select(F.col("decision_id").alias("id"), "code")),
        ("state_projection", C.projection_faults(frames["state_projection"].select(F.col("state_projection_id").alias("id"), "active_decision_ids"), decisions).select("id", "code")),
        ("context_pack", C.pack_faults(packs, reduce(DataFrame.unionByName, seen)).select(F.col("pack_id").alias("id"), "code")),
    ]


def faults(frames: dict[str, DataFrame]) -> DataFrame:
    """(object_type, id, code): the rules of single objects and those between them; nothing is mended."""
    alone = [(k, of_objects(f, k)) for k, f in frames.items() if rules(k, f.columns)]
    return reduce(DataFrame.unionByName, [f.select(F.lit(k).alias("object_type"), "id", "code") for k, f in [*alone, *across(frames)]])


def worst_first(found: DataFrame) -> DataFrame:
    """(code, severity, n): how often each rule is broken."""
    critical = F.col("code").isin("SECRET_IN_CONTEXT_PACK", "CROSS_CLIENT_REFERENCE", "PACK_SCOPE_MISSING", "NO_EVIDENCE_SERIALIZED_AS_FALSE", "GAP_SERIALIZED_AS_BOOLEAN", "FORBIDDEN_FIELD")
    return found.groupBy("code").agg(F.count("*").alias("n")).select("code", F.when(critical, "CRITICAL").otherwise("ERROR").alias("severity"), "n")
