"""Reads of the stored knowledge: active items, structures and own experiences, as one ordered pack with conflicts and gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph as G
from . import pack as P
from . import scope as S

LIMIT = 12
# Tasks, and those that read structures and experiences, and those that need the environment's facts.
TASKS, WITH_EXPERIENCE, WITH_ENVIRONMENT = ("LEARN", "ASK", "BUILD", "DEBUG", "EVOLVE"), ("BUILD", "DEBUG", "ASK"), ("BUILD", "DEBUG")
#: Columns of an item of a pack.
ITEM = ("item_id", "store", "title", "summary", "scope_type", "scope_id", "epistemic_status", "authority", "relevance", "data_classification", "compatibility_status", "version", "node_type", "instruction_authority", "provenance")
#: Where an item comes from: its sources with their places.
PROVENANCE = "array<struct<source_id:string,locator_kind:string,locator:map<string,string>>>"
#: Of a source that has no place of its own, the columns that say where in a recording it lies.
_RECORDED = ("transcript_id", "segment_id", "start_ms", "end_ms")


def active(rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows in force at as_of: ACTIVE, and valid until later or without an end."""
    return rows.where((F.col("lifecycle_state") == "ACTIVE") & (F.col("valid_until").isNull() | (F.col("valid_until") > as_of)))


def matching(rows: DataFrame, text: Column, query: str | None) -> DataFrame:
    """Rows that match a web-style query, with rank; a blank query matches all with rank 0."""
    words = T.tokens(text)
    if not (query or "").strip():
        return rows.withColumn("rank", F.lit(0.0))
    return rows.withColumn("_words", words).where(T.websearch(F.col("_words"), query)).withColumn("rank", T.rank_of(F.col("_words"), query)).drop("_words")


def _or(column: str, other: str) -> Column:
    return F.coalesce(column, F.lit(other))


def provenance_of(sources: DataFrame) -> DataFrame:
    """sources(knowledge_id, source_id, locator_kind, locator map) -> (item_id, provenance), one list for each item.

    Stores that were filled before places had kinds name the recording instead: transcript, segment and times.
    """
    if "locator_kind" in sources.columns:
        kind, place = F.coalesce("locator_kind", F.lit("GENERIC")), F.coalesce("locator", F.create_map().cast("map<string,string>"))
    else:
        held = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in _RECORDED if c in sources.columns]))
        kind, place = F.lit("MEDIA_TIME"), F.map_from_entries(held)
    entry = F.struct(F.col("source_id").cast("string").alias("source_id"), kind.alias("locator_kind"), place.alias("locator"))
    key = lambda e: F.struct(e["source_id"], e["locator_kind"], F.to_json(e["locator"]))
    order = lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)
    return sources.groupBy(F.col("knowledge_id").alias("item_id")).agg(F.array_sort(F.collect_list(entry), order).alias("provenance"))


def knowledge_items(rows: DataFrame, query: str | None, scope: str, as_of: Column, limit: int = LIMIT, sources: DataFrame | None = None) -> DataFrame:
    """Stored knowledge as items: the guard first, then force and match; rank down, newest approval (unknown last), id.

    A store without scope columns cannot prove whose a row is: the global scope reads it as global, any other reads
    nothing of it. sources give the items' provenance.
    """
    if "scope_type" not in rows.columns:
        rows = rows.withColumns({"scope_type": F.lit("GLOBAL"), "scope_id": F.lit("GLOBAL")}).where(F.lit(S.parse_scope(scope)[0] == "GLOBAL"))
    later = {"data_classification": "string", "compatibility_status": "string", "observed_version": "string", "node_type": "string"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in later.items() if c not in rows.columns})
    seen = matching(active(S.guard(rows, scope), as_of), F.concat_ws(" ", "title", "summary"), query)
    best = seen.orderBy(F.desc("rank"), F.desc_nulls_last("approved_at"), "knowledge_id").limit(limit)
    items = best.select(
        F.col("knowledge_id").alias("item_id"), F.lit("knowledge").alias("store"), _or("title", "(untitled)").alias("title"), _or("summary", "").alias("summary"), _or("scope_type", "GLOBAL").alias("scope_type"), _or("scope_id", "GLOBAL").alias("scope_id"),
        _or("epistemic_status", "UNKNOWN").alias("epistemic_status"), P.authority(F.col("epistemic_status"), F.col("knowledge_type")).alias("authority"), F.col("rank").alias("relevance"),
        _or("data_classification", "INTERNAL").alias("data_classification"), _or("compatibility_status", "UNKNOWN_COMPATIBILITY").alias("compatibility_status"), F.col("observed_version").alias("version"), "node_type", _or("instruction_authority", "NONE").alias("instruction_authority"),
    )
    none = F.array().cast(PROVENANCE)
    if sources is None:
        return items.withColumn("provenance", none)
    named = sources.join(items.select(F.col("item_id").alias("knowledge_id")), "knowledge_id", "left_semi")  # at most limit items
    return items.join(provenance_of(named), "item_id", "left").withColumn("provenance", F.coalesce("provenance", none))


def structure_items(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rows(item_id, knowledge_role, learning_scope, risk_decision, max_severity, node_types, source_repo, source_commit, source_path, implementation_reference_allowed, compiled_at) of foreign workflows as items.

    What they are made of, never advice: only those that may be referred to, the newest first. They are observed, not
    ranked by a query, and point to the file they come from.
    """
    best = rows.where("implementation_reference_allowed").orderBy(F.desc("compiled_at"), "item_id").limit(limit)
    told = lambda c: F.coalesce(F.col(c), F.lit("None"))
    summary = F.concat(F.lit("role="), told("knowledge_role"), F.lit(" scope="), told("learning_scope"), F.lit(" risk="), told("risk_decision"), F.lit("/"), told("max_severity"), F.lit(" nodes="), F.array_join(F.slice(F.coalesce("node_types", F.array().cast("array<string>")), 1, 8), ", "))
    place = F.map_filter(F.create_map(F.lit("path"), F.col("source_path"), F.lit("commit"), F.col("source_commit")), lambda k, v: F.coalesce(v != "", F.lit(False)))
    return best.select(
        "item_id", F.lit("structure").alias("store"), F.concat(F.lit("Structure reference: "), F.coalesce(F.nullif("source_path", F.lit("")), "item_id")).alias("title"), summary.alias("summary"),
        F.lit("GLOBAL").alias("scope_type"), F.lit("GLOBAL").alias("scope_id"), F.lit("OBSERVED").alias("epistemic_status"), F.lit("EXTERNAL_WORKFLOW_ANALYZED").alias("authority"), F.lit(0.0).alias("relevance"), F.lit("INTERNAL").alias("data_classification"),
        F.lit("UNKNOWN_COMPATIBILITY").alias("compatibility_status"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("node_type"), F.lit("NONE").alias("instruction_authority"),
        F.array(F.struct(F.col("source_repo").alias("source_id"), F.lit("REPO_FILE").alias("locator_kind"), place.alias("locator"))).cast(PROVENANCE).alias("provenance"),
    )


def experience_items(rows: DataFrame, query: str | None, scope: str, environment: str, limit: int = LIMIT) -> DataFrame:
    """Own runs as items: those of the same environment first, then the newest; measured ones rank above any model's word."""
    said = matching(S.guard(rows, scope), F.concat_ws(" ", "category", "observed_error", "hypothesis", "change_summary"), query)
    here = F.col("environment").eqNullSafe(environment)
    best = said.orderBy(F.desc(here), F.desc("created_at"), "experience_id").limit(limit)
    part = lambda name, c: F.concat(F.lit(f"{name}: "), _or(c, "-"))
    return best.select(
        F.col("experience_id").alias("item_id"), F.lit("experience").alias("store"), F.concat(F.lit("["), _or("category", ""), F.lit("] "), F.substring(_or("observed_error", ""), 1, 120)).alias("title"),
        F.concat_ws(" | ", part("hypothesis", "hypothesis"), part("change", "change_summary"), F.concat(part("before", "result_before"), F.lit(" -> "), part("after", "result_after"))).alias("summary"), "scope_type", "scope_id", _or("epistemic_status", "OBSERVED").alias("epistemic_status"),
        F.when(F.col("epistemic_status") == "MEASURED", "MEASURED_OWN_EXECUTION").otherwise("MODEL_INFERENCE").alias("authority"), F.when(here, 1.0).otherwise(0.5).alias("relevance"), F.lit("INTERNAL").alias("data_classification"),
        F.lit("UNKNOWN_COMPATIBILITY").alias("compatibility_status"), F.col("version"), F.col("node").alias("node_type"), F.lit("NONE").alias("instruction_authority"), F.array().cast(PROVENANCE).alias("provenance"),
    )


def conflicts(items: DataFrame) -> DataFrame:
    """(kind, node, item_ids): items that say so themselves, nodes seen in several versions, deprecated beside current ones."""
    marked = items.where("epistemic_status = 'CONFLICTING'").select(F.lit("MARKED_CONFLICTING").alias("kind"), "node_type", F.array("item_id").alias("item_ids"))
    known = items.where("node_type is not null and version is not null")
    of_nodes = G.version_conflicts(known.select(F.col("node_type").alias("node"), "version", F.col("compatibility_status").alias("status"))).select("kind", F.col("node").alias("node_type"))
    held = known.groupBy("node_type").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))  # at most three limits of items
    return marked.unionByName(of_nodes.join(held, "node_type").select("kind", "node_type", "item_ids"))


def pack(frames: dict[str, DataFrame], query: str, scope: str, as_of: Column, task: str = "ASK", environment: str = "DEV", limit: int = LIMIT) -> dict[str, DataFrame]:
    """items by authority, relevance and id; conflicts among them; gaps: what is missing is said, never left out in silence.

    frames may hold knowledge, sources (of knowledge), structures and experiences; a store that is not there is a gap, and
    so is knowledge without scopes: read as global by the global scope, refused to any other.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    spark = next(iter(frames.values())).sparkSession
    parts, gaps = [knowledge_items(frames["knowledge"], query, scope, as_of, limit, frames.get("sources"))] if "knowledge" in frames else [], [] if "knowledge" in frames else ["NO_STORE:knowledge"]
    if "knowledge" in frames and "scope_type" not in frames["knowledge"].columns:
        gaps.append("UNSCOPED_STORE:knowledge:" + ("READ_AS_GLOBAL" if S.parse_scope(scope)[0] == "GLOBAL" else "REFUSED"))
    if task in WITH_EXPERIENCE:
        gaps += [f"NO_STORE:{k}" for k in ("structures", "experiences") if k not in frames]
        parts += [structure_items(frames["structures"], limit)] if "structures" in frames else []
        parts += [experience_items(frames["experiences"], query, scope, environment, limit)] if "experiences" in frames else []
    gaps += ["NO_ENVIRONMENT_PROFILE"] if task in WITH_ENVIRONMENT else []
    if not parts:
        raise ValueError("no store to read")
    rank = F.array_position(F.array(*map(F.lit, P.AUTHORITIES)), F.col("authority"))
    items = reduce(DataFrame.unionByName, parts).select(*ITEM).orderBy(rank, F.desc("relevance"), "item_id")
    said = spark.createDataFrame([(g,) for g in gaps], "gap string")
    none = items.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("NO_ITEM_FOUND").alias("gap"))
    return {"items": items, "conflicts": conflicts(items), "gaps": said.unionByName(none)}


def rendered(items: DataFrame) -> DataFrame:
    """(line) of a pack in its order: rank and authority, title, status, scope."""
    rank = F.array_position(F.array(*map(F.lit, P.AUTHORITIES)), F.col("authority"))
    head = F.concat(F.lit("["), rank.cast("string"), F.lit(":"), F.col("authority"), F.lit("] "), F.col("title"))
    return items.select(F.concat_ws(" | ", head, "epistemic_status", F.concat_ws(":", "scope_type", "scope_id")).alias("line"))
