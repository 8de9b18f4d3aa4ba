"""A world of objects, read only through a scope; the read pipeline and the context pack.

World.scoped() is the only way to rows: every frame it hands out has the guard and the SECRET filter at its leaf, so
no later step, score or count can see what the scope may not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity as I
from ..sources.tables import scratch
from . import budget as B
from . import evidence as E
from . import graph as G
from . import scope as S
from .schemas import OWN_ID, SCHEMAS, structural_faults

# Statuses that leave a question open; events and evidence that a pack takes, by mode.
OPEN_HYPOTHESES, OPEN_UNKNOWNS = ("OPEN", "PARTIALLY_SUPPORTED", "CONFLICTING"), ("OPEN", "PARTIALLY_RESOLVED")
SETTLED_UNKNOWNS, GONE_CLAIMS, PII_CLASS = ("RESOLVED", "NO_LONGER_RELEVANT"), ("SUPERSEDED", "RETRACTED"), "PII"
MODES = {"OPERATIONAL": (5, 10), "RESEARCH": (3, 25), "BUILD": (5, 12), "AUDIT": (25, 25), "STRATEGY": (3, 12)}


#: Columns of evidence that a search may filter by, each by a value or a set of them, beside exclude_pii.
FILTERS = ("direction", "strength", "evidence_type", "epistemic_status")
#: Version of the rules by which packs are put together, a part of their identity.
PACK_VERSION = "1.0.0"
NO_EVIDENCE = "NO_EVIDENCE_FOUND"
#: Lists of a pack that grow with the scope: pack_rows gives their items as rows.
LONG_LISTS = ("entity_ids", "decision_ids", "claim_ids", "hypothesis_ids", "unknown_ids", "constraints", "provenance_summary")
UNTOLD = " asserting object(s) were excluded for having no traceable source: "
_IDS = "array<string>"


class AmbiguousEntity(ValueError):
    """Several entities match a query equally well."""


class BudgetTooSmall(ValueError):
    """Not even the core of the pack fits."""

    def __init__(self, requested: int, minimum: int) -> None:
        super().__init__(f"budget {requested} is below the minimum {minimum}")
        self.requested, self.minimum, self.missing = requested, minimum, minimum - requested


@dataclass
class World:
    frames: dict[str, DataFrame]

    @classmethod
    def of(cls, spark: SparkSession, frames: dict[str, DataFrame] | None = None) -> World:
        """A world of the given frames; types without one are empty. Unknown types are refused."""
        frames = frames or {}
        if unknown := set(frames) - set(SCHEMAS):
            raise ValueError(f"unknown object types: {sorted(unknown)}")
        return cls({k: frames[k] if k in frames else spark.createDataFrame([], s) for k, s in SCHEMAS.items()})

    @classmethod
    def read(cls, spark: SparkSession, folder: str, kinds: tuple[str, ...]) -> World:
        """From one JSON-lines folder for each type, with its closed schema."""
        return cls.of(spark, {k: spark.read.schema(SCHEMAS[k]).option("mode", "FAILFAST").json(f"{folder}/{k}") for k in kinds})

    def faults(self) -> DataFrame:
        """(object_type, id, code) over all types."""
        return reduce(DataFrame.unionByName, [structural_faults(f, k).withColumn("object_type", F.lit(k)) for k, f in self.frames.items()])

    def scoped(self, scope: str, include_global: bool = True) -> ScopedWorld:
        return ScopedWorld(self, scope, include_global)


class ScopedWorld:
    def __init__(self, world: World, scope: str, include_global: bool) -> None:
        self.scope, self._world, self._global = S.parse_scope(scope), world, include_global
        self._text = scope

    def all_of(self, kind: str) -> DataFrame:
        rows = self._world.frames[kind]
        if kind == "fragment":  # fragments have no scope of their own: they are seen through their source
            return rows.join(self.all_of("source").select("source_id"), "source_id", "left_semi")
        rows = S.guard(rows, self._text, self._global)
        return rows.where(S.not_secret(F.col("level"))) if "level" in rows.columns else rows

    def by_id(self, kind: str, name: str) -> DataFrame:
        return self.all_of(kind).where(F.col(OWN_ID[kind]) == name)

    def withheld(self) -> DataFrame:
        """(object_type, n) of secret objects that the scope would otherwise see."""
        kinds = ("entity", "source", "claim", "evidence", "decision")
        secret = lambda rows: rows.where("level = 'SECRET'" if "level" in rows.columns else "false")
        found = [secret(S.guard(self._world.frames[k], self._text, self._global)).agg(F.count("*").alias("n")).select(F.lit(k).alias("object_type"), "n") for k in kinds]
        return reduce(DataFrame.unionByName, found)

    def resolve(self, query: str, limit: int = 10) -> DataFrame:
        return E.resolve(self.all_of("entity").select("entity_id", "canonical_name", "aliases"), query, limit)

    def require_one(self, query: str) -> str | None:
        """The resolved id, None without a match; ambiguity is an error that names no candidate of another scope."""
        rows = self.resolve(query).where("is_best").select("entity_id").limit(2).collect()
        if len(rows) > 1:
            raise AmbiguousEntity(query)
        return rows[0][0] if rows else None

    def relations(self, entity: str) -> DataFrame:
        """(predicate, object_entity_id, claim_id) of an entity's visible claims to visible entities."""
        claims = self.all_of("claim").where((F.col("subject_entity_id") == entity) & F.col("object_entity_id").isNotNull())
        seen = self.all_of("entity").select(F.col("entity_id").alias("object_entity_id"))
        return claims.join(seen, "object_entity_id", "left_semi").select("predicate", "object_entity_id", "claim_id").orderBy("predicate", "object_entity_id", "claim_id")

    def expand(self, entities: list[str], depth: int = 1) -> DataFrame:
        """(node, depth): visible entities reached over visible claims, from subject to object; one step unless told otherwise."""
        claims = self.all_of("claim").where("object_entity_id is not null").select("subject_entity_id", "object_entity_id")
        seen = self.all_of("entity").select("entity_id")
        edges = claims.select(F.col("subject_entity_id").alias("src"), F.col("object_entity_id").alias("dst")).join(seen.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")
        return G.expand(edges, claims.sparkSession.createDataFrame([(e,) for e in entities], "node string"), depth)

    def evidence_text(self) -> DataFrame:
        """Evidence with the text of its visible fragments and its source's title."""
        rows = self.all_of("evidence").select("evidence_id", "source_id", "fragment_ids", "subject_entity_id", "strength")
        parts = rows.select("evidence_id", F.explode("fragment_ids").alias("fragment_id")).join(self.all_of("fragment").select("fragment_id", "content"), "fragment_id")
        texts = parts.groupBy("evidence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fragment_id", "content"))), lambda x: x["content"]), " ").alias("body"))
        titles = self.all_of("source").select("source_id", "title")
        both = rows.join(texts, "evidence_id", "left").join(titles, "source_id", "left")
        return both.select("evidence_id", "source_id", "subject_entity_id", "strength", F.concat_ws(" ", "title", "body").alias("text"))

    def search(self, query: str, entities: list[str] | None = None, limit: int = 25, filters: dict | None = None) -> DataFrame:
        """The best hits; evidence without a visible source to point to is no hit, nor is any that a filter rules out.

        filters name a value or a set of values for direction, strength, evidence_type or epistemic_status; exclude_pii
        leaves out what carries personal data. Any other name is an error.
        """
        filters = dict(filters or {})
        without_pii = filters.pop("exclude_pii", False)
        if unknown := set(filters) - set(FILTERS):
            raise ValueError(f"unknown filters: {sorted(unknown)}")
        kept = self.all_of("evidence")
        for name, wanted in filters.items():
            if wanted is not None:
                kept = kept.where(F.col(name).isin(*([wanted] if isinstance(wanted, str) else sorted(wanted))))
        if without_pii:
            kept = kept.where(~F.coalesce(F.array_contains("data_classes", PII_CLASS), F.lit(False)))
        linked = None
        if entities:
            about = self.all_of("claim").where(F.col("subject_entity_id").isin(*entities))
            linked = about.select(F.explode(F.concat(F.coalesce("supporting_evidence_ids", F.array().cast(_IDS)), F.coalesce("counter_evidence_ids", F.array().cast(_IDS)))).alias("evidence_id"))
        pointed = self.source_pointers().select("evidence_id").distinct()
        rows = self.evidence_text().join(kept.select("evidence_id"), "evidence_id", "left_semi").join(pointed, "evidence_id", "left_semi")
        return E.search(rows, query, linked, entities, limit=limit)

    def absence(self, hits: DataFrame) -> DataFrame:
        """(kind): a row if there are no hits, as finding nothing is not finding that something is false."""
        return hits.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(NO_EVIDENCE).alias("kind"))

    def source_pointers(self) -> DataFrame:
        """(evidence_id, source_id, fragment_id, locator, observed_at, content_hash): where visible evidence comes from.

        Its own provenance first; else its source and fragments, or its source alone, if the scope may see that source.
        """
        rows = self.all_of("evidence").withColumn("own", F.filter("provenance", lambda p: p["source_id"].isNotNull()))
        told, columns = F.coalesce(F.size("own") > 0, F.lit(False)), ("source_id", "fragment_id", "locator", "observed_at", "content_hash")
        own = rows.where(told).select("evidence_id", F.explode("own").alias("p")).select("evidence_id", *[f"p.{c}" for c in columns])
        source = self.all_of("source").select("source_id", F.col("content_hash").alias("source_hash"))
        rest = rows.where(~told).select("evidence_id", "source_id", "observed_at", F.explode_outer("fragment_ids").alias("fragment_id")).join(source, "source_id")
        held = self._world.frames["fragment"].select("fragment_id", "content_hash", F.get("provenance", F.lit(0))["locator"].alias("locator"))
        both = rest.join(held, "fragment_id", "left").withColumn("content_hash", F.when(F.col("fragment_id").isNull(), F.col("source_hash")).otherwise(F.col("content_hash")))
        return own.unionByName(both.select("evidence_id", *columns))

    def provenance(self, kind: str) -> DataFrame:
        """(object_id, source_ids) of visible claims or evidence that can name a source: their own provenance, else their sources."""
        rows = self.all_of(kind)
        sources = F.array_sort(F.coalesce("source_ids", F.array().cast("array<string>"))) if kind == "claim" else F.array_compact(F.array("source_id"))
        own = F.filter(F.transform("provenance", lambda p: p["source_id"]), lambda x: x.isNotNull())
        found = F.when(F.coalesce(F.size("provenance") > 0, F.lit(False)), own).otherwise(sources)
        return rows.select(F.col(OWN_ID[kind]).alias("object_id"), found.alias("source_ids")).where(F.size("source_ids") > 0)

    def constraints(self) -> DataFrame:
        """(line): active decisions restated, which no budget drops."""
        return G.active_decisions(self.all_of("decision")).select(F.concat_ws(": ", "decision_id", "decision").alias("line")).orderBy("line")

    def tier_of(self, ids: DataFrame) -> DataFrame:
        """ids(object_id) -> one row: the highest level and the data classes of the visible objects that are named."""
        kinds = [k for k, f in self._world.frames.items() if {"level", "data_classes"} <= set(f.columns) and k != "context_pack"]
        held = reduce(DataFrame.unionByName, [self.all_of(k).select(F.col(OWN_ID[k]).alias("object_id"), "level", "data_classes") for k in kinds])
        named = held.join(ids.select("object_id").distinct(), "object_id", "left_semi")
        classes = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("data_classes", F.array().cast("array<string>"))))))
        return named.agg(S.highest_tier(S.tier(F.col("level"))).alias("level"), classes.alias("data_classes"))

    def trace(self, query: str, entities: list[str] | None = None) -> DataFrame:
        """(stage, available, n) of a read in the order of its stages; the semantic stage is said to be missing."""
        hits, wanted = self.search(query, entities), entities or []
        one = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), F.lit(True).alias("available"), "n")
        none = self.all_of("entity").limit(0)
        found = [
            one("ENTITY_RESOLUTION", self.all_of("entity").where(F.col("entity_id").isin(*wanted)) if wanted else none), one("SCOPE_GUARD", self.all_of("evidence")),
            one("CURRENT_STATE", self.all_of("claim").where("status = 'ACTIVE'")), one("STRUCTURED_RELATIONAL", hits.where("relational > 0")), one("LEXICAL", hits.where("lexical > 0")),
            one("RELATION_EXPANSION", self.expand(wanted) if wanted else none), one("RAW_SOURCE_POINTER", self.source_pointers().join(hits.select("evidence_id"), "evidence_id", "left_semi")),
        ]
        semantic = none.sparkSession.createDataFrame([("SEMANTIC", False, None)], "stage string, available boolean, n long")
        return reduce(DataFrame.unionByName, [*found, semantic])

    def _claims(self, entity: str | None) -> DataFrame:
        return S.about_entity(self.all_of("claim"), entity) if entity else self.all_of("claim")

    def state_ids(self, entity: str | None = None) -> DataFrame:
        """(kind, id): what is in force or open, a row each, so that a large scope is no large row."""
        open_of = lambda kind, states: self.all_of(kind).where(F.col("status").isin(*states))
        held = {
            "ACTIVE_DECISION": (G.active_decisions(self.all_of("decision")), "decision_id"), "CURRENT_CLAIM": (self._claims(entity).where("status = 'ACTIVE'"), "claim_id"),
            "OPEN_HYPOTHESIS": (open_of("hypothesis", OPEN_HYPOTHESES), "hypothesis_id"), "OPEN_UNKNOWN": (open_of("unknown", OPEN_UNKNOWNS), "unknown_id"),
        }
        return reduce(DataFrame.unionByName, [rows.select(F.lit(kind).alias("kind"), F.col(name).alias("id")) for kind, (rows, name) in held.items()])

    def state(self, entity: str | None = None) -> DataFrame:
        """One row: how many of each kind, the newest stamp, the next thing to learn, freshness; no row if nothing is recorded."""
        ids = self.state_ids(entity)
        counts = ids.agg(*[F.count_if(F.col("kind") == k).alias(c) for k, c in (("CURRENT_CLAIM", "n_claims"), ("ACTIVE_DECISION", "n_decisions"), ("OPEN_HYPOTHESIS", "n_hypotheses"), ("OPEN_UNKNOWN", "n_unknowns"))])
        learn = G.next_learning(self.all_of("hypothesis").where(F.col("status").isin(*OPEN_HYPOTHESES)), self.all_of("unknown").where(F.col("status").isin(*OPEN_UNKNOWNS)))
        return self._recorded(entity).join(counts, F.lit(True)).join(learn, F.lit(True), "left")  # one row each

    def _recorded(self, entity: str | None) -> DataFrame:
        """One row (n_recorded, as_of, freshness_status): the newest stamp of what makes up the state; no row if nothing is recorded."""
        contributing = [self._claims(entity), *[self.all_of(k) for k in ("decision", "hypothesis", "unknown")]]
        newest = reduce(DataFrame.unionByName, [r.select(_newest(r).alias("t")) for r in contributing]).agg(F.count("*").alias("n_recorded"), F.max("t").alias("as_of"))
        return newest.where("n_recorded > 0").withColumn("freshness_status", G.freshness(F.col("as_of"), F.col("as_of")))

    def conflicts(self, entity: str | None = None) -> DataFrame:
        """(description, claim_id, evidence_ids): contradictions left standing, a row for each claim of one.

        A claim that says it is in conflict; one with counter evidence that nobody has reconciled; active claims that
        give a subject and predicate several object values, where none counts as a value. Objects that are entities are
        no values.
        """
        claims = self._claims(entity)
        counter = F.array_sort(F.coalesce("counter_evidence_ids", F.array().cast(_IDS)))
        told = (F.col("status") == "DISPUTED") | (F.col("epistemic_status") == "CONFLICTING")
        of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        said = of("claim ", F.col("claim_id"), " is recorded as being in conflict (", F.coalesce("epistemic_status", F.lit("None")), "/", F.coalesce("status", F.lit("None")), ")")
        against = of("claim ", F.col("claim_id"), " has evidence against it that has not been reconciled")
        alone = claims.withColumn("description", F.when(F.coalesce(told, F.lit(False)), said).when(F.size(counter) > 0, against)).where("description is not null").select("description", "claim_id", counter.alias("evidence_ids"))
        active = claims.where("status = 'ACTIVE'").select("claim_id", F.coalesce("subject_entity_id", F.lit("None")).alias("subject_id"), F.coalesce("predicate", F.lit("None")).alias("predicate"), F.col("object_value").alias("value"), "status")
        torn = G.contradictions(active)
        apart = active.join(torn, ["subject_id", "predicate"]).select(of(F.col("n_claims").cast("string"), " active claims disagree about '", F.col("predicate"), "' for ", F.col("subject_id")).alias("description"), "claim_id", F.array().cast(_IDS).alias("evidence_ids"))
        return alone.unionByName(apart)

    def _logged(self, entity: str | None) -> DataFrame:
        """(object_type, id, status, first_at, changed_at, occurred_at, recorded_at): the stamps of all that a change is told of."""
        stamp = lambda c, rows: F.col(c) if c in rows.columns else F.lit(None).cast("timestamp")
        changed = {"claim": ("created_at", "last_updated_at"), "decision": ("effective_from", "created_at"), "hypothesis": ("last_updated_at",), "unknown": ("last_updated_at",), "event": ("occurred_at", "recorded_at")}
        out = []
        for kind, of in changed.items():
            rows = self._claims(entity) if kind == "claim" else self.all_of(kind)
            first = [stamp(c, rows) for c in ("occurred_at", "created_at", "effective_from", "recorded_at")]
            # A claim is new by its creation and gone by its last change; both are told, so both are kept.
            at = F.when(F.col("status").isin(*GONE_CLAIMS), F.col("last_updated_at")).otherwise(F.col("created_at")) if kind == "claim" else F.greatest(*[stamp(c, rows) for c in of], F.lit(None).cast("timestamp"))
            out.append(rows.select(F.lit(kind).alias("object_type"), F.col(OWN_ID[kind]).alias("id"), (F.col("status") if "status" in rows.columns else F.lit(None).cast("string")).alias("status"), F.least(*first).alias("first_at"), at.alias("changed_at"), stamp("occurred_at", rows).alias("occurred_at"), stamp("recorded_at", rows).alias("recorded_at"), _newest(rows).alias("newest_at")))
        return reduce(DataFrame.unionByName, out)

    def delta(self, since: str | None, entity: str | None = None) -> DataFrame:
        """(change, object_type, id, late_days): what changed after since; late_days where an event was recorded more than 30 days after it occurred."""
        at = F.to_timestamp(F.lit(since))
        log = self._logged(entity)
        what = (
            F.when((F.col("object_type") == "claim") & (F.col("status") == "ACTIVE"), "NEW_CLAIM").when((F.col("object_type") == "claim") & F.col("status").isin(*GONE_CLAIMS), "SUPERSEDED_CLAIM").when(F.col("object_type") == "decision", "DECISION_CHANGE")
            .when(F.col("object_type") == "hypothesis", "HYPOTHESIS_CHANGE").when((F.col("object_type") == "unknown") & F.col("status").isin(*SETTLED_UNKNOWNS), "RESOLVED_UNKNOWN").when(F.col("object_type") == "event", "RECENT_EVENT")
        )
        seen = F.lit(True) if since is None else F.coalesce(F.col("changed_at") > at, F.lit(False))
        rows = log.withColumn("change", what).where(F.col("change").isNotNull() & seen)
        rows = rows.select("change", "object_type", "id", F.when(F.col("object_type") == "event", G.late(F.col("occurred_at"), F.col("recorded_at"))).alias("late_days"))
        states = self.all_of("state_projection").select(F.lit("STATE_TRANSITION").alias("change"), F.lit("state_projection").alias("object_type"), F.col("state_projection_id").alias("id"), F.lit(None).cast("long").alias("late_days"))
        anything = self.coverage(since, entity).where(F.col("coverage") != "NO_RECORD").select("coverage")
        return rows.unionByName(states.join(anything, F.lit(True), "left_semi"))

    def coverage(self, since: str | None, entity: str | None = None) -> DataFrame:
        """One row (coverage, earliest, as_of): whether the record reaches back to since. One pass over the stamps."""
        told = self._logged(entity).agg(F.count("*").alias("n"), F.min("first_at").alias("earliest"), F.max("newest_at").alias("as_of"))
        at = F.to_timestamp(F.lit(since))
        partial = F.coalesce(at < F.col("earliest"), F.lit(False))
        return told.select(F.when(F.col("n") == 0, "NO_RECORD").when(partial, "PARTIAL_NO_RECORD_BEFORE").otherwise("COVERED").alias("coverage"), "earliest", "as_of")

    def fingerprint(self) -> DataFrame:
        """One row (fingerprint): a digest of every object that the scope may see, whatever their order; partial sums only."""
        digest = lambda rows: F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
        parts = [self.all_of(k) for k in sorted(self._world.frames)]
        return reduce(DataFrame.unionByName, [r.select(digest(r).alias("d")) for r in parts]).agg(I.fingerprint(F.col("d")).alias("fingerprint"))

    def _entries(self, kind: str, rows: DataFrame) -> DataFrame:
        """(object_id, entry): for claims or evidence their provenance, their own or their sources'; entry is null where they can name none."""
        fields = [f.name for f in self._world.frames[kind].schema["provenance"].dataType.elementType.fields]
        bare = lambda s: F.struct(*[(s if c == "source_id" else F.lit(None).cast(self._world.frames[kind].schema["provenance"].dataType.elementType[c].dataType)).alias(c) for c in fields])
        sources = F.array_sort(F.coalesce("source_ids", F.array().cast(_IDS))) if kind == "claim" else F.array_compact(F.array("source_id"))
        found = F.when(F.coalesce(F.size("provenance") > 0, F.lit(False)), F.col("provenance")).otherwise(F.transform(sources, bare))
        name = F.col(OWN_ID[kind])
        entry = F.when(F.size(found) > 0, F.struct(name.alias("object_id"), F.lit(kind.capitalize()).alias("object_type"), found.alias("provenance")))
        return rows.select(name.alias("object_id"), entry.alias("entry"), *[(F.col(c) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in (("level", "string"), ("data_classes", _IDS), ("strength", "string"))])

    def _asserting(self, hits: DataFrame, entity: str | None) -> tuple[DataFrame, DataFrame]:
        """Entries of the claims in force and of the evidence that was found."""
        return self._entries("claim", self._claims(entity).where("status = 'ACTIVE'")), self._entries("evidence", self.all_of("evidence").join(hits.select("evidence_id"), "evidence_id", "left_semi"))

    def _gaps(self, objective: str) -> list[Column]:
        """The lines about what is missing, but for the one that names objects; null where nothing is."""
        scope = ":".join(self.scope)
        return [
            _line(F.col("as_of").isNull(), f"no state is recorded for {scope}; this is an absence in the record, not a finding"), _line(F.col("n_hits") == 0, f"{NO_EVIDENCE}: nothing matched {objective!r} in {scope}; this is not evidence that any claim is false"),
            _line(F.lit(True), "retrieval stage SEMANTIC is not available in this deployment"), _line(F.col("coverage") != "COVERED", "delta coverage is ", F.col("coverage")),
            _line(F.col("n_withheld") > 0, F.col("n_withheld").cast("string"), " object(s) in scope are SECRET and are excluded from this pack"),
        ]

    def _own(self, objective: str, mode: str, token_budget: int, requirements: tuple[str, ...], generated_at: str | None) -> list[Column]:
        """The columns of a pack that hold no list of objects."""
        rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, S.TIERS)), c), F.lit(0))
        return [
            F.lit("1.0.0").alias("contract_version"), F.lit("ContextPack").alias("object_type"), F.lit("cp_" + "0" * 32).alias("context_pack_id"), F.lit(PACK_VERSION).alias("version"), F.lit(objective).alias("objective"), F.lit(mode).alias("mode"),
            F.struct(F.lit(self.scope[0]).alias("scope_type"), F.lit(self.scope[1]).alias("scope_id")).alias("scope"),
            F.coalesce(F.lit(generated_at), F.date_format(F.coalesce("as_of", "recorded_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z")).alias("generated_at"),
            F.array().cast("array<struct<artifact_id:string>>").alias("artifact_refs"), F.array(*map(F.lit, sorted(requirements))).cast(_IDS).alias("procedural_refs"), F.lit(token_budget).alias("token_budget"),
            F.when(rank(F.col("other_level")) > rank(F.col("asserted_level")), F.col("other_level")).otherwise(F.col("asserted_level")).alias("sensitivity_level"), F.coalesce("freshness_status", F.lit("UNKNOWN_FRESHNESS")).alias("freshness_status"),
        ]

    def _projection(self, entity: str | None) -> Column:
        """The id of the state that a pack tells of."""
        return F.concat(F.lit("sp_"), F.left(F.sha2(F.concat_ws("\x1f", F.col("fingerprint"), F.lit(":".join(self.scope)), F.lit(entity or ""), F.lit("state")), 256), F.lit(24)))

    def pack_row(self, objective: str, mode: str = "OPERATIONAL", token_budget: int = 8000, entities: list[str] | None = None, requirements: tuple[str, ...] = (), since: str | None = None, generated_at: str | None = None) -> DataFrame:
        """One row: the pack for an objective, fitted to its budget, with size, fits, minimum_required and trimmed.

        The row holds all lists before it is fitted; where a scope is too large for that, pack_rows gives them as rows.
        """
        n_events, n_evidence = MODES[mode]
        entity = entities[0] if entities and len(entities) == 1 else None
        listed = lambda rows, c, name: rows.agg(F.array_sort(F.collect_list(c)).alias(name))
        ids = self.state_ids(entity)
        of = lambda kind, name: listed(ids.where(F.col("kind") == kind), "id", name)
        hits = self.search(objective, entities, n_evidence)
        asserting = reduce(DataFrame.unionByName, self._asserting(hits, entity))
        told = asserting.agg(
            F.array_sort(F.collect_list(F.when(F.col("entry.object_type") == "Claim", F.col("object_id")))).alias("claim_ids"), F.array_sort(F.collect_list(F.when(F.col("entry.object_type") == "Evidence", F.col("object_id")))).alias("evidence_ids"),
            F.array_sort(F.collect_list("entry"), _by_object).alias("provenance_summary"), F.array_sort(F.collect_list(F.when(F.col("entry").isNull(), F.col("object_id")))).alias("untold"), _strengths(), *_told(),
        )
        others = ids.where("kind <> 'CURRENT_CLAIM'").agg(F.when(F.count("*") > 0, F.lit("INTERNAL")).alias("other_level"))
        events = self.delta(since).where("change = 'RECENT_EVENT'").select("id").orderBy("id").limit(n_events)
        reach = self.expand(entities).select("node") if entities else ids.limit(0).select(F.col("id").alias("node"))
        withheld = self.withheld().agg(F.sum("n").alias("n_withheld"))
        state = self._recorded(entity).select("as_of", "freshness_status")
        covered = self.coverage(since).select("coverage", F.col("as_of").alias("recorded_at"))
        found = hits.agg(F.count("*").alias("n_hits"))
        parts = [told, others, of("ACTIVE_DECISION", "decision_ids"), of("OPEN_HYPOTHESIS", "hypothesis_ids"), of("OPEN_UNKNOWN", "unknown_ids"), listed(events, "id", "recent_event_ids"), listed(reach, "node", "reached"), listed(self.constraints(), "line", "constraints"), withheld, covered, found, self.fingerprint()]
        row = reduce(lambda a, b: a.join(b, F.lit(True)), parts).join(state, F.lit(True), "left")  # one row each
        gaps = F.array_compact(F.array(*self._gaps(objective), _line(F.size("untold") > 0, F.size("untold").cast("string"), UNTOLD, F.array_join("untold", ", "))))
        wanted = F.array(*map(F.lit, entities)) if entities else F.array().cast(_IDS)
        pack = row.select(
            *self._own(objective, mode, token_budget, requirements, generated_at), F.array_sort(F.array_union(wanted, F.col("reached"))).alias("entity_ids"),
            F.when(F.col("as_of").isNotNull(), F.array(self._projection(entity))).otherwise(F.array().cast(_IDS)).alias("state_projection_ids"),
            "decision_ids", "claim_ids", "evidence_ids", "hypothesis_ids", "unknown_ids", "recent_event_ids", F.array_sort(gaps).alias("gaps"), "constraints", "data_classes", "provenance_summary", "strengths", "fingerprint",
        )
        world = pack.select("fingerprint")
        fitted = B.fit(pack.drop("fingerprint")).join(world, F.lit(True))
        included = ("state_projection_ids", "decision_ids", "claim_ids", "evidence_ids", "hypothesis_ids", "unknown_ids", "recent_event_ids", "procedural_refs", "artifact_refs", "constraints", "gaps", "provenance_summary")
        identity = F.to_json(F.struct(*sorted(("version", "contract_version", "objective", "mode", "scope", "entity_ids", "token_budget", "fingerprint", *included))))
        return fitted.withColumn("context_pack_id", F.concat(F.lit("cp_"), F.left(F.sha2(identity, 256), F.lit(32)))).drop("fingerprint")

    def pack_rows(self, objective: str, mode: str = "OPERATIONAL", token_budget: int = 8000, entities: list[str] | None = None, requirements: tuple[str, ...] = (), since: str | None = None, generated_at: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(head, items): the pack of pack_row, with a row for each item of the lists that grow with the scope.

        items(list, item, entry): those of LONG_LISTS, provenance_summary for claims only and with its entries; in untold what names no
        source; in shortened what the shortened constraints restate, if they were. head: one row, the pack without these lists and without its id, which is
        a digest of one text of everything, but with n_ and their names; size, fits, minimum_required and trimmed are those of the whole pack. Lines of
        gaps that name untold or shortened objects are measured but left to the rows. Of the steps only the shortening of
        constraints touches a long list, and what it saves is a sum; items are stored once.
        """
        spark = self._world.frames["claim"].sparkSession
        n_events, n_evidence = MODES[mode]
        entity = entities[0] if entities and len(entities) == 1 else None
        claims, evidence = self._asserting(self.search(objective, entities, n_evidence), entity)
        evidence = _stored(evidence)  # as few rows as a mode takes
        line = F.concat_ws(": ", "decision_id", "decision")
        entry = F.lit(None).cast(claims.schema["entry"].dataType)
        in_list = lambda name, item, of=entry: F.struct(F.lit(name).alias("list"), item.alias("item"), of.alias("entry"))
        decided = G.active_decisions(self.all_of("decision")).select(F.inline(F.array(*[F.struct(F.lit(k).alias("list"), c.alias("item")) for k, c in (("decision_ids", F.col("decision_id")), ("constraints", line))])))
        open_of = [self.all_of(k).where(F.col("status").isin(*states)).select(F.lit(f"{k}_ids").alias("list"), F.col(OWN_ID[k]).alias("item")) for k, states in (("hypothesis", OPEN_HYPOTHESES), ("unknown", OPEN_UNKNOWNS))]
        wanted = spark.createDataFrame([(e,) for e in entities or []], "node string")
        reached = (wanted.unionByName(self.expand(entities).select("node")) if entities else wanted).distinct().select(F.lit("entity_ids").alias("list"), F.col("node").alias("item"))
        name, no_entry = F.col("object_id"), F.col("entry").isNull()
        told = claims.select(F.explode(F.when(no_entry, F.array(in_list("untold", name))).otherwise(F.array(in_list("claim_ids", name), in_list("provenance_summary", name, F.col("entry"))))).alias("x"), "level", "data_classes")
        told = told.select("x.*", *[F.when(F.col("x.entry").isNotNull(), F.col(c)).alias(c) for c in ("level", "data_classes")])
        silent = evidence.where(no_entry).select(F.lit("untold").alias("list"), name.alias("item"))
        items = _stored(reduce(lambda a, b: a.unionByName(b, True), [told, decided, *open_of, reached, silent]).where("item is not null"))

        of, text = (lambda k: F.col("list") == k), T.StringType()
        long = of("constraints") & (F.length("item") > B.LINE)
        total = lambda when, n: F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("long")
        size = F.when(of("provenance_summary"), B.tokens(F.col("entry"), items.schema["entry"].dataType)).otherwise(B.tokens(F.col("item"), text))
        sums = items.agg(
            *[F.count_if(of(k)).alias(f"n_{k}") for k in (*LONG_LISTS, "untold")], total(~of("untold"), size).alias("outside"), total(of("untold"), F.length("item")).alias("untold_letters"), F.count_if(long).alias("n_long"),
            total(long, F.length(F.split_part("item", F.lit(":"), F.lit(1)))).alias("long_letters"), total(long, B.tokens(F.col("item"), text) - B.tokens(B.shortened(F.col("item")), text)).alias("shorter"),
        )
        asserted = items.where(of("provenance_summary")).select("entry.object_type", "entry", "level", "data_classes").unionByName(evidence.select("entry.object_type", "entry", "level", "data_classes")).agg(*_told())
        found = evidence.agg(
            F.count("*").alias("n_hits"), F.array_sort(F.collect_list(F.when(~no_entry, name))).alias("evidence_ids"), F.array_sort(F.collect_list("entry"), _by_object).alias("provenance_summary"), _strengths(),
        )
        events = self.delta(since).where("change = 'RECENT_EVENT'").select("id").orderBy("id").limit(n_events).agg(F.array_sort(F.collect_list("id")).alias("recent_event_ids"))
        withheld = self.withheld().agg(F.sum("n").alias("n_withheld"))
        covered = self.coverage(since).select("coverage", F.col("as_of").alias("recorded_at"))
        row = reduce(lambda a, b: a.join(b, F.lit(True)), [sums, asserted, found, events, withheld, covered]).join(self._recorded(entity).select("as_of", "freshness_status"), F.lit(True), "left")  # one row each
        row = row.withColumn("other_level", F.when(F.col("n_decision_ids") + F.col("n_hypothesis_ids") + F.col("n_unknown_ids") > 0, "INTERNAL"))

        empty = F.array().cast(_IDS)
        counts = ("outside", "untold_letters", "n_long", "long_letters", "shorter", *[f"n_{k}" for k in (*LONG_LISTS, "untold")])
        head = row.select(
            *self._own(objective, mode, token_budget, requirements, generated_at), *[empty.alias(k) for k in LONG_LISTS if k != "provenance_summary"], F.when(F.col("as_of").isNotNull(), F.array(F.lit("sp_" + "0" * 24))).otherwise(empty).alias("state_projection_ids"),
            "evidence_ids", "recent_event_ids", F.array_sort(F.array_compact(F.array(*self._gaps(objective)))).alias("gaps"), "data_classes", "provenance_summary", "strengths", *counts,
        )
        untold = F.when(F.col("n_untold") > 0, B.letters_tokens(B.joined_length(F.col("n_untold"), F.col("untold_letters")) + F.length(F.col("n_untold").cast("string")) + len(UNTOLD))).otherwise(0)
        saved = F.col("shorter") - F.when(F.col("n_long") > 0, B.letters_tokens(B.trim_line_length("VERBOSE_SUMMARY", F.col("n_long"), F.col("long_letters")))).otherwise(0)
        head = head.withColumn("outside", F.col("outside") + untold).withColumn("whole", F.col("outside") + B.pack_tokens(head, ("strengths", *counts)))
        head = _stored(head.withColumn("shortens", ~((F.col("whole") <= token_budget) & (token_budget >= 1)) & (saved > 0)).withColumn("outside", F.col("outside") - F.when(F.col("shortens"), saved).otherwise(0)))
        one, counted = head.first(), [f"n_{k}" for k in (*LONG_LISTS, "untold")]
        # The rest is fitted to what the long lists leave of the budget.
        rest = head.drop(*counts, "whole", "shortens").withColumn("token_budget", F.lit(token_budget - one["outside"]).cast("long"))
        fitted = B.fit(rest).withColumns({"token_budget": F.lit(token_budget), "size": F.col("size") + one["outside"]}).withColumn("minimum_required", F.when(~F.col("fits"), F.col("size")))
        fitted = fitted.drop(*[k for k in LONG_LISTS if k != "provenance_summary"]).join(self.fingerprint(), F.lit(True)).withColumn("state_projection_ids", F.when(F.size("state_projection_ids") > 0, F.array(self._projection(entity))).otherwise(empty))
        fitted = fitted.drop("fingerprint").withColumns({c: F.lit(one[c]).cast("long") for c in counted} | {"n_shortened": F.lit(one["n_long"] if one["shortens"] else 0).cast("long")})
        items = items.select("list", "item", "entry")
        if one["shortens"]:
            restated = items.where(long).select(F.lit("shortened").alias("list"), F.split_part("item", F.lit(":"), F.lit(1)).alias("item"), "entry")
            items = items.withColumn("item", F.when(long, B.shortened(F.col("item"))).otherwise(F.col("item"))).unionByName(restated)
        return fitted, items

    def context_pack(self, objective: str, mode: str = "OPERATIONAL", token_budget: int = 8000, entities: list[str] | None = None, requirements: tuple[str, ...] = (), since: str | None = None, generated_at: str | None = None) -> dict:
        """pack_row as a dictionary, or BudgetTooSmall with the exact minimum. The only driver boundary of a read: one row."""
        row = self.pack_row(objective, mode, token_budget, entities, requirements, since, generated_at).first().asDict(recursive=True)
        told = {c: row.pop(c) for c in ("size", "fits", "minimum_required", "trimmed")}
        if not told["fits"]:
            raise BudgetTooSmall(token_budget, told["minimum_required"])
        return row


def _stored(rows: DataFrame) -> DataFrame:
    """rows, written once and read by all that follows."""
    at = scratch(rows.sparkSession)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def _line(condition: Column, *text: Column | str) -> Column:
    return F.when(condition, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))


def _strengths() -> Column:
    return F.map_from_entries(F.collect_list(F.when(F.col("strength").isNotNull(), F.struct("object_id", "strength")))).alias("strengths")


def _told() -> tuple[Column, Column]:
    """Aggregates: the highest level and the data classes of what has an entry."""
    told = F.col("entry").isNotNull()
    level = F.coalesce(S.highest_tier(F.when(told, F.coalesce("level", F.lit("INTERNAL")))), F.lit("PUBLIC"))
    return level.alias("asserted_level"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(told, F.coalesce("data_classes", F.array().cast(_IDS))))))).alias("data_classes")


def _by_object(a: Column, b: Column) -> Column:
    """Order of entries, whose locators have none."""
    one, other = (F.struct(e["object_type"], e["object_id"]) for e in (a, b))
    return F.when(one < other, -1).when(one > other, 1).otherwise(0)


def _newest(rows: DataFrame) -> Column:
    """The latest stamp that a row has."""
    stamps = [F.col(c) for c in ("occurred_at", "recorded_at", "created_at", "last_updated_at", "effective_from", "observed_at") if c in rows.columns]
    return F.greatest(*stamps, F.lit(None).cast("timestamp"))
