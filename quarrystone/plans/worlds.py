"""Queries that read a world through its scope: the tables as entities, claims, sources, fragments, evidence and decisions.

Sources are the documents' sources, evidence and fragments the documents, entities the customers, claims and decisions the
orders. The scope sees src3 and what is global; src10, every 17th evidence and every 50th entity are secret.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import checks as C
from ..operators import semantic as M
from ..operators.schemas import OWN_ID, SCHEMAS, VOCABULARIES
from ..operators.world import World
from ..sources.tables import table
from .reads import SCOPE, SINCE

_DAY = "2024-01-01 00:00:00"
DIRECTIONS, STRENGTHS = ("SUPPORTS", "CONTRADICTS", "NEUTRAL"), ("STRONG", "MODERATE", "WEAK")


def _frame(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """rows as objects of a kind; columns that are not given are null."""
    schema = rows.sparkSession.createDataFrame([], SCHEMAS[kind]).schema
    given = {"contract_version": F.lit("1.0.0"), "object_type": F.lit(kind)} | columns
    return rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _one_of(values: tuple[str, ...], number: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col(number) % len(values)).cast("int"))


def _scoped(is_global: Column, client: Column) -> dict[str, Column]:
    return {"scope_type": F.when(is_global, "GLOBAL").otherwise("CLIENT"), "scope_id": F.when(is_global, "GLOBAL").otherwise(client)}


def _day(number: Column) -> Column:
    return F.timestamp_add("DAY", number.cast("int"), F.to_timestamp(F.lit(_DAY)))


def world(spark, folder) -> World:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    of_source = _scoped(F.coalesce(F.substring("source", 4, 9).try_cast("int") % 10 == 0, F.lit(False)), F.col("source"))
    fragment, hashed = F.concat(F.lit("f"), "doc_id"), F.sha2(F.col("text"), 256)
    own = F.struct(F.col("source").alias("source_id"), fragment.alias("fragment_id"), F.create_map(F.lit("page"), (F.col("doc_id") % 7).cast("string")).alias("locator"), _day(F.col("doc_id") % 60).alias("observed_at"), F.lit(None).cast("timestamp").alias("captured_at"), hashed.alias("content_hash"))
    third, fifth = F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0
    people = table(spark, folder, "customer").select("c_custkey", "c_name")
    mine = lambda c: _scoped(F.col(c) % 3 == 0, F.when(F.col(c) % 3 == 1, "src3").otherwise("src4"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    key = F.col("o_orderkey")
    before = F.when(key % 7 == 0, F.concat(F.lit("d"), (key - 1).cast("string")))
    return World.of(spark, {
        "source": _frame(docs.select("source").distinct(), "source", source_id=F.col("source"), title=F.concat(F.lit("title of "), "source"), content_hash=F.sha2("source", 256), level=F.when(F.col("source") == "src10", "SECRET").otherwise("INTERNAL"), **of_source),
        "fragment": _frame(docs.where(third), "fragment", fragment_id=fragment, source_id=F.col("source"), content=F.col("text"), content_hash=hashed),
        "evidence": _frame(
            docs, "evidence", evidence_id=F.concat(F.lit("v"), "doc_id"), source_id=F.col("source"), fragment_ids=F.when(third, F.array(fragment)).otherwise(F.array().cast("array<string>")),
            direction=_one_of(DIRECTIONS, "doc_id"), strength=_one_of(STRENGTHS, "doc_id"), provenance=F.when(fifth, F.array(own)), level=F.when(F.col("doc_id") % 17 == 0, "SECRET").otherwise("INTERNAL"),
            data_classes=F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("PII"))), created_at=_day(F.col("doc_id") % 60), **of_source,
        ),
        "entity": _frame(people, "entity", entity_id=F.concat(F.lit("e"), "c_custkey"), canonical_name=F.col("c_name"), level=F.when(F.col("c_custkey") % 50 == 0, "SECRET").otherwise("INTERNAL"), **mine("c_custkey")),
        "claim": _frame(
            orders, "claim", claim_id=F.concat(F.lit("c"), "o_orderkey"), subject_entity_id=F.concat(F.lit("e"), "o_custkey"), predicate=_one_of(("owns", "supplies"), "o_orderkey"), object_entity_id=F.when(key % 4 != 0, F.concat(F.lit("e"), (key % 100 + 1).cast("string"))),
            object_value=F.when(key % 4 == 0, (key % 9).cast("string")), status=F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("SUPERSEDED"), source_ids=F.when(key % 2 == 0, F.array(F.lit("src3"), F.lit("src0"))), level=F.lit("INTERNAL"),
            supporting_evidence_ids=F.array(F.concat(F.lit("v"), (key % 97).cast("string"))), created_at=_day(key % 40), last_updated_at=_day(key % 50), **mine("o_orderkey"),
        ),
        "decision": _frame(orders, "decision", decision_id=F.concat(F.lit("d"), "o_orderkey"), decision=F.concat(F.lit("ship "), "o_custkey"), status=F.when(F.col("o_orderstatus") != "F", "ACTIVE").otherwise("SUPERSEDED"), supersedes=before, created_at=_day(key % 45), **mine("o_orderkey")),
    })


def changing_world(spark, folder) -> World:
    """The world with everything that changes: claims in every state, hypotheses, unknowns, events, projections."""
    frames = dict(world(spark, folder).frames)
    key = F.substring("claim_id", 2, 12).cast("long")
    frames["claim"] = frames["claim"].withColumns({
        "status": F.when((F.col("status") != "ACTIVE") & (key % 11 == 0), "DISPUTED").when((F.col("status") != "ACTIVE") & (key % 3 == 1), "RETRACTED").otherwise(F.col("status")), "epistemic_status": F.when(key % 13 == 0, "CONFLICTING").otherwise("DECLARED"),
        "counter_evidence_ids": F.when(key % 17 == 0, F.array(F.concat(F.lit("v"), (key % 50).cast("string")), F.lit("v1"))),
    })
    frames["decision"] = frames["decision"].withColumn("effective_from", F.timestamp_add("DAY", F.lit(1), "created_at"))
    mine = lambda c: _scoped(F.col(c) % 3 == 0, F.when(F.col(c) % 3 == 1, "src3").otherwise("src4"))
    part, supplier = table(spark, folder, "part").select("p_partkey"), table(spark, folder, "supplier").select("s_suppkey")
    frames["hypothesis"] = _frame(part, "hypothesis", hypothesis_id=F.concat(F.lit("h"), "p_partkey"), status=_one_of(VOCABULARIES["hypothesis", "status"], "p_partkey"), next_best_learning=F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("ask "), "p_partkey")), created_at=_day(F.col("p_partkey") % 20), last_updated_at=_day(F.col("p_partkey") % 30), **mine("p_partkey"))
    frames["unknown"] = _frame(supplier, "unknown", unknown_id=F.concat(F.lit("u"), "s_suppkey"), statement=F.lit("?"), status=_one_of(VOCABULARIES["unknown", "status"], "s_suppkey"), priority=_one_of(VOCABULARIES["unknown", "priority"], "s_suppkey"), created_at=_day(F.lit(3)), last_updated_at=_day(F.col("s_suppkey") % 25 + 3), **mine("s_suppkey"))
    events = table(spark, folder, "events").select("event_id", "ts")
    frames["event"] = _frame(events, "event", event_id=F.concat(F.lit("x"), "event_id"), occurred_at=F.timestamp_add("DAY", -(F.col("event_id") % 40).cast("int"), "ts"), recorded_at=F.col("ts"), **mine("event_id"))
    frames["state_projection"] = _frame(table(spark, folder, "nation").select("n_nationkey"), "state_projection", state_projection_id=F.concat(F.lit("sp"), "n_nationkey"), **mine("n_nationkey"))
    return World.of(spark, frames)


def world_source_pointers(spark, folder):
    rows = world(spark, folder).scoped(SCOPE).source_pointers()
    return rows.withColumns({"locator": F.array_join(F.transform(F.map_entries("locator"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"), "observed_at": F.date_format("observed_at", "yyyy-MM-dd")})


def world_provenance(spark, folder):
    mine = world(spark, folder).scoped(SCOPE)
    rows = mine.provenance("claim").unionByName(mine.provenance("evidence"))
    return rows.select("object_id", F.array_join("source_ids", ",").alias("sources"))


def world_unprovenanced(spark, folder):
    """Active claims that a pack leaves out, as they can name no source."""
    mine = world(spark, folder).scoped(SCOPE)
    return mine.all_of("claim").where("status = 'ACTIVE'").select("claim_id").join(mine.provenance("claim").select(F.col("object_id").alias("claim_id")), "claim_id", "left_anti")


def world_constraints(spark, folder):
    return world(spark, folder).scoped(SCOPE).constraints()


def world_relations(spark, folder):
    return world(spark, folder).scoped(SCOPE).relations("e1")


def world_expansion(spark, folder):
    return world(spark, folder).scoped(SCOPE).expand(["e1", "e3"], 2)


def world_filtered_search(spark, folder):
    """Evidence that supports, found by words and by links of claims about an entity."""
    hits = world(spark, folder).scoped(SCOPE).search("nation heed src3 title", ["e1"], 40, {"direction": "SUPPORTS", "strength": "STRONG"})
    return hits.select("evidence_id", "relational", "score")


def world_withheld(spark, folder):
    return world(spark, folder).scoped(SCOPE).withheld()


def world_delta(spark, folder):
    return changing_world(spark, folder).scoped(SCOPE).delta(SINCE)


def world_coverage(spark, folder):
    """Whether the record reaches back to a moment, before its start and after."""
    mine = changing_world(spark, folder).scoped(SCOPE)
    rows = [mine.coverage(since).select(F.lit(since).alias("since"), "coverage", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("earliest", "as_of")]) for since in (SINCE, "2020-01-01 00:00:00")]
    return reduce(DataFrame.unionByName, rows)


def world_conflicts(spark, folder):
    return changing_world(spark, folder).scoped(SCOPE).conflicts().withColumn("evidence_ids", F.array_join("evidence_ids", ","))


def world_pack(spark, folder):
    """The pack of everything that concerns one entity, in a budget that holds it."""
    head, items = changing_world(spark, folder).scoped(SCOPE).pack_rows("nation heed", "RESEARCH", 2_000_000_000, ["e1"], ("first", "second"), SINCE)
    lists = ("entity_ids", "decision_ids", "claim_ids", "evidence_ids", "hypothesis_ids", "unknown_ids", "recent_event_ids", "constraints", "data_classes")
    long = [c for c in lists if c not in head.columns]
    digests = I.joined_md5(items.where(F.col("list").isin(*long)), "list", "item")
    told = digests.agg(*[F.coalesce(F.max(F.when(F.col("list") == c, F.col("md5"))), F.md5(F.lit(""))).alias(c) for c in long])
    n_told = (F.size("provenance_summary") + F.col("n_provenance_summary")).cast("long").alias("n_provenance")
    return head.join(told, F.lit(True)).select("mode", "sensitivity_level", "freshness_status", "fits", n_told, *[F.col(c) if c in long else F.md5(F.array_join(c, ",")).alias(c) for c in lists])


def world_tier(spark, folder):
    """The level and the classes of everything that a pack of all visible evidence and claims would hold."""
    mine = world(spark, folder).scoped(SCOPE)
    ids = [mine.all_of(k).select(F.col(OWN_ID[k]).alias("object_id")) for k in ("evidence", "claim")]
    return mine.tier_of(reduce(DataFrame.unionByName, ids)).select("level", F.array_join("data_classes", ",").alias("data_classes"))


def world_state(spark, folder):
    """Ids of everything in force or open, a row each."""
    return changing_world(spark, folder).scoped(SCOPE).state_ids()


def world_state_summary(spark, folder):
    row = changing_world(spark, folder).scoped(SCOPE).state()
    return row.select("n_claims", "n_decisions", "n_hypotheses", "n_unknowns", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"), "next_best_learning", "freshness_status")


def world_trace(spark, folder):
    return world(spark, folder).scoped(SCOPE).trace("nation heed", ["e1"])


def world_faults(spark, folder):
    """Objects of the twelve types that break a structural rule, counted by type and rule."""
    return world(spark, folder).faults().groupBy("object_type", "code").agg(F.count("*").alias("n"))


def semantic_faults(spark, folder):
    """How often the objects of the world, claims with every status, break each rule of meaning."""
    frames = dict(world(spark, folder).frames)
    number = F.substring("claim_id", 2, 12).try_cast("long")
    status = F.get(F.array(*map(F.lit, C.STATUSES)), (number % 9).cast("int"))
    value = F.when(number % 11 == 0, F.lit("NO_EVIDENCE_FOUND")).when(number % 13 == 0, F.lit("false")).when(number % 17 == 0, F.lit('{"a": [{ "Tok\\u0065n" : 1}]}')).when(number % 19 == 0, F.lit('{"a": "\\"token\\":"}')).otherwise(F.col("object_value"))
    frames["claim"] = frames["claim"].withColumns({"epistemic_status": status, "object_value": value, "data_classes": F.when(number % 23 == 0, F.array(F.lit("SECRET")))})
    return M.worst_first(M.faults(frames))


def pack_references(spark, folder):
    """Orders as packs: every object that one names, once."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("context_pack_id"))
    name = lambda letter, c: F.collect_list(F.concat(F.lit(letter), F.col(c).cast("string")))
    packs = lines.agg(name("p", "l_partkey").alias("claim_ids"), name("s", "l_suppkey").alias("evidence_ids"), name("s", "l_suppkey").alias("entity_ids"))
    return C.referenced_ids(packs)


QUERIES = {f.__name__: f for f in (
    world_source_pointers, world_provenance, world_unprovenanced, world_constraints, world_relations, world_expansion, world_filtered_search, world_withheld, world_delta, world_coverage, world_conflicts, world_pack, world_tier, world_state, world_state_summary, world_trace, world_faults, semantic_faults, pack_references,
)}

_MINE = "case when {0} % 3 = 0 then 'GLOBAL' when {0} % 3 = 1 then 'src3' else 'src4' end in ('GLOBAL', 'src3')"
_WORLD = f"""src as (select distinct source from documents where source = 'src3' or try_cast(substr(source, 4) as int) % 10 = 0 and source <> 'src10'),
ev as (select *, 'v' || doc_id as evidence_id, case when doc_id % 3 = 0 then 'f' || doc_id end as fragment_id from documents where (source = 'src3' or try_cast(substr(source, 4) as int) % 10 = 0) and doc_id % 17 <> 0),
en as (select 'e' || c_custkey as entity_id, c_name from customer where {_MINE.format("c_custkey")} and c_custkey % 50 <> 0),
cl as (select 'c' || o_orderkey as claim_id, 'e' || o_custkey as subject, ['owns', 'supplies'][o_orderkey % 2 + 1] as predicate, case when o_orderkey % 4 <> 0 then 'e' || (o_orderkey % 100 + 1) end as object, case when o_orderkey % 4 = 0 then (o_orderkey % 9)::varchar end as value,
  o_orderstatus = 'O' as active, o_orderkey % 2 = 0 as told, 'v' || (o_orderkey % 97) as evidence_id, o_orderkey from orders where {_MINE.format("o_orderkey")}),
de as (select 'd' || o_orderkey as decision_id, 'ship ' || o_custkey as decision, o_orderstatus <> 'F' as active, case when o_orderkey % 7 = 0 then 'd' || (o_orderkey - 1) end as supersedes, o_orderkey from orders where {_MINE.format("o_orderkey")}),
de_active as (select * from de where active and decision_id not in (select supersedes from de where supersedes is not null)),
pointers as (select evidence_id, source as source_id, 'f' || doc_id as fragment_id, 'page=' || (doc_id % 7) as locator, strftime(date '2024-01-01' + (doc_id % 60)::int, '%Y-%m-%d') as observed_at, sha256(text) as content_hash from ev where doc_id % 5 = 0
  union all select evidence_id, source, fragment_id, null, null, case when fragment_id is null then sha256(source) else sha256(text) end from ev join src using (source) where doc_id % 5 <> 0),
edges as (select subject as src, object as dst from cl where object in (select entity_id from en))"""
_STATUSES = "['" + "','".join(C.STATUSES) + "']"
_SCOPE_ID = "case when {0} % 3 = 0 then 'GLOBAL' when {0} % 3 = 1 then 'src3' else 'src4' end"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


def _hits(words: list[str], limit: int, extra: str, linked: str = "select evidence_id from cl where subject = 'e1'") -> str:
    """Hits of a search about e1: a link is worth 0.7 x 0.6, all words 0.4. Only a visible source gives its title; a pointer is needed."""
    text = "concat_ws(' ', case when seen is not null then 'title of ' || source end, case when doc_id % 3 = 0 and seen is not null then coalesce(text, '') end)"
    return f"""texts as (select ev.*, {_WORDS.format(text)} as words from ev left join (select source as seen from src) on seen = source where {extra} and evidence_id in (select evidence_id from pointers)),
scored as (select evidence_id, doc_id, case when evidence_id in ({linked}) then 0.7 else 0.0 end::double as relational,
  len(list_filter({words}, lambda w: list_contains(words, w))) / {len(words)}.0 as lexical from texts),
hits as (select evidence_id, relational, lexical, round((0.6 * relational + 0.4 * lexical)::double, 6) as score from scored where round((0.6 * relational + 0.4 * lexical)::double, 6) >= 0.01 order by score desc, doc_id % 3, evidence_id limit {limit})"""


#: What the world's objects lack: a type, how many there are, and the required columns that none of them has.
_LACKING = (
    ("entity", "count(*) from customer", ("entity_type", "aliases", "status", "created_at", "last_updated_at")), ("claim", "count(*) from orders", ("epistemic_status", "counter_evidence_ids")),
    ("source", "count(distinct source) from documents", ("source_type", "origin", "captured_at", "ingested_at", "data_classes", "trust_class", "instruction_authority", "status", "metadata")),
    ("fragment", "count(*) from documents where doc_id % 3 = 0", ("fragment_type", "created_at", "provenance")), ("evidence", "count(*) from documents", ("evidence_type", "epistemic_status")), ("decision", "count(*) from orders", ("title", "effective_from", "source_ids")),
)
#: States of everything that changes, beside the world.
_CHANGING = f"""cc as (select cl.*, cl.o_orderkey as n, cl.o_orderkey % 3 = 0 as global, case when cl.active then 'ACTIVE' when cl.o_orderkey % 11 = 0 then 'DISPUTED' when cl.o_orderkey % 3 = 1 then 'RETRACTED' else 'SUPERSEDED' end as status from cl),
hy as (select p_partkey as n from part where {_MINE.format("p_partkey")}), un as (select s_suppkey as n from supplier where {_MINE.format("s_suppkey")}), xs as (select event_id as n, ts from events where {_MINE.format("event_id")})"""
_IDS = "md5(coalesce(string_agg({0}, ',' order by {0}), ''))"
ORACLE_SQL = {
    "world_source_pointers": f"with {_WORLD} select * from pointers",
    "world_provenance": f"with {_WORLD} select claim_id as object_id, 'src0,src3' as sources from cl where told union all select evidence_id, source from ev",
    "world_unprovenanced": f"with {_WORLD} select claim_id from cl where active and not told",
    "world_constraints": f"with {_WORLD} select decision_id || ': ' || decision as line from de_active",
    "world_relations": f"with {_WORLD} select predicate, object as object_entity_id, claim_id from cl where subject = 'e1' and object in (select entity_id from en)",
    "world_expansion": f"""with {_WORLD}, one as (select distinct dst from edges where src in ('e1', 'e3') and dst not in ('e1', 'e3')), two as (select distinct dst from edges where src in (select dst from one) and dst not in ('e1', 'e3') and dst not in (select dst from one))
select dst as node, 1 as depth from one union all select dst, 2 from two""",
    "world_filtered_search": f"with {_WORLD}, {_hits(['nation', 'heed', 'src3', 'title'], 40, 'doc_id % 3 = 0')} select evidence_id, relational, score from hits",
    "world_withheld": f"""select 'entity' as object_type, count(*) as n from customer where {_MINE.format("c_custkey")} and c_custkey % 50 = 0 union all select 'source', count(distinct source) from documents where source = 'src10'
union all select 'claim', 0 union all select 'evidence', count(*) from documents where (source = 'src3' or try_cast(substr(source, 4) as int) % 10 = 0) and doc_id % 17 = 0 union all select 'decision', 0""",
    "world_delta": f"""with {_WORLD}, {_CHANGING} select 'NEW_CLAIM' as change, 'claim' as object_type, claim_id as id, null::bigint as late_days from cc where active and n % 40 > 9
union all select 'SUPERSEDED_CLAIM', 'claim', claim_id, null from cc where status in ('SUPERSEDED', 'RETRACTED') and n % 50 > 9 union all select 'DECISION_CHANGE', 'decision', decision_id, null from de where o_orderkey % 45 + 1 > 9
union all select 'HYPOTHESIS_CHANGE', 'hypothesis', 'h' || n, null from hy where n % 30 > 9 union all select 'RESOLVED_UNKNOWN', 'unknown', 'u' || n, null from un where n % 4 > 1 and n % 25 + 3 > 9
union all select 'RECENT_EVENT', 'event', 'x' || n, case when n % 40 > 30 then n % 40 end from xs where ts > timestamp '{SINCE}' union all select 'STATE_TRANSITION', 'state_projection', 'sp' || n_nationkey, null from nation where {_MINE.format("n_nationkey")}""",
    "world_coverage": f"""with {_WORLD}, {_CHANGING}, t as (select timestamp '2024-01-01' + to_days((n % 40)::int) as first, timestamp '2024-01-01' + to_days(greatest(n % 40, n % 50)::int) as last from cc
  union all select timestamp '2024-01-01' + to_days((o_orderkey % 45)::int), timestamp '2024-01-01' + to_days((o_orderkey % 45 + 1)::int) from de union all select timestamp '2024-01-01' + to_days((n % 20)::int), timestamp '2024-01-01' + to_days(greatest(n % 20, n % 30)::int) from hy
  union all select timestamp '2024-01-04', timestamp '2024-01-04' + to_days((n % 25)::int) from un union all select ts - to_days((n % 40)::int), ts from xs), m as (select min(first) as a, max(last) as z from t)
select since, case when since::timestamp < a then 'PARTIAL_NO_RECORD_BEFORE' else 'COVERED' end as coverage, strftime(a, '%Y-%m-%d %H:%M:%S') as earliest, strftime(z, '%Y-%m-%d %H:%M:%S') as as_of from m, (values ('{SINCE}'), ('2020-01-01 00:00:00')) s(since)""",
    "world_conflicts": f"""with {_WORLD}, {_CHANGING}, g as (select subject, predicate, count(*) as n, count(distinct coalesce(value, 'None')) as v from cc where active group by all)
select case when status = 'DISPUTED' or n % 13 = 0 then 'claim ' || claim_id || ' is recorded as being in conflict (' || case when n % 13 = 0 then 'CONFLICTING' else 'DECLARED' end || '/' || status || ')'
  else 'claim ' || claim_id || ' has evidence against it that has not been reconciled' end as description, claim_id, case when n % 17 = 0 then array_to_string(list_sort(['v' || (n % 50), 'v1']), ',') else '' end as evidence_ids from cc where status = 'DISPUTED' or n % 13 = 0 or n % 17 = 0
union all select g.n || ' active claims disagree about ' || chr(39) || predicate || chr(39) || ' for ' || subject, claim_id, '' from cc join g using (subject, predicate) where active and g.n > 1 and v > 1""",
    "world_pack": f"""with {_WORLD}, {_CHANGING}, {_hits(['nation', 'heed'], 25, 'true', "select evidence_id from cl where subject = 'e1' union all select unnest(['v' || (n % 50), 'v1']) from cc where subject = 'e1' and n % 17 = 0")}, mc as (select * from cc where active and (global or subject = 'e1' or coalesce(object, '') = 'e1')), told as (select claim_id as id, 'C' as kind from mc where n % 2 = 0 union all select evidence_id, 'E' from hits),
xe as (select 'x' || n as id from xs where ts > timestamp '{SINCE}' order by 1 limit 3), reached as (select distinct dst from edges where src = 'e1' union select 'e1')
select 'RESEARCH' as mode, 'INTERNAL' as sensitivity_level, 'FRESH' as freshness_status, true as fits, (select count(*) from told) as n_provenance, (select {_IDS.format("dst")} from reached) as entity_ids, (select {_IDS.format("decision_id")} from de_active) as decision_ids,
  (select {_IDS.format("id")} from told where kind = 'C') as claim_ids, (select {_IDS.format("id")} from told where kind = 'E') as evidence_ids, (select {_IDS.format("'h' || n")} from hy where n % 6 < 3) as hypothesis_ids, (select {_IDS.format("'u' || n")} from un where n % 4 < 2) as unknown_ids,
  (select {_IDS.format("id")} from xe) as recent_event_ids, (select {_IDS.format("decision_id || ': ' || decision")} from de_active) as constraints, (select {_IDS.format("c")} from (select distinct 'PII' as c from ev join hits using (evidence_id) where ev.doc_id % 4 = 0)) as data_classes""",
    "world_tier": f"""with {_WORLD}, named as (select evidence_id as id, 'INTERNAL' as level, case when doc_id % 4 = 0 then 'PII' end as class from ev union all select claim_id, 'INTERNAL', null from cl)
select max(level) as level, coalesce(string_agg(distinct class, ','), '') as data_classes from named""",
    "world_state": f"""with {_WORLD}, {_CHANGING} select 'ACTIVE_DECISION' as kind, decision_id as id from de_active union all select 'CURRENT_CLAIM', claim_id from cc where active
union all select 'OPEN_HYPOTHESIS', 'h' || n from hy where n % 6 < 3 union all select 'OPEN_UNKNOWN', 'u' || n from un where n % 4 < 2""",
    "world_state_summary": f"""with {_WORLD}, {_CHANGING} select (select count(*) from cc where active) as n_claims, (select count(*) from de_active) as n_decisions, (select count(*) from hy where n % 6 < 3) as n_hypotheses, (select count(*) from un where n % 4 < 2) as n_unknowns,
  strftime(timestamp '2024-01-01' + to_days(greatest((select max(greatest(n % 40, n % 50)) from cc), (select max(o_orderkey % 45 + 1) from de), (select max(greatest(n % 20, n % 30)) from hy), (select max(n % 25 + 3) from un))::int), '%Y-%m-%d %H:%M:%S') as as_of,
  (select 'ask ' || arg_min(n, 'h' || n) from hy where n % 6 < 3 and n % 4 = 0) as next_best_learning, 'FRESH' as freshness_status""",
    "world_trace": f"""with {_WORLD}, {_hits(['nation', 'heed'], 25, 'true')} select 'ENTITY_RESOLUTION' as stage, true as available, count(*) as n from en where entity_id = 'e1' union all select 'SCOPE_GUARD', true, count(*) from ev
union all select 'CURRENT_STATE', true, count(*) from cl where active union all select 'STRUCTURED_RELATIONAL', true, count(*) from hits where relational > 0 union all select 'LEXICAL', true, count(*) from hits where lexical > 0
union all select 'RELATION_EXPANSION', true, count(distinct dst) from edges where src = 'e1' and dst <> 'e1' union all select 'RAW_SOURCE_POINTER', true, count(*) from pointers where evidence_id in (select evidence_id from hits) union all select 'SEMANTIC', false, null""",
    "world_faults": "with n(object_type, n, codes) as (" + " union all ".join(f"select '{k}', (select {n}), {['REQUIRED_' + c.upper() for c in codes]}" for k, n, codes in _LACKING)
    + ") select object_type, unnest(codes) as code, n from n where n > 0 union all select 'claim', 'REQUIRED_SOURCE_IDS', count(*) from orders where o_orderkey % 2 <> 0 having count(*) > 0",
    "semantic_faults": f"""with cl as (select o_orderkey as n, {_STATUSES}[o_orderkey % 9 + 1] as status, o_orderkey % 2 = 0 as told, {_SCOPE_ID.format("o_orderkey")} as scope, o_orderkey % 97 as doc from orders),
ev as (select doc_id, case when try_cast(substr(source, 4) as int) % 10 = 0 then 'GLOBAL' else source end as scope from documents),
de as (select o_orderkey as n, o_orderstatus <> 'F' as active from orders), links as (select c.*, e.doc_id, e.scope as e_scope from cl c left join ev e on e.doc_id = c.doc),
found as (select 'EPISTEMIC_PROVENANCE_REQUIRED' as code from cl where status in ('OBSERVED', 'MEASURED') and not told
  union all select 'NO_EVIDENCE_FOUND_MISLABELLED' from cl where n % 11 = 0 and status <> 'UNKNOWN' union all select 'NO_EVIDENCE_SERIALIZED_AS_FALSE' from cl where n % 11 <> 0 and n % 13 = 0 and status = 'UNKNOWN'
  union all select 'FORBIDDEN_FIELD' from cl where n % 11 <> 0 and n % 13 <> 0 and n % 17 = 0 union all select 'SENSITIVITY_AXIS_CONFLATED' from cl where n % 23 = 0
  union all select 'CLAIM_BROKEN_EVIDENCE_REFERENCE' from links where doc_id is null union all select case when scope <> 'GLOBAL' then 'CROSS_CLIENT_REFERENCE' else 'CROSS_SCOPE_REFERENCE' end from links where e_scope <> scope and e_scope <> 'GLOBAL'
  union all select 'GENERIC_EVIDENCE_CANNOT_GROUND_ENTITY_OBSERVATION' from links where e_scope = 'GLOBAL' and scope <> 'GLOBAL' and status in ('OBSERVED', 'MEASURED')
  union all select case when o.n is null then 'SUPERSEDES_BROKEN_REFERENCE' else 'SUPERSEDED_DECISION_STILL_ACTIVE' end from de d left join de o on o.n = d.n - 1 where d.n % 7 = 0 and (o.n is null or o.active))
select code, case when code in ('CROSS_CLIENT_REFERENCE', 'NO_EVIDENCE_SERIALIZED_AS_FALSE', 'FORBIDDEN_FIELD') then 'CRITICAL' else 'ERROR' end as severity, count(*) as n from found group by all""",
    "pack_references": """select distinct l_orderkey::varchar as context_pack_id, unnest(['p' || l_partkey, 's' || l_suppkey]) as object_id from lineitem""",
}
