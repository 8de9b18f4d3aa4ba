"""Queries of stored packs, compiled items and the checks between objects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import compile as K
from ..operators import stored as R
from ..sources.tables import table
from .reads import SCOPE
from .work import _BAD, _FINDINGS, _NAMES, _leaves

AS_OF = "2024-03-01 00:00:00"


def knowledge_read(spark, folder):
    """Documents as stored knowledge: in force, of the scope, newest approval first."""
    docs, day = table(spark, folder, "documents").select("doc_id", "source"), F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    client = F.col("source") != "src0"
    rows = docs.select(
        F.col("doc_id").alias("knowledge_id"), F.element_at(F.array(*map(F.lit, ("PATTERN", "FIX", "NOTE", "CHECKLIST"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("knowledge_type"),
        F.lit(None).cast("string").alias("title"), F.col("source").alias("summary"), F.element_at(F.array(*map(F.lit, C.STATUSES)), (F.col("doc_id") % 9 + 1).cast("int")).alias("epistemic_status"),
        F.when(client, "CLIENT").otherwise("GLOBAL").alias("scope_type"), F.when(client, F.col("source")).otherwise("GLOBAL").alias("scope_id"), F.when(F.col("doc_id") % 6 == 0, "RETIRED").otherwise("ACTIVE").alias("lifecycle_state"),
        F.when(F.col("doc_id") % 3 != 0, F.timestamp_add("DAY", (F.col("doc_id") % 90).cast("int"), day)).alias("valid_until"), F.when(F.col("doc_id") % 7 != 0, F.timestamp_add("DAY", (F.col("doc_id") % 50).cast("int"), day)).alias("approved_at"),
        *[F.lit(None).cast("string").alias(c) for c in ("data_classification", "compatibility_status", "observed_version", "node_type", "instruction_authority")],
    )
    items = R.knowledge_items(rows, None, SCOPE, F.to_timestamp(F.lit(AS_OF)), 40)
    return items.select("item_id", "title", "scope_id", "epistemic_status", "authority", "data_classification", "instruction_authority")


def experience_read(spark, folder):
    """Events as own runs: those of the environment first, then the newest."""
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("experience_id"), F.lit("GLOBAL").alias("scope_type"), F.lit("GLOBAL").alias("scope_id"), F.get(F.array(*map(F.lit, ("DEV", "TEST", "STAGING"))), (F.col("user_id") % 3).cast("int")).alias("environment"),
        F.col("event_type").alias("category"), F.lit("late").alias("observed_error"), F.when(F.col("event_id") % 2 == 0, "cause").alias("hypothesis"), F.lit(None).cast("string").alias("change_summary"), F.lit("red").alias("result_before"), F.lit("green").alias("result_after"),
        F.when(F.col("event_id") % 5 == 0, "MEASURED").when(F.col("event_id") % 5 == 1, "INFERRED").alias("epistemic_status"), F.lit("1").alias("version"), F.lit("http").alias("node"), F.col("ts").alias("created_at"),
    )
    return R.experience_items(rows, None, SCOPE, "TEST", 30).select("item_id", "title", "summary", "epistemic_status", "authority", "relevance")


def projection_decisions(spark, folder):
    """Customers' projections that list every order as an active decision, some an unknown one."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    held = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    projections = held.select("id", F.when(F.col("id") % 50 == 0, F.concat("ids", F.array(F.lit(-1).cast("long")))).otherwise(F.col("ids")).alias("active_decision_ids"))
    decisions = orders.select(F.col("o_orderkey").alias("decision_id"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "F", "SUPERSEDED").alias("status"))
    return C.projection_faults(projections, decisions).groupBy("id", "code").agg(F.count("*").alias("n"))


def pack_provenance(spark, folder):
    """Orders as packs of claims about parts: those of returned lines have no entry, open lines an empty one."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.min("l_suppkey").alias("supplier"))
    claim = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    entry = F.when(F.col("flag") != "R", F.struct(claim.alias("key"), F.when(F.col("status") == "F", F.array(F.col("supplier").cast("string"))).otherwise(F.array(F.lit(""))).alias("value")))
    packs = lines.groupBy(F.col("l_orderkey").alias("pack_id")).agg(F.collect_list(claim).alias("claim_ids"), F.map_from_entries(F.collect_list(entry)).alias("provenance"))
    return C.provenance_faults(packs.withColumn("evidence_ids", F.lit(None).cast("array<string>")))


def stored_promotions(spark, folder):
    """Orders as claims that replace the customer's order before; every fortieth replaces one that is not there."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    names = F.array(*map(F.lit, C.STATUSES[:7]))
    claims = orders.select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 40 == 0, F.lit(-1).cast("long")).otherwise(before).alias("supersedes"), F.get(names, (F.col("o_orderkey") % 7).cast("int")).alias("epistemic_status"))
    return C.stored_promotions(claims)


def run_journal_faults(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"), F.get(F.array(*map(F.lit, ("PLANNING", "DRAFT", "NOPE", "TESTING"))), (F.col("event_id") % 4).cast("int")).alias("phase"), (F.col("event_id") % 7).alias("attempts"),
        F.when(F.col("user_id") % 11 == 0, "PRODUCTION").otherwise("DEV").alias("environment"), F.when(F.col("event_id") % 5 == 0, "GLOBAL").otherwise("CLIENT").alias("scope_type"), F.when(F.col("event_id") % 10 == 0, "GLOBAL").otherwise("c").alias("scope_id"),
    )
    return C.run_faults(rows)


def common_types(spark, folder):
    return K.most_common(table(spark, folder, "part").select("p_type"), "p_type")


def _found(nodes):
    return nodes.select("path").distinct().select("path", F.sha2("path", 256).alias("sha256"), F.lit(None).cast("string").alias("parse_error"))


def _compiled(spark, folder):
    nodes, leaves = _leaves(spark, folder)
    edges = spark.createDataFrame([], "path string, source string, channel string, output int, target string, input int")
    from ..operators import analyze as A

    return K.items(_found(nodes), nodes, leaves, edges, A.findings(nodes, leaves), "example/flows", "a" * 40)


def compiled_items(spark, folder):
    """Pages as workflows, compiled: what an item holds, and how many of its records the rules refuse."""
    rows = _compiled(spark, folder)
    return rows.select("source_path", "node_count", F.array_join("integrations", ",").alias("integrations"), F.size("security_findings").alias("n_findings"), "max_severity", "knowledge_role", "learning_scope", "structure_reference_allowed")


def compiled_records(spark, folder):
    """Keys of the three tables' rows of the compiled items that break no rule."""
    rows = _compiled(spark, folder)
    parts = K.records(rows.join(K.item_faults(rows).select("source_path"), "source_path", "left_anti"), "1.0")
    both = parts["items"].select("item_id", "analysis_id").join(parts["analyses"].select("analysis_id", "source_id"), "analysis_id").join(parts["sources"].select("source_id", "source_path"), "source_id")
    return both.select("source_path", "source_id", "analysis_id", "item_id")


def corpus_gate(spark, folder):
    """Rules that a corpus must show and does not."""
    from ..operators import analyze as A

    nodes, leaves = _leaves(spark, folder)
    hits = A.findings(nodes, leaves).select(F.array("rule_id").alias("rules"))
    return K.corpus_gate(hits, ["EXECUTE_COMMAND", "CUSTOM_CODE", "SSH_EXECUTION", "DECRYPTED_CREDENTIAL_EXPORT"])


QUERIES = {f.__name__: f for f in (knowledge_read, experience_read, projection_decisions, pack_provenance, stored_promotions, run_journal_faults, common_types, compiled_items, compiled_records, corpus_gate)}

_STATUSES = "['" + "','".join(C.STATUSES) + "']"
_ROLE = "case severity when 'CRITICAL' then 'SECURITY_EXAMPLE' when 'HIGH' then 'QUARANTINED' when 'MEDIUM' then 'STRUCTURE_ONLY' else 'REFERENCE' end"
_SCOPE_OF = "case severity when 'CRITICAL' then 'security_only' when 'HIGH' then 'review_only' when 'MEDIUM' then 'structure_only' else 'structure_and_metadata' end"
_PATHS = f"""{_FINDINGS}, w as (select path, count(*) as node_count, string_agg(distinct 'n8n-nodes-base.' || kind, ',' order by 'n8n-nodes-base.' || kind) as integrations from nodes group by path),
f as (select path, count(*) as n from hits group by path), all_paths as (select w.*, coalesce(f.n, 0)::int as n_findings, coalesce(d.severity, 'INFO') as severity from w left join f using (path) left join decided d using (path))"""
ORACLE_SQL = {
    "knowledge_read": f"""with k as (select doc_id, ['PATTERN', 'FIX', 'NOTE', 'CHECKLIST'][doc_id % 4 + 1] as t, {_STATUSES}[doc_id % 9 + 1] as e, case when source = 'src0' then 'GLOBAL' else source end as scope_id,
  case when doc_id % 3 <> 0 then timestamp '2024-01-01' + to_days((doc_id % 90)::int) end as until, case when doc_id % 7 <> 0 then timestamp '2024-01-01' + to_days((doc_id % 50)::int) end as approved
  from documents where source in ('src0', 'src3') and doc_id % 6 <> 0)
select doc_id as item_id, '(untitled)' as title, scope_id, e as epistemic_status, case when e = 'MEASURED' then 'MEASURED_OWN_EXECUTION' when t in ('PATTERN', 'CHECKLIST') and e = 'OBSERVED' then 'VALIDATED_PATTERN'
  when t = 'FIX' then 'HUMAN_APPROVED_CORRECTION' when e = 'DECLARED' then 'TUTORIAL' when e in ('INFERRED', 'HYPOTHESIS', 'ESTIMATED') then 'MODEL_INFERENCE' else 'COMMUNITY' end as authority,
  'INTERNAL' as data_classification, 'NONE' as instruction_authority from k where until is null or until > timestamp '{AS_OF}' order by approved desc nulls last, doc_id limit 40""",
    "experience_read": """select event_id as item_id, '[' || event_type || '] late' as title, 'hypothesis: ' || case when event_id % 2 = 0 then 'cause' else '-' end || ' | change: - | before: red -> after: green' as summary,
  case event_id % 5 when 0 then 'MEASURED' when 1 then 'INFERRED' else 'OBSERVED' end as epistemic_status, case when event_id % 5 = 0 then 'MEASURED_OWN_EXECUTION' else 'MODEL_INFERENCE' end as authority,
  case when user_id % 3 = 1 then 1.0 else 0.5 end::double as relevance from events order by (user_id % 3 = 1) desc, ts desc, event_id limit 30""",
    "projection_decisions": """with l as (select o_custkey as id, o_orderstatus as s from orders union all select distinct o_custkey, 'missing' from orders where o_custkey % 50 = 0)
select id, case when s = 'missing' then 'PROJECTION_BROKEN_DECISION_REFERENCE' else 'SUPERSEDED_DECISION_PRESENTED_AS_ACTIVE' end as code, count(*) as n from l where s <> 'O' group by all""",
    "pack_provenance": """with l as (select l_orderkey, l_partkey, max(l_returnflag) as flag, max(l_linestatus) as status from lineitem group by all)
select l_orderkey as pack_id, 'p' || l_partkey as object_id, case when flag = 'R' then 'CONTEXT_PACK_MISSING_PROVENANCE' else 'CONTEXT_PACK_EMPTY_PROVENANCE_ENTRY' end as code from l where flag = 'R' or status <> 'F'""",
    "stored_promotions": f"""with c as (select o_orderkey as claim_id, case when o_orderkey % 40 = 0 then -1 else lag(o_orderkey) over (partition by o_custkey order by o_orderkey) end as supersedes, {_NAMES}[o_orderkey % 7 + 1] as after from orders),
b as (select c.claim_id, c.after, o.claim_id as old, o.after as before from c left join c o on o.claim_id = c.supersedes where c.supersedes is not null)
select claim_id, case when old is null then 'SUPERSEDES_MISSING_CLAIM' else 'FORBIDDEN_PROMOTION' end as code from b where old is null or {_BAD}""",
    "run_journal_faults": """with c as (select event_id as run_id, unnest([case when event_id % 4 = 2 then 'PHASE' end, case when event_id % 7 > 4 then 'ATTEMPTS' end, case when user_id % 11 = 0 then 'NO_PRODUCTION_MUTATION' end,
  case when event_id % 5 = 0 and event_id % 10 <> 0 then 'SCOPE_SHAPE' end]) as code from events) select * from c where code is not null""",
    "common_types": "select p_type as value, count(*) as n from part group by p_type order by n desc, p_type limit 20",
    "compiled_items": f"with {_PATHS} select path as source_path, node_count, integrations, n_findings, severity as max_severity, {_ROLE} as knowledge_role, {_SCOPE_OF} as learning_scope, severity not in ('CRITICAL', 'HIGH') as structure_reference_allowed from all_paths",
    "compiled_records": """with p as (select distinct 'w' || (page_id // 5) as source_path from pages), s as (select source_path, sha256('example/flows' || chr(31) || repeat('a', 40) || chr(31) || source_path || chr(31) || sha256(source_path)) as source_id from p),
a as (select *, sha256(source_id || chr(31) || '1.0') as analysis_id from s) select source_path, source_id, analysis_id, sha256(analysis_id || chr(31) || '0.1') as item_id from a""",
    "corpus_gate": f"with {_FINDINGS} select value from (select unnest(['EXECUTE_COMMAND', 'CUSTOM_CODE', 'SSH_EXECUTION', 'DECRYPTED_CREDENTIAL_EXPORT']) as value) where value not in (select rule_id from hits)",
}
