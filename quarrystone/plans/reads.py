"""Queries of the read path: guard, evidence, resolution, state, changes, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import requests as N
from ..operators import scope as S
from ..sources.tables import scratch, table

#: The request of these queries.
SCOPE, QUERY, LINKED_QUERY = "CLIENT:src3", "the heed nation of the and ther", "Ther heed"
AS_OF = "2024-02-15 00:00:00"
SINCE = "2024-01-10 00:00:00"


def scoped_documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents with a scope: every tenth source is global, the others are clients."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    is_global = F.substring("source", 4, 9).cast("int") % 10 == 0
    return docs.withColumns({"scope_type": F.when(is_global, "GLOBAL").otherwise("CLIENT"), "scope_id": F.when(is_global, "GLOBAL").otherwise(F.col("source"))})


_SCOPED = """scoped as (select doc_id, text, source,
  case when cast(substr(source, 4) as int) % 10 = 0 then 'GLOBAL' else 'CLIENT' end as scope_type,
  case when cast(substr(source, 4) as int) % 10 = 0 then 'GLOBAL' else source end as scope_id from documents)"""
_SEEN = "(scope_type = 'GLOBAL' or scope_type = 'CLIENT' and scope_id = 'src3')"


def _sql_normal(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(replace({x}, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g'))"


def _sql_tokens(x: str) -> str:
    return f"list_filter(string_split({_sql_normal(x)}, ' '), lambda t: t <> '')"


def scope_guard_visible_docs(spark, folder):
    return S.guard(scoped_documents(spark, folder), SCOPE).select("doc_id", "scope_type", "scope_id")


def scope_guard_dropped_count(spark, folder):
    docs = scoped_documents(spark, folder)
    allowed = S.visible(spark, SCOPE).withColumn("seen", F.lit(True))
    both = docs.select("scope_type", "scope_id").join(F.broadcast(allowed), ["scope_type", "scope_id"], "left")
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.col("seen").isNull()).alias("n_dropped"))


def _labelled(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", F.when(F.col("toxic") == 1, "SECRET").when(F.col("quality") == 0, "CLIENT_CONFIDENTIAL").alias("level"), F.when(F.col("quality") == 0, "PII").alias("class"))
    return scoped_documents(spark, folder).select("doc_id", "source").join(labels, "doc_id", "left")


def secret_excluded(spark, folder):
    return _labelled(spark, folder).where(S.not_secret(F.col("level"))).groupBy("source").agg(F.count("*").alias("n_docs"))


def pii_marked(spark, folder):
    rows = _labelled(spark, folder)
    return rows.groupBy("source").agg(
        F.count_if(F.col("class") == "PII").alias("n_pii"), S.highest_tier(S.tier(F.col("level"))).alias("highest_tier"),
        F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes"),
    )


def normalise_names(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows = rows.unionByName(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    rows = rows.unionByName(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name")))
    return rows.select("id", T.normalise(F.col("name")).alias("normal"))


def _entities(spark, folder):
    return table(spark, folder, "nation").select(
        F.concat(F.lit("nation_"), F.col("n_nationkey")).alias("entity_id"), F.col("n_name").alias("canonical_name"),
        F.array(F.concat(F.lit("N-"), F.col("n_nationkey")), F.concat(F.lit("The "), F.col("n_name"))).alias("aliases"),
    ).unionByName(table(spark, folder, "customer").select(
        F.concat(F.lit("customer_"), F.col("c_custkey")).alias("entity_id"), F.col("c_name").alias("canonical_name"),
        F.array(F.concat(F.lit("C-"), F.col("c_custkey"))).alias("aliases"),
    ))


def _resolve(query):
    def run(spark, folder):
        return E.resolve(_entities(spark, folder), query).select("entity_id", "match_kind", "matched_on", "score", "ambiguous")

    return run


def _resolve_sql(query: str) -> str:
    normal = "lower('" + query + "')"
    return f"""
with entities as (
  select 'nation_' || n_nationkey as entity_id, n_name as canonical_name, ['N-' || n_nationkey, 'The ' || n_name] as aliases from nation
  union all select 'customer_' || c_custkey, c_name, ['C-' || c_custkey] from customer
), m as (select *, {_sql_normal('canonical_name')} as plain, trim(regexp_replace({normal}, '[^a-z0-9]+', ' ', 'g')) as q,
  list_sort(list_filter(aliases, lambda a: a = '{query}')) as same,
  list_sort(list_filter(aliases, lambda a: {_sql_normal('a')} = trim(regexp_replace({normal}, '[^a-z0-9]+', ' ', 'g')))) as alike,
  list_sort(list_filter(aliases, lambda a: starts_with({_sql_normal('a')}, trim(regexp_replace({normal}, '[^a-z0-9]+', ' ', 'g'))))) as starts from entities),
k as (select entity_id, canonical_name, case
    when entity_id = '{query}' then {{'r': 0, 'kind': 'EXACT_ID', 'on': entity_id, 's': 1.0::double}}
    when canonical_name = '{query}' then {{'r': 1, 'kind': 'EXACT_CANONICAL_NAME', 'on': canonical_name, 's': 0.98::double}}
    when len(same) > 0 then {{'r': 2, 'kind': 'EXACT_ALIAS', 'on': same[1], 's': 0.92::double}}
    when plain = q then {{'r': 3, 'kind': 'NORMALIZED_CANONICAL_NAME', 'on': canonical_name, 's': 0.88::double}}
    when len(alike) > 0 then {{'r': 4, 'kind': 'NORMALIZED_ALIAS', 'on': alike[1], 's': 0.82::double}}
    when starts_with(plain, q) then {{'r': 5, 'kind': 'CANONICAL_NAME_PREFIX', 'on': canonical_name, 's': 0.6::double}}
    when len(starts) > 0 then {{'r': 6, 'kind': 'ALIAS_PREFIX', 'on': starts[1], 's': 0.55::double}}
    when list_has_all(string_split(plain, ' '), string_split(q, ' ')) then {{'r': 7, 'kind': 'CANONICAL_NAME_CONTAINS', 'on': canonical_name, 's': 0.4::double}} end as x from m),
top as (select entity_id, x from k where x is not null order by x.r, entity_id limit 10)
select entity_id, x.kind as match_kind, x.on as matched_on, x.s as score, (select count(*) from top where x.r = (select min(x.r) from top)) > 1 as ambiguous from top"""


def lexical_evidence_topk(spark, folder):
    docs = S.guard(scoped_documents(spark, folder), SCOPE).withColumn("evidence_id", F.col("doc_id"))
    return E.search(docs, QUERY).select("doc_id", "score")


def evidence_for_requests(spark, folder):
    """Every turn of every conversation as a request of one of twenty clients: its best hits, or that there are none."""
    docs = scoped_documents(spark, folder).withColumn("evidence_id", F.col("doc_id"))
    turns = table(spark, folder, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.lit("CLIENT").alias("scope_type"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("scope_id"), F.when(F.col("turn") == 1, F.lit("of no ??")).otherwise(F.col("text")).alias("query"))
    at = scratch(spark)  # an index is stored once and read by all that a search joins
    N.postings(docs).write.option("compression", "zstd").parquet(at)
    return N.search(spark.read.parquet(at), turns).select("request_id", "kind", "evidence_id", "score")


_LEXICAL = f"""
with {_SCOPED}, q as (select list_distinct(list_filter({_sql_tokens("'" + QUERY + "'")}, lambda t: length(t) >= 3)) as w),
s as (select doc_id, round(0.4 * len(list_intersect(w, {_sql_tokens('text')})) / len(w), 6)::double as score from scoped, q where {_SEEN})
select doc_id, score from s where score >= 0.01 order by score desc, doc_id limit 25"""


def evidence_relational_lexical(spark, folder):
    docs = S.guard(scoped_documents(spark, folder), SCOPE)
    labels = table(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 1, "STRONG").otherwise("WEAK").alias("strength"))
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("evidence_id"), "text", F.coalesce("strength", F.lit("MODERATE")).alias("strength"),
        F.when(F.col("doc_id") % 7 == 0, "e1").when(F.col("doc_id") % 7 == 1, "e2").alias("subject_entity_id"),
    )
    claims = table(spark, folder, "benchmark").select(F.array(F.col("item_id") * 3, F.col("item_id") * 10 + 3).alias("supporting"), F.array(F.col("item_id") * 20).alias("counter"))
    linked = claims.select(F.explode(F.concat("supporting", "counter")).alias("evidence_id"))
    return E.search(rows, QUERY, linked, ["e1"]).select("evidence_id", "strength", "relational", F.round("lexical", 6).alias("lexical"), "score")


_RELATIONAL = f"""
with {_SCOPED}, q as (select list_distinct(list_filter({_sql_tokens("'" + QUERY + "'")}, lambda t: length(t) >= 3)) as w),
linked as (select distinct unnest([item_id * 3, item_id * 10 + 3, item_id * 20]) as doc_id from benchmark),
s as (select d.doc_id, coalesce(case when quality = 1 then 'STRONG' when quality is not null then 'WEAK' end, 'MODERATE') as strength,
  case when d.doc_id % 7 = 0 then 1.0 when l.doc_id is not null then 0.7 else 0.0 end::double as relational,
  (len(list_intersect(w, {_sql_tokens('text')})) / len(w))::double as lexical
  from scoped d cross join q left join labels b using (doc_id) left join linked l on l.doc_id = d.doc_id where {_SEEN} and d.doc_id % 7 <> 1)
select doc_id as evidence_id, strength, relational, round(lexical, 6) as lexical, round(0.6 * relational + 0.4 * lexical, 6) as score from s
where round(0.6 * relational + 0.4 * lexical, 6) >= 0.01
order by score desc, case strength when 'STRONG' then 1 when 'MODERATE' then 2 else 3 end, doc_id limit 25"""


def _matching(query):
    def run(spark, folder):
        docs = table(spark, folder, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
        return docs.where(T.websearch(F.col("t"), query)).select("doc_id", T.rank_of(F.col("t"), query).alias("rank"))

    return run


def _matching_sql(condition: str, words: tuple[str, ...]) -> str:
    held = ", ".join(f"'{w}'" for w in words)
    return f"""with d as (select doc_id, {_sql_tokens('text')} as t from documents)
select doc_id, round(len(list_filter(t, lambda x: x in ({held}))) / (len(t) + 50.0::double), 6)::double as rank from d where {condition}"""


def _decisions(spark, folder):
    """orders as decisions: every third order of a customer supersedes the one before."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return orders.select(F.col("o_orderkey").alias("decision_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") - 1).alias("supersedes"), F.when(F.col("o_orderstatus") == "F", "REVOKED").otherwise("ACTIVE").alias("status"))


_DECISIONS = """decisions as (select o_orderkey as decision_id, case when o_orderkey % 3 = 0 then o_orderkey - 1 end as supersedes,
  case when o_orderstatus = 'F' then 'REVOKED' else 'ACTIVE' end as status from orders)"""


def active_decisions_anti(spark, folder):
    return G.active_decisions(_decisions(spark, folder)).select("decision_id", "status")


def supersession_faults(spark, folder):
    return G.supersession_faults(_decisions(spark, folder))


def contradictions(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("subject_id"), F.lit("returnflag").alias("predicate"), F.col("l_returnflag").alias("value"), F.lit("ACTIVE").alias("status"))
    return G.contradictions(lines)


def conflict_versions(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey", F.col("l_suppkey").alias("version"), F.when(F.col("l_returnflag") == "R", "DEPRECATED").otherwise("CURRENT").alias("status"))
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("node"))
    return G.version_conflicts(lines.join(part, "l_partkey").select("node", "version", "status"))


def state_projection_counts(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderkey", "o_orderdate")
    parts = orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_orderstatus") == "F").alias("n_closed"), F.max("o_orderdate").alias("newest"),
        F.min_by("o_orderkey", F.struct(F.when(F.col("o_orderstatus") == "O", 0).otherwise(1), F.col("o_orderkey"))).alias("next_id"),
    )
    as_of = F.to_timestamp(F.lit("1998-06-01 00:00:00"))
    summary = F.concat(F.col("n_open").cast("string"), F.lit(" open, "), F.col("n_closed").cast("string"), F.lit(" closed"))
    return parts.select("o_custkey", "n_open", "n_closed", "next_id", summary.alias("summary"), G.freshness(F.col("newest"), as_of).alias("freshness"))


_STATE = """
select o_custkey, count(*) filter (where o_orderstatus = 'O') as n_open, count(*) filter (where o_orderstatus = 'F') as n_closed,
  coalesce(min(o_orderkey) filter (where o_orderstatus = 'O'), min(o_orderkey)) as next_id,
  count(*) filter (where o_orderstatus = 'O') || ' open, ' || count(*) filter (where o_orderstatus = 'F') || ' closed' as summary,
  case when timestamp '1998-06-01' - max(o_orderdate) > interval 90 day then 'STALE' else 'FRESH' end as freshness
from orders group by o_custkey"""


def delta_since(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    since = F.to_timestamp(F.lit(SINCE))
    return events.where(G.changed_since(since, "ts")).groupBy("user_id", "event_type").agg(F.count("*").alias("n_changes"), F.min("event_id").alias("first_id"))


def delta_coverage(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts")
    since = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    rows = events.groupBy("user_id").agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
    return rows.select("user_id", G.coverage(since, F.col("earliest")).alias("coverage"), (F.col("latest") > since).alias("changed"))


def late_events(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    recorded = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 86_400_000_000).cast("long"))
    return events.select("event_id", G.late(F.col("ts"), recorded).alias("late_days")).where("late_days is not null")


def _edges(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    bought = orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    held = lines.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return bought.unionByName(held)


def relation_expansion_depth2(spark, folder):
    seeds = spark.createDataFrame([("c1",), ("c2",), ("c7",)], "node string")
    return G.expand(_edges(spark, folder), seeds, 2)


_EXPANSION = """
with recursive edges as (select 'c' || o_custkey as src, 'o' || o_orderkey as dst from orders union all select 'o' || l_orderkey, 'p' || l_partkey from lineitem),
walk as (select unnest(['c1', 'c2', 'c7']) as node, 0 as depth union select dst, depth + 1 from walk join edges on src = node where depth < 2)
select node, min(depth)::int as depth from walk group by node having min(depth) > 0"""


def three_table_structure_join(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer, nation = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey"), table(spark, folder, "nation").select("n_nationkey", "n_name")
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(12).select("o_orderkey", "c_name", "n_name")


def provenance_collect(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    cited = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("cited"))
    orders = table(spark, folder, "orders").select("o_orderkey")
    return orders.join(cited, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("cited", F.lit("")).alias("provenance"))


QUERIES = {f.__name__: f for f in (
    scope_guard_visible_docs, scope_guard_dropped_count, secret_excluded, pii_marked, normalise_names, lexical_evidence_topk, evidence_for_requests, evidence_relational_lexical,
    active_decisions_anti, supersession_faults, contradictions, conflict_versions, state_projection_counts, delta_since, delta_coverage, late_events,
    relation_expansion_depth2, three_table_structure_join, provenance_collect,
)}
QUERIES |= {
    "resolve_entity_tiers": _resolve("nation 7"), "resolve_entity_ambiguity": _resolve("customer"), "resolve_entity_alias": _resolve("N-7"),
    "fts_match_all_terms": _matching("the and heed"), "fts_phrase_or_not": _matching('"of the" or "in the" -heed'),
}
_LEVELS = "with l as (select d.source, case when toxic = 1 then 'SECRET' when quality = 0 then 'CLIENT_CONFIDENTIAL' end as level, case when quality = 0 then 'PII' end as class from documents d left join labels using (doc_id))"
ORACLE_SQL = {
    "scope_guard_visible_docs": f"with {_SCOPED} select doc_id, scope_type, scope_id from scoped where {_SEEN}",
    "scope_guard_dropped_count": f"with {_SCOPED} select count(*) as n_rows, count(*) filter (where not {_SEEN}) as n_dropped from scoped",
    "secret_excluded": f"{_LEVELS} select source, count(*) as n_docs from l where coalesce(level, 'INTERNAL') <> 'SECRET' group by source",
    "pii_marked": f"""{_LEVELS} select source, count(*) filter (where class = 'PII') as n_pii,
  arg_max(coalesce(level, 'INTERNAL'), case coalesce(level, 'INTERNAL') when 'INTERNAL' then 2 when 'CLIENT_CONFIDENTIAL' then 4 else 5 end) as highest_tier,
  coalesce(string_agg(distinct class, ','), '') as classes from l group by source""",
    "normalise_names": f"""with n as (select c_custkey as id, c_name as name from customer union all select p_partkey, p_name from part union all select doc_id, text from documents)
select id, {_sql_normal('name')} as normal from n""",
    "resolve_entity_tiers": _resolve_sql("nation 7"), "resolve_entity_ambiguity": _resolve_sql("customer"), "resolve_entity_alias": _resolve_sql("N-7"),
    "evidence_for_requests": f"""with {_SCOPED}, q as (select conv_id || '-' || turn as request_id, 'src' || (conv_id % 20) as client, list_distinct(list_filter({_sql_tokens("case when turn = 1 then 'of no ??' else text end")}, lambda t: length(t) >= 3)) as w from conversations),
d as (select doc_id, scope_id, list_distinct({_sql_tokens('text')}) as t from scoped), f as (select request_id, doc_id, len(list_intersect(w, t)) as n, len(w) as size from q join d on scope_id in (client, 'GLOBAL') where len(w) > 0),
r as (select *, round((0.4 * n / size)::double, 6) as score, row_number() over (partition by request_id order by n desc, doc_id) as place from f where n > 0), h as (select request_id, 'HIT' as kind, doc_id as evidence_id, score from r where place <= 25 and score >= 0.01)
select * from h union all select request_id, 'NO_EVIDENCE_FOUND', null, null from q where request_id not in (select request_id from h)""",
    "lexical_evidence_topk": _LEXICAL, "evidence_relational_lexical": _RELATIONAL,
    "fts_match_all_terms": _matching_sql("list_has_all(t, ['the', 'and', 'heed'])", ("the", "and", "heed")),
    "fts_phrase_or_not": _matching_sql("(contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') or contains(' ' || array_to_string(t, ' ') || ' ', ' in the ')) and not list_contains(t, 'heed')", ("of", "the", "in", "heed")),
    "active_decisions_anti": f"with {_DECISIONS} select decision_id, status from decisions d where status = 'ACTIVE' and not exists (select 1 from decisions x where x.supersedes = d.decision_id)",
    "supersession_faults": f"""with {_DECISIONS} select d.decision_id, case when o.decision_id is null then 'SUPERSEDES_BROKEN_REFERENCE' else 'SUPERSEDED_DECISION_STILL_ACTIVE' end as code
from decisions d left join decisions o on o.decision_id = d.supersedes where d.supersedes is not null and (o.decision_id is null or o.status = 'ACTIVE')""",
    "contradictions": """select l_partkey as subject_id, 'returnflag' as predicate, count(*) as n_claims, count(distinct l_returnflag) as n_values
from lineitem group by l_partkey having count(*) > 1 and count(distinct l_returnflag) > 1""",
    "conflict_versions": """with g as (select p_brand as node, count(distinct l_suppkey) as n_versions, count(*) filter (where l_returnflag = 'R') as n_deprecated, count(*) as n_items
  from lineitem join part on p_partkey = l_partkey group by p_brand)
select *, 'VERSION_CONFLICT' as kind from g where n_versions > 1 union all select *, 'DEPRECATED_BESIDE_CURRENT' from g where n_deprecated between 1 and n_items - 1""",
    "state_projection_counts": _STATE,
    "delta_since": f"select user_id, event_type, count(*) as n_changes, min(event_id) as first_id from events where ts > timestamp '{SINCE}' group by all",
    "delta_coverage": """select user_id, case when min(ts) <= timestamp '2024-01-01 12:00:00' then 'COVERED' else 'PARTIAL_NO_RECORD_BEFORE' end as coverage,
  max(ts) > timestamp '2024-01-01 12:00:00' as changed from events group by user_id""",
    "late_events": "select event_id, floor(round(value * 86400000000) / 86400000000)::bigint as late_days from events where round(value * 86400000000) > 30 * 86400000000",
    "relation_expansion_depth2": _EXPANSION,
    "three_table_structure_join": """select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
order by o_orderdate desc, o_orderkey limit 12""",
    "provenance_collect": """select o_orderkey, coalesce((select string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey) from lineitem where l_orderkey = o_orderkey), '') as provenance from orders""",
}
