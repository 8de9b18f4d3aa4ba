"""Queries of the contract's mechanisms: packs that fit budgets, hosts and packages, snapshots, runs, closed schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analyze as A
from ..operators import budget as B
from ..operators import checks as C
from ..operators import closed as K
from ..operators import runs as J
from ..operators import snapshots as N
from ..sources.tables import scratch, table

#: Budgets that every pack is fitted to.
BUDGETS = (250, 400, 480, 560, 640, 900)
_LONG = " and it must hold for every shipment of this order, whatever its lines"
_PACK_LISTS, _PACK_EVENTS = 10, 120


def _packs(spark, folder):
    """Customers as packs: their first open orders are decisions, their first orders evidence, first events of a tenth of the users recent events."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    first = orders.withColumn("n", nth).where(F.col("n") <= _PACK_LISTS)
    key = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit("d"), key, F.lit(": ship it"), F.repeat(F.lit(_LONG), (F.col("o_orderkey") % 4).cast("int")))
    entry = F.struct(F.concat(F.lit("v"), key).alias("object_id"), F.lit("Evidence").alias("object_type"), F.array(F.struct(F.concat(F.lit("src"), (F.col("o_orderkey") % 20).cast("string")).alias("source_id"))).alias("provenance"))
    strength = F.get(F.array(*map(F.lit, ("WEAK", "MODERATE", "STRONG"))), (F.col("o_orderkey") % 4).cast("int"))
    held = first.groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "P", line))).alias("constraints"), F.array_sort(F.collect_list(F.concat(F.lit("v"), key))).alias("evidence_ids"),
        F.array_sort(F.collect_list(entry)).alias("provenance_summary"), F.map_from_entries(F.collect_list(F.when(strength.isNotNull(), F.struct(F.concat(F.lit("v"), key), strength)))).alias("strengths"),
    )
    events = table(spark, folder, "events").select((F.col("user_id") % 10).alias("tenth"), "event_id")
    recent = events.withColumn("n", F.row_number().over(Window.partitionBy("tenth").orderBy("event_id"))).where(F.col("n") <= _PACK_EVENTS)
    name = F.concat(F.lit("e"), F.lpad((F.col("event_id") % 10_000).cast("string"), 4, "0"))
    recent = recent.groupBy("tenth").agg(F.array_sort(F.collect_list(name)).alias("recent_event_ids"))
    customer = F.col("o_custkey")
    made = F.transform(F.sequence(F.lit(1), (customer % 5 * 30 + 1).cast("int")), lambda k: F.concat(F.lit("p"), F.lpad(k.cast("string"), 4, "0")))
    return held.join(F.broadcast(recent), customer % 10 == F.col("tenth"), "left").select(
        F.concat(F.lit("cp_"), customer.cast("string")).alias("context_pack_id"), F.lit("ship what is open").alias("objective"), "constraints", "evidence_ids", "provenance_summary", "strengths",
        F.coalesce("recent_event_ids", F.array().cast("array<string>")).alias("recent_event_ids"), F.when(customer % 3 == 0, F.array(F.struct(F.concat(F.lit("artifact-"), customer.cast("string")).alias("artifact_id")))).alias("artifact_refs"),
        made.alias("procedural_refs"), F.array(F.lit("the record starts late")).alias("gaps"), F.array(*map(F.lit, BUDGETS)).alias("token_budget"),
    )


def context_packs_fitted(spark, folder):
    """Every customer's pack at every budget: what it comes to, which steps were taken, what it still holds."""
    rows = B.fit(_packs(spark, folder))
    joined = lambda c: F.array_join(c, ",")
    return rows.select(
        "context_pack_id", "token_budget", "size", "fits", "minimum_required", joined(F.transform("trimmed", lambda t: t["step"])).alias("steps"), joined("evidence_ids").alias("evidence_ids"), joined("recent_event_ids").alias("recent_event_ids"),
        F.size("provenance_summary").cast("long").alias("n_provenance"), joined("procedural_refs").alias("procedural_refs"), F.md5(F.array_join("gaps", "|")).alias("gaps_md5"), F.md5(F.array_join("constraints", "|")).alias("constraints_md5"),
    )


def context_packs_core(spark, folder):
    """What no budget takes of every customer's pack."""
    packs = _packs(spark, folder).withColumn("token_budget", F.lit(BUDGETS[0])).drop("strengths")
    return packs.select("context_pack_id", B.minimum_tokens(packs).alias("minimum"), B.pack_tokens(packs).alias("whole"))


def private_network_urls(spark, folder):
    """Pages as URLs of addresses that their numbers make, in eight ways to write one: how many are private, by way."""
    n = F.col("page_id")
    four = F.concat_ws(".", (n % 256).cast("string"), (n * 7 % 256).cast("string"), (n % 3).cast("string"), F.lit("9"))
    six = F.concat(F.lower(F.hex(n * 257 % 65536)), F.lit("::"), F.lower(F.hex(n % 65536)))
    ways = {
        "plain": F.concat(F.lit("http://"), four, F.lit("/x")), "expression": F.concat(F.lit("=https://"), four), "user": F.concat(F.lit("http://u:p@"), four, F.lit(":81/")), "bracketed": F.concat(F.lit("http://["), six, F.lit("]:8080/")),
        "mapped": F.concat(F.lit("http://[::ffff:"), four, F.lit("]")), "template": F.concat(F.lit("http://"), four, F.lit("/{{x}}")), "named": F.concat(F.lit("http://h"), n.cast("string"), F.when(n % 2 == 0, ".local").otherwise(".example")), "other_scheme": F.concat(F.lit("ftp://"), four),
    }
    rows = table(spark, folder, "pages").select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ways)), F.array(*ways.values()))).alias("way", "url"))
    return rows.groupBy("way").agg(F.count_if(T.private_or_local(F.col("url"))).alias("n_private"), F.count("*").alias("n"))


_PACKAGES = ("n8n-nodes-base.", "@n8n/n8n-nodes-langchain.", "n8n-nodes-langchain.", "evilnodes-base.", "n8n-nodes-base-extra.", "")
_NODE_NAMES = ("executeCommand", "code", "httpRequest", "set", "slackTrigger", "manualTrigger", "ssh")


def package_verdicts(spark, folder):
    """Nodes of six packages, two of them with names that only look like first-party ones: verdicts and pins."""
    n = F.col("page_id")
    kind = F.concat(F.get(F.array(*map(F.lit, _PACKAGES)), (n % len(_PACKAGES)).cast("int")), F.get(F.array(*map(F.lit, _NODE_NAMES)), (n % len(_NODE_NAMES)).cast("int")))
    rows = table(spark, folder, "pages").select(kind.alias("type"), A.node_risk(kind, F.when(n % 11 == 0, 1).otherwise(0)).alias("r"))
    return rows.groupBy("type").agg(F.first("r.verdict").alias("verdict"), F.count_if("r.requires_pinning").alias("n_pinned"), F.count("*").alias("n"))


def _tables(docs):
    """Documents as sources, analyses and items: three tables that name one another."""
    sources = docs.select(F.sha2(F.concat_ws("|", "source", F.col("doc_id").cast("string")), 256).alias("source_id"), "source", "doc_id", F.sha2("text", 256).alias("sha256"))
    analyses = docs.select(F.concat_ws("|", "source", (F.col("doc_id") % 500).cast("string")).alias("analysis_id"), "lang").withColumn("analyzer_version", F.lit("1.0"))
    items = docs.select(F.sha2("text", 256).alias("item_id"), F.length("text").cast("long").alias("n_chars"))
    return {"sources": N.Batch(sources, ["source_id"]), "analyses": N.Batch(analyses.dropDuplicates(), ["analysis_id", "lang"], ["analyzer_version"]), "items": N.Batch(items, ["item_id"])}


def snapshot_commits(spark, folder):
    """Two thirds of the documents as three tables in one commit, then all of them in another: rows of each table and version, read through the manifests."""
    docs, held = table(spark, folder, "documents").select("doc_id", "source", "lang", "text"), N.Snapshots(spark, scratch(spark))
    held.commit(_tables(docs.where("doc_id % 3 <> 0")))
    held.commit(_tables(docs))
    counts = [held.read(name, v).agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), F.lit(name).alias("table"), "n") for v in (1, 2) for name in held.tables(v)]
    return reduce(DataFrame.unionByName, counts)


def snapshot_plan(spark, folder):
    """What a commit of all documents would do after one of two thirds, if every fiftieth text had changed: a plan that drifts, so nothing may be written."""
    docs, held = table(spark, folder, "documents").select("doc_id", "source", "lang", "text"), N.Snapshots(spark, scratch(spark))
    held.commit(_tables(docs.where("doc_id % 3 <> 0")))
    return held.plan(_tables(docs.withColumn("text", F.when(F.col("doc_id") % 50 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))))


#: A run that goes well at first, uses all its attempts, and is closed; every fifth entry is out of turn instead.
_PATH = ("PLANNING", "DRAFT", "VALIDATING", "AWAITING_APPROVAL", *("TESTING", "DEBUGGING") * 5, "PASSED", "DRAFT", "BLOCKED", "DRAFT", "VALIDATING", "ABORTED", "PLANNING")


def _entries(spark, folder):
    """Events as entries of their users' runs, phases by the events' numbers within the user."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("at", "seq")) - 1
    usual, other = F.get(F.array(*map(F.lit, _PATH)), nth % len(_PATH)), F.get(F.array(*map(F.lit, (*J.PHASES, "NOPE"))), (F.col("seq") % (len(J.PHASES) + 1)).cast("int"))
    return events.withColumn("phase", F.when(F.col("seq") % 5 == 0, other).otherwise(usual))


def run_transitions(spark, folder):
    """Every entry of every run: its verdict, and where the run stands after it."""
    return J.journal(_entries(spark, folder)).select("run_id", "seq", "phase", "verdict", "phase_after", "attempts_after")


def run_states(spark, folder):
    """Where each run stands at last, and how many of its entries were refused."""
    return J.current(J.journal(_entries(spark, folder))).select("run_id", "phase", "attempts", "n_refused")


def runs_stalled(spark, folder):
    """Open runs that heard nothing for longer than two days, up to the table's last entry."""
    entries = _entries(spark, folder)
    until = entries.agg(F.max("at").alias("until"))
    journal = J.journal(entries).crossJoin(F.broadcast(until))  # one row
    return J.stalled(journal, "2 days", F.col("until")).select("run_id", "phase", F.date_format("stalled_at", "yyyy-MM-dd HH:mm:ss").alias("stalled_at"))


#: What is put in the place of what in an item's text, and the faults that it makes: every number modulo so many plus one is one of them.
_PLANTED = (
    ('"schema_version":"0.1"', '"schema_version":"0.3"', ("schema_version:VALUE",)),
    ('"kind":"KNOWLEDGE_ITEM",', "", ("kind:MISSING_FIELD",)),
    ('"provenance":{', '"provenance":{"branch":"main",', ("provenance.branch:UNEXPECTED_FIELD",)),
    ('"source_commit":"', '"source_commit":"X', ("provenance.source_commit:PATTERN",)),
    ('"node_count":2', '"node_count":"2"', ("workflow.node_count:NOT_A_WHOLE_NUMBER",)),
    ('"node_count":2', '"node_count":5', ("workflow:NODE_COUNT",)),
    ('"trigger_types":["start"]', '"trigger_types":["start",null]', ("workflow.trigger_types[1]:NOT_A_STRING",)),
    ('"operation":"get"', '"operation":"get it"', ("workflow.nodes[1].operation:NOT_A_SAFE_SCALAR",)),
    ('"operation":"get"', '"operation":"get","parameters":{"a":[{}]}', ("workflow.nodes[1].parameters:UNEXPECTED_FIELD",)),
    ('"target_input_index":0', '"target_input_index":-1', ("workflow.edges[0].target_input_index:TOO_SMALL",)),
    ('"max_severity":"CRITICAL"', '"max_severity":"HIGH"', ("admission:UNKNOWN_DECISION",)),
    ('"validated":false', '"validated":true', ("admission.validated:VALUE",)),
    ('"char_count":7,"preview"', '"char_count":7,"sha1":"","preview"', ("untrusted_text[0].sha1:UNEXPECTED_FIELD",)),
    ('"content_persisted":false', '"content_persisted":false,"\\u0063ode":"x"', ("executable_snippets_untrusted[0].code:UNEXPECTED_FIELD", "executable_snippets_untrusted:BANNED_KEY")),
    ('"security_findings":[', '"security_findings":{"a":[', (":NOT_JSON",)),
)


def _items(docs):
    """Documents as compiled items in JSON text."""
    digest, path = F.sha2("text", 256), F.concat(F.lit("flows/"), F.col("doc_id").cast("string"), F.lit(".json"))
    node = lambda name, kind, **more: F.struct(F.lit(name).alias("name_untrusted"), F.lit(kind).alias("type"), F.lit(1).alias("type_version"), *[F.lit(v).alias(k) for k, v in more.items()], F.array().cast("array<string>").alias("credential_types"))
    whole = F.struct(
        F.lit("0.1").alias("schema_version"), F.lit("KNOWLEDGE_ITEM").alias("kind"), F.lit("UNTRUSTED_SOURCE_DATA").alias("source_content_trust"),
        F.struct(F.lit("example/flows").alias("source_repo"), F.lit("a" * 40).alias("source_commit"), path.alias("source_path"), digest.alias("sha256")).alias("provenance"),
        F.struct(
            F.substring("text", 1, 200).alias("name_untrusted"), F.lit(2).alias("node_count"), F.create_map(F.lit("start"), F.lit(1), F.lit("http"), F.lit(1)).alias("node_types"), F.array(F.lit("start")).alias("trigger_types"), F.array(F.col("source")).alias("integrations"),
            F.array(node("a", "start", operation=None), node("b", "http", operation="get")).alias("nodes"), F.array(F.struct(F.lit("a").alias("source_name_untrusted"), F.lit("b").alias("target_name_untrusted"), F.lit("main").alias("channel"), F.lit(0).alias("source_output_index"), F.lit(0).alias("target_input_index"))).alias("edges"),
        ).alias("workflow"),
        F.struct(
            F.lit("RAW_UNTRUSTED").alias("source_stage"), F.lit("STATIC_ANALYZED").alias("analysis_stage"), F.lit("BLOCKED").alias("risk_decision"), F.lit("CRITICAL").alias("max_severity"), F.lit("SECURITY_EXAMPLE").alias("knowledge_role"), F.lit("security_only").alias("learning_scope"),
            F.lit(False).alias("structure_reference_allowed"), F.lit(False).alias("implementation_reference_allowed"), F.lit(False).alias("validated"),
        ).alias("admission"),
        F.array(F.struct(F.col("lang").alias("severity"))).alias("security_findings"),
        F.array(F.struct(F.lit("text").alias("kind"), F.lit("").alias("node_name"), F.lit("").alias("node_type"), F.lit("p").alias("json_path"), digest.alias("sha256"), F.lit(7).alias("char_count"), F.substring("text", 1, 400).alias("preview"))).alias("untrusted_text"),
        F.array(F.struct(F.lit("code").alias("kind"), F.lit("").alias("node_name"), F.lit("").alias("node_type"), F.lit("p").alias("json_path"), F.lit("r").alias("reason"), F.lit("l").alias("language"), digest.alias("sha256"), F.length("text").alias("char_count"), F.lit(False).alias("content_persisted"))).alias("executable_snippets_untrusted"),
    )
    return docs.select("doc_id", F.to_json(whole).alias("json"))


def closed_schema_faults(spark, folder):
    """Documents as compiled items, most of them with one of fifteen faults: everything that breaks the item's schema, with its path."""
    items = _items(table(spark, folder, "documents").select("doc_id", "text", "source", "lang").where("text is not null"))
    turn, json = F.col("doc_id") % (len(_PLANTED) + 1), F.col("json")
    broken = F.coalesce(*[F.when(turn == k, F.replace(json, F.lit(old), F.lit(new))) for k, (old, new, _) in enumerate(_PLANTED)], json)
    return K.faults(items.withColumn("json", broken), "doc_id")


def closed_schema_records(spark, folder):
    """The valid ones of these items as records: how many rows each table would have, and their names' digest."""
    items = _items(table(spark, folder, "documents").select("doc_id", "text", "source", "lang").where("text is not null"))
    valid = items.join(K.faults(items, "doc_id").select("doc_id").distinct(), "doc_id", "left_anti")
    parts = K.prepared(valid, "1.0")
    both = parts["items"].join(parts["analyses"].select("analysis_id", "source_id"), "analysis_id").join(parts["sources"].select("source_id", "source_path", "sha256"), "source_id")
    return both.select("source_path", "sha256", "source_id", "analysis_id", "item_id", F.array_join("integrations", ",").alias("integrations"))


_TYPES = ("n8n-nodes-base.executeCommand", "n8n-nodes-base.httpRequest", "n8n-nodes-base.code", "n8n-nodes-base.set", "@n8n/n8n-nodes-langchain.agent")


def _flows(spark, folder):
    """Orders as workflow files: lines are nodes with nested parameters, each connected to the next."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("x"))
    orders = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def node(x, k):
        part, supplier = x["l_partkey"], x["l_suppkey"]
        headers = F.array(F.struct(F.lit("X").alias("name"), text("value-", part).alias("apiKey")), F.struct(F.lit("Y").alias("name"), F.lit(None).cast("string").alias("apiKey")))
        options = F.struct(headers.alias("headers"), F.lit(3).alias("retry"), F.array(F.array(text("deep ", supplier))).alias("rows"))
        parameters = F.struct(text("http://", F.when(supplier % 3 == 0, "10.0.0.").otherwise("8.8.8."), supplier % 200, "/").alias("url"), F.when(part % 7 == 0, "eval (1)").otherwise("return 1").alias("jsCode"), F.lit("get").alias("operation"), options.alias("options"))
        return F.struct(text("n", k).alias("name"), F.get(F.array(*map(F.lit, _TYPES)), (part % len(_TYPES)).cast("int")).alias("type"), F.lit(1.1).alias("typeVersion"), parameters.alias("parameters"), F.when(supplier % 9 == 0, F.struct(F.struct(F.lit("id").alias("id")).alias("httpAuth"))).alias("credentials"))

    def link(k):
        target = F.struct(text("n", k + 1).alias("node"), F.lit("main").alias("type"), F.lit(0).alias("index"))
        outputs = F.array(F.array(target), F.array().cast("array<struct<node:string,type:string,index:int>>"))
        return F.struct(text("n", k).alias("key"), F.struct(outputs.alias("main")).alias("value"))

    last = F.size("xs") - 2
    links = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), link))
    content = F.to_json(F.struct(F.transform("xs", node).alias("nodes"), F.map_from_entries(links).alias("connections")))
    return orders.select(text("flow-", F.col("l_orderkey")).alias("path"), content.alias("content"), F.sha2(content, 256).alias("sha256"), F.lit(None).cast("string").alias("parse_error"))


def workflow_nodes(spark, folder):
    """Nodes read from workflow files."""
    nodes, _, _ = A.documents(_flows(spark, folder))
    return nodes.select("path", "n", "name", "type", F.array_join("credential_types", ",").alias("credential_types"), "type_version", "resource", "operation")


def workflow_edges(spark, folder):
    """Edges read from workflow files."""
    return A.documents(_flows(spark, folder))[2]


def workflow_leaves(spark, folder):
    """Strings at any depth of the nodes' parameters, by their place."""
    _, leaves, _ = A.documents(_flows(spark, folder))
    return leaves.groupBy("json_path").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


def workflow_reports(spark, folder):
    """Workflow files from JSON text to decisions: how many of each severity, with how many findings of each rule."""
    flows = _flows(spark, folder)
    nodes, leaves, _ = A.documents(flows, scratch(spark))
    rows = A.reports(flows, nodes, A.findings(nodes, leaves)).select("path", "max_severity", "risk_decision", "node_count", "n_findings", F.array_join("rules", ",").alias("rules"))
    return rows.groupBy("max_severity", "risk_decision", "rules").agg(F.count("*").alias("n"), F.sum("node_count").alias("n_nodes"), F.sum("n_findings").alias("n_findings"))


def leaked_ids(spark, folder):
    """Orders as packs of JSON text that name their suppliers; a pack may see what is global and the suppliers of its own client."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.struct(F.concat(F.lit("s"), "l_suppkey").alias("supplier"), F.concat(F.lit("part-"), "l_partkey").alias("part")).alias("x"))
    packs = lines.groupBy(F.col("l_orderkey").alias("pack_id")).agg(F.to_json(F.struct(F.collect_list("x").alias("lines"))).alias("text"))
    packs = packs.withColumns({"scope_type": F.lit("CLIENT"), "scope_id": (F.col("pack_id") % 25).cast("string")})
    nation = F.col("s_nationkey")
    objects = table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("object_id"), F.when(nation < 5, "GLOBAL").otherwise("CLIENT").alias("scope_type"), F.when(nation < 5, "GLOBAL").otherwise(nation.cast("string")).alias("scope_id"))
    return C.leaked_ids(packs, objects)


QUERIES = {f.__name__: f for f in (leaked_ids, workflow_nodes, workflow_edges, workflow_leaves, workflow_reports, closed_schema_faults, closed_schema_records, context_packs_fitted, context_packs_core, private_network_urls, package_verdicts, snapshot_commits, snapshot_plan, run_transitions, run_states, runs_stalled)}


def _tok(text: str) -> str:
    return f"ceil(length({text}) / 4.0)::bigint"


def _list(texts: str) -> str:
    return f"(2 + coalesce(list_sum(list_transform({texts}, lambda x: {_tok('x')})), 0)::bigint)"


_ENTRY = f"2 + 3 + {_tok('x.id')} + 3 + 2 + 3 + 2 + 2 + 3 + {_tok('x.src')}"
_PROV = f"(2 + coalesce(list_sum(list_transform(prov, lambda x: {_ENTRY})), 0)::bigint)"
_ARTS = f"(2 + coalesce(list_sum(list_transform(arts, lambda x: 2 + 3 + {_tok('x')})), 0)::bigint)"
_GAPS = "list_sort(list_distinct(list_concat(['the record starts late'], list_transform(log, lambda l: 'trimmed for token budget (' || l.step || '): ' || len(l.gone) || ' item(s) removed from ' || l.field || ' [' || array_to_string(l.gone, ', ') || ']'))))"
# Keys: context_pack_id 4, objective 3, token_budget 3, then the seven lists; values that no step changes.
_SIZE = f"2 + 4 + {_tok('pid')} + 3 + {_tok(chr(39) + 'ship what is open' + chr(39))} + 3 + 1 + 3 + 4 + 4 + 3 + 4 + 5 + 1 + {_list('cons')} + {_ARTS} + {_list('evs')} + {_list('evid')} + {_list('refs')} + {_PROV} + {_list(_GAPS)}"
_PACK_ROWS = f"""o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders), f as (select * from o where n <= {_PACK_LISTS}),
e as (select tenth, list_sort(list('e' || lpad((event_id % 10000)::varchar, 4, '0'))) as evs from (select event_id, user_id % 10 as tenth, row_number() over (partition by user_id % 10 order by event_id) as n from events) where n <= {_PACK_EVENTS} group by tenth),
p as (select o_custkey, list_sort(list('d' || o_orderkey || ': ship it' || repeat('{_LONG}', (o_orderkey % 4)::int)) filter (where o_orderstatus = 'P')) as cons, list_sort(list('v' || o_orderkey)) as evid,
  list_sort(list({{'id': 'v' || o_orderkey, 'src': 'src' || (o_orderkey % 20), 'rank': case when o_orderkey % 4 = 3 then 4 else o_orderkey % 4 + 1 end}})) as prov from f group by o_custkey),
s as (select 'cp_' || o_custkey as pid, coalesce(cons, []) as cons, evid, prov, coalesce(evs, []) as evs, case when o_custkey % 3 = 0 then ['artifact-' || o_custkey] else [] end as arts,
  list_transform(range(1, o_custkey % 5 * 30 + 2), lambda k: 'p' || lpad(k::varchar, 4, '0')) as refs, prov as known, []::struct(step varchar, field varchar, gone varchar[])[] as log from p left join e on tenth = o_custkey % 10)"""


def _fold() -> str:
    """The five steps, each as: what it would take, the state after it, its size, and whether it stays."""
    parts = [f"z0 as (select *, {_SIZE} as size, false as done from (select s.*, unnest({list(BUDGETS)}) as budget from s))"]
    gone = {
        "VERBOSE_SUMMARY": "list_transform(list_filter(cons, lambda x: length(x) > 160), lambda x: split_part(x, ':', 1))", "LOW_RELEVANCE_ARTIFACTS": "arts", "OLDER_EVENTS": "case when len(evs) > 2 then evs[: len(evs) - 2] else evs end",
        "WEAKER_EVIDENCE": "list_transform(list_sort(list_transform(list_filter(known, lambda x: list_contains(evid, x.id)), lambda x: {'r': x.rank, 'id': x.id}))[: len(evid) - greatest(1, len(evid) // 4)], lambda x: x.id)", "SECONDARY_PROCEDURAL_REFS": "refs[2:]",
    }
    after = {
        "VERBOSE_SUMMARY": {"cons": "list_sort(list_transform(cons, lambda x: case when length(x) > 160 then substr(x, 1, 157) || '...' else x end))"}, "LOW_RELEVANCE_ARTIFACTS": {"arts": "[]::varchar[]"}, "OLDER_EVENTS": {"evs": "case when len(evs) > 2 then evs[len(evs) - 1 :] else []::varchar[] end"},
        "WEAKER_EVIDENCE": {"evid": "list_sort(list_filter(evid, lambda x: not list_contains(gone, x)))", "prov": "list_filter(prov, lambda x: not list_contains(gone, x.id))"}, "SECONDARY_PROCEDURAL_REFS": {"refs": "refs[:1]"},
    }
    state = ("cons", "arts", "evs", "evid", "prov", "refs")
    for k, step in enumerate(B.DROP_ORDER):
        field = {"VERBOSE_SUMMARY": "constraints (shortened)"}.get(step, B.STEP_FIELDS[step])
        parts.append(f"g{k} as (select *, {gone[step]} as gone from z{k})")
        changed = ", ".join(f"{after[step].get(c, c)} as {c}" for c in state)
        entry = f"case when len(gone) > 0 then list_append(log, {{'step': '{step}', 'field': '{field}', 'gone': list_sort(gone)}}) else log end"
        parts.append(f"a{k} as (select pid, budget, known, {changed}, {entry} as log from g{k})")
        parts.append(f"m{k} as (select *, {_SIZE} as size from a{k})")
        kept = ", ".join(f"case when z.size > z.budget and m.size < z.size then m.{c} else z.{c} end as {c}" for c in (*state, "log", "size"))
        parts.append(f"z{k + 1} as (select pid, budget, z.known, {kept} from z{k} z join m{k} m using (pid, budget))")
    return ",\n".join(parts)


def _in_networks(networks: tuple[str, ...], octets: tuple[str, str, str, str]) -> str:
    found = []
    for network in networks:
        address, _, length = network.partition("/")
        number, want, left = f"({octets[0]} * 16777216 + {octets[1]} * 65536 + {octets[2]} * 256 + {octets[3]})", 0, int(length)
        for part in address.split("."):
            want = want * 256 + int(part)
        found.append(f"{number} // {2 ** (32 - left)} = {want // 2 ** (32 - left)}")
    return "(" + " or ".join(found) + ")"


_FOUR = ("(page_id % 256)", "(page_id * 7 % 256)", "(page_id % 3)", "9")
_PRIVATE_4 = f"({_in_networks(T.INNER_4, _FOUR)} and not {_in_networks(T.PUBLIC_4, _FOUR)})"
#: Of a first group and a last one, with zeros between; no other part of these networks is met.
_PRIVATE_6 = "(g // 8192 = 0 or g // 16384 in (1, 2) or g // 8192 = 6 or g // 4096 = 14 or g // 2048 = 30 or g // 1024 = 62 or g // 512 = 126 or g // 128 = 508 or g // 64 = 1018 or g in (8193, 8194))"
_TWO = "select 1 as version, doc_id, source, lang, text from documents where doc_id % 3 <> 0 union all select 2, doc_id, source, lang, text from documents"
_LEGAL = " or ".join(f"(now = '{k}' and want in ({', '.join(repr(x) for x in v)}))" for k, v in J.TRANSITIONS.items())
_VERDICT = f"""case when want is null or not list_contains({list(J.PHASES)}, want) then 'UNKNOWN_PHASE' when want = now then 'UNCHANGED' when now in ('PASSED', 'ABORTED') then 'RUN_CLOSED'
  when not coalesce((now is null and want = 'PLANNING') or {_LEGAL}, false) then 'ILLEGAL_TRANSITION' when want = 'DEBUGGING' and used = {J.MAX_ATTEMPTS} then 'ATTEMPTS_EXHAUSTED' else 'ACCEPTED' end"""
#: Entry by entry: run r's n-th entry from where its entry before has left it.
_RUNS = f"""e as (select user_id as run_id, ts as moment, event_id as seq, row_number() over (partition by user_id order by ts, event_id) as n from events),
p as (select *, case when seq % 5 = 0 then {[*J.PHASES, "NOPE"]}[seq % {len(J.PHASES) + 1} + 1] else {list(_PATH)}[(n - 1) % {len(_PATH)} + 1] end as want from e),
w(run_id, moment, seq, n, want, verdict, now, used) as (
  select run_id, moment, seq, n, want, verdict, case when verdict = 'ACCEPTED' then want end, 0 from (select *, {_VERDICT} as verdict from (select *, null::varchar as now, 0 as used from p where n = 1))
  union all select run_id, moment, seq, n, want, verdict, case when verdict = 'ACCEPTED' then want else now end, used + (verdict = 'ACCEPTED' and want = 'DEBUGGING')::int
  from (select *, {_VERDICT} as verdict from (select p.*, w.now, w.used from p join w on w.run_id = p.run_id and w.n + 1 = p.n)))"""
_NODES = f"""l as (select 'flow-' || l_orderkey as path, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as n, count(*) over (partition by l_orderkey) as size, {list(_TYPES)}[l_partkey % {len(_TYPES)} + 1] as type, l_partkey as part, l_suppkey as supp from lineitem)"""
_FOUND = """h as (select path, unnest([case when type like '%executeCommand' then 'EXECUTE_COMMAND:4' end, case when type like '%httpRequest' then 'NETWORK_REQUEST:3' end, case when type like '%.code' then 'CUSTOM_CODE:3' end,
  case when type like '%httpRequest' and supp % 3 = 0 then 'PRIVATE_NETWORK_URL:4' end, case when type like '%.code' and part % 7 = 0 then 'CODE_EVAL:4' end, case when length('value-' || part) >= 8 then 'POSSIBLE_HARDCODED_SECRET:4' end]) as f from l
  union all select path, 'AI_WITH_PRIVILEGED_EXECUTION:5' from l group by path having bool_or(type like '%executeCommand') and bool_or(type like '%agent')),
r as (select path, string_agg(distinct split_part(f, ':', 1), ',' order by split_part(f, ':', 1)) as rules, max(split_part(f, ':', 2)::int) as worst, count(*) as n_findings from h where f is not null group by path)"""
ORACLE_SQL = {
    "leaked_ids": "select distinct l_orderkey as pack_id, 's' || l_suppkey as object_id from lineitem join supplier on s_suppkey = l_suppkey where s_nationkey >= 5 and s_nationkey <> l_orderkey % 25",
    "workflow_nodes": f"with {_NODES} select path, n::int as n, 'n' || n as name, type, case when supp % 9 = 0 then 'httpAuth' else '' end as credential_types, '1.1' as type_version, null::varchar as resource, 'get' as operation from l",
    "workflow_edges": f"with {_NODES} select path, 'n' || n as source, 'main' as channel, 0 as output, 'n' || (n + 1) as target, 0 as input from l where n < size - 1",
    "workflow_leaves": f"""with {_NODES}, f as (select unnest([{{'p': 'parameters.url', 'v': 'http://' || case when supp % 3 = 0 then '10.0.0.' else '8.8.8.' end || (supp % 200) || '/'}}, {{'p': 'parameters.jsCode', 'v': case when part % 7 = 0 then 'eval (1)' else 'return 1' end}}, {{'p': 'parameters.operation', 'v': 'get'}},
  {{'p': 'parameters.options.headers[0].name', 'v': 'X'}}, {{'p': 'parameters.options.headers[1].name', 'v': 'Y'}}, {{'p': 'parameters.options.headers[0].apiKey', 'v': 'value-' || part}}, {{'p': 'parameters.options.rows[0][0]', 'v': 'deep ' || supp}}]) as x from l)
select x.p as json_path, count(*) as n, count(distinct x.v) as n_values from f group by 1""",
    "workflow_reports": f"""with {_NODES}, {_FOUND}, w as (select path, count(*) as node_count from l group by path), s as (select *, coalesce(worst, 1) as k from w left join r using (path))
select ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][k] as max_severity, case k when 5 then 'BLOCKED' when 4 then 'REVIEW_REQUIRED' else 'SAFE_FOR_LEARNING' end as risk_decision, rules, count(*) as n, sum(node_count)::bigint as n_nodes, sum(n_findings)::bigint as n_findings from s group by all""",
    "closed_schema_faults": f"""with p(turn, faults) as (values {", ".join(f"({k}, {list(f)})" for k, (_, _, f) in enumerate(_PLANTED))}),
f as (select doc_id, unnest(faults) as f from documents join p on turn = doc_id % {len(_PLANTED) + 1} where text is not null) select doc_id, regexp_extract(f, '^(.*):', 1) as path, regexp_extract(f, '[A-Z_]+$') as code from f""",
    "closed_schema_records": """with s as (select *, 'flows/' || doc_id || '.json' as source_path, sha256(text) as digest from documents where text is not null),
a as (select *, sha256('example/flows' || chr(31) || repeat('a', 40) || chr(31) || source_path || chr(31) || digest) as source_id from s), b as (select *, sha256(source_id || chr(31) || '1.0') as analysis_id from a)
select source_path, digest as sha256, source_id, analysis_id, sha256(analysis_id || chr(31) || '0.1') as item_id, source as integrations from b""",
    "snapshot_commits": f"""with d as ({_TWO}) select version, 'sources' as "table", count(distinct source || '|' || doc_id) as n from d group by version
union all select version, 'analyses', count(distinct (source || '|' || (doc_id % 500), lang)) from d group by version union all select version, 'items', count(distinct text) from d group by version""",
    "snapshot_plan": """with s as (select *, doc_id % 3 <> 0 as held, case when doc_id % 50 = 1 then text || '!' else text end as now from documents), texts as (select distinct now from s)
select 'sources' as "table", case when not held then 'created' when now = text then 'reused' else 'drifted' end as outcome, count(*) as n from s group by 2
union all select 'analyses', case when bool_or(held) then 'reused' else 'created' end as outcome, count(*) from (select bool_or(held) as held from s group by source, doc_id % 500, lang) group by held
union all select 'items', case when exists (select 1 from s where held and text = texts.now) then 'reused' else 'created' end as outcome, count(*) from texts group by 2""",
    "run_transitions": f"with recursive {_RUNS} select run_id, seq, want as phase, verdict, now as phase_after, used as attempts_after from w",
    "run_states": f"with recursive {_RUNS} select run_id, arg_max(coalesce(now, ''), n) as phase, arg_max(used, n) as attempts, count(*) filter (where verdict not in ('ACCEPTED', 'UNCHANGED')) as n_refused from w group by run_id",
    "runs_stalled": f"""with recursive {_RUNS}, g as (select *, coalesce(lead(moment) over (partition by run_id order by n), (select max(ts) from events)) as upto from w)
select run_id, now as phase, strftime(moment + interval 2 days, '%Y-%m-%d %H:%M:%S') as stalled_at from g where now is not null and now not in ('PASSED', 'ABORTED') and upto > moment + interval 2 days""",
    "context_packs_fitted": f"""with {_PACK_ROWS}, {_fold()}
select pid as context_pack_id, budget as token_budget, size, size <= budget as fits, case when size > budget then size end as minimum_required, array_to_string(list_transform(log, lambda l: l.step), ',') as steps, array_to_string(evid, ',') as evidence_ids,
  array_to_string(evs, ',') as recent_event_ids, len(prov) as n_provenance, array_to_string(refs, ',') as procedural_refs, md5(array_to_string({_GAPS}, '|')) as gaps_md5, md5(array_to_string(cons, '|')) as constraints_md5 from z5""",
    "context_packs_core": f"""with {_PACK_ROWS}, t as (select *, 2 + 4 + {_tok('pid')} + 3 + 5 + 3 + 1 + 3 + {_list('cons')} + 5 + {_PROV} + 1 + 2 + 6 as minimum from s)
select pid as context_pack_id, minimum, minimum + 4 + {_list('evs')} + 3 + {_list('evid')} + 4 + {_list('refs')} + case when len(arts) > 0 then 4 + {_ARTS} else 0 end as whole from t""",
    "private_network_urls": f"""with w as (select page_id, page_id * 257 % 65536 as g, unnest(['plain', 'expression', 'user', 'bracketed', 'mapped', 'template', 'named', 'other_scheme']) as way from pages)
select way, count(*) filter (where case way when 'bracketed' then {_PRIVATE_6} when 'named' then page_id % 2 = 0 when 'mapped' then true when 'template' then false when 'other_scheme' then false else {_PRIVATE_4} end) as n_private, count(*) as n from w group by way""",
    "package_verdicts": f"""with k as (select page_id, {list(_PACKAGES)}[page_id % {len(_PACKAGES)} + 1] as pkg, {list(_NODE_NAMES)}[page_id % {len(_NODE_NAMES)} + 1] as name from pages)
select pkg || name as type, case when pkg = 'n8n-nodes-base.' and name in ('executeCommand', 'ssh') then 'BLOCKED' when pkg = 'n8n-nodes-base.' and name = 'code' or page_id % {len(_PACKAGES)} > 2 then 'REVIEW_REQUIRED' else 'ALLOWED' end as verdict,
  count(*) filter (where pkg = 'n8n-nodes-base.' and name = 'httpRequest' or page_id % 11 = 0 or name like '%Trigger' and not (pkg = 'n8n-nodes-base.' and name = 'manualTrigger')) as n_pinned, count(*) as n from k group by all""",
}
