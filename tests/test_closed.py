"""Closed schemas: each rule broken once, at its path; what is allowed is not told; documents that are none."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import closed
from quarrystone.operators.snapshots import Batch, Snapshots

H = "a" * 64
ITEM = {
    "schema_version": "0.1", "kind": "KNOWLEDGE_ITEM", "source_content_trust": "UNTRUSTED_SOURCE_DATA", "provenance": {"source_repo": "r", "source_commit": "b" * 40, "source_path": "p/é", "sha256": H},
    "workflow": {
        "name_untrusted": "", "node_count": 2, "node_types": {"t": 1, "u": 0}, "trigger_types": ["x", "x"], "integrations": [],
        "nodes": [{"name_untrusted": "n", "type": "t", "type_version": 1.5, "resource": None, "operation": "op", "credential_types": ["c"]}, {"name_untrusted": "", "type": "u", "credential_types": []}],
        "edges": [{"source_name_untrusted": "n", "target_name_untrusted": "", "channel": "main", "source_output_index": 0, "target_input_index": 0}],
    },
    "admission": {
        "source_stage": "RAW_UNTRUSTED", "analysis_stage": "STATIC_ANALYZED", "risk_decision": "BLOCKED", "max_severity": "CRITICAL", "knowledge_role": "SECURITY_EXAMPLE", "learning_scope": "security_only",
        "structure_reference_allowed": False, "implementation_reference_allowed": False, "validated": False,
    },
    "security_findings": [{"rule_id": None, "severity": "HIGH"}, {}],
    "untrusted_text": [{"kind": "k", "node_name": "", "node_type": "", "json_path": "j", "sha256": H, "char_count": 0, "preview": ""}, {"kind": "k", "node_name": "", "node_type": "", "json_path": "j", "sha256": H, "char_count": 3}],
    "executable_snippets_untrusted": [{"kind": "k", "node_name": "", "node_type": "", "json_path": "j", "reason": "r", "language": 'l,"code":', "sha256": H, "char_count": 1, "content_persisted": False}],
}
DROP = object()
#: Where something is put, what, and the faults that it makes.
BROKEN = [
    (["x"], 1, {("x", "UNEXPECTED_FIELD")}),
    (["schema_version"], "0.2", {("schema_version", "VALUE")}),
    (["schema_version"], 1, {("schema_version", "NOT_A_STRING")}),
    (["kind"], DROP, {("kind", "MISSING_FIELD")}),
    (["source_content_trust"], None, {("source_content_trust", "NOT_A_STRING")}),
    (["provenance"], [], {("provenance", "NOT_AN_OBJECT")}),
    (["provenance", "z"], {"deep": 1}, {("provenance.z", "UNEXPECTED_FIELD")}),
    (["provenance", "source_repo"], "", {("provenance.source_repo", "EMPTY")}),
    (["provenance", "source_repo"], "é" * 513, {("provenance.source_repo", "TOO_LONG")}),
    (["provenance", "source_commit"], "B" * 40, {("provenance.source_commit", "PATTERN")}),
    (["provenance", "source_commit"], "b" * 40 + "\n", {("provenance.source_commit", "PATTERN")}),
    (["provenance", "source_commit"], "b" * 65, {("provenance.source_commit", "TOO_LONG")}),
    (["provenance", "sha256"], "a" * 63, {("provenance.sha256", "PATTERN")}),
    (["provenance", "source_path"], "p" * 2049, {("provenance.source_path", "TOO_LONG")}),
    (["workflow", "name_untrusted"], "n" * 257, {("workflow.name_untrusted", "TOO_LONG")}),
    (["workflow", "node_count"], True, {("workflow.node_count", "NOT_A_WHOLE_NUMBER")}),
    (["workflow", "node_count"], 3, {("workflow", "NODE_COUNT")}),
    (["workflow", "node_count"], -1, {("workflow.node_count", "TOO_SMALL"), ("workflow", "NODE_COUNT")}),
    (["workflow", "node_count"], 1.5, {("workflow.node_count", "NOT_A_WHOLE_NUMBER")}),
    (["workflow", "node_types", ""], 1, {("workflow.node_types.<key>", "EMPTY")}),
    (["workflow", "node_types", "t"], "1", {("workflow.node_types.t", "NOT_A_WHOLE_NUMBER")}),
    (["workflow", "node_types"], None, {("workflow.node_types", "NOT_AN_OBJECT")}),
    (["workflow", "trigger_types"], "x", {("workflow.trigger_types", "NOT_AN_ARRAY")}),
    (["workflow", "trigger_types", 1], 7, {("workflow.trigger_types[1]", "NOT_A_STRING")}),
    (["workflow", "integrations"], ["", "i" * 257], {("workflow.integrations[0]", "EMPTY"), ("workflow.integrations[1]", "TOO_LONG")}),
    (["workflow", "nodes", 1], "n", {("workflow.nodes[1]", "NOT_AN_OBJECT")}),
    (["workflow", "nodes", 1, "parameters"], {}, {("workflow.nodes[1].parameters", "UNEXPECTED_FIELD")}),
    (["workflow", "nodes", 0, "type"], "", {("workflow.nodes[0].type", "EMPTY")}),
    (["workflow", "nodes", 0, "type_version"], "two words", {("workflow.nodes[0].type_version", "NOT_A_SAFE_SCALAR")}),
    (["workflow", "nodes", 0, "resource"], [1], {("workflow.nodes[0].resource", "NOT_A_SAFE_SCALAR")}),
    (["workflow", "nodes", 0, "operation"], {}, {("workflow.nodes[0].operation", "NOT_A_SAFE_SCALAR")}),
    (["workflow", "nodes", 0, "credential_types", 0], "c" * 129, {("workflow.nodes[0].credential_types[0]", "TOO_LONG")}),
    (["workflow", "nodes", 0, "credential_types"], DROP, {("workflow.nodes[0].credential_types", "MISSING_FIELD")}),
    (["workflow", "edges", 0, "channel"], None, {("workflow.edges[0].channel", "NOT_A_STRING")}),
    (["workflow", "edges", 0, "source_output_index"], -1, {("workflow.edges[0].source_output_index", "TOO_SMALL")}),
    (["workflow", "edges", 0, "w"], 0, {("workflow.edges[0].w", "UNEXPECTED_FIELD")}),
    (["admission", "source_stage"], "RAW", {("admission.source_stage", "VALUE")}),
    (["admission", "analysis_stage"], "", {("admission.analysis_stage", "VALUE")}),
    (["admission", "implementation_reference_allowed"], True, {("admission.implementation_reference_allowed", "VALUE")}),
    (["admission", "validated"], 0, {("admission.validated", "NOT_A_BOOLEAN")}),
    (["admission", "structure_reference_allowed"], True, {("admission", "STRUCTURE_ALLOWED")}),
    (["admission", "max_severity"], "LOW", {("admission", "UNKNOWN_DECISION")}),
    (["admission", "learning_scope"], "review_only", {("admission", "OTHER_ROLE")}),
    (["security_findings", 0, "severity"], "s" * 33, {("security_findings[0].severity", "TOO_LONG")}),
    (["security_findings", 1, "message"], "m", {("security_findings[1].message", "UNEXPECTED_FIELD")}),
    (["security_findings"], {}, {("security_findings", "NOT_AN_ARRAY")}),
    (["untrusted_text", 0, "preview"], "p" * 401, {("untrusted_text[0].preview", "TOO_LONG")}),
    (["untrusted_text", 0, "preview"], None, {("untrusted_text[0].preview", "NOT_A_STRING")}),
    (["untrusted_text", 1, "sha256"], "X" * 64, {("untrusted_text[1].sha256", "PATTERN")}),
    (["untrusted_text", 1, "char_count"], "3", {("untrusted_text[1].char_count", "NOT_A_WHOLE_NUMBER")}),
    (["executable_snippets_untrusted", 0, "content_persisted"], True, {("executable_snippets_untrusted[0].content_persisted", "VALUE")}),
    (["executable_snippets_untrusted", 0, "reason"], "", {("executable_snippets_untrusted[0].reason", "EMPTY")}),
    (["executable_snippets_untrusted", 0, "more"], [{"a": {"command": 1}}], {("executable_snippets_untrusted[0].more", "UNEXPECTED_FIELD"), ("executable_snippets_untrusted", "BANNED_KEY")}),
    (["executable_snippets_untrusted", 0, "content"], "x", {("executable_snippets_untrusted[0].content", "UNEXPECTED_FIELD"), ("executable_snippets_untrusted", "BANNED_KEY")}),
]


def altered(path, value):
    item = copy.deepcopy(ITEM)
    at = item
    for step in path[:-1]:
        at = at[step]
    if value is DROP:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return item


@pytest.fixture(scope="module")
def told(spark):
    rows = [(str(k), json.dumps(altered(p, v), ensure_ascii=k % 2 == 0)) for k, (p, v, _) in enumerate(BROKEN)] + [("good", json.dumps(ITEM, indent=1))]
    rows += [("none", None), ("text", "{"), ("list", "[]"), ("bare", '"x"'), ("escaped", json.dumps(ITEM).replace('"x", "x"', '"x"').replace('"kind": "KNOWLEDGE_ITEM"', '"k\\u0069nd": "KNOWLEDGE_ITEM"'))]
    out = {}
    for r in closed.faults(spark.createDataFrame(rows, "id string, json string").repartition(3), "id").collect():
        out.setdefault(r.id, []).append((r.path, r.code))
    return out


@pytest.mark.parametrize("k", range(len(BROKEN)))
def test_each_rule(told, k):
    found = told.get(str(k), [])
    assert set(found) == BROKEN[k][2] and len(found) == len(set(found))


def test_whole_documents(told):
    assert "good" not in told and "escaped" not in told
    assert told["none"] == told["text"] == [("", "NOT_JSON")] and told["list"] == told["bare"] == [("", "NOT_AN_OBJECT")]


def test_size_counts_separators(spark):
    """The size is that of the text with a space behind each comma and colon."""
    wide = len(json.dumps(ITEM, ensure_ascii=False, sort_keys=True).encode())
    rows = spark.createDataFrame([("a", json.dumps(ITEM))], "id string, json string")
    assert closed.faults(rows, "id", max_bytes=wide).count() == 0
    assert [(r.path, r.code) for r in closed.faults(rows, "id", max_bytes=wide - 1).collect()] == [("", "TOO_LARGE")]


def test_records_of_valid_items(spark, tmp_path):
    """Three tables that name one another, published in one commit; the same item again is reused, another analysis of it is new."""
    rows = spark.createDataFrame([(json.dumps(ITEM),)], "json string")
    parts = closed.prepared(rows, "1.0")
    keys = {"sources": "source_id", "analyses": "analysis_id", "items": "item_id"}
    batches = lambda parts: {name: Batch(f, [keys[name]]) for name, f in parts.items()}
    store = Snapshots(spark, str(tmp_path / "store"))
    assert store.commit(batches(parts)).counts == {name: {"created": 1, "reused": 0, "drifted": 0} for name in keys}
    assert not store.commit(batches(closed.prepared(rows, "1.0"))).published
    assert {n: c["created"] for n, c in store.commit(batches(closed.prepared(rows, "2.0"))).counts.items()} == {"sources": 0, "analyses": 1, "items": 1}
    both = store.read("items").join(store.read("analyses"), "analysis_id").join(store.read("sources"), "source_id")
    assert both.count() == 2 and both.first().trigger_types == ["x"] and both.where(F.col("sha256") == H).count() == 2
    with pytest.raises(ValueError):
        closed.prepared(rows, "")


def test_parsed_once(spark):
    """Null checks, as joins make them, do not parse an item once more."""
    texts = spark.range(2).select(F.concat(F.lit("{"), F.col("id").cast("string")).alias("json"))
    told = closed.prepared(texts, "1.0")["sources"].where("source_id is not null and source_path is not null")
    assert told._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
