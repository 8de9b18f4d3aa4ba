"""Workflows as items: what they hold, what the rules refuse, and that a refused or repeated batch changes nothing."""

import json

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import analyze, checks, compile, snapshots, stored
from quarrystone.sources import units


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("flows")
    flows = {
        "a": {"nodes": [{"name": "t", "type": "n8n-nodes-base.manualTrigger"}, {"name": "s", "type": "n8n-nodes-base.set", "parameters": {"text": "hello", "apiKey": "abcdefghij"}}], "connections": {"t": {"main": [[{"node": "s", "index": 1}]]}}},
        "b": {"nodes": [{"name": "c", "type": "n8n-nodes-base.code", "parameters": {"jsCode": "eval(1)"}}, {"name": "n" * 400, "type": "n8n-nodes-base.set"}]},
        "empty": {"nodes": []},
    }
    for name, flow in flows.items():
        (folder / f"{name}.json").write_text(json.dumps(flow))
    (folder / "broken.json").write_text("{")
    found = units.files(spark, str(folder)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    nodes, leaves, edges = analyze.documents(found)
    return compile.items(found, nodes, leaves, edges, analyze.findings(nodes, leaves), "r", "c" * 40).cache()


def test_items(items):
    held = {r.source_path: r for r in items.collect()}
    assert set(held) == {"a.json", "b.json", "empty.json"}
    a, b, e = (held[k] for k in ("a.json", "b.json", "empty.json"))
    assert a.node_count == 2 and [(x.source_name_untrusted, x.target_name_untrusted, x.target_input_index) for x in a.edges] == [("t", "s", 1)] and a.trigger_types == ["n8n-nodes-base.manualTrigger"]
    assert [(x.json_path, x.char_count) for x in a.untrusted_text] == [("parameters.text", 5)] and [x.rule_id for x in a.security_findings] == ["POSSIBLE_HARDCODED_SECRET"]
    assert "abcdefghij" not in str(held) and "eval(1)" not in str(held)
    assert [(x.reason, x.language) for x in b.executable] == [("code_node", "javascript")] and max(len(x.name_untrusted) for x in b.nodes) == 256
    assert (b.knowledge_role, b.learning_scope, b.structure_reference_allowed) == ("QUARANTINED", "review_only", False)
    assert e.node_count == 0 and e.nodes == [] and e.knowledge_role == "REFERENCE"


def test_rules_and_publication(items, spark, tmp_path):
    assert compile.item_faults(items).count() == 0
    bad = items.limit(1).withColumns({"node_count": F.lit(9), "learning_scope": F.lit("none"), "sha256": F.lit("X"), "validated": F.lit(True), "source_commit": F.lit(None).cast("string"), "source_path": F.lit("../x")})
    assert {r.code for r in compile.item_faults(bad).collect()} == {"NODE_COUNT", "ROLE_SCOPE", "SHA256", "NOT_VALIDATED", "COMMIT", "PATH"}
    at = str(tmp_path / "store")
    with pytest.raises(ValueError):
        compile.publish(items.unionByName(bad), at, "1.0")
    assert not (tmp_path / "store").exists()
    assert compile.publish(items, at, "1.0", dry_run=True) == {k: (3, 0) for k in compile.KEYS} and not (tmp_path / "store").exists()
    assert compile.publish(items, at, "1.0") == {k: (3, 0) for k in compile.KEYS}
    assert compile.publish(items, at, "1.0") == {k: (0, 3) for k in compile.KEYS}
    assert compile.publish(items, at, "2.0") == {"sources": (0, 3), "analyses": (3, 0), "items": (3, 0)}
    with pytest.raises(ValueError):  # one part has drifted: no part is written
        compile.publish(items.withColumn("max_severity", F.lit("LOW")), at, "1.0")
    assert snapshots.Snapshots(spark, at).read("analyses").count() == 6
    assert [r.value for r in compile.corpus_gate(spark.createDataFrame([(["A"],)], "rules array<string>"), ["A", "B"]).collect()] == ["B"]


def test_stored_pack(spark):
    schema = "knowledge_id string, knowledge_type string, title string, summary string, epistemic_status string, scope_type string, scope_id string, data_classification string, compatibility_status string, observed_version string, node_type string, instruction_authority string, lifecycle_state string, valid_until timestamp, approved_at timestamp"
    row = lambda i, scope, status="OBSERVED", version="1", state="CURRENT": (i, "PATTERN", "solar " + i, "s", status, "GLOBAL" if scope == "GLOBAL" else "CLIENT", scope, None, state, version, "http", None, "ACTIVE", None, None)
    knowledge = spark.createDataFrame([row("k1", "a"), row("k2", "b"), row("k3", "GLOBAL", "MEASURED", "2"), row("k4", "a", "CONFLICTING", "2", "DEPRECATED")], schema)
    shape = "item_id string, knowledge_role string, learning_scope string, risk_decision string, max_severity string, node_types array<string>, source_repo string, source_commit string, source_path string, implementation_reference_allowed boolean, compiled_at int"
    structures = spark.createDataFrame([("w1", "REFERENCE", "s", "SAFE", "INFO", ["x.set", "x.solar"], "r", "c", "p.json", True, 1), ("w2", "REFERENCE", "s", "SAFE", "INFO", [], "r", None, None, True, 2), ("w3", "REFERENCE", "s", "SAFE", "INFO", [], "r", "c", "q", False, 3)], shape)
    sources = spark.createDataFrame([("k1", "s2", None, {"page": "2"}), ("k1", "s1", "PDF_PAGE", None), ("k2", "s3", "PDF_PAGE", None)], "knowledge_id string, source_id string, locator_kind string, locator map<string,string>")
    as_of = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    got = stored.pack({"knowledge": knowledge, "structures": structures, "sources": sources}, "solar", "CLIENT:a", as_of, "BUILD")
    items = {r.item_id: r for r in got["items"].collect()}
    assert list(items) == ["k3", "k1", "w1", "w2", "k4"]
    assert [tuple(p) for p in items["k1"].provenance] == [("s1", "PDF_PAGE", {}), ("s2", "GENERIC", {"page": "2"})] and items["k3"].provenance == []
    assert (items["w1"].title, items["w1"].epistemic_status, items["w1"].relevance) == ("Structure reference: p.json", "OBSERVED", 0.0) and items["w1"].summary == "role=REFERENCE scope=s risk=SAFE/INFO nodes=x.set, x.solar"
    assert [tuple(p) for p in items["w1"].provenance] == [("r", "REPO_FILE", {"path": "p.json", "commit": "c"})] and items["w2"].title == "Structure reference: w2" and items["w2"].provenance[0].locator == {}
    old = knowledge.drop("scope_type", "scope_id", "data_classification", "compatibility_status", "observed_version", "node_type")
    spoken = spark.createDataFrame([("k1", "s1", "t9", None, 5, 9)], "knowledge_id string, source_id string, transcript_id string, segment_id string, start_ms long, end_ms long")
    mine, everyone = stored.pack({"knowledge": old, "sources": spoken}, "solar", "CLIENT:a", as_of, "LEARN"), stored.pack({"knowledge": old, "sources": spoken}, "solar", "GLOBAL", as_of, "LEARN")
    assert mine["items"].count() == 0 and {r.gap for r in mine["gaps"].collect()} == {"UNSCOPED_STORE:knowledge:REFUSED", "NO_ITEM_FOUND"}
    assert everyone["items"].count() == 4 and {r.gap for r in everyone["gaps"].collect()} == {"UNSCOPED_STORE:knowledge:READ_AS_GLOBAL"}
    assert [tuple(p) for p in everyone["items"].where("item_id = 'k1'").first().provenance] == [("s1", "MEDIA_TIME", {"transcript_id": "t9", "start_ms": "5", "end_ms": "9"})]
    assert {(r.kind, tuple(r.item_ids)) for r in got["conflicts"].collect()} == {("MARKED_CONFLICTING", ("k4",)), ("VERSION_CONFLICT", ("k1", "k3", "k4")), ("DEPRECATED_BESIDE_CURRENT", ("k1", "k3", "k4"))}
    assert {r.gap for r in got["gaps"].collect()} == {"NO_STORE:experiences", "NO_ENVIRONMENT_PROFILE"}
    assert stored.rendered(got["items"]).first().line == "[2:MEASURED_OWN_EXECUTION] solar k3 | MEASURED | GLOBAL:GLOBAL"
    nothing = stored.pack({"knowledge": knowledge}, "lunar", "CLIENT:a", as_of, "LEARN")
    assert nothing["items"].count() == 0 and [r.gap for r in nothing["gaps"].collect()] == ["NO_ITEM_FOUND"]
    with pytest.raises(ValueError):
        stored.pack({"knowledge": knowledge}, "x", "CLIENT:a", as_of, "GUESS")


def test_checks_with_nulls(spark):
    packs = spark.createDataFrame([("p", ["c1", "c2"], ["e1"], {"c1": ["s"], "e1": [None, ""]}), ("q", None, None, None)], "pack_id string, claim_ids array<string>, evidence_ids array<string>, provenance map<string,array<string>>")
    assert {(r.pack_id, r.object_id, r.code[13:]) for r in checks.provenance_faults(packs).collect()} == {("p", "c2", "MISSING_PROVENANCE"), ("p", "e1", "EMPTY_PROVENANCE_ENTRY")}
    assert {r.object_id for r in checks.referenced_ids(packs, "pack_id").collect()} == {"c1", "c2", "e1"}
    projections = spark.createDataFrame([("s", ["d1", "d2", "d3"]), ("t", None)], "id string, active_decision_ids array<string>")
    decisions = spark.createDataFrame([("d1", "ACTIVE"), ("d2", None)], "decision_id string, status string")
    assert {(r.decision_id, r.code[:10]) for r in checks.projection_faults(projections, decisions).collect()} == {("d2", "SUPERSEDED"), ("d3", "PROJECTION")}
