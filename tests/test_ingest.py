import json

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import ingest


def item(path, **more):
    return {"source_path": path, "sha256": "a" * 64, "risk_decision": "SAFE_FOR_LEARNING", "knowledge_role": "REFERENCE", "node_count": 2, "untrusted_text_count": 0, "finding_rules": []} | more


def frame(spark, *items):
    return spark.createDataFrame([tuple(x.values()) for x in items], ingest.ITEM)


def test_manifest(spark):
    whole = {"manifest_version": "1", "source_repo": "r", "source_commit": "c", "analyzer_version": "1", "selection_profile": "p", "items": [item("a.json")]}
    assert ingest.load_manifest(json.dumps(whole)) == whole
    for bad in ({**whole, "x": 1}, {**whole, "items": []}, {**whole, "items": [item("a")] * 5}, {**whole, "items": [{"source_path": "a"}]}):
        with pytest.raises(ValueError):
            ingest.load_manifest(json.dumps(bad))
    items = frame(spark, item("../a"), item("b", finding_rules=["NETWORK_REQUEST", "A"]), item("b"), item("c", sha256="zz"))
    assert sorted(map(tuple, ingest.manifest_faults(items).collect())) == [("../a", "UNSAFE_PATH"), ("b", "REPEATED_PATH"), ("b", "RULES_ALLOWED"), ("b", "RULES_SORTED_UNIQUE"), ("c", "SHA256_FORMAT")]
    drift = ingest.rebuilt_drift(frame(spark, item("a"), item("b"), item("c")), frame(spark, item("a"), item("b", node_count=3)))
    assert sorted(map(tuple, drift.collect())) == [("b", "node_count"), ("c", "missing")]


def test_reports_profiles_and_scripts(spark):
    reports = spark.createDataFrame([("./x/a/flow.json",), ("y/flow.json",), ("x\\b.json",)], "source_path string")
    wanted = spark.createDataFrame([("flow.json",), ("a/flow.json",), ("x/b.json",), ("low.json",)], "path string")
    got = {r.path: (r.n_matches, r.source_path) for r in ingest.matching_reports(reports, wanted).collect()}
    assert got == {"flow.json": (2, None), "a/flow.json": (1, "./x/a/flow.json"), "x/b.json": (1, "x\\b.json"), "low.json": (0, None)}
    assert ingest.profile_faults('{"url": "http://h", "apiKey": "x", "n": {"v": "Bearer abcdefgh1"}}') == ["apiKey", "n.v"]
    assert spark.range(1).select(ingest.sanitised_url(F.lit("https://u:p@h.org:8/x?y"))).first()[0] == "https://h.org:8"
    scripts = spark.createDataFrame([("1.sql", "check (kind in ('a', 'b'))"), ("2.sql", "CHECK (kind IN ('c','b','a')) check (other in ('z'))")], "path string, text string")
    assert {r.column: r.values for r in ingest.sql_vocabularies(scripts).collect()} == {"kind": ["a", "b", "c"], "other": ["z"]}
    assert ingest.fail_closed(reports, "CLIENT:a").count() == 0 and ingest.fail_closed(reports, "GLOBAL:GLOBAL").count() == 3
    assert ingest.capabilities(spark, reports, ["source_path", "nope"], ["upper"]).where("present").count() == 2
