import json

import pytest
from test_world import frame

from quarrystone.__main__ import main
from quarrystone.operators.snapshots import Snapshots


def said(capsys):
    return capsys.readouterr().out.strip().splitlines()


def test_workflows(spark, tmp_path, capsys):
    folder = tmp_path / "flows" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps({"name": "a", "nodes": [{"name": "t", "type": "n8n-nodes-base.manualTrigger", "parameters": {}}], "connections": {}}))
    (folder / "b.json").write_text("{")
    assert main(["analyze", str(tmp_path / "flows"), "--out", str(tmp_path / "out")], spark) == 0
    assert [(r["risk_decision"], r["n"]) for r in map(json.loads, said(capsys))] == [("BLOCKED", 1), ("SAFE_FOR_LEARNING", 1)]
    make = ["compile", str(tmp_path / "flows"), "--out", str(tmp_path / "store"), "--repo", "example/flows", "--commit", "a" * 40]
    assert main([*make, "--dry-run"], spark) == 0 and not (tmp_path / "store").exists()
    assert main(make, spark) == 0 and [r.source_path for r in Snapshots(spark, str(tmp_path / "store")).read("sources").collect()] == ["deep/a.json"]
    assert main([*make[:-1], "short"], spark) == 1
    with pytest.raises(SystemExit):
        main(["run", "nonsense", "--tables", "x", "--out", "y"], spark)


def test_worlds(spark, tmp_path, capsys):
    a = {"scope_type": "CLIENT", "scope_id": "a"}
    entity = [{"entity_id": "ea", "entity_type": "COMPANY", "canonical_name": "Alpha"} | a, {"entity_id": "eb", "entity_type": "COMPANY", "canonical_name": "Beta"} | a | {"scope_id": "b"}]
    claim = {"claim_id": "c1", "subject_entity_id": "ea", "predicate": "p", "object_value": "1", "epistemic_status": "DECLARED", "source_ids": ["s"]} | a
    for name, more in (("good", {}), ("poor", {"epistemic_status": "SURE"}), ("bad", {"object_value": '{"token": "x"}'})):
        frame(spark, "entity", entity).write.json(str(tmp_path / name / "entity"))
        frame(spark, "claim", [claim | more]).write.json(str(tmp_path / name / "claim"))
    assert [(main(["check", str(tmp_path / n)], spark), said(capsys)[-1]) for n in ("poor", "bad")] == [(0, "LIMITS"), (1, "BLOCKED")]
    capsys.readouterr()
    assert main(["pack", str(tmp_path / "good"), "alpha", "--scope", "CLIENT:a", "--entity", "Alpha"], spark) == 0
    pack = json.loads(said(capsys)[-1])
    assert pack["claim_ids"] == ["c1"] and [(e["object_id"], [p["source_id"] for p in e["provenance"]]) for e in pack["provenance_summary"]] == [("c1", ["s"])] and "eb" not in str(pack)
    assert main(["pack", str(tmp_path / "good"), "alpha", "--scope", "CLIENT:a", "--budget", "3"], spark) == 1
    assert main(["pack", str(tmp_path / "good"), "alpha", "--scope", "nowhere"], spark) == 1
