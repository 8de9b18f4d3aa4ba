"""A small world of two clients: nothing of one reaches the other, packs are reproducible and fit their budgets."""

import datetime as dt

import pytest
from test_budget import size as size_of

from quarrystone.operators import semantic
from quarrystone.operators.checks import FORBIDDEN_PROMOTIONS
from quarrystone.operators.schemas import REQUIRED, SCHEMAS, VOCABULARIES, structural_faults
from quarrystone.operators.world import AmbiguousEntity, BudgetTooSmall, World

T0 = dt.datetime(2024, 1, 1)


def frame(spark, kind, rows):
    names = [c.strip().split(" ")[0] for c in SCHEMAS[kind].replace("struct<source_id:string,fragment_id:string,locator:map<string,string>,observed_at:timestamp,captured_at:timestamp,content_hash:string>", "x").split(", ")]
    types = dict(spark.createDataFrame([], SCHEMAS[kind]).dtypes)
    plain = {"string": "x", "timestamp": T0, "int": 1}
    whole = {c: VOCABULARIES[kind, c][0] if (kind, c) in VOCABULARIES else [] if types[c].startswith("array") else plain[types[c]] for c in REQUIRED[kind] if c not in ("level", "subject_entity_id")}
    filled = [whole | {"contract_version": "1.0.0", "object_type": kind, "level": "INTERNAL"} | r for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in filled], SCHEMAS[kind])


@pytest.fixture(scope="module")
def world(spark):
    a, b, g = ({"scope_type": "CLIENT", "scope_id": "a"}, {"scope_type": "CLIENT", "scope_id": "b"}, {"scope_type": "GLOBAL", "scope_id": "GLOBAL"})
    ent = lambda i, n, s, **k: {"entity_id": i, "entity_type": "COMPANY", "canonical_name": n, "aliases": [], "status": "ACTIVE", "created_at": T0} | s | k
    claim = lambda i, s, o, sc, **k: {"claim_id": i, "subject_entity_id": s, "predicate": "owns", "object_entity_id": o, "epistemic_status": "DECLARED", "status": "ACTIVE", "created_at": T0, "last_updated_at": T0, "supporting_evidence_ids": ["v1"]} | sc | k
    return World.of(spark, {
        "entity": frame(spark, "entity", [ent("ea", "Alpha Works", a), ent("eb", "Beta Works", b), ent("eg", "Global Works", g), ent("es", "Hidden", a, level="SECRET"), ent("ea2", "Alpha Works", a)]),
        "claim": frame(spark, "claim", [claim("c1", "ea", "eg", a), claim("c2", "eg", "eb", g), claim("c3", "ea", None, a, predicate="size", object_value="1"), claim("c4", "ea", None, a, predicate="size", object_value="2")]),
        "source": frame(spark, "source", [{"source_id": "s1", "source_type": "DOCUMENT", "title": "solar report", "captured_at": T0, "level": "PUBLIC"} | a, {"source_id": "s2", "source_type": "DOCUMENT", "title": "solar secret", "captured_at": T0, "level": "SECRET"} | a, {"source_id": "s3", "source_type": "DOCUMENT", "title": "solar b", "captured_at": T0, "level": "PUBLIC"} | b]),
        "fragment": frame(spark, "fragment", [{"fragment_id": "f1", "source_id": "s1", "content": "solar panels", "content_hash": "x"}, {"fragment_id": "f2", "source_id": "s2", "content": "solar hidden", "content_hash": "x"}]),
        "evidence": frame(spark, "evidence", [{"evidence_id": "v1", "source_id": "s1", "fragment_ids": ["f1"], "direction": "SUPPORTS", "strength": "STRONG", "created_at": T0} | a, {"evidence_id": "v2", "source_id": "s3", "fragment_ids": [], "direction": "SUPPORTS", "strength": "WEAK", "created_at": T0} | b]),
        "decision": frame(spark, "decision", [{"decision_id": "d1", "title": "t", "decision": "x", "status": "ACTIVE", "created_at": T0} | a, {"decision_id": "d2", "title": "t", "decision": "y", "status": "ACTIVE", "supersedes": "d1", "created_at": T0 + dt.timedelta(40)} | a]),
        "event": frame(spark, "event", [{"event_id": f"note-number-{k:04d}", "event_type": "REVIEW", "occurred_at": T0, "recorded_at": T0} | a for k in range(8)]),
    })


def test_reads_stay_in_scope(spark, world):
    mine = world.scoped("CLIENT:a")
    assert {r.entity_id for r in mine.all_of("entity").collect()} == {"ea", "eg", "ea2"}
    assert [r.evidence_id for r in mine.search("solar", ["ea"]).collect()] == ["v1"]
    assert sorted(map(tuple, mine.expand(["ea"], 3).collect())) == [("eg", 1)] and mine.expand(["eg"]).count() == 0  # from subject to object only
    assert mine.search("solar", filters={"direction": "CONTRADICTS"}).count() == 0 and mine.search("solar", filters={"strength": "STRONG"}).count() == 1
    with pytest.raises(ValueError):
        mine.search("solar", filters={"content": "x"})
    assert mine.search("solar", filters={"strength": {"WEAK", "STRONG"}, "direction": None, "exclude_pii": True}).count() == 1
    assert mine.absence(mine.search("solar")).count() == 0 and [r.kind for r in mine.absence(mine.search("nothing like it")).collect()] == ["NO_EVIDENCE_FOUND"]
    assert [(r.relational, r.score) for r in mine.search("solar wind").collect()] == [(0.0, 0.2)]  # without an entity a word is worth its weight only
    assert [r.fragment_id for r in mine.all_of("fragment").collect()] == ["f1"]
    assert {r.object_type: r.n for r in mine.withheld().collect()}["entity"] == 1
    assert {(r.kind, r.id) for r in mine.state_ids("ea").collect()} == {("ACTIVE_DECISION", "d2"), *[("CURRENT_CLAIM", c) for c in ("c1", "c2", "c3", "c4")]}
    state = mine.state("ea").first()
    assert (state.n_claims, state.n_decisions, state.freshness_status, state.as_of) == (4, 1, "FRESH", T0 + dt.timedelta(40)) and World.of(spark).scoped("CLIENT:a").state().count() == 0
    assert sorted((r.description, r.claim_id) for r in mine.conflicts("ea").collect()) == [("2 active claims disagree about 'size' for ea", "c3"), ("2 active claims disagree about 'size' for ea", "c4")]
    assert {(r.change, r.id) for r in mine.delta("2024-01-15").collect()} == {("DECISION_CHANGE", "d2")} and mine.coverage("2024-01-15").first().coverage == "COVERED"
    assert mine.coverage("2023-12-31").first().coverage == "PARTIAL_NO_RECORD_BEFORE" and World.of(spark).scoped("CLIENT:a").coverage("2024-01-01").first().coverage == "NO_RECORD"
    assert mine.require_one("eg") == "eg" and mine.require_one("nobody") is None
    with pytest.raises(AmbiguousEntity):
        mine.require_one("Alpha Works")
    assert [tuple(r) for r in mine.relations("ea").collect()] == [("owns", "eg", "c1")]


def test_packs(spark, world):
    mine = world.scoped("CLIENT:a")
    full = mine.context_pack("solar", entities=["ea"])
    assert full | {"generated_at": "2024"} == mine.context_pack("solar", entities=["ea"], generated_at="2024")  # the time is no part of its identity
    assert full["evidence_ids"] == ["v1"] and "eb" not in str(full) and full["generated_at"] == "2024-02-10T00:00:00Z" and full["entity_ids"] == ["ea", "eg"]
    assert full["provenance_summary"] == [{"object_id": "v1", "object_type": "Evidence", "provenance": [{"source_id": "s1", "fragment_id": None, "locator": None, "observed_at": None, "captured_at": None, "content_hash": None}]}]
    assert len(full["recent_event_ids"]) == 5 and len(full["state_projection_ids"]) == 1 and full["sensitivity_level"] == "INTERNAL"
    other = World.of(spark, world.frames | {"unknown": frame(spark, "unknown", [{"unknown_id": "u1", "statement": "x", "status": "RESOLVED", "priority": "LOW", "scope_type": "CLIENT", "scope_id": "a"}])}).scoped("CLIENT:a")
    assert other.context_pack("solar", entities=["ea"])["context_pack_id"] != full["context_pack_id"]  # another world is another pack
    with pytest.raises(BudgetTooSmall) as why:
        mine.context_pack("solar", entities=["ea"], token_budget=10)
    smallest = mine.context_pack("solar", entities=["ea"], token_budget=why.value.minimum)
    assert size_of(smallest) == why.value.minimum and smallest["provenance_summary"] == full["provenance_summary"]
    row = mine.pack_row("solar", entities=["ea"], requirements=tuple(f"p{k:04d}" for k in range(150)), token_budget=size_of(full) + 290).first()
    assert row.fits and [t.step for t in row.trimmed] == ["SECONDARY_PROCEDURAL_REFS"] and row.procedural_refs == ["p0000"] and sum(g.startswith("trimmed for token budget (SECONDARY") for g in row.gaps) == 1
    empty = World.of(spark).scoped("CLIENT:a").context_pack("solar")
    assert empty["freshness_status"] == "UNKNOWN_FRESHNESS" and empty["sensitivity_level"] == "PUBLIC" and empty["generated_at"] == "1970-01-01T00:00:00Z" and any(g.startswith("NO_EVIDENCE_FOUND") for g in empty["gaps"])


def test_conflicts_and_changes(spark):
    """Every kind of conflict and of change, and what is none."""
    a = {"scope_type": "CLIENT", "scope_id": "a"}
    late = T0 + dt.timedelta(20)
    claim = lambda i, **k: {"claim_id": i, "subject_entity_id": "e", "predicate": "p", "epistemic_status": "DECLARED", "status": "ACTIVE", "created_at": T0, "last_updated_at": T0} | a | k
    claims = [
        claim("k1", status="DISPUTED", counter_evidence_ids=["v2", "v1"]), claim("k2", epistemic_status="CONFLICTING", predicate="q"), claim("k3", counter_evidence_ids=["v1"], predicate="r"), claim("k4", object_entity_id="x"), claim("k5", object_entity_id="y"),
        claim("k6", predicate="s", object_value="1", created_at=late), claim("k7", predicate="s"), claim("k8", status="RETRACTED", last_updated_at=late, created_at=late), claim("k9", status="SUPERSEDED", created_at=late), claim("k10", predicate="t", object_value="1"), claim("k11", predicate="t", object_value="1", status="SUPERSEDED"),
    ]
    mine = World.of(spark, {
        "claim": frame(spark, "claim", claims), "decision": frame(spark, "decision", [{"decision_id": "d1", "status": "ACTIVE", "created_at": T0, "effective_from": late} | a]),
        "hypothesis": frame(spark, "hypothesis", [{"hypothesis_id": f"h{k}", "status": s, "next_best_learning": n, "created_at": T0, "last_updated_at": t} | a for k, (s, n, t) in enumerate([("OPEN", "ask", late), ("SUPPORTED", None, T0)])]),
        "unknown": frame(spark, "unknown", [{"unknown_id": f"u{k}", "status": s, "priority": "LOW", "statement": "s", "created_at": T0, "last_updated_at": late} | a for k, s in enumerate(("OPEN", "RESOLVED", "NO_LONGER_RELEVANT"))]),
        "event": frame(spark, "event", [{"event_id": "ev1", "occurred_at": T0 - dt.timedelta(30), "recorded_at": late} | a, {"event_id": "ev2", "occurred_at": T0, "recorded_at": T0} | a]),
        "state_projection": frame(spark, "state_projection", [{"state_projection_id": "sp1"} | a]),
    }).scoped("CLIENT:a")
    assert sorted((r.claim_id, r.description.split(" ", 2)[2][:12], r.evidence_ids) for r in mine.conflicts().collect()) == [
        ("k1", "is recorded ", ["v1", "v2"]), ("k2", "is recorded ", []), ("k3", "has evidence", ["v1"]), ("k6", "claims disag", []), ("k7", "claims disag", []),
    ]
    since = (T0 + dt.timedelta(10)).isoformat(sep=" ")
    assert {(r.change, r.id, r.late_days) for r in mine.delta(since).collect()} == {
        ("NEW_CLAIM", "k6", None), ("SUPERSEDED_CLAIM", "k8", None), ("DECISION_CHANGE", "d1", None), ("HYPOTHESIS_CHANGE", "h0", None), ("RESOLVED_UNKNOWN", "u1", None), ("RESOLVED_UNKNOWN", "u2", None), ("RECENT_EVENT", "ev1", 50), ("STATE_TRANSITION", "sp1", None),
    }
    told = mine.coverage(since).first()
    assert (told.coverage, told.earliest, told.as_of) == ("COVERED", T0 - dt.timedelta(30), late)
    state = mine.state().first()
    assert (state.n_claims, state.n_decisions, state.n_hypotheses, state.n_unknowns, state.next_best_learning) == (7, 1, 1, 1, "ask")


def test_sources_and_trace(spark, world):
    mine = world.scoped("CLIENT:a")
    assert [tuple(r) for r in mine.source_pointers().collect()] == [("v1", "s1", "f1", None, None, "x")]
    assert [tuple(r) for r in mine.provenance("evidence").collect()] == [("v1", ["s1"])] and mine.provenance("claim").count() == 0
    assert [r.line for r in mine.constraints().collect()] == ["d2: y"]
    named = spark.createDataFrame([("ea",), ("es",), ("s1",)], "object_id string")
    assert mine.tier_of(named).first().level == "INTERNAL"  # what is secret is not even counted
    trace = {r.stage: (r.available, r.n) for r in mine.trace("solar", ["ea"]).collect()}
    assert trace["SEMANTIC"] == (False, None) and trace["LEXICAL"] == (True, 1) and trace["RELATION_EXPANSION"] == (True, 1) and len(trace) == 8
    pack = mine.context_pack("solar", entities=["ea"])
    assert pack["claim_ids"] == [] and any(g.startswith("4 asserting object(s)") and g.endswith("c1, c2, c3, c4") for g in pack["gaps"]) and pack["constraints"] == ["d2: y"]


def test_evidence_without_a_visible_source_is_no_hit(spark, world):
    lost = frame(spark, "evidence", [{"evidence_id": "v9", "source_id": "s2", "fragment_ids": ["f1"], "scope_type": "CLIENT", "scope_id": "a"}])
    both = World.of(spark, world.frames | {"evidence": world.frames["evidence"].union(lost)})
    assert [r.evidence_id for r in both.scoped("CLIENT:a").search("solar").collect()] == ["v1"]


def test_vocabularies_are_whole():
    """Numbers of values, so that a list cut short is noticed."""
    sizes = {f"{k}.{c}": len(v) for (k, c), v in VOCABULARIES.items()}
    assert sizes["entity.entity_type"] == 11 and sizes["source.source_type"] == 10 and sizes["fragment.fragment_type"] == 8 and sizes["event.event_type"] == 7
    assert sizes["hypothesis.status"] == sizes["candidate.candidate_type"] == sizes["evidence.evidence_type"] == 6 and sizes["context_pack.mode"] == 5 and sizes["unknown.status"] == 4
    assert all(set(REQUIRED[k]) <= {c.strip().split(" ")[0] for c in SCHEMAS[k].split(",")} | set(REQUIRED[k]) for k in SCHEMAS) and REQUIRED.keys() == SCHEMAS.keys()


def test_faults(spark, world):
    assert world.faults().count() == 0
    bad = frame(spark, "claim", [{"claim_id": "c", "subject_entity_id": "e", "predicate": "p", "epistemic_status": "SURE", "status": "ACTIVE", "scope_type": "CLIENT", "scope_id": "GLOBAL", "contract_version": "1"}])
    assert {r.code for r in structural_faults(bad.union(bad), "claim").collect()} == {"VOCABULARY_EPISTEMIC_STATUS", "SCOPE", "CONTRACT_VERSION", "CLAIM_OBJECT", "DUPLICATE_ID"}
    with pytest.raises(ValueError):
        World.of(spark, {"nonsense": bad})


def test_rules_of_meaning(spark, world):
    """Each rule broken once by the smallest object that breaks it; forbidden keys at any depth, however written."""
    a, b = {"scope_type": "CLIENT", "scope_id": "a"}, {"scope_type": "CLIENT", "scope_id": "b"}
    claim = lambda i, **k: {"claim_id": i, "subject_entity_id": "ea", "predicate": "p", "object_value": "1", "epistemic_status": "DECLARED"} | a | k
    claims = [claim("k1", epistemic_status="MEASURED"), claim("k2", object_value='"NO_EVIDENCE_FOUND"'), claim("k3", epistemic_status="UNKNOWN", object_value="false"), claim("k4", object_value='[{"x": {"API_\\u004bey": 1}}]'), claim("k5", object_value='{"a": "\\"token\\":", "tokens": 1}')]
    claims += [claim("k6", data_classes=["PUBLIC"]), claim("k7", level="PII"), claim("k8", supporting_evidence_ids=["v2"]), claim("k9", epistemic_status="DECLARED", source_ids=["s1"], object_value=None), claim("k10", supersedes="k6", epistemic_status="OBSERVED", source_ids=["s1"])]
    packs = [{"context_pack_id": "p1", "claim_ids": ["c1"], "entity_ids": ["es", "eb"], "gaps": ["false"]} | a, {"context_pack_id": "p2", "claim_ids": ["c1"], "provenance_summary": ["c1"]} | b]
    frames = World.of(spark, world.frames | {
        "claim": frame(spark, "claim", claims), "context_pack": frame(spark, "context_pack", packs), "candidate": frame(spark, "candidate", [{"candidate_id": "n1", "status": "PENDING", "proposed_epistemic_status": "OBSERVED", "payload": "{}"} | a, {"candidate_id": "n2", "status": "REJECTED", "proposed_epistemic_status": "OBSERVED", "payload": '{"sql":1}'} | a]),
        "state_projection": frame(spark, "state_projection", [{"state_projection_id": "t1", "active_decision_ids": ["d1", "dx"]} | a]),
    }).frames
    got = {(r.id, r.code) for r in semantic.faults(frames).collect()}
    assert got >= {
        ("k1", "EPISTEMIC_PROVENANCE_REQUIRED"), ("k2", "NO_EVIDENCE_FOUND_MISLABELLED"), ("k3", "NO_EVIDENCE_SERIALIZED_AS_FALSE"), ("k4", "FORBIDDEN_FIELD"), ("k6", "SENSITIVITY_AXIS_CONFLATED"), ("k7", "SENSITIVITY_AXIS_CONFLATED"), ("k8", "CROSS_CLIENT_REFERENCE"),
        ("k10", "INVALID_EPISTEMIC_PROMOTION") if "OBSERVED" in FORBIDDEN_PROMOTIONS["DECLARED"] else ("k1", "EPISTEMIC_PROVENANCE_REQUIRED"), ("p1", "SECRET_IN_CONTEXT_PACK"), ("p1", "CROSS_CLIENT_REFERENCE"), ("p1", "GAP_SERIALIZED_AS_BOOLEAN"),
        ("n1", "CANDIDATE_PROPOSES_UNSOURCED_OBSERVATION"), ("n2", "FORBIDDEN_FIELD"), ("t1", "PROJECTION_BROKEN_DECISION_REFERENCE"), ("d2", "SUPERSEDED_DECISION_STILL_ACTIVE"),
    }
    assert not {i for i, _ in got} & {"k5", "k9", "p2"} and ("n2", "CANDIDATE_PROPOSES_UNSOURCED_OBSERVATION") not in got
    assert semantic.faults(World.of(spark).frames).count() == 0


def test_pack_rows(spark, world):
    """a pack in rows has the lists and the measures of the pack in one row, at a budget that holds it and at one that nothing fits, where constraints are shortened."""
    a = {"scope_type": "CLIENT", "scope_id": "a"}
    decisions = [{"decision_id": f"d{k}", "decision": "word " * (10 if k % 3 else 90), "status": "ACTIVE", "created_at": T0} | a for k in range(12)]
    claims = [{"claim_id": f"k{k}", "subject_entity_id": "ea", "predicate": "p", "status": "ACTIVE", "created_at": T0, "source_ids": ["s1", "s3"] if k % 2 else []} | a for k in range(9)]
    mine = World.of(spark, world.frames | {"decision": frame(spark, "decision", decisions), "claim": frame(spark, "claim", claims)}).scoped("CLIENT:a")
    told = {"entities": ["ea"], "requirements": ("p1", "p2"), "since": "2023-12-01"}
    whole = mine.pack_row("solar", token_budget=100_000, **told).first()  # any budget that is a number counts alike
    for budget, row in ((whole.size, whole), (10, mine.pack_row("solar", token_budget=10, **told).first())):
        head, items = mine.pack_rows("solar", token_budget=budget, **told)
        one, got = head.first(), {}
        for r in items.collect():
            got.setdefault(r["list"], []).append((r["item"], r["entry"]))
        assert (one.size, one.fits, one.minimum_required, one.token_budget, one.state_projection_ids) == (row.size, row.fits, row.minimum_required, budget, row.state_projection_ids) and row.fits == (not row.trimmed)
        for c in ("entity_ids", "decision_ids", "claim_ids", "hypothesis_ids", "unknown_ids", "constraints"):
            assert sorted(x for x, _ in got.get(c, [])) == row[c] and one[f"n_{c}"] == len(row[c]), c
        assert sorted((e for _, e in got["provenance_summary"]), key=lambda e: e.object_id) + one.provenance_summary == row.provenance_summary
        assert [t for t in row.trimmed if t.step != "VERBOSE_SUMMARY"] == one.trimmed and sorted(x for x, _ in got.get("shortened", [])) == [x for t in row.trimmed if t.step == "VERBOSE_SUMMARY" for x in t.removed]
        assert [g for g in row.gaps if "d0" not in g and "k0" not in g] == one.gaps and [x for x, _ in sorted(got["untold"])] == [f"k{k}" for k in range(0, 9, 2)]
        assert [one[c] for c in ("sensitivity_level", "data_classes", "freshness_status", "evidence_ids", "recent_event_ids", "generated_at", "procedural_refs")] == [row[c] for c in ("sensitivity_level", "data_classes", "freshness_status", "evidence_ids", "recent_event_ids", "generated_at", "procedural_refs")]


def test_digests_of_long_lists(spark):
    """Texts that fill many pieces of many tasks, some of them equal."""
    import hashlib

    from quarrystone.functions import identity as I

    rows = [("a", f"x{k % 700}") for k in range(3000)] + [("b", "é"), ("b", ""), ("b", None), ("c", "y" * 20_000), ("c", "z")]
    got = {r.k: (r.n, r.md5) for r in I.joined_md5(spark.createDataFrame(rows, "k string, t string").repartition(7), "k", "t").collect()}
    want = {k: sorted(t for g, t in rows if g == k and t is not None) for k in "abc"}
    assert got == {k: (len(v), hashlib.md5(",".join(v).encode()).hexdigest()) for k, v in want.items()}
