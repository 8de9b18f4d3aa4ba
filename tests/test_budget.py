"""The fold of drop steps against a plain walk through them, over packs that reach every branch."""

import math
import random

from pyspark.sql import functions as F

from quarrystone.operators import budget as B

PACK = (
    "context_pack_id string, objective string, token_budget int, scope map<string,string>, level string, constraints array<string>, artifact_refs array<struct<artifact_id:string,kind:string>>, recent_event_ids array<string>, evidence_ids array<string>, procedural_refs array<string>, "
    "provenance_summary array<struct<object_id:string,object_type:string,provenance:array<struct<source_id:string,fragment_id:string>>>>, gaps array<string>, strengths map<string,string>"
)


def size(x):
    if x is None:
        return 0
    if isinstance(x, str):
        return math.ceil(len(x) / 4)
    if isinstance(x, dict):
        return 2 + sum(size(k) + size(v) for k, v in x.items() if v is not None)
    return 2 + sum(map(size, x)) if isinstance(x, list) else 1


def walked(pack, strengths, budget):
    """(pack, steps taken, smallest size) by the rules, one step after another."""
    base, log = list(pack["gaps"]), []
    order = {"WEAK": 0, "MODERATE": 1, "STRONG": 2}

    def lines(entries):
        return [f"trimmed for token budget ({s}): {len(r)} item(s) removed from {f} [{', '.join(r)}]" for s, f, r in entries]

    smallest = size(pack | {"gaps": sorted(set(base))})
    pack = pack | {"gaps": sorted(set(base))}
    for step in B.DROP_ORDER:
        if smallest <= budget:
            break
        after, field = dict(pack), B.STEP_FIELDS[step]
        if step == "VERBOSE_SUMMARY":
            gone = [c.split(":")[0] for c in pack["constraints"] if len(c) > 160]
            after["constraints"], field = sorted(c if len(c) <= 160 else c[:157] + "..." for c in pack["constraints"]), "constraints (shortened)"
        elif step == "LOW_RELEVANCE_ARTIFACTS":
            gone, after[field] = [a["artifact_id"] for a in pack[field]], []
        elif step == "OLDER_EVENTS":
            after[field] = pack[field][-2:] if len(pack[field]) > 2 else []
            gone = [e for e in pack[field] if e not in after[field]]
        elif step == "WEAKER_EVIDENCE":
            ranked = sorted(pack[field], key=lambda e: (order.get(strengths.get(e), 3), e))
            gone = ranked[: len(ranked) - max(1, len(ranked) // 4)]
            after[field] = sorted(set(pack[field]) - set(gone))
            after["provenance_summary"] = [p for p in pack["provenance_summary"] if p["object_id"] not in gone]
        else:
            after[field] = pack[field][:1]
            gone = [r for r in pack[field] if r not in after[field]]
        told = [*log, (step, field, sorted(gone))] if gone else log
        after["gaps"] = sorted(set(base) | set(lines(told)))
        if size(after) < smallest:
            pack, log, smallest = after, told, size(after)
    return pack, [s for s, _, _ in log], smallest


def packs():
    rng = random.Random(7)
    for n in range(40):
        evidence = [f"v{k}" for k in range(rng.choice([0, 1, 3, 4, 9, 20]))]
        yield {
            "context_pack_id": f"cp_{n}", "objective": "o" * rng.randrange(9), "token_budget": None, "scope": {"scope_type": "CLIENT", "scope_id": "a"}, "level": rng.choice([None, "INTERNAL"]),
            "constraints": sorted(f"d{k}: " + "x" * rng.choice([5, 155, 157, 400]) for k in range(rng.randrange(4))), "artifact_refs": [{"artifact_id": f"a{k}", "kind": rng.choice([None, "k" * 30])} for k in range(rng.randrange(3))],
            "recent_event_ids": [chr(0x4E00 + k) for k in range(rng.choice([0, 1, 2, 3, 12, 150]))], "evidence_ids": evidence, "procedural_refs": [f"p{k:04d}" for k in range(rng.choice([0, 1, 2, 6, 130]))],
            "provenance_summary": [{"object_id": e, "object_type": "Evidence", "provenance": [{"source_id": "s1", "fragment_id": rng.choice([None, "f1"])}]} for e in evidence if e != "v2"], "gaps": ["b gap", "a gap", "b gap"][: rng.randrange(4)],
        }, {e: rng.choice(["WEAK", "MODERATE", "STRONG", "OTHER"]) for e in evidence if rng.random() < 0.9}


def test_every_step_at_every_budget(spark):
    made = [(p | {"token_budget": b}, s) for p, s in packs() for b in (1, 60, 90, 130, 200, 320, 420, 5000)]
    names = [c.split(" ")[0] for c in PACK.replace("struct<artifact_id:string,kind:string>", "x").replace("struct<object_id:string,object_type:string,provenance:array<struct<source_id:string,fragment_id:string>>>", "x").replace("map<string,string>", "m").split(", ")]
    rows = spark.createDataFrame([tuple((p | {"strengths": s})[c] for c in names) for p, s in made], PACK)
    got = {(r["context_pack_id"], r["token_budget"]): r.asDict(recursive=True) for r in B.fit(rows).collect()}
    taken = set()
    for pack, strengths in made:
        r = got[pack["context_pack_id"], pack["token_budget"]]
        want, steps, smallest = walked(pack, strengths, pack["token_budget"])
        fits = smallest <= pack["token_budget"]
        assert (r["size"], r["fits"], r["minimum_required"], [t["step"] for t in r["trimmed"]]) == (smallest, fits, None if fits else smallest, steps)
        assert {k: r[k] for k in want} == want and size({k: r[k] for k in want}) == smallest
        taken |= set(steps)
    assert taken == set(B.DROP_ORDER)
    whole = rows.drop("strengths")
    assert whole.where(B.pack_tokens(whole) < B.minimum_tokens(whole)).count() == 0


def test_packs_without_lists_or_budgets(spark):
    """Missing lists are empty; a null budget and one below 1 are never met; an empty table gives no rows."""
    rows = spark.createDataFrame([("a", None), ("b", 0), ("c", 1000)], "context_pack_id string, token_budget int")
    assert {r["context_pack_id"]: (r["fits"], r["trimmed"]) for r in B.fit(rows).collect()} == {"a": (False, []), "b": (False, []), "c": (True, [])}
    assert B.fit(rows.where(F.lit(False))).count() == 0


def test_several_budgets(spark):
    """a pack with an array of budgets is measured once and comes to what each budget alone comes to."""
    lists = dict(constraints=["d1: " + "x" * 300, "d2: y"], recent_event_ids=[f"e{k}" for k in range(30)], evidence_ids=[f"v{k}" for k in range(9)], procedural_refs=["p1", "p2", "p3"], gaps=["late", "late"], strengths={"v1": "WEAK"})
    names, kinds = [*lists, "context_pack_id"], "constraints array<string>, recent_event_ids array<string>, evidence_ids array<string>, procedural_refs array<string>, gaps array<string>, strengths map<string,string>, context_pack_id string"
    packs = spark.createDataFrame([(*lists.values(), "cp_1"), ([], [], ["v2", "v2"], None, [], None, "cp_2")], kinds).select(*names)
    budgets = [None, 0, 20, 60, 100, 120, 150, 200, 10_000]
    values = ", ".join("cast(null as int)" if b is None else str(b) for b in budgets)
    told = ["context_pack_id", "token_budget", *[c for c in names if c not in ("strengths", "context_pack_id")], "size", "fits", "minimum_required", "trimmed"]
    got = B.fit(packs.withColumn("token_budget", F.expr(f"array({values})"))).select(*told).collect()
    each = B.fit(packs.withColumn("token_budget", F.explode(F.expr(f"array({values})")))).select(*told).collect()
    assert len(got) == 2 * len(budgets) and sorted(map(str, got)) == sorted(map(str, each))
    assert {len(r.trimmed) for r in got if r.context_pack_id == "cp_1"} == {0, 1}
