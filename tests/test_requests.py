"""Search for many requests against a scan of all evidence for each."""

import random

import pytest

from quarrystone.operators import requests as R

COMMON, RARE = [f"common{k}" for k in range(6)], [f"rare{k}" for k in range(60)]


def brute(evidence, requests, limit, min_score=0.01):
    out = {}
    strength = {"STRONG": 1, "MODERATE": 2, "WEAK": 3}
    for rid, kind, scope, query in requests:
        words = {w for w in (query or "").lower().split() if len(w) >= 3}
        found = []
        for eid, k, s, power, text in evidence:
            if text is None or (k, s) not in ((kind, scope), ("GLOBAL", "GLOBAL")):
                continue
            n = len(words & set(text.lower().split()))
            if n and round(0.4 * n / len(words), 6) >= min_score:
                found.append((-n, strength.get(power, 9), eid, round(0.4 * n / len(words), 6)))
        out[rid] = [(eid, score) for _, _, eid, score in sorted(found)[:limit]]
    return out


@pytest.mark.parametrize("limit", [1, 3, 25])
def test_against_a_scan(spark, limit):
    """Requests that the bound answers and that it does not, frequent words alone, no words, another scope, no hits at all."""
    rng = random.Random(limit)
    scopes = [("GLOBAL", "GLOBAL"), ("CLIENT", "a"), ("CLIENT", "b")]
    evidence = [(k, *rng.choice(scopes), rng.choice(["STRONG", "MODERATE", "WEAK", None]), " ".join(rng.sample(COMMON, rng.randrange(1, 6)) + rng.sample(RARE, rng.randrange(0, 4)))) for k in range(400)]
    evidence += [(900, "CLIENT", "a", "WEAK", None), (901, None, None, "WEAK", "common1"), (902, "CLIENT", "a", "STRONG", "")]
    requests = [(k, *rng.choice(scopes[1:]), " ".join(rng.sample(COMMON, rng.randrange(0, 4)) + rng.sample(RARE, rng.randrange(0, 4)))) for k in range(60)]
    requests += [(100, "CLIENT", "a", None), (101, "CLIENT", "a", "of an"), (102, "CLIENT", "c", "rare1 rare2"), (103, "CLIENT", "a", "unknown words"), (104, "GLOBAL", "GLOBAL", "common1 rare3")]
    index = R.postings(spark.createDataFrame(evidence, "evidence_id long, scope_type string, scope_id string, strength string, text string"))
    got, absent = {}, set()
    for r in R.search(index, spark.createDataFrame(requests, "request_id long, scope_type string, scope_id string, query string"), limit).collect():
        if r.kind == R.NO_EVIDENCE:
            absent.add(r.request_id)
        else:
            got.setdefault(r.request_id, []).append((r.place, r.evidence_id, r.score))
    want = brute(evidence, requests, limit)
    assert {k: [(e, s) for _, e, s in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert absent == {k for k, v in want.items() if not v} and {100, 101, 103} <= absent


def test_empty_tables(spark):
    index = R.postings(spark.createDataFrame([], "evidence_id long, scope_type string, scope_id string, text string"))
    requests = spark.createDataFrame([(1, "CLIENT", "a", "word")], "request_id long, scope_type string, scope_id string, query string")
    assert [(r.request_id, r.kind) for r in R.search(index, requests).collect()] == [(1, R.NO_EVIDENCE)] and R.search(index, requests.limit(0)).count() == 0


def test_blocks_and_parts(spark):
    """evidence and requests that fill many groups give what one group gives; equal words and strengths go by id over all blocks."""
    rng = random.Random(7)
    evidence = [(k, *rng.choice([("GLOBAL", "GLOBAL"), ("CLIENT", "a")]), rng.choice(["STRONG", None]), " ".join(rng.sample(COMMON, 3) + rng.sample(RARE, 2))) for k in range(300)]
    requests = [(f"r{k}", "CLIENT", "a", " ".join(rng.sample(COMMON, 2) + rng.sample(RARE, 2))) for k in range(40)]
    index = R.postings(spark.createDataFrame(evidence, "evidence_id long, scope_type string, scope_id string, strength string, text string"))
    asked = spark.createDataFrame(requests, "request_id string, scope_type string, scope_id string, query string")
    found = R.search(index, asked, 25, block_words=100, part_requests=7)
    got = {}
    for r in found.orderBy("place").collect():
        got.setdefault(r.request_id, []).append((r.evidence_id, r.score))
    assert got == brute(evidence, requests, 25)


def test_evidence_goes_to_one_block(spark, monkeypatch):
    """rounds of requests give what one gives, evidence is dealt out once for each round and not for each part of requests, and a round's shuffle files go."""
    rng = random.Random(9)
    evidence = [(k, *rng.choice([("GLOBAL", "GLOBAL"), ("CLIENT", "a")]), rng.choice(["STRONG", None]), " ".join(rng.sample(COMMON, 3) + rng.sample(RARE, 2))) for k in range(200)]
    requests = [(f"r{k}", "CLIENT", "a", " ".join(rng.sample(COMMON, 2) + rng.sample(RARE, 2))) for k in range(60)] + [("none", "CLIENT", "a", "nowhere")]
    index = R.postings(spark.createDataFrame(evidence, "evidence_id long, scope_type string, scope_id string, strength string, text string"))
    asked = spark.createDataFrame(requests, "request_id string, scope_type string, scope_id string, query string")
    plans, stored = [], R._stored
    monkeypatch.setattr(R, "_stored", lambda rows: plans.append(rows) or stored(rows))
    got = {}
    for r in R.search(index, asked, 25, block_words=150, part_requests=5, round_words=1000).orderBy("place").collect():
        got.setdefault(r.request_id, []).append((r.evidence_id, r.score))
    assert got == brute(evidence, requests, 25) | {"none": [(None, None)]}
    rounds = plans[2:]
    assert len(rounds) > 2 and sum(p.count() for p in rounds) == sum(len(v) for k, v in got.items() if k != "none")
    assert all("cogroup" not in (plan := p._jdf.queryExecution().optimizedPlan().toString()).lower() and plan.count("RepartitionByExpression") == 1 and plan.count("Generate explode") == 1 for p in rounds)
