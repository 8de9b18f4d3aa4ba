"""The run journal: against a walk entry by entry, over hot runs and odd entries, and as a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import runs as R

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "run_id string, at timestamp, seq long, phase string"


def walked(rows):
    """{(run, at, seq): (verdict, phase, attempts)} by the rules, spelled out."""
    state, out = {}, {}
    for run, at, seq, phase in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2], R.PHASES.index(r[3]) if r[3] in R.PHASES else 99)):
        now, used = state.get(run, (None, 0))
        if phase not in R.PHASES:
            verdict = "UNKNOWN_PHASE"
        elif phase == now:
            verdict = "UNCHANGED"
        elif now in ("PASSED", "ABORTED"):
            verdict = "RUN_CLOSED"
        elif (now is None and phase != "PLANNING") or (now is not None and phase not in R.TRANSITIONS[now]):
            verdict = "ILLEGAL_TRANSITION"
        elif phase == "DEBUGGING" and used == 4:
            verdict = "ATTEMPTS_EXHAUSTED"
        else:
            verdict, state[run] = "ACCEPTED", (phase, used + (phase == "DEBUGGING"))
        out[run, at, seq] = (verdict, *state.get(run, (None, 0)))
    return out


def entries():
    rng, rows = random.Random(5), []
    path = ["PLANNING", "DRAFT", "VALIDATING", "AWAITING_APPROVAL", *["TESTING", "DEBUGGING"] * 6, "BLOCKED", "DRAFT", "ABORTED", "DRAFT"]
    for run in range(12):
        at = T0
        for n in range(300 if run == 0 else rng.randrange(1, 40)):  # one run has most entries, over many days
            at += dt.timedelta(minutes=rng.choice([0, 5, 300, 3000]))
            phase = path[n % len(path)] if rng.random() < 0.8 else rng.choice([*R.PHASES, "NOPE", None])
            rows.append((f"r{run}", at, n, phase))
    return rows


def test_against_a_walk(spark):
    rows = entries()
    lost = [(None, T0, 1, "PLANNING"), ("r1", None, 2, "DRAFT")]
    got = R.journal(spark.createDataFrame(rows + lost, SCHEMA).withColumn("day", F.lit("x")).repartition(5)).collect()
    want = walked(rows)
    assert {(r.run_id, r["at"], r.seq): (r.verdict, r.phase_after, r.attempts_after) for r in got if r.verdict != "NO_RUN"} == want
    assert {v for v, _, _ in want.values()} == set(R.VERDICTS) and sum(r.verdict == "NO_RUN" for r in got) == len(lost) and len(got) == len(rows) + len(lost)
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    following = {(a[0], a[1], a[2]): b[1] if a[0] == b[0] else None for a, b in zip(order, [*order[1:], (None,) * 4], strict=True)}
    assert {(r.run_id, r["at"], r.seq): r.next_at for r in got if r.verdict != "NO_RUN"} == following


def test_where_runs_stand(spark):
    rows = entries()
    journal = R.journal(spark.createDataFrame(rows, SCHEMA))
    want, last = walked(rows), {}
    for (run, at, seq), (_, phase, used) in want.items():
        last[run] = max(last.get(run, ()), (at, seq, phase or "", used))
    assert {r.run_id: (r["at"], r.phase or "", r.attempts) for r in R.current(journal).collect()} == {run: (at, phase, used) for run, (at, _, phase, used) in last.items()}
    assert R.journal(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_machines():
    m = R.machine({"PLANNING": ("DEBUGGING",), "DEBUGGING": ("PLANNING",)}, max_attempts=1)
    state = 0
    told = []
    for phase in ("DEBUGGING", "PLANNING", "DEBUGGING", "PLANNING", "DEBUGGING"):
        p = R.PHASES.index(phase)
        told.append(R.VERDICTS[m.verdict[p, state]])
        state = int(m.next[p, state])
    assert told == ["ILLEGAL_TRANSITION", "ACCEPTED", "ACCEPTED", "ACCEPTED", "ATTEMPTS_EXHAUSTED"] and (m.phase(state), m.attempts(state)) == ("PLANNING", 1)


@pytest.mark.parametrize("horizon", [None, dt.timedelta(days=1)])
def test_stream_equals_batch(spark, tmp_path, horizon):
    """The same verdicts and states entry by entry; a silence that a later batch reveals is told of as the batch twin tells it."""
    from quarrystone.streaming import runs as S

    rows = sorted(entries(), key=lambda r: (r[1], r[2]))
    for k in range(4):
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get(S.PROVIDER[0])
    spark.conf.set(*S.PROVIDER)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = S.run_journal(stream, horizon).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    finally:
        spark.conf.set(S.PROVIDER[0], before)
    told = spark.read.parquet(str(tmp_path / "out")).collect()
    batch = R.journal(spark.createDataFrame(rows, SCHEMA))
    pick = lambda found: sorted(((r.run_id, r["at"], r.seq, r.verdict, r.phase_after, r.attempts_after) for r in found), key=str)
    assert pick(r for r in told if r.verdict != S.STALLED) == pick(batch.collect())
    silent = {(r.run_id, r["at"]) for r in told if r.verdict == S.STALLED}
    if horizon is None:
        assert not silent
    else:
        known = {(r.run_id, r.stalled_at) for r in R.stalled(batch, "1 day", F.lit(rows[-1][1]).cast("timestamp")).collect()}
        assert silent and silent <= known
