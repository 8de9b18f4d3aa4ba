"""The journal of build runs as a state machine: phases, legal transitions, attempts, runs that stall.

A run's state is its phase and the attempts it has used, one of a few dozen; an entry of the journal is a function from
states to states, and such functions compose. So a run need not pass through one task from its first entry to its last:
entries are dealt by run and day, each day is first folded into its function, the functions of a run's days are composed
in order, and each day is walked again from the state in which it starts. A run that holds a third of all entries is as
many tasks as it has days. Memory is one batch of rows; the walk is linear.

Nothing illegal changes a state: such entries come back with the reason, and the run stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phases of a run, and how many attempts it has before a person must decide.
PHASES = ("PLANNING", "DRAFT", "VALIDATING", "AWAITING_APPROVAL", "TESTING", "DEBUGGING", "PASSED", "BLOCKED", "ABORTED")
MAX_ATTEMPTS = 4
#: Phases that end a run, the one that uses an attempt, and the one that a run starts in.
CLOSED, ATTEMPT, FIRST = ("PASSED", "ABORTED"), "DEBUGGING", "PLANNING"
#: What may follow what; a parameter. A blocked run goes on by a new draft, a person's decision.
TRANSITIONS = {
    "PLANNING": ("DRAFT", "BLOCKED", "ABORTED"),
    "DRAFT": ("VALIDATING", "BLOCKED", "ABORTED"),
    "VALIDATING": ("DRAFT", "AWAITING_APPROVAL", "BLOCKED", "ABORTED"),
    "AWAITING_APPROVAL": ("DRAFT", "TESTING", "BLOCKED", "ABORTED"),
    "TESTING": ("DEBUGGING", "PASSED", "BLOCKED", "ABORTED"),
    "DEBUGGING": ("DRAFT", "TESTING", "BLOCKED", "ABORTED"),
    "BLOCKED": ("DRAFT", "ABORTED"),
}
VERDICTS = ("ACCEPTED", "UNCHANGED", "UNKNOWN_PHASE", "ILLEGAL_TRANSITION", "ATTEMPTS_EXHAUSTED", "RUN_CLOSED")


@dataclass(frozen=True)
class Machine:
    """Tables by phase of the entry (unknown ones last) and by state: the next state, and the verdict."""

    next: np.ndarray
    verdict: np.ndarray
    max_attempts: int

    def phase(self, state: int) -> str | None:
        return None if state == 0 else PHASES[(state - 1) // (self.max_attempts + 1)]

    def attempts(self, state: int) -> int:
        return 0 if state == 0 else (state - 1) % (self.max_attempts + 1)


def machine(transitions: dict[str, tuple[str, ...]] | None = None, max_attempts: int = MAX_ATTEMPTS) -> Machine:
    """State 0 is a run without an entry; others are 1 + phase * (max_attempts + 1) + attempts."""
    legal, wide = transitions or TRANSITIONS, max_attempts + 1
    n = 1 + len(PHASES) * wide
    after, verdict = np.tile(np.arange(n, dtype=np.int32), (len(PHASES) + 1, 1)), np.zeros((len(PHASES) + 1, n), np.int32)
    verdict[len(PHASES)] = VERDICTS.index("UNKNOWN_PHASE")
    for p, phase in enumerate(PHASES):
        for state in range(n):
            now, used = (None, 0) if state == 0 else (PHASES[(state - 1) // wide], (state - 1) % wide)
            if now == phase:
                told = "UNCHANGED"
            elif now in CLOSED:
                told = "RUN_CLOSED"
            elif phase not in ((FIRST,) if now is None else legal.get(now, ())):
                told = "ILLEGAL_TRANSITION"
            elif phase == ATTEMPT and used == max_attempts:
                told = "ATTEMPTS_EXHAUSTED"
            else:
                told = "ACCEPTED"
                after[p, state] = 1 + p * wide + used + (phase == ATTEMPT)
            verdict[p, state] = VERDICTS.index(told)
    return Machine(after, verdict, max_attempts)


def phase_number(phase: Column) -> Column:
    """The place of a phase in PHASES; their number for any other, and for null."""
    return F.coalesce(*[F.when(phase == p, F.lit(k)) for k, p in enumerate(PHASES)], F.lit(len(PHASES))).cast("int")


_DAY = "run_id {run}, day date, first_at timestamp, states array<int>"
_STARTS = "run_id {run}, day date, start int, next_day_at timestamp"
_OUT = "run_id {run}, at timestamp, seq {seq}, phase string, verdict string, phase_after string, attempts_after int, next_at timestamp"


def _folded(m: Machine):
    """Sorted entries -> for each run and day its first time and, for every state, the state in which the day leaves it."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = day = first = None
        states = np.zeros(0, np.int32)
        for batch in batches:
            out = []
            for r, d, at, p in zip(batch["run_id"], batch["day"], batch["at"], batch["number"].tolist(), strict=True):
                if r != run or d != day:
                    if run is not None:
                        out.append((run, day, first, states.tolist()))
                    run, day, first, states = r, d, at, np.arange(m.next.shape[1], dtype=np.int32)
                states = m.next[p][states]
            yield pd.DataFrame(out, columns=["run_id", "day", "first_at", "states"])
        if run is not None:
            yield pd.DataFrame([(run, day, first, states.tolist())], columns=["run_id", "day", "first_at", "states"])

    return fold


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Days of runs in order -> the state in which each starts, and when the run's next day begins."""
    held, state = None, 0
    for batch in batches:
        out = []
        for run, day, first, states in zip(batch["run_id"], batch["day"], batch["first_at"], batch["states"], strict=True):
            if held is not None:
                out.append((*held, first if held[0] == run else None))
            state = state if held is not None and held[0] == run else 0
            held = (run, day, state)
            state = int(states[state])
        yield pd.DataFrame(out, columns=["run_id", "day", "start", "next_day_at"])
    if held is not None:
        yield pd.DataFrame([(*held, None)], columns=["run_id", "day", "start", "next_day_at"])


def _walked(m: Machine):
    """Sorted entries beside their day's start -> entries with verdicts, the state after each, the time of the run's next entry."""
    columns = ["run_id", "at", "seq", "phase", "verdict", "phase_after", "attempts_after", "next_at"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = run = day = later = None
        state = 0
        for batch in batches:
            out = []
            for r, d, at, seq, phase, p, start, next_day in zip(*(batch[c] for c in ("run_id", "day", "at", "seq", "phase", "number", "start", "next_day_at")), strict=True):
                same = r == run and d == day
                if held is not None:
                    out.append((*held, at if same else later))
                run, day, later = r, d, next_day
                state = state if same else int(start)
                told = VERDICTS[m.verdict[p, state]]
                state = int(m.next[p, state])
                held = (r, at, seq, phase, told, m.phase(state), m.attempts(state))
            yield pd.DataFrame(out, columns=columns)
        if held is not None:
            yield pd.DataFrame([(*held, later)], columns=columns)

    return walk


def journal(entries: DataFrame, m: Machine | None = None) -> DataFrame:
    """entries(run_id, at, seq, phase) -> run_id, at, seq, phase, verdict, phase_after, attempts_after, next_at.

    Entries of a run count in the order of (at, seq). Those without a run or a time belong to no journal: verdict
    NO_RUN, nothing after them. Equal (at, seq) of a run are taken in the order of their phases. An unknown phase, or
    none, changes nothing.
    """
    m = m or machine()
    run, seq = (entries.schema[c].dataType.simpleString() for c in ("run_id", "seq"))
    rows = entries.select("run_id", F.col("at").cast("timestamp").alias("at"), "seq", "phase").withColumns({"day": F.to_date("at"), "number": phase_number(F.col("phase"))})
    known = rows.where("run_id is not null and at is not null")
    order = ("run_id", "day", "at", "seq", "number")
    dealt = known.repartition("run_id", "day").sortWithinPartitions(*order)
    days = dealt.select("run_id", "day", "at", "number").mapInPandas(_folded(m), _DAY.format(run=run))
    starts = days.repartition("run_id").sortWithinPartitions("run_id", "day").mapInPandas(_composed, _STARTS.format(run=run))
    both = known.join(starts, ["run_id", "day"]).repartition("run_id", "day").sortWithinPartitions(*order)
    told = both.select("run_id", "day", "at", "seq", "phase", "number", "start", "next_day_at").mapInPandas(_walked(m), _OUT.format(run=run, seq=seq))
    lost = rows.where("run_id is null or at is null")
    return told.unionByName(lost.select("run_id", "at", "seq", "phase", F.lit("NO_RUN").alias("verdict")), allowMissingColumns=True)


def current(journal: DataFrame) -> DataFrame:
    """(run_id, at, phase, attempts): where each run stands after its last entry, and how many of its entries were refused."""
    told = journal.where("run_id is not null and at is not null").groupBy("run_id")
    last = F.max_by(F.struct("phase_after", "attempts_after"), F.struct("at", "seq", F.col("next_at").isNull().cast("int")))
    return told.agg(F.max("at").alias("at"), last.alias("s"), F.count_if(~F.col("verdict").isin("ACCEPTED", "UNCHANGED")).alias("n_refused")).select("run_id", "at", F.col("s.phase_after").alias("phase"), F.col("s.attempts_after").alias("attempts"), "n_refused")


def stalled(journal: DataFrame, horizon: str, until: Column) -> DataFrame:
    """(run_id, phase, stalled_at): open runs without an entry for longer than horizon, as of until."""
    ends = F.col("at") + F.expr(f"interval {horizon}")
    open_now = F.col("phase_after").isNotNull() & ~F.col("phase_after").isin(*CLOSED)
    return journal.where(open_now & (F.coalesce("next_at", until) > ends)).select("run_id", F.col("phase_after").alias("phase"), ends.alias("stalled_at"))
