"""The run journal as a stream: keyed state of one number a run, the same tables of transitions, timers for runs that stall."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import CLOSED, VERDICTS, Machine, machine, phase_number

#: Keyed state with timers needs this store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STALLED = "STALLED"
_COLUMNS = ["run_id", "at", "seq", "phase", "verdict", "phase_after", "attempts_after"]


class _Journal(StatefulProcessor):
    """Entries of a batch in the order of (at, seq); an open run that hears nothing for the horizon is told of once for each silence."""

    def __init__(self, m: Machine, horizon: timedelta | None) -> None:
        self._m, self._silence = m, None if horizon is None else int(horizon.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", "state int")

    def _now(self) -> int:
        return self._state.get()[0] if self._state.exists() else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq", "number"], kind="stable")
        state, out = self._now(), []
        for at, seq, phase, p in zip(batch["at"], batch["seq"].tolist(), batch["phase"], batch["number"].tolist(), strict=True):
            told = VERDICTS[self._m.verdict[p, state]]
            state = int(self._m.next[p, state])
            out.append((key[0], at, seq, phase, told, self._m.phase(state), self._m.attempts(state)))
        self._state.update((state,))
        if self._silence is not None:
            for due in list(self._handle.listTimers()):
                self._handle.deleteTimer(due)
            if state and self._m.phase(state) not in CLOSED:
                self._handle.registerTimer(int(batch["at"].iloc[-1].timestamp() * 1000) + self._silence)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, due = self._now(), pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], due, None, None, STALLED, self._m.phase(state), self._m.attempts(state))], columns=_COLUMNS)

    def close(self) -> None:
        pass


def run_journal(entries: DataFrame, horizon: timedelta | None = None, lateness: str = "0 seconds", m: Machine | None = None) -> DataFrame:
    """A stream of entries(run_id, at, seq, phase) -> each with its verdict and the state after it (append mode).

    Within a run entries arrive in order, but for those of one batch; a stream of other order is sorted into batches by
    its reader. With a horizon, open runs that the watermark finds silent for so long give a row STALLED, at the time
    when it became due. Entries without a run or a time are not journalled.
    """
    run, seq = (entries.schema[c].dataType.simpleString() for c in ("run_id", "seq"))
    rows = entries.where("run_id is not null and at is not null").withColumn("number", phase_number(F.col("phase"))).withWatermark("at", lateness)
    schema = f"run_id {run}, at timestamp, seq {seq}, phase string, verdict string, phase_after string, attempts_after int"
    mode = "None" if horizon is None else "EventTime"
    return rows.groupBy("run_id").transformWithStateInPandas(_Journal(m or machine(), horizon), schema, "Append", mode)
