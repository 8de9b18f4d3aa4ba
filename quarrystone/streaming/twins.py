"""Structured Streaming twins of the batch operators; on the same rows they end with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import store
from ..sources.units import WINDOW_MS


def append_once(rows: DataFrame, path: str, key: list[str], immutable: list[str], checkpoint: str) -> DataStreamWriter:
    """Appends what is new of each micro-batch; a replayed batch creates nothing, since ids are content-addressed."""

    def write(batch: DataFrame, _: int) -> None:
        store.append(batch, path, key, immutable)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def first_seen(rows: DataFrame, key: list[str], stamp: str, lateness: str = "30 days") -> DataFrame:
    """Each key once within the watermark; the state of older keys is dropped."""
    return rows.withWatermark(stamp, lateness).dropDuplicatesWithinWatermark(key)


def latest_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key so far (update mode): one struct of state for each key."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in (*order, *rest)])


def counts_by_window(rows: DataFrame, stamp: str, group: str, size: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Changes by group and window, with a watermark."""
    return rows.withWatermark(stamp, lateness).groupBy(F.window(stamp, size).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def transcript_windows(segments: DataFrame, key: str, span_ms: int = WINDOW_MS) -> DataFrame:
    """Greedy windows over segments that arrive in order; an open window is kept as state and emitted in its present form with each batch.

    The last row of a (key, window) is its final form.
    """
    kind = segments.schema[key].dataType.simpleString()
    fields = "window int, start_ms long, end_ms long, first_n long, n_segments int"

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("n")
        held, out = (state.get if state.exists else None), []
        for n, start, end in zip(rows["n"].tolist(), rows["start_ms"].tolist(), rows["end_ms"].tolist(), strict=True):
            if held is not None and end - held[1] <= span_ms:
                held = (held[0], held[1], max(held[2], end), held[3], held[4] + 1)
                continue
            if held is not None:
                out.append(held)
            held = (held[0] + 1 if held is not None else 1, start, end, n, 1)
        state.update(held)
        done = pd.DataFrame([*out, held], columns=["window", "start_ms", "end_ms", "first_n", "n_segments"])
        done.insert(0, key, keys[0])
        yield done

    return segments.select(key, "n", "start_ms", "end_ms").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {fields}", fields, "append", "NoTimeout")
