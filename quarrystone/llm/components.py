"""Connected components over a table of links: alternating large-star and small-star steps.

Only minima are taken per vertex, so no group is gathered; each partition first
reduces its links to a spanning forest. Links with a null end and loops count for
nothing; repeated links count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: So many distinct links, at most, are reduced by one task.
ONE_TASK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (vertex, smallest vertex of its component) of the graph with edges a-b."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def _reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept_a, kept_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([kept_a, batch.a.to_numpy(np.int64)]), np.concatenate([kept_b, batch.b.to_numpy(np.int64)])
        kept_a, kept_b = forest(a, b)
        if len(kept_a) > 2_000_000:  # bounded memory: what is reduced goes on, the next steps do the rest
            yield pd.DataFrame({"a": kept_a, "b": kept_b})
            kept_a, kept_b = kept_a[:0], kept_b[:0]
    yield pd.DataFrame({"a": kept_a, "b": kept_b})


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a long, b long) -> (id, component) for every vertex with a link; component is the smallest id reachable."""
    edges = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= ONE_TASK:  # a counted bound: beyond it the steps below share the work
        edges = written(edges.coalesce(1).mapInPandas(_reduced, "a long, b long"))
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
    edges = written(edges.mapInPandas(_reduced, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.a", "e.b").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
