"""Embedding near-dedup: epsilon grid order join.

cosine >= t is euclidean distance <= sqrt(2 - 2t) between unit vectors. Vectors are
turned into the principal basis, a rotation that keeps distances; the grid cells of
their leading coordinates, of that width, order them. Contiguous stretches of this
order are blocks with bounding boxes. Pairs of blocks that could hold a link are
joined recursively: intervals are halved until their boxes are provably distant or
they are small, and small ones are compared by matrix products, in double precision
wherever a coarse product comes near t.

No pair of rows ever leaves a task: each pair of blocks yields counts and a spanning
forest of its links. Equal vectors are compared once and counted by their number.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, nor do vectors of different dimension with one
another; a null vec_id links with nothing and gets component_id null; every row of
the table gives one row. Finite vectors of any magnitude are compared by direction
alone. A row that repeats another's vec_id and vector is a vector of its own, and they
count one another; rows that repeat a vec_id with other vectors each get the links of
all of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import components, forest

THRESHOLD = 0.9
#: Leading principal coordinates that make the grid's cells.
LEADING = 4
#: Vectors in a block, and in an interval that is compared at once.
BLOCK, LEAF = 4096, 512
#: Single-precision products differ by less than this from the double ones.
COARSE = 1e-4


def _raw(vectors: DataFrame) -> DataFrame:
    """(vec_id, copy, dim, raw) of the vectors that can link; copy is a hash of the components as they stand."""
    wide = isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType)
    kind = "<f8" if wide else "<f4"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, v in zip(batch["vec_id"], batch["embedding"], strict=True):
                if v is None or not len(v):
                    continue
                x = np.asarray([np.nan if y is None else y for y in v] if getattr(v, "dtype", object) == object else v, dtype=np.float64)
                if np.isfinite(x).all() and x.any():
                    raw = (x + 0.0).astype(kind).tobytes()  # -0.0 is 0.0
                    out.append((i, hashlib.blake2b(raw, digest_size=16).digest(), len(x), raw))
            yield pd.DataFrame(out, columns=["vec_id", "copy", "dim", "raw"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null").mapInPandas(read, "vec_id long, copy binary, dim int, raw binary")


def _units(raws: list[bytes], kind: str) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is taken out first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(kind: str):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                u = _units(part["raw"].tolist(), kind)
                held[dim] = held.get(dim, 0) + u.T @ u
        for dim, m in held.items():
            yield pd.DataFrame({"dim": np.int32(dim), "cell": np.arange(m.size), "value": m.ravel()})

    return sums


def _bases(distinct: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """The principal basis for each dimension, from all vectors; dim * dim numbers reach the driver."""
    summed = distinct.select("dim", "raw").mapInPandas(_moments(kind), "dim int, cell int, value double").groupBy("dim", "cell").agg(F.sum("value").alias("value")).toPandas()
    bases = {}
    for dim, part in summed.groupby("dim"):
        m = part.sort_values("cell")["value"].to_numpy().reshape(dim, dim)
        _, basis = np.linalg.eigh((m + m.T) / 2)
        bases[int(dim)] = np.ascontiguousarray(basis[:, ::-1])
    return bases


def _near(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, reach: float) -> bool:
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap) <= reach * reach


def join_intervals(a: np.ndarray, b: np.ndarray, unit_a: np.ndarray, unit_b: np.ndarray, same: bool, threshold: float, leaf: int = LEAF) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start in a, start in b, matrix of links) for the leaves of the recursion over two stretches in grid order.

    a and b are in the principal basis, unit_a and unit_b as they came; the latter decide.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    single_a, single_b = a.astype(np.float32), b.astype(np.float32)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1 or same and b1 <= a0:
            continue
        if not _near(a[a0:a1].min(0), a[a0:a1].max(0), b[b0:b1].min(0), b[b0:b1].max(0), reach):
            continue
        if a1 - a0 <= leaf and b1 - b0 <= leaf:
            if (single_a[a0:a1] @ single_b[b0:b1].T).max() < threshold - COARSE:
                continue
            linked = unit_a[a0:a1] @ unit_b[b0:b1].T >= threshold
            if same and a0 == b0:
                linked = np.triu(linked, 1)
            elif same and b0 < a0:
                continue
            if linked.any():
                yield a0, b0, linked
            continue
        mid_a, mid_b = (a0 + a1) // 2, (b0 + b1) // 2
        halves_a = [(a0, a1)] if a1 - a0 <= leaf else [(a0, mid_a), (mid_a, a1)]
        halves_b = [(b0, b1)] if b1 - b0 <= leaf else [(b0, mid_b), (mid_b, b1)]
        todo += [(*x, *y) for x in halves_a for y in halves_b]


def _blocks(bases: dict[int, np.ndarray], kind: str):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block() -> pd.DataFrame:
            nonlocal n
            dim = held[0][1]
            y = _units([r for _, _, _, r in held], kind) @ bases[dim]
            n += 1
            reach = 1e-6
            return pd.DataFrame(
                {
                    "block": [(task << 32) | n],
                    "dim": [dim],
                    "low": [(y.min(0) - reach).tolist()],
                    "high": [(y.max(0) + reach).tolist()],
                    "ids": [np.array([i for i, _, _, _ in held], "<i8").tobytes()],
                    "copies": [np.array([c for _, _, c, _ in held], "<i8").tobytes()],
                    "raws": [b"".join(r for _, _, _, r in held)],
                }
            )

        for batch in batches:
            for row in zip(batch["id"].tolist(), batch["dim"].tolist(), batch["copies"].tolist(), batch["raw"], strict=True):
                if held and (held[0][1] != row[1] or len(held) == BLOCK):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    return cut


def _cells(bases: dict[int, np.ndarray], kind: str, width: float):
    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = np.zeros((len(batch), LEADING), np.int32)
            for dim, part in batch.reset_index(drop=True).groupby("dim"):
                y = _units(part["raw"].tolist(), kind) @ bases[dim][:, :LEADING]
                cells[part.index, : y.shape[1]] = np.floor(y / width)
            yield batch.assign(**{f"cell{k}": cells[:, k] for k in range(LEADING)})

    return project


def _compared(bases: dict[int, np.ndarray], kind: str, threshold: float):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        sides = []
        for row in group.itertuples():
            unit = _unit(np.frombuffer(row.raws, kind).reshape(-1, row.dim))
            sides.append((np.frombuffer(row.ids, "<i8"), np.frombuffer(row.copies, "<i8"), unit @ bases[row.dim], unit))
        (ids_a, n_a, turned_a, unit_a), (ids_b, n_b, turned_b, unit_b) = sides[0], sides[-1]
        same = len(sides) == 1
        count_a, count_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        ends_a, ends_b = [], []
        for a0, b0, linked in join_intervals(turned_a, turned_b, unit_a, unit_b, same, threshold):
            count_a[a0 : a0 + linked.shape[0]] += linked @ n_b[b0 : b0 + linked.shape[1]]
            count_b[b0 : b0 + linked.shape[1]] += linked.T @ n_a[a0 : a0 + linked.shape[0]]
            i, j = np.nonzero(linked)
            u, v = forest(ids_a[a0 + i], ids_b[b0 + j])
            ends_a.append(u)
            ends_b.append(v)
        ids, n = np.concatenate([ids_a, ids_b]), np.concatenate([count_a, count_b])
        counted = pd.DataFrame({"id": ids[n > 0], "other": np.full((n > 0).sum(), -1), "n": n[n > 0]})
        if not ends_a:
            return counted.astype({"id": "int64", "other": "int64", "n": "int64"})
        u, v = forest(np.concatenate(ends_a), np.concatenate(ends_b))
        return pd.concat([counted, pd.DataFrame({"id": u, "other": v, "n": 0})]).astype({"id": "int64", "other": "int64", "n": "int64"})

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept for each row."""
    wide = isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType)
    kind = "<f8" if wide else "<f4"
    rows = written(_raw(vectors))
    # Equal vectors are one vector with a number of copies; its id is the smallest.
    distinct = written(rows.groupBy("copy", "dim", "raw").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    bases = _bases(distinct, kind)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) or 1e-9
    order = ["dim", *(f"cell{k}" for k in range(LEADING))]
    cells = ", ".join(f"cell{k} int" for k in range(LEADING))
    placed = distinct.select("id", "dim", "copies", "raw").mapInPandas(_cells(bases, kind, width), f"id long, dim int, copies long, raw binary, {cells}")
    # The hash at the end lets a cell that holds much of the data span tasks.
    ordered = placed.withColumn("tie", F.xxhash64("id")).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    blocks = written(ordered.mapInPandas(_blocks(bases, kind), "block long, dim int, low array<double>, high array<double>, ids binary, copies binary, raws binary"))
    boxes = blocks.select("block", "dim", "low", "high", F.floor(F.col("low")[0] / width).alias("c0"), F.floor(F.col("high")[0] / width).alias("c1"))
    left = boxes.select(F.col("block").alias("a"), "dim", F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence("c0", "c1")).alias("cell"))
    right = boxes.select(F.col("block").alias("b"), "dim", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1)).alias("cell"))
    gaps = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    distance = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)
    pairs = left.join(right, ["dim", "cell"]).where("a <= b").where(distance <= width * width + 1e-6).select("a", "b").distinct()
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).join(blocks.select("block", "dim", "ids", "copies", "raws"), "block")
    found = written(sides.groupBy("a", "b").applyInPandas(_compared(bases, kind, threshold), "id long, other long, n long"))
    parts = components(found.where("n = 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("links"))
    known = distinct.select("copy", "id", "copies").join(counts, "id", "left").join(parts, "id", "left")
    known = known.select("copy", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.select("vec_id", "copy").join(known, "copy").select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long"))
    able = linked.groupBy("vec_id").agg(F.count("*").alias("n_rows"), F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rest.join(able, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
