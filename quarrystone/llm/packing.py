"""Best-fit packing of tokenised documents into sequences of bounded length.

Hierarchical residual packing: each task packs its own pieces best-fit, longest
first; bins that are full enough are done; the others travel up a tree, where
groups of tasks' bins are items of the next best-fit round, until one group is
left. Before each round those bins are done that no other bin fits into, and those that
more bins than could ever fill them are as roomy as. Only (document, piece, length, crc) travels, never tokens, and a task holds a
bounded number of items at a time.

Defined results: a null text is an empty text; every document has at least the
closing id; pieces of equal length are taken in order of (doc_id, piece); a null
doc_id stays null; repeated rows are packed each for itself; an empty table gives
no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, written
from .token_parts import document_ids

CAPACITY = 2048
#: A task packs at most so many items at a time; more are packed in turns.
TASK_ITEMS = 200_000
#: So many groups of bins meet in one task of the next round.
FAN_IN = 8
#: Bins with so few free places are done.
SLACK = 8


def pieces(ids: bytes, capacity: int = CAPACITY) -> list[bytes]:
    """The ids of a document cut into pieces of capacity, the first one shorter if need be."""
    size, n = 4 * capacity, len(ids)
    first = n % size or size
    return [ids[:first]] + [ids[at : at + size] for at in range(first, n, size)]


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit, longest first: the bin of each item, and the free places of each bin."""
    bins, free = np.zeros(len(lengths), np.int64), []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free places
    used: list[int] = []  # sorted free places that occur
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect.bisect_left(used, need)
        if at < len(used):
            room = used[at]
            b = open_at[room].pop()
            if not open_at[room]:
                used.pop(at)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i] = b
        free[b] = left = room - need
        if left:
            if not open_at[left]:
                bisect.insort(used, left)
            open_at[left].append(b)
    return bins, np.array(free, np.int64)


_FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
_ITEM = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
_BIN = f"bin_group long, room int, items array<{_ITEM}>"


def _binned(frames: Iterator[tuple[int, list[list[tuple]]]], capacity: int) -> Iterator[pd.DataFrame]:
    """Packs (group, bins as lists of items) best-fit by the bins' lengths."""
    for group, held in frames:
        if not held:
            continue
        held.sort(key=lambda items: (items[0][0] is None, items[0][0] or 0, items[0][1]))
        bins, free = best_fit(np.array([sum(x[3] for x in items) for items in held], np.int64), capacity)
        out: list[list[dict]] = [[] for _ in free]
        end = np.zeros(len(free), np.int64)
        for b, items in zip(bins.tolist(), held, strict=True):
            for x in items:
                out[b].append(dict(zip(_FIELDS, (*x, int(end[b])), strict=True)))
                end[b] += x[3]
        for at in range(0, len(out), 2000):
            yield pd.DataFrame({"bin_group": group, "room": free[at : at + 2000].astype(np.int32), "items": out[at : at + 2000]})


def _first_round(file: str, capacity: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def filled() -> Iterator[tuple[int, list[list[tuple]]]]:
            held: list[list[tuple]] = []
            for batch in batches:
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    doc, at = None if pd.isna(doc) else int(doc), 0
                    for k, piece in enumerate(pieces(document_ids(text, file).tobytes(), capacity)):
                        held.append([(doc, k, at, len(piece) // 4, zlib.crc32(piece))])
                        at += len(piece) // 4
                if len(held) >= TASK_ITEMS:
                    yield task, held
                    held = []
                release()
            yield task, held

        yield from _binned(filled(), capacity)

    return pack


def _next_round(capacity: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def filled() -> Iterator[tuple[int, list[list[tuple]]]]:
            held: list[list[tuple]] = []
            group = 0
            for batch in batches:
                for group, items in zip(batch["bin_group"].tolist(), batch["items"], strict=True):
                    held.append([tuple(x[f] for f in _FIELDS[:5]) for x in items])
                if len(held) >= TASK_ITEMS:
                    yield group, held
                    held = []
            yield group, held

        yield from _binned(filled(), capacity)

    return pack


def _open_bins(rest: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(bins that are done, bins that may still take or become an item).

    One of two bins that go together is half full at most. So of the fuller ones only as many can be of use as
    there are bins that are half full at most, and the roomiest of them serve as well as any others.
    """
    n = {r["room"]: r["n"] for r in rest.groupBy("room").agg(F.count("*").alias("n")).collect()}  # a row for each number of free places
    small = {room: k for room, k in n.items() if 2 * (capacity - room) <= capacity}
    if not small:
        return rest, rest.limit(0)
    least, needed, bar, taken = capacity - max(small), sum(small.values()), min(small), 0
    for room in sorted(set(n) - set(small), reverse=True):
        if taken >= needed or room < least:
            break
        bar, taken = room, taken + n[room]
    spare = taken - needed
    if spare <= 0:
        return rest.where(F.col("room") < bar), rest.where(F.col("room") >= bar)
    # Of the bins with bar free places only some are needed: as many from each group.
    level = rest.where(F.col("room") == bar)
    counts = [r["n"] for r in level.groupBy("bin_group").agg(F.count("*").alias("n")).collect()]  # a row for each task of the round before
    share = bisect.bisect_left(range(max(counts) + 1), n[bar] - spare, key=lambda k: sum(min(c, k) for c in counts))
    first = F.row_number().over(Window.partitionBy("bin_group").orderBy(F.col("items")[0]["doc_id"], F.col("items")[0]["piece"]))
    level = level.withColumn("nth", first)
    return rest.where(F.col("room") < bar).unionByName(level.where(F.col("nth") > share).drop("nth")), rest.where(F.col("room") > bar).unionByName(level.where(F.col("nth") <= share).drop("nth"))


def pack(docs: DataFrame, file: str, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text), a byte-level tokenizer's JSON file -> doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    bins = written(rows.mapInPandas(_first_round(file, capacity), _BIN))
    done = bins.where(F.col("room") <= SLACK)
    rest = bins.where(F.col("room") > SLACK)
    groups = (bins.agg(F.max("bin_group")).first()[0] or 0) + 1
    while groups > 1:
        groups = -(-groups // FAN_IN)
        ended, rest = _open_bins(rest, capacity)
        done = done.unionByName(ended)
        # Groups are dealt by their hash, so some tasks may pack two of them together and some none.
        rest = rest.withColumn("bin_group", F.floor(F.col("bin_group") / FAN_IN)).repartition(groups, "bin_group")
        packed = written(rest.mapInPandas(_next_round(capacity), _BIN))
        done = done.unionByName(packed.where(F.col("room") <= SLACK))
        rest = packed.where(F.col("room") > SLACK)
    bins = done.unionByName(rest).withColumn("sequence_id", F.monotonically_increasing_id())
    bins = bins.select("sequence_id", F.explode("items").alias("item"))  # apart, or each item would draw a number
    return bins.select("item.doc_id", "item.piece", "item.start", "item.length", "item.ids_crc32", "sequence_id", "item.offset")
