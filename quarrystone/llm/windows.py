"""Packing into padded windows: best-fit decreasing over a segment tree of remaining capacities.

Documents longer than a window are first cut into full windows; what is left of them, and every shorter document, is an
item. Items go, longest first, into the tightest open window that takes them; a segment tree over remaining capacities,
whose nodes count the open windows below them, finds it. As a window is padded unless it is full or as long as a power of
two, windows that best fit leave open are then levelled: the emptiest are cut up to fill the fullest, and of the last
one of a task the tokens go into windows of powers of two. So no token of padding is left, and no item is cut that
best fit could place.

A task packs its own documents, in turns of a bounded number of tokens, and hands its last open window from turn to
turn. Nothing is shuffled.

Defined results: a null text is an empty text; every document has at least the closing id; items of equal length are
taken in the order of the table; repeated rows are packed each for itself; a null doc_id stays null; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release
from .token_parts import document_ids

CAPACITY = 1024
#: A task holds at most so many tokens at a time, beside one batch of documents.
TURN_TOKENS = 4_000_000


@dataclass
class Item:
    """Part of a document: its ids and where they start in it."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Item, Item]:
        return Item(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Item(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, capacity: int) -> None:
        self._leaves = 1 << capacity.bit_length()
        self._count = [0] * (2 * self._leaves)
        self._held: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        node = room + self._leaves
        while node:
            self._count[node] += n
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self._held[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(remaining capacity, window) of the tightest open window with at least need left, which is taken out."""
        node = need + self._leaves
        if not self._count[node]:
            while node > 1 and (node & 1 or not self._count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node if self._count[2 * node] else 2 * node + 1
        room = node - self._leaves
        self._add(room, -1)
        return room, self._held[room].pop()


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit decreasing: the items of each window."""
    tree, windows = OpenWindows(capacity), []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[i])
        if found is None:
            found = capacity, len(windows)
            windows.append([])
        room, w = found
        windows[w].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], w)
    return windows


def _unpadded(length: int, capacity: int) -> bool:
    return length == capacity or length & (length - 1) == 0


def _moved(source: list[Item], target: list[Item], n: int) -> None:
    """The last n tokens of source go to target; at most one item is cut."""
    while n:
        item = source.pop()
        if len(item.ids) > n:
            head, item = item.cut(len(item.ids) - n)
            source.append(head)
        target.append(item)
        n -= len(item.ids)


def levelled(windows: list[list[Item]], capacity: int = CAPACITY) -> tuple[list[list[Item]], list[Item]]:
    """(windows without padding, the items of at most one open window): the emptiest windows are cut up to fill the fullest."""
    size = lambda w: sum(len(x.ids) for x in w)
    done = [w for w in windows if _unpadded(size(w), capacity)]
    left = sorted(((size(w), w) for w in windows if not _unpadded(size(w), capacity)), key=lambda x: -x[0])
    first, last = 0, len(left) - 1
    while first < last:
        full, target = left[first]
        held, source = left[last]
        n = min(capacity - full, held)
        _moved(source, target, n)
        left[first], left[last] = (full + n, target), (held - n, source)
        first += full + n == capacity
        last -= held == n
    rest = left[first][1] if left and first == last else []
    return done + [w for n, w in left if n == capacity], [] if size(rest) == capacity else rest


def in_powers(items: list[Item]) -> list[list[Item]]:
    """Windows of powers of two that hold the items."""
    n, out = sum(len(x.ids) for x in items), []
    while n:
        window: list[Item] = []
        _moved(items, window, 1 << n.bit_length() - 1)
        n -= 1 << n.bit_length() - 1
        out.append(window)
    return out


_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(file: str, capacity: int, turn_tokens: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33

        def rows(windows: list[list[Item]]) -> pd.DataFrame:
            nonlocal number
            out = []
            for window in windows:
                at = 0
                for x in window:
                    out.append((x.doc_id, x.start, len(x.ids), zlib.crc32(x.ids.tobytes()), x.doc_tokens, number, at))
                    at += len(x.ids)
                number += 1
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _COLUMNS.split(", ")])
            return frame.assign(doc_id=frame["doc_id"].astype("Int64"))

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    yield None if pd.isna(doc) else int(doc), document_ids(text, file)
                release()

        items: list[Item] = []
        full: list[list[Item]] = []
        held = 0
        for doc, ids in documents():
            whole = Item(doc, 0, ids, len(ids))
            while len(whole.ids) >= capacity:
                window, whole = whole.cut(capacity)
                full.append([window])
            if len(whole.ids):
                items.append(whole)
            held += len(ids)
            if held >= turn_tokens:
                windows, items = levelled([[items[i] for i in w] for w in best_fit([len(x.ids) for x in items], capacity)], capacity)
                yield rows(full + windows)
                full, held = [], 0
        windows, items = levelled([[items[i] for i in w] for w in best_fit([len(x.ids) for x in items], capacity)], capacity)
        yield rows(full + windows + in_powers(items))

    return pack


def pack(docs: DataFrame, file: str, capacity: int = CAPACITY, turn_tokens: int = TURN_TOKENS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_packed(file, capacity, turn_tokens), _COLUMNS)
