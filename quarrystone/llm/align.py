"""Cross-tokenizer alignment: where two tokenizers' tokens of the same text end together.

Texts of an Arrow batch are laid end to end, both tokenizers' token ends are counted once over the bytes of the whole
batch, and the places where both end cut the tokens into groups; prefix sums, taken at the documents' own ends, give each
document's counts. Every stretch between two neighbouring ends lies in one token of either side, so these stretches are
the links.

How many documents hold an id pair linked is known only corpus-wide. Tasks gather runs of documents of bounded size;
a run writes its documents' pairs as numbers into its own list of distinct pairs, and that list once. Lists are counted
by pair, counts go back to the runs that asked, and each run's documents are finished beside them: what is shuffled are
distinct pairs of runs, never links of documents.

Defined results: a text that is null or empty, or whose bytes either tokenizer changes, has no tokens: zeros and ''; a
null doc_id stays null; repeated rows count each as a document of its own; a document of any length is aligned in
stretches that end where both tokenizers certainly end, so memory is bounded by its ids; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, written
from .token_parts import ByteLevel, Cache, Pieces, spaced_parts

#: Parts (words, mostly) that are aligned at once, and links of documents that share a list of distinct pairs.
STRETCH, RUN_LINKS = 200_000, 1_500_000


@dataclass
class Sums:
    """What a document's stretches add up to."""

    doc_id: int | None
    n: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))  # tokens of A, tokens of B, groups, links
    groups: hashlib._Hash | None = None
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)


class Aligner:
    """Both tokenizers with a cache of parts, for one worker process."""

    def __init__(self, file_a: str, file_b: str) -> None:
        a, b = ByteLevel(file_a, plain=True), Pieces(file_b)
        self._bytes = a.token_bytes(), b.token_bytes()
        self._lengths = [np.array([len(t) for t in side], np.int64) for side in self._bytes]
        self._cache = Cache([a.spaced, b.spaced])
        self._sound = np.zeros(0, bool)
        width = len(str(max(map(len, self._bytes)) - 1))
        # A row of ASCII digits for each id, padded in front, and a place for what follows it.
        self._digits = np.array([list(f"{i:>{width}} ".encode()) for i in range(max(map(len, self._bytes)))], np.uint8)

    def make_room(self) -> None:
        """Only while no numbers of parts are in use."""
        if self._cache.full():
            self._sound = self._sound[self._cache.forget()]

    def numbered(self, keys: list[str]) -> np.ndarray:
        numbers, new = self._cache.numbered(keys)
        if new:
            at, spaced = np.arange(len(self._sound), len(self._sound) + len(new)), [b" " + k.encode() for k in new]
            self._sound = np.concatenate([self._sound, np.logical_and(*[self._same(side, at, spaced) for side in (0, 1)])])
        return numbers

    def _same(self, side: int, numbers: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Whether the tokens of each part are its bytes; mostly all are, and one comparison tells."""
        ids, count = self._cache.gathered(side, numbers)
        tokens = list(map(self._bytes[side].__getitem__, ids.tolist()))
        length = np.add.reduceat(self._lengths[side][ids], np.cumsum(count) - count)
        if b"".join(tokens) == b"".join(texts) and (length == np.fromiter(map(len, texts), np.int64, len(texts))).all():
            return np.ones(len(texts), bool)
        ends = np.cumsum(count).tolist()
        return np.array([b"".join(tokens[s:e]) == t for s, e, t in zip([0, *ends], ends, texts)])

    def sound(self, numbers: np.ndarray) -> bool:
        """Both tokenizers give the parts' bytes back."""
        return bool(self._sound[numbers].all())

    def aligned(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Parts of several documents end to end, sizes of them in each ->
        (counts of each document, its groups as text without a last ";", distinct pairs, (document, pair) that occur, how often).
        """
        upto = np.concatenate([[0], np.cumsum(sizes)])
        sides = [self._cache.gathered(k, numbers) for k in (0, 1)]
        ends = [np.cumsum(length[ids]) for (ids, _), length in zip(sides, self._lengths, strict=True)]
        total = int(ends[0][-1])
        marks_a, marks_b = (np.bincount(e, minlength=total + 1) for e in ends)
        cut = marks_a & marks_b
        groups, some = np.cumsum(cut), np.flatnonzero(marks_a | marks_b)
        token_end = [np.concatenate([[0], np.cumsum(count)])[upto] for _, count in sides]
        byte_end = np.concatenate([[0], ends[0]])[token_end[0]]
        link_end = np.searchsorted(some, byte_end, "right")
        counts = np.stack([np.diff(token_end[0]), np.diff(token_end[1]), np.diff(groups[byte_end]), np.diff(link_end)], axis=1)
        # A stretch that ends at p lies in the token that follows the ends before p.
        covering = [np.cumsum(m)[some] - m[some] for m in (marks_a, marks_b)]
        linked = sides[0][0][covering[0]].astype(np.int64) << 32 | sides[1][0][covering[1]]
        number, pairs = pd.factorize(linked)
        of_doc = np.repeat(np.arange(len(sizes)), counts[:, 3])
        which, seen = pd.factorize(of_doc * len(pairs) + number)
        return counts, self._as_text(sides, ends, groups, cut, byte_end), pairs, seen, np.bincount(which)

    def _as_text(self, sides, ends, groups, cut, byte_end) -> list[bytes]:
        """Decimal ids, A's before B's in each group; "," between ids, "|" between sides, ";" between groups."""
        (ids_a, _), (ids_b, _) = sides
        of_a, of_b = ((groups - cut)[e] for e in ends)
        closed_a, closed_b = np.bincount(of_a), np.bincount(of_b)
        place_a = np.arange(len(ids_a)) + (np.cumsum(closed_b) - closed_b)[of_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(closed_a)[of_b]
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        ids[place_a], ids[place_b] = ids_a, ids_b
        rows = self._digits[ids]
        rows[:, -1] = ord(",")
        rows[place_a[np.cumsum(closed_a) - 1], -1] = ord("|")
        rows[place_b[np.cumsum(closed_b) - 1], -1] = ord(";")
        kept = rows != ord(" ")
        text, upto = rows[kept].tobytes(), np.concatenate([[0], np.cumsum(kept.sum(axis=1))])
        tokens = np.searchsorted(ends[0], byte_end, "right") + np.searchsorted(ends[1], byte_end, "right")
        return [text[a : b - 1] for a, b in zip(upto[tokens[:-1]].tolist(), upto[tokens[1:]].tolist(), strict=True)]


@functools.cache
def aligner_of(file_a: str, file_b: str) -> Aligner:
    return Aligner(file_a, file_b)


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_RUN = f"run long, {_DOC}, numbers binary, times binary, a array<int>, b array<int>, docs array<int>"


def _frame(run: int, docs: list[Sums], number: np.ndarray, pairs: np.ndarray) -> pd.DataFrame:
    """The rows of a run: its documents, then its list of distinct pairs with the number of its documents that hold each."""
    upto = np.concatenate([[0], np.cumsum([sum(map(len, d.pairs)) for d in docs])])
    rows = [
        (run, d.doc_id, *d.n.tolist(), d.groups.hexdigest() if d.groups else "", number[s:e].astype("<i4").tobytes(), b"".join(t.astype("<i4").tobytes() for t in d.times), None, None, None)
        for d, s, e in zip(docs, upto, upto[1:])
    ]
    if len(pairs):
        rows.append((run, *[None] * 8, (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), np.bincount(number).astype(np.int32)))
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _RUN.split(", ")])
    return frame.astype(dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links"), "Int64"))


def _finished(run: int, docs: list[Sums]) -> pd.DataFrame:
    for doc in docs:
        if len(doc.pairs) > 1:  # a pair of several stretches counts once
            which, pairs = pd.factorize(np.concatenate(doc.pairs))
            doc.times, doc.pairs = [np.bincount(which, np.concatenate(doc.times))], [pairs]
    held = [p for d in docs for p in d.pairs]
    number, pairs = pd.factorize(np.concatenate(held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return _frame(run, docs, number, pairs)


def _aligned(file_a: str, file_b: str, stretch: int, run_links: int):
    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        coder, run = aligner_of(file_a, file_b), TaskContext.get().partitionId() << 32
        docs: list[Sums] = []
        waiting: list[tuple[Sums, np.ndarray]] = []

        def settle() -> int:
            """Aligns the stretches that wait; how many links they have."""
            if not waiting:
                return 0
            counts, texts, pairs, seen, times = coder.aligned(np.concatenate([n for _, n in waiting]), np.array([len(n) for _, n in waiting]))
            cuts = np.searchsorted(seen // len(pairs), np.arange(len(waiting) + 1))
            for k, (doc, _) in enumerate(waiting):
                doc.n += counts[k]
                if doc.groups is None:
                    doc.groups = hashlib.sha256(texts[k])
                else:
                    doc.groups.update(b";" + texts[k])
                doc.pairs.append(pairs[seen[cuts[k] : cuts[k + 1]] % len(pairs)])
                doc.times.append(times[cuts[k] : cuts[k + 1]])
            waiting.clear()
            return int(counts[:, 3].sum())

        size = links = 0
        for batch in batches:
            for names, keys in _together(batch["doc_id"], batch["text"], stretch):
                upto = np.concatenate([[0], np.cumsum(list(map(len, keys)))])
                numbers = coder.numbered([k for part in keys for k in part])
                for name, s, e in zip(names, upto, upto[1:]):
                    docs.append(doc := Sums(None if pd.isna(name) else int(name)))
                    if s == e or not coder.sound(numbers[s:e]):
                        continue
                    for at in range(s, e, stretch):
                        waiting.append((doc, numbers[at : min(e, at + stretch)]))
                        size += len(waiting[-1][1])
                        if size >= stretch:
                            links, size = links + settle(), 0
                links, size = links + settle(), 0
                coder.make_room()
                if links >= run_links:
                    yield _finished(run, docs)
                    docs, run, links = [], run + 1, 0
            release()
        if docs:
            yield _finished(run, docs)

    return align


def _together(names: pd.Series, texts: pd.Series, size: int) -> Iterator[tuple[list, list[list[str]]]]:
    """(doc_ids, their parts) of documents that have about so many parts together."""
    held, parts, n = [], [], 0
    for name, text in zip(names, texts, strict=True):
        held.append(name)
        parts.append(spaced_parts(text) if text else [])
        n += len(parts[-1])
        if n >= size:
            yield held, parts
            held, parts, n = [], [], 0
    if held:
        yield held, parts


def _counted(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """Documents of a run beside the corpus-wide counts of its pairs."""
    told = told.sort_values("place")
    held, best = told["held"].to_numpy(np.int64), told["best"].to_numpy(bool)
    number, times = np.frombuffer(b"".join(docs["numbers"]), "<i4"), np.frombuffer(b"".join(docs["times"]), "<i4").astype(np.int64)
    upto = np.concatenate([[0], np.cumsum([len(x) // 4 for x in docs["numbers"]])])
    out = docs.drop(columns=["run", "numbers", "times"])
    for name, what in (("n_best", times * best[number]), ("count_sum", times * held[number])):
        out[name] = np.diff(np.concatenate([[0], np.cumsum(what)])[upto])
    return out


def align(docs: DataFrame, file_a: str, file_b: str, stretch: int = STRETCH, run_links: int = RUN_LINKS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum for every row."""
    rows = written(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_aligned(file_a, file_b, stretch, run_links), _RUN))
    listed = rows.where("a is not null").select("run", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "p")).select("run", "place", "p.a", "p.b", "p.docs")
    counts = listed.groupBy("a", "b").agg(F.sum("docs").alias("held"))
    best = counts.withColumn("best", F.col("held") == F.max("held").over(Window.partitionBy("a")))
    told = listed.select("run", "place", "a", "b").join(best, ["a", "b"]).select(F.col("run").alias("asked"), "place", "held", "best")
    found = rows.where("a is null").select("run", *[c.split()[0] for c in _DOC.split(", ")], "numbers", "times")
    return found.groupBy("run").cogroup(told.groupBy("asked")).applyInPandas(_counted, f"{_DOC}, n_best long, count_sum long")
