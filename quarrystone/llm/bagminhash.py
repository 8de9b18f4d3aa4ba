"""Near-duplicates by BagMinHash over multisets of five-word shingles.

Signatures follow hierarchical Poisson processes over discretised weights: a
shingle's weight axis is cut into the dyadic intervals [0,1), [1,2), [2,4), ...
Each (shingle, interval) carries its own Poisson process whose rate is the
interval's length; a point has a time, a place on the weight axis and a register.
A document of weight w sees the points placed below w, and each register keeps its
earliest. Two registers agree with the probability of the weighted Jaccard
similarity. Points are drawn in order of time only until they can no longer win.

Bands of signatures give buckets. The member that meets most others is a bucket's hub;
buckets with one hub are a group, so a group of copies is one group in spite of its many
buckets. Groups of bounded size are compared in one task each, by counting what their
members share; what leaves the task is a spanning forest of the links. In a larger group
every member x is described by how it differs from a reference C, the multiset that most
of a few members have: D(x) is what x lacks of C and what it has beyond C. A link of x
and y means |D(x) ^ D(y)| = |x ^ y| <= b (|x| + |y|) with b = (1 - t) / (1 + t), so with
r(x) = |D(x)| - b |x|:

* r(x) + r(y) <= 0 is a link without any look at the texts. The member with the least r is
  the centre of all such links.
* any other link shares at least (r(x) + r(y)) / 2 elements of D(x) and D(y). So it is
  enough to compare members that meet in a prefix of their differences (prefix filtering),
  cut by the levels of both r. Copies that were changed independently hardly ever meet.

The hub is compared with all members as well. Those that meet in prefixes are the buckets
of the next round, parts of their group without its hub, so groups shrink until none is
left. No link between bucket mates is lost, no group is gathered beyond the bound, and a
group of copies costs about its number of members.

Words are what lies between ASCII white space, as they stand. Texts of one to four
words have one shingle, all their words. Defined results: texts that are null,
empty or white space link with nothing; equal texts form one class before anything
else; of a repeated doc_id the smallest text counts; a null doc_id is left out of
classes(), as no result could name it, and deduplicated() keeps such rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SEED, as_rows, fields, joined, mix, release, seed_of, written
from .components import components, forest

SHINGLE = 5
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
#: So many members, the hub among them, make a large group's reference.
COMPANIONS = 16
#: A group of so many members with so many shingles, at most, is compared in one task.
GROUP, GROUP_SHINGLES = 256, 3_000_000
#: So many members of a large group meet its reference in one task.
COHORT = 64
#: Documents are signed in batches of about so many shingles.
BATCH_SHINGLES = 200_000
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class _Words(dict):
    """Word -> 64-bit hash; forgets everything when it is large."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= 150_000:
            self.clear()
        self[word] = value
        return value


def shingles(text: str | None, words: _Words) -> np.ndarray:
    """64-bit hashes of a text's shingles in order, repeats included."""
    split = (text or "").encode("utf-8", "surrogatepass").split()
    if not split:
        return np.zeros(0, np.uint64)
    codes = mix(np.fromiter(map(words.__getitem__, split), dtype=np.uint64, count=len(split)) + SEED)
    n = max(1, len(codes) - SHINGLE + 1)
    total = np.full(n, len(codes) if len(codes) < SHINGLE else SHINGLE, dtype=np.uint64)
    for k in range(min(SHINGLE, len(codes))):
        total = total + codes[k : k + n] * _STEPS[k]
    return mix(total)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row of registers (times as float32) for each bag of (distinct 64-bit elements, integer weights >= 1)."""
    best = np.full(len(bags) * registers, np.inf)
    if not bags or not sum(len(e) for e, _ in bags):
        return best.reshape(len(bags), registers).astype(np.float32)
    owner = np.repeat(np.arange(len(bags)), [len(e) for e, _ in bags])
    element, weight = np.concatenate([e for e, _ in bags]), np.concatenate([w for _, w in bags]).astype(np.float64)
    low, high, level = 0.0, 1.0, 0
    parts = []
    while len(element):  # the hierarchy: an element takes part in each interval that begins below its weight
        parts.append((owner, mix(element + seed_of(level + 1)), weight, np.full(len(element), low), np.full(len(element), high - low)))
        low, high, level = high, 2 * high, level + 1
        more = weight > low
        owner, element, weight = owner[more], element[more], weight[more]
    owner, seed, weight, low_end, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, point = np.zeros(len(owner)), 0
    while len(owner):
        drawn = mix(seed + seed_of(2 * point + 1))
        other = mix(drawn ^ _STEPS[0])
        time = time - np.log(_uniform(drawn)) / length
        seen = low_end + _uniform(other) * length < weight
        slot = owner * registers + (mix(other ^ _STEPS[1]) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, slot[seen], time[seen])
        last = best.reshape(len(bags), registers).max(axis=1)
        go = time < last[owner]
        owner, seed, weight, low_end, length, time = owner[go], seed[go], weight[go], low_end[go], length[go], time[go]
        point += 1
    return best.reshape(len(bags), registers).astype(np.float32)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    bits = np.ascontiguousarray(sigs, dtype="<f4").view("<u4").reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * SEED, bits.shape[:2])
    for k in range(ROWS):
        key = mix(key ^ (bits[:, :, k] + _STEPS[k]))
    return key.astype(np.int64)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = _Words()

    def done(ids: list, sizes: list, bags: list) -> pd.DataFrame:
        return pd.DataFrame({"id": ids, "size": sizes, "keys": list(band_keys(signatures(bags)))})

    for batch in batches:
        ids, sizes, bags, n = [], [], [], 0
        for i, text in zip(batch["id"], batch["text"], strict=True):
            found = shingles(text, words)
            if len(found):
                ids.append(i)
                sizes.append(len(found))
                bags.append(np.unique(found, return_counts=True))
                n += len(found)
            if n >= BATCH_SHINGLES:
                yield done(ids, sizes, bags)
                ids, sizes, bags, n = [], [], [], 0
        if ids:
            yield done(ids, sizes, bags)
        del batch, ids, bags
        release()


def features(text: str | None, words: _Words) -> np.ndarray:
    """A text's multiset of shingles as a sorted set: the n-th occurrence of a shingle is an element of its own."""
    values, counts = np.unique(shingles(text, words), return_counts=True)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(mix(np.repeat(values, counts) + mix(nth.astype(np.uint64) + SEED)))


def similar(common, size_a, size_b, threshold: float):
    """Whether sets of these sizes with so much in common have a Jaccard similarity of threshold or more."""
    return (common > 0) & (common >= threshold / (1 + threshold) * (size_a + size_b) - 1e-9)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two texts' features, which is the weighted one of their shingles."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def linked_pairs(bags: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked pairs of some sets of features, from products of blocks of their presence matrix."""
    size = np.array([len(x) for x in bags])
    values, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    run = np.cumsum(np.r_[True, values[1:] != values[:-1]]) - 1
    several = np.bincount(run)[run] > 1
    owner, run = owner[several], run[several]
    column = np.cumsum(np.r_[True, run[1:] != run[:-1]]) - 1 if len(run) else run
    common = np.zeros((len(bags), len(bags)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        low, high = np.searchsorted(column, [first, first + 4096])
        present = np.zeros((len(bags), 4096), np.float32)
        present[owner[low:high], column[low:high] - first] = 1
        common += present @ present.T
    return np.nonzero(np.triu(similar(common, size[:, None], size[None, :], threshold), 1))


def _resolved(threshold: float):
    """Rows (grp, id, text) in the order of groups -> a spanning forest of each group's links."""

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, group, ids, bags, ends = _Words(), None, [], [], []

        def close() -> None:
            if len(ids) > 1:
                i, j = linked_pairs(bags, threshold)
                if len(i):
                    of = np.array(ids, np.int64)
                    ends.append(forest(of[i], of[j]))

        def links_found() -> pd.DataFrame:
            a, b = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            for g, i, text in zip(batch["grp"], batch["id"], batch["text"], strict=True):
                if g != group:
                    close()
                    group, ids, bags = g, [], []
                ids.append(i)
                bags.append(features(text, words))
            yield links_found()
            ends.clear()
            del batch
            release()
        close()
        yield links_found()

    return resolve


_REFERENCE = "grp long, width double, known binary, held binary, n int, hub binary"


def _references(threshold: float):
    """Companions (grp, p, id, text) in the order of groups, the hub first -> one reference for each group.

    known holds their elements, held how many of the n companions have each; width is that of a level of r.
    """

    def refer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, group, bags, out = _Words(), None, [], []

        def close() -> None:
            if bags:
                known, held = np.unique(np.concatenate(bags), return_counts=True)
                width = max(1.0, (1 - threshold) / (1 + threshold) * float(np.median([len(x) for x in bags])) / 2)
                out.append((group, width, known.tobytes(), held.astype(np.uint8).tobytes(), len(bags), bags[0].tobytes()))

        def frame() -> pd.DataFrame:
            return pd.DataFrame({k: pd.Series([x[n] for x in out], dtype=t) for n, (k, t) in enumerate(zip(["grp", "width", "known", "held", "n", "hub"], ["int64", "float64", object, object, "int32", object], strict=True))})

        for batch in batches:
            for g, text in zip(batch["grp"], batch["text"], strict=True):
                if g != group:
                    close()
                    group, bags = g, []
                if not bags or sum(map(len, bags)) < GROUP_SHINGLES:
                    bags.append(features(text, words))
            yield frame()
            out.clear()
        close()
        yield frame()

    return refer


def differences(x: np.ndarray, known: np.ndarray, held: np.ndarray, n: int) -> np.ndarray:
    """D(x): what x lacks of the reference and has beyond it, those that few companions share first, else in hash order."""
    centre = known[held * 2 > n]
    beyond, lost = np.setdiff1d(x, centre, assume_unique=True), np.setdiff1d(centre, x, assume_unique=True)
    at = np.minimum(np.searchsorted(known, beyond), len(known) - 1)
    frequent = np.where(known[at] == beyond, held[at], 0)
    missed = n - held[np.searchsorted(known, lost)]
    element = np.concatenate([beyond, mix(lost + _STEPS[2])])
    return element[np.lexsort((element, np.repeat([0, 1], [len(beyond), len(lost)]), np.concatenate([frequent, missed])))]


def _relative(threshold: float):
    """Rows in the order of (grp, salt, role), the reference before the members -> how each member stands to it."""

    def relate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, least = _Words(), (1 - threshold) / (1 + threshold)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.role == 0:
                    known, held, hub, n, width = np.frombuffer(row.known, np.uint64), np.frombuffer(row.held, np.uint8).astype(np.int64), np.frombuffer(row.hub, np.uint64), int(row.n), row.width
                    continue
                x = features(row.text, words)
                delta = differences(x, known, held, n)
                common = len(np.intersect1d(x, hub, assume_unique=True))
                out.append((row.grp, row.p, row.id, len(x), len(delta) - least * len(x), width, bool(similar(common, len(x), len(hub), threshold)), delta.tobytes()))
            names, types = ["grp", "p", "id", "size", "r", "width", "linked", "delta"], ["int64", "int64", "int64", "int64", "float64", "float64", "bool", object]
            yield pd.DataFrame({k: pd.Series([x[n] for x in out], dtype=t) for n, (k, t) in enumerate(zip(names, types, strict=True))})
            del batch, out
            release()

    return relate


def prefixes(size: int, r: float, n_delta: int, width: float, least_r: float, threshold: float) -> list[tuple[int, int, int]]:
    """(level of the larger r, level of the smaller r, length of the prefix) of every meeting place of a member.

    least_r is the least r of the group; two members with r <= -least_r need not meet, as both are linked to the centre.
    """
    share, bar = (1 - threshold) / (1 + threshold), -least_r
    own, outside = math.floor(r / width), r > bar + 1e-9
    found = []

    def add(larger: int, smaller: int, other: float) -> None:
        needed = max(1, math.ceil((r + other) / 2 - 1e-9))
        if n_delta >= needed:
            found.append((larger, smaller, n_delta - needed + 1))

    # As the one with the smaller r: the other's is at most |D| + share * size here, or they have too little to share.
    for level in range(max(own, math.floor(bar / width)), math.floor((n_delta + share * size + 1e-9) / width) + 1):
        add(level, own, max(level * width, least_r if outside and level == own else bar))
    # As the one with the larger r: the other is at most 1 / threshold times as large.
    if outside:
        for level in range(math.floor((r - 2 * share * size / threshold - 1e-9) / width), own):
            if (level + 1) * width >= least_r:
                add(own, level, max(level * width, least_r))
    return found


def _met(threshold: float):
    """Members with their differences -> (bucket, parent, id, size, rank) of their meeting places; hubs meet no one any more."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                delta, group = np.frombuffer(row.delta, np.uint64), np.array([row.grp], np.int64).view(np.uint64)
                places = prefixes(row.size, row.r, len(delta), row.width, row.least_r, threshold)
                keys = [mix(delta[:n] ^ mix(mix(group + seed_of(larger & 0xFFFFFFFF)) + seed_of(smaller & 0xFFFFFFFF))) for larger, smaller, n in places]
                found = np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)
                yield pd.DataFrame({"bucket": found, "parent": np.int64(row.grp), "id": np.int64(row.id), "size": np.int64(row.size), "rank": float(row.r)})

    return meet


def _hubs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of (bucket, rank, id) -> (parent, p, id, size, rank) where a bucket has two members or more; p is the first of them."""
    last = None  # bucket, rows seen of it, its hub's id, size and rank
    for batch in batches:
        bucket, parent, ids, size, rank = (batch[c].to_numpy() for c in ("bucket", "parent", "id", "size", "rank"))
        at = np.maximum.accumulate(np.where(np.r_[True, bucket[1:] != bucket[:-1]], np.arange(len(bucket)), 0))
        nth, hub, hub_size, hub_rank = np.arange(len(bucket)) - at, ids[at], size[at], rank[at]
        if last is not None and bucket[0] == last[0]:
            goes_on = at == 0
            nth = np.where(goes_on, nth + last[1], nth)
            hub, hub_size, hub_rank = (np.where(goes_on, old, new) for old, new in zip(last[2:], (hub, hub_size, hub_rank), strict=True))
        last = (bucket[-1], nth[-1] + 1, hub[-1], hub_size[-1], hub_rank[-1])
        others, second = nth > 0, nth == 1
        out = {"parent": parent, "p": hub, "id": ids, "size": size, "rank": rank}, {"parent": parent, "p": hub, "id": hub, "size": hub_size, "rank": hub_rank}
        yield pd.concat([pd.DataFrame(out[0])[others], pd.DataFrame(out[1])[second]]).drop_duplicates()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, class_id) for each distinct doc_id; class_id is the smallest doc_id of its component."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = written(docs.groupBy("doc_id").agg(F.min("text").alias("text")))
    worded = F.coalesce("text", F.lit("")).rlike("[^ \\t-\\r]")
    named = written(docs.select("doc_id", F.when(worded, F.unhex(F.md5("text"))).alias("copy")))
    first = named.where("copy is not null").groupBy("copy").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    several = written(first.where("n > 1").select("copy", "id"))  # equal texts share the smallest doc_id
    ids = joined(named, several, ["copy"], "left", several.count()).select("doc_id", F.coalesce("id", "doc_id").alias("id"))
    ids = written(ids)
    copies = written(ids.where("doc_id <> id").select("doc_id"))
    texts = written(joined(docs.where(worded), copies, ["doc_id"], "left_anti", copies.count()).select(F.col("doc_id").alias("id"), "text"))
    parts = written(components(links(texts, threshold)))
    return joined(ids, parts, ["id"], "left", parts.count()).select("doc_id", F.coalesce("component", "id").alias("class_id"))


def links(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """texts(id long, text), ids and texts distinct -> (a, b) whose multiset overlap is threshold or more, enough to connect every linked pair of bucket mates."""
    keys = written(texts.mapInPandas(_signed, "id long, size long, keys array<long>"))
    rows = keys.select("id", "size", F.explode("keys").alias("bucket"))
    shared = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = written(joined(rows, shared, ["bucket"], "inner", shared.count()))
    met = buckets.groupBy("id").agg((-F.sum("n")).cast("double").alias("rank"))
    buckets = buckets.join(met, "id")
    hubs = buckets.groupBy("bucket").agg(F.min(F.struct("rank", "id"))["id"].alias("p"))
    members = buckets.join(hubs, "bucket").select(F.lit(0).cast("long").alias("parent"), "p", "id", "size", "rank")
    found = []
    while True:  # each group is a part of the one it comes from, without its hub, so this ends
        members = written(members.distinct().select(F.xxhash64("parent", "p").alias("grp"), "p", "id", "size", "rank"))
        groups = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
        large = written(groups.where((F.col("n") > GROUP) | (F.col("total") > GROUP_SHINGLES)).select("grp", "n"))
        n_large = large.count()
        small = written(joined(members, large, ["grp"], "left_anti", n_large).select("grp", "id"))
        held = joined(texts, small, ["id"], "inner", small.count()).select("grp", "id", "text")
        found.append(written(held.repartition("grp").sortWithinPartitions("grp", "id").mapInPandas(_resolved(threshold), "a long, b long")))
        if not n_large:
            break
        related = written(_related(joined(members, large, ["grp"], "inner", n_large), texts, threshold))
        ends = related.groupBy("grp").agg(F.min(F.struct("r", "id")).alias("low"), F.max("r").alias("most"))
        ends = written(ends.select("grp", F.col("low.r").alias("least_r"), F.col("low.id").alias("centre"), "most"))
        related = joined(related, ends, ["grp"], "inner", n_large)
        found.append(written(related.where("linked and id <> p").select(F.col("p").alias("a"), F.col("id").alias("b"))))
        found.append(written(related.where("r + least_r <= 1e-9 and id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))))
        # Groups whose members are all linked to the centre are done. Even shares, as some have far more places than others.
        places = related.where("most + least_r > 1e-9 and id <> p").repartition(max(16, 2 * texts.sparkSession.sparkContext.defaultParallelism))
        places = places.select("grp", "id", "size", "r", "width", "least_r", "delta").mapInPandas(_met(threshold), _PLACE)
        # A bucket's rows stream by in order, so that even a frequent difference takes no memory.
        members = written(places).repartition("bucket").sortWithinPartitions("bucket", "rank", "id").mapInPandas(_hubs, "parent long, p long, id long, size long, rank double")
    return functools.reduce(DataFrame.union, found)


_PLACE = "bucket long, parent long, id long, size long, rank double"


def _related(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(grp, p, id, size, r, width, linked, delta) of the members (grp, p, id, size, rank, n) of large groups."""
    nth = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("id") != F.col("p"), "rank", "id"))
    members = written(members)
    chosen = written(members.withColumn("nth", nth).where(F.col("nth") <= COMPANIONS).select("grp", "id", "nth"))
    read = joined(texts, chosen, ["id"], "inner", chosen.count()).select("grp", "nth", "text")
    references = written(read.repartition("grp").sortWithinPartitions("grp", "nth").mapInPandas(_references(threshold), _REFERENCE))
    salts = F.ceil(F.col("members") / COHORT).cast("int")
    counted = members.groupBy("grp").agg(F.first("n").alias("members"))
    sent = references.join(counted, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("members")
    rows = joined(texts, members, ["id"], "inner", members.count())
    rows = rows.select("grp", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / COHORT)).cast("int").alias("salt"), F.lit(1).alias("role"), "p", "id", "text")
    both = rows.unionByName(sent.withColumn("role", F.lit(0)), allowMissingColumns=True)
    ordered = both.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "role", "id")
    return ordered.mapInPandas(_relative(threshold), "grp long, p long, id long, size long, r double, width double, linked boolean, delta binary")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose doc_id stands for its class; rows without a doc_id stay, and of rows with equal doc_id and text one stays."""
    kept = written(classes(docs, threshold).where("doc_id = class_id").select(F.col("doc_id").alias("key")))
    n_kept = kept.count()
    named = joined(as_rows(docs, key=F.col("doc_id").cast("long")), kept, ["key"], "left_semi", n_kept).select(*fields(docs))
    if n_kept != named.count():
        named = named.dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))
