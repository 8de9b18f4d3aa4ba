"""Byte-level BPE encoding and decoding.

Distinct words are encoded by Spark's higher-order functions: a fold over a word's
bytes joins, round by round, the neighbours of the lowest rank, and looks ranks up in
a literal rank map. Decoding concatenates the binary pieces of the ids, of all ids of a document, however they were found.

All words of the corpus are counted, from the parts between spaces that Spark counts; the
max_known most frequent, at most, are folded once and become a dictionary of bounded size,
which goes to every task. A document is its known words' ids, joined as it is split, with
gaps for its other words. Of these, most are made of neighbouring ids that folded words hold
as well, and so have the ids that a fold would give them (see Joined); the rest are encoded
by the same fold in the document's own row. So no document is shuffled, and what goes to the
tasks does not grow with the corpus. A fold copies its array at every merge;
words of more than LONG_WORD bytes, for which this would cost the square of their length,
are merged by a heap instead as their document is split.

Defined results: a null text is an empty one, with no ids; repeated rows and further
columns are harmless; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import heapq
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UNUSUAL, cut_at_spaces, release, word_splitter, written
from .native import let

#: The dictionary of folded words holds at most so many.
MAX_KNOWN = 600_000
#: Documents in a frame that goes back to the JVM.
ROWS_AT_ONCE = 250
#: A task sends its counts on when it holds so many words.
COUNTED_WORDS = 250_000
#: Words of more bytes are merged by a heap.
LONG_WORD = 2000
#: A task keeps so many parts of texts, twice at most, with what they encode to.
KEPT_PARTS = 100_000
#: Buckets and places of the perfect hash of pairs; places are a prime number.
_BUCKETS, _PLACES = 32_749, 131_071
_NONE = 1 << 20
#: Marks that end many words and are words of their own after letters.
_MARKS = frozenset(".,;:!?")


def _hashed(a: int, b: int) -> int:
    """xxhash64(a, b) of two longs as Spark computes it."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", a), 42)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", b), first)))[0]


def _pieces(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Ranks:
    """What a rank file says: ranks of pairs of ids, ids of single bytes, pieces of ids.

    A pair's rank is the rank of its bytes; only parts that are pieces themselves ever meet.
    """

    def __init__(self, rank_file: str) -> None:
        ranks = _pieces(rank_file)
        self.bits = max(ranks.values()).bit_length()
        keys: dict[int, list[tuple[int, int]]] = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    h = _hashed(a, b)
                    keys.setdefault(h % _BUCKETS, []).append((h >> 20, (a << self.bits | b) << self.bits | rank))
        if sum(map(len, keys.values())) > 0.9 * _PLACES:
            raise ValueError("too many pairs for the hash's places")
        self.masks, self.pairs = [0] * _BUCKETS, [-1] * _PLACES
        for bucket in sorted(keys, key=lambda k: -len(keys[k])):  # large buckets first, each with the first mask by which its keys find free places
            turn = 0
            while True:
                mask = _hashed(bucket, turn)
                at = [(h ^ mask) % _PLACES for h, _ in keys[bucket]]
                if len(set(at)) == len(at) and all(self.pairs[x] < 0 for x in at):
                    break
                turn += 1
            self.masks[bucket] = mask
            for x, (_, entry) in zip(at, keys[bucket], strict=True):
                self.pairs[x] = entry
        self.bytes = [ranks[bytes([k])] for k in range(256)]
        self.firsts = [ranks.get(bytes([a, b]), _NONE) for a in range(256) for b in range(256)]
        self.codes = [k.to_bytes(4, "little") for k in range(max(ranks.values()) + 1)]
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece


@functools.cache
def _ranks(rank_file: str) -> Ranks:
    return Ranks(rank_file)


class Fold:
    """Encoding and decoding as columns over the tables of a rank file, which a plan holds as the literal value of a subquery."""

    def __init__(self, spark: SparkSession, rank_file: str) -> None:
        r = _ranks(rank_file)
        self.bits = r.bits
        row = [(r.masks, r.pairs, r.bytes, r.firsts, r.codes, r.pieces)]
        held = written(spark.createDataFrame(row, "masks array<bigint>, pairs array<bigint>, bytes array<bigint>, firsts array<bigint>, codes array<binary>, pieces array<binary>"))
        self.tables = held.select(F.struct(*held.columns)).scalar()

    def rank(self, tables: Column, a: Column, b: Column) -> Column:
        """The rank of two neighbouring ids, or _NONE."""

        def entry(h: Column) -> Column:
            mask = F.get(tables["masks"], F.pmod(h, F.lit(_BUCKETS).cast("long")).cast("int"))
            return F.get(tables["pairs"], F.pmod(F.shiftright(h, 20).bitwiseXOR(mask), F.lit(_PLACES).cast("long")).cast("int"))

        found = let(F.xxhash64(a, b), entry)
        key = F.shiftleft(a, self.bits).bitwiseOR(b)
        return let(found, lambda e: F.when(F.shiftright(e, self.bits) == key, e.bitwiseAND(F.lit((1 << self.bits) - 1).cast("long"))).otherwise(F.lit(_NONE).cast("long")))

    def ids(self, tables: Column, word: Column) -> Column:
        """The ids of a word given as an array of its bytes: array<int>.

        The state is an array of the parts: rank of joining a part with the next, where the part begins, its id,
        packed in one long, so that the smallest is the leftmost pair of the lowest rank. Each turn joins that
        pair; the copying makes a word's cost grow with the square of its bytes.
        """

        def part(rank: Column, begin: Column, token: Column) -> Column:
            return F.shiftleft(rank, 40).bitwiseOR(F.shiftleft(begin.cast("long"), 17)).bitwiseOR(token)

        def token(x: Column) -> Column:
            return x.bitwiseAND(F.lit((1 << 17) - 1).cast("long"))

        first = F.transform(
            word, lambda x, k: part(F.coalesce(F.get(tables["firsts"], x.cast("int") * 256 + F.get(word, k + 1)), F.lit(_NONE).cast("long")), k, F.get(tables["bytes"], x.cast("int")))
        )

        def turn(state: Column, _: Column) -> Column:
            def joined(low: Column, k: Column) -> Column:  # counted from 1: parts k and k + 1 become one
                new = F.shiftright(low, 40)
                where = low.bitwiseAND(((1 << 40) - 1) ^ ((1 << 17) - 1))
                after = F.shiftleft(F.coalesce(self.rank(tables, new, token(F.get(state, k + 1))), F.lit(_NONE).cast("long")), 40).bitwiseOR(where).bitwiseOR(new)
                before = let(
                    F.get(state, k - 2),
                    lambda x: F.shiftleft(self.rank(tables, token(x), new), 40).bitwiseOR(x.bitwiseAND((1 << 40) - 1)),
                )
                rest = F.slice(state, k + 2, F.size(state) - k - 1)
                return F.when(k > 1, F.concat(F.slice(state, F.lit(1), k - 2), F.array(before, after), rest)).otherwise(F.concat(F.array(after), rest))

            return let(F.array_min(state), lambda low: F.when(low >= _NONE << 40, state).otherwise(let(F.array_position(state, low).cast("int"), lambda k: joined(low, k))))

        return F.aggregate(F.sequence(F.lit(2), F.size(word)), first, turn, lambda state: F.transform(state, lambda x: token(x).cast("int")))

    def encoded(self, codes: Column, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit numbers; strings hold any bytes as they are joined."""
        return F.array_join(F.transform(ids, lambda i: F.get(codes, i).cast("string")), "")

    def decoded(self, pieces: Column, ids: Column) -> Column:
        """The concatenated pieces of ids."""
        return F.array_join(F.transform(ids, lambda i: F.get(pieces, i).cast("string")), "")

    def both(self, rows: DataFrame, words: Column) -> DataFrame:
        """rows with folded, the ids and bytes, as strings of any bytes, of each of an array of words as byte arrays.

        The tables' column is named once, so the optimizer puts the subquery's value in its place: no row carries it.
        """

        def one(tables: Column, word: Column) -> Column:
            return let(self.ids(tables, word), lambda ids: F.struct(self.encoded(tables["codes"], ids).alias("ids"), self.decoded(tables["pieces"], ids).alias("bytes")))

        return rows.withColumn("_tables", self.tables).select("*", let(F.col("_tables"), lambda tables: F.transform(words, lambda word: one(tables, word))).alias("folded")).drop("_tables")


def _words_of_part(split):
    """split(" " + part) for a part of a text after a space: letters alone, or before one mark, need no search by the pattern that cut_at_spaces allows."""

    def plain(letters: str) -> bool:
        return letters.isalpha() and (letters.isascii() or not UNUSUAL.search(letters))

    def words(part: str) -> tuple[str, ...]:
        if plain(part):
            return (" " + part,)
        if part[-1:] in _MARKS and plain(part[:-1]):
            return " " + part[:-1], part[-1]
        return tuple(split(" " + part))

    return words


def _parts_of(docs: DataFrame, pattern: str) -> DataFrame:
    """(led, part, n): the distinct parts of texts between spaces, with a space before them or not; whole texts if the pattern allows no cuts."""
    if not cut_at_spaces(pattern):
        return docs.select(F.lit(False).alias("led"), F.col("text").alias("part"), F.lit(1).cast("long").alias("n")).where("part is not null")
    parts = docs.select(F.posexplode(F.split("text", " ")).alias("k", "part"))
    return parts.groupBy((F.col("k") > 0).alias("led"), "part").agg(F.count("*").alias("n"))


def _counted(pattern: str):
    """(led, part, n) -> occurrences of the words of parts; a word may come in several rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = word_splitter(pattern), Counter()
        words_of = _words_of_part(split)

        def flush() -> pa.RecordBatch:
            short = {w: n for w, n in held.items() if len(w) <= LONG_WORD // 4}  # so many characters never make a long word
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(short), pa.string()), pa.array(list(short.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for led, part, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word in words_of(part) if led else split(part):
                    held[word] += n
            if len(held) >= COUNTED_WORDS:
                yield flush()
        yield flush()

    return count


def known_words(docs: DataFrame, rank_file: str, pattern: str, max_known: int = MAX_KNOWN) -> tuple[DataFrame, Fold]:
    """(word, ids) of the words that are so frequent that at most max_known are as frequent."""
    counts = written(_parts_of(docs, pattern).mapInArrow(_counted(pattern), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # How many words occur n times, up to a bound; beyond it the share of all occurrences bounds their number.
    top = 10_000
    rows = counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("words"), F.sum("n").alias("total")).orderBy(F.desc("n")).collect()
    bar, seen, total = None, 0, sum(r["total"] for r in rows)
    for r in rows:
        seen += r["words"]
        if seen > max_known:
            break
        bar = r["n"]
    bar = bar if bar is not None else max(top, -(-total // max_known))
    fold = Fold(docs.sparkSession, rank_file)
    chosen = counts.where(F.col("n") >= bar).select("word").repartition(F.col("word")).mapInArrow(_with_bytes, "word string, codes array<smallint>")
    return fold.both(chosen, F.array("codes")).select("word", F.col("folded")[0]["ids"].cast("binary").alias("ids")), fold


def _code_lists(words: list[bytes]) -> pa.ListArray:
    """Words as lists of their bytes."""
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int16)))


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _code_lists([w.encode() for w in batch.column(0).to_pylist()])], ["word", "codes"])


@functools.cache
def _held_pieces(rank_file: str) -> dict[bytes, int]:
    """A rank file's table, once for each worker process."""
    return _pieces(rank_file)


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length: the leftmost pair of the lowest rank first, in a heap, over a linked list of parts."""
    n = len(word)
    after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap = [(rank, k, 2) for k in range(n - 1) if (rank := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k, length = heapq.heappop(heap)
        other = after[k]
        if not size[k] or other >= n or size[k] + size[other] != length:
            continue  # one of the two has been merged since
        size[k], size[other], after[k] = length, 0, after[other]
        if after[k] < n:
            before[after[k]] = k
        for x in (before[k], k):
            if x >= 0 and after[x] < n:
                whole = size[x] + size[after[x]]
                if (rank := ranks.get(word[x : x + whole])) is not None:
                    heapq.heappush(heap, (rank, x, whole))
    return [ranks[word[k : k + size[k]]] for k in range(n) if size[k]]


class Joined:
    """Ids of words whose neighbouring ids all stand together in folded words as well.

    Tokens are what a fold makes of their joined bytes if and only if it makes each neighbouring two of them from the
    bytes of these two: until a merge passes a border for the first time, both sides are merged as they would be alone,
    so that merge happens with these two alone as well, or never. So a word has one such row of tokens at most, and the
    first that is found is the fold's.
    """

    def __init__(self, ids: list[bytes], rank_file: str) -> None:
        """ids: those of folded words, as little-endian unsigned 32-bit numbers; no word is empty."""
        tokens = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        begins = np.zeros(len(tokens), bool)
        begins[np.cumsum(sizes) - sizes] = True
        before = np.concatenate([[0], tokens])[:-1]
        pieces = {rank: piece for piece, rank in _held_pieces(rank_file).items()}
        after: dict[int, dict[bytes, int]] = {token: {} for token in np.unique(tokens).tolist()}
        for pair in np.unique((before << 32 | tokens)[~begins]).tolist():
            after[pair >> 32][pieces[pair & 0xFFFFFFFF]] = pair & 0xFFFFFFFF
        #: id -> lengths of the pieces that stand after it, longest first, and their ids
        self._after = {token: (self._lengths(found), found) for token, found in after.items()}
        #: what a word begins with: the pieces of all ids seen, by their first three bytes
        firsts: dict[bytes, dict[bytes, int]] = {}
        for token in after:
            firsts.setdefault(pieces[token][:3], {})[pieces[token]] = token
        for start, found in firsts.items():
            found.update({start[:k]: firsts[start[:k]][start[:k]] for k in (1, 2) if k < len(start) and start[:k] in firsts})
        self._firsts = {start: (self._lengths(found), found) for start, found in firsts.items()}

    @staticmethod
    def _lengths(pieces: dict[bytes, int]) -> tuple[int, ...]:
        return tuple(sorted(set(map(len, pieces)), reverse=True))

    def ids(self, word: bytes) -> list[int] | None:
        """The word's ids, or None if the folded words do not tell."""
        n, after, firsts = len(word), self._after, self._firsts
        start = firsts.get(word[:3]) or firsts.get(word[:2]) or firsts.get(word[:1])
        if start is None:
            return None
        lengths, pieces = start
        tries, path, begin, dead = iter(lengths), [], 0, set()
        above = []  # for each piece of the path: where it begins, what may stand there and the lengths still to be tried
        while True:
            for length in tries:
                end = begin + length
                if end <= n and (token := pieces.get(word[begin:end])) is not None and not (dead and (token, end) in dead):
                    path.append(token)
                    if end == n:
                        return path
                    above.append((begin, pieces, tries))
                    begin, (lengths, pieces) = end, after[token]
                    tries = iter(lengths)
                    break
            else:  # nothing goes on from here
                if not path:
                    return None
                dead.add((path.pop(), begin))
                begin, pieces, tries = above.pop()


_HELD: dict = {}


def _lookup(sent, rank_file: str, pattern: str) -> _Parts:
    """The dictionary of a broadcast and what its words tell, built once for each worker process."""
    value = sent.value
    if _HELD.get("of") is not value:
        _HELD.clear()
        _HELD.update(of=value, parts=_Parts(pa.ipc.open_stream(value).read_all(), rank_file, pattern))
    return _HELD["parts"]


def _sent(known: DataFrame):
    table = known.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return known.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


_SPLIT = "doc_id long, ids array<binary>, bytes array<binary>, other array<array<smallint>>"


class _Parts(dict):
    """Part of a text after a space -> its ids if they are known, else a tuple of its words; None if it must not be split alone.

    Known words after a space are always held; of other parts the last ones met, between KEPT_PARTS and twice as many.
    """

    def __init__(self, known: pa.Table, rank_file: str, pattern: str) -> None:
        words, ids = (known.column(c).to_pylist() for c in ("word", "ids"))
        super().__init__((w[1:], x) for w, x in zip(words, ids, strict=True) if w[0] == " " and w[1:2].strip())
        self._others = {w: x for w, x in zip(words, ids, strict=True) if w[0] != " " or not w[1:2].strip()}
        ranks = _held_pieces(rank_file)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self._pieces = pa.array(pieces, pa.binary())
        self.split, self._rank_file, self._joined = word_splitter(pattern), rank_file, Joined(ids, rank_file)
        self._words, self._new, self._old = _words_of_part(self.split), [], []

    def code(self, word: str) -> bytes | None:
        """A word's ids if they are known, else None; those of long words are merged here."""
        found = self._others.get(word)
        if found is None and word[0] == " ":
            found = self.get(word[1:])
        if found.__class__ is bytes:
            return found
        if found is not None:
            return None
        raw = word.encode()
        ids = merged_by_heap(raw, _held_pieces(self._rank_file)) if len(raw) > LONG_WORD else self._joined.ids(raw)
        return ids and struct.pack(f"<{len(ids)}I", *ids)

    def decoded(self, ids: list[bytes]) -> pa.Array:
        """The concatenated pieces of each list of ids."""
        ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
        if not ends[-1]:
            return pa.array([b""] * len(ids), pa.binary())
        _, offsets, values = self._pieces.take(pa.array(np.frombuffer(b"".join(ids), "<u4"))).buffers()
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.frombuffer(offsets, np.int32)[ends]), values])

    def __missing__(self, part: str) -> bytes | tuple | None:
        if not part or part[0].isspace():
            return None
        words = self._words(part)
        got = [self.code(w) for w in words]
        value = words if None in got else b"".join(got)
        if len(part) <= LONG_WORD // 4:  # longer ones seldom come again
            if len(self._new) >= KEPT_PARTS:
                for old in self._old:
                    del self[old]
                self._old, self._new = self._new, []
            self._new.append(part)
            self[part] = value
        return value


def _split_up(sent, rank_file: str, pattern: str):
    """(doc_id, text) -> runs of known words' ids and what they decode to, one more than there are other words."""

    def lists(ends: list[int], values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    def split_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _lookup(sent, rank_file, pattern)
        split, cut = held.split, cut_at_spaces(pattern)

        def laid_out(text: str | None) -> list:
            """The parts of a text between spaces, or a text in one part, each as its ids or its words."""
            if text and cut:
                parts = text.split(" ")
                got = list(map(held.__getitem__, parts))
                got[0] = tuple(split(parts[0]))
                if None not in got:
                    return got
            return [tuple(split(text)) if text else b""]

        def framed(rows: pa.RecordBatch) -> pa.RecordBatch:
            ids, run_ends, rare, rare_ends = [], [0], [], [0]
            for text in rows.column(1).to_pylist():
                got = laid_out(text)
                run, begin = [], 0
                for k in [k for k, x in enumerate(got) if x.__class__ is tuple]:
                    run += got[begin:k]
                    begin = k + 1
                    for word in got[k]:
                        ids_of = held.code(word)
                        if ids_of is not None:
                            run.append(ids_of)
                            continue
                        ids.append(b"".join(run))
                        rare.append(word.encode())
                        run = []
                ids.append(b"".join(run + got[begin:]))
                run_ends.append(len(ids))
                rare_ends.append(len(rare))
            columns = [rows.column(0), lists(run_ends, pa.array(ids, pa.binary())), lists(run_ends, held.decoded(ids)), lists(rare_ends, _code_lists(rare))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "bytes", "other"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):  # small frames: what a worker holds stays small
                yield framed(batch.slice(at, ROWS_AT_ONCE))
            del batch
            release()

    return split_up


def encode(docs: DataFrame, rank_file: str, pattern: str, max_known: int = MAX_KNOWN) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary) for each row."""
    known, fold = known_words(docs, rank_file, pattern, max_known)
    sent = _sent(known)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_split_up(sent, rank_file, pattern), _SPLIT)

    def whole(runs: str, part: str) -> Column:
        ends = F.transform(F.col(runs), lambda x, k: F.concat(x.cast("string"), F.coalesce(F.get("folded", k)[part], F.lit(""))))
        return F.array_join(ends, "").cast("binary")

    folded = fold.both(rows, F.col("other"))
    return folded.select("doc_id", whole("ids", "ids").alias("ids"), whole("bytes", "bytes").alias("decoded"))


def digests(docs: DataFrame, rank_file: str, pattern: str, max_known: int = MAX_KNOWN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, as a written table: so batches for Python are small."""
    rows = encode(docs, rank_file, pattern, max_known)
    return written(rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")))
