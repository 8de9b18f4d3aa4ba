"""Evidence search for a whole table of requests at once: evidence and requests meet in blocks of bounded size.

The index holds a row for each piece of evidence, with its distinct words. A scope's evidence is dealt into blocks of so
many words, each piece to one block; its requests go to each of its blocks. One task takes a block's evidence first and
lays out the words' lists; then the requests pass by, and each counts its words over their lists. A block gives one row with the best
of a request, so what is merged grows with requests and blocks, never with the pairs that share a word. Every request is
counted against all evidence of its scopes. Copies of requests for all blocks would outgrow the tables, so requests go in
rounds whose copies hold no more words than the evidence; a round's shuffle files go when its hits are stored. So disk grows
with the tables, time with requests times evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import scratch
from .evidence import strength_rank

NO_EVIDENCE = "NO_EVIDENCE_FOUND"
#: What the words of a request weigh beside its entities; fewer hits than this are none.
LEXICAL_WEIGHT, MIN_SCORE, LIMIT = 0.4, 0.01, 25
#: Words of evidence in a block, requests that are answered at once: what a task holds.
BLOCK_WORDS, PART_REQUESTS = 8_000_000, 50_000
#: A scope's evidence makes so many blocks, if they have this share of a block's words each, so that tasks share it.
SPREAD, LEAST_SHARE = 8, 16
#: Words in the copies of requests that any round may hold, however little evidence there is.
ROUND_WORDS = 100_000_000
#: Words that a share of a block's evidence holds are counted by a byte for each piece of it: 8 bytes at most for each of its words.
FREQUENT = 8


def postings(evidence: DataFrame) -> DataFrame:
    """evidence(evidence_id, scope_type, scope_id, text, strength?) -> (scope, evidence_id, rank, words, size): each piece of evidence with each of its words once.

    Evidence without a text, or one without a scope, is found by no request.
    """
    rank = strength_rank(F.col("strength")) if "strength" in evidence.columns else F.lit(9)
    rows = evidence.where("scope_type is not null and scope_id is not null and text is not null")
    rows = rows.select(F.concat_ws(":", "scope_type", "scope_id").alias("scope"), "evidence_id", rank.cast("int").alias("rank"), T.query_tokens(F.col("text")).alias("words"))
    return rows.withColumn("size", F.size("words"))


def wanted_words(requests: DataFrame) -> DataFrame:
    """requests(request_id, scope_type, scope_id, query) -> (scope, request_id, words): each in its own scope and the global one."""
    own = F.concat_ws(":", "scope_type", "scope_id")
    rows = requests.where("query is not null").select("request_id", F.array_distinct(F.array(own, F.lit("GLOBAL:GLOBAL"))).alias("scopes"), T.query_tokens(F.col("query")).alias("words"))
    return rows.select(F.explode("scopes").alias("scope"), "request_id", "words")


def _stored(rows: DataFrame) -> DataFrame:
    """rows, written once; the shuffle files of what made them are removed when they are."""
    spark, at, cleanup = rows.sparkSession, scratch(rows.sparkSession), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        rows.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(cleanup, before) if before is not None else spark.conf.unset(cleanup)
    return spark.read.schema(rows.schema).parquet(at)


class _Block:
    """The evidence of a block in its order, and for each word where it occurs."""

    def __init__(self) -> None:
        self.rows, self.n, self._codes, self._vocabulary = [], 0, [], {}
        self._sizes: list[np.ndarray] = []

    def add(self, rows: pa.RecordBatch, words: pa.Array) -> None:
        """More evidence; words: those of each, joined by spaces."""
        lists = pc.split_pattern(words, " ")
        held = lists.flatten().dictionary_encode()
        codes = np.array([self._vocabulary.setdefault(w, len(self._vocabulary)) for w in held.dictionary.to_pylist()], np.int32)
        self._codes.append(codes[held.indices.to_numpy(zero_copy_only=False)])
        self._sizes.append(lists.value_lengths().to_numpy(zero_copy_only=False))
        self.rows.append(rows)
        self.n += rows.num_rows

    def lay_out(self) -> None:
        codes, sizes = np.concatenate(self._codes), np.concatenate(self._sizes)
        self._codes, self._sizes = [], []
        lengths = np.bincount(codes, minlength=len(self._vocabulary))
        self._ends = np.concatenate([[0], np.cumsum(lengths)])
        self._found = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[np.argsort(codes, kind="stable")]  # each word's list, one after another
        self._rows_of = {}
        for x in np.flatnonzero(lengths * FREQUENT > self.n).tolist():
            self._rows_of[x] = np.zeros(self.n, np.uint8)
            self._rows_of[x][self._found[self._ends[x] : self._ends[x + 1]]] = 1

    def best(self, words: list[str], limit: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The places of the evidence with the most of some words, the first ones of equal ones, and how many words."""
        known = [x for x in map(self._vocabulary.get, words) if x is not None]
        if not known:
            return None
        n, rare = np.zeros(self.n, np.int32), []
        for x in known:
            if x in self._rows_of:
                n += self._rows_of[x]
            else:
                rare.append(self._found[self._ends[x] : self._ends[x + 1]])
        if rare:
            n += np.bincount(np.concatenate(rare), minlength=self.n).astype(np.int32)
        reached = np.cumsum(np.bincount(n)[:0:-1])  # how much evidence has so many words or more, the most first
        least = len(reached) - min(int(np.searchsorted(reached, limit)), len(reached) - 1)
        hits = np.flatnonzero(n >= least)
        hits = hits[np.argsort(-n[hits], kind="stable")[:limit]]
        return hits, n[hits]


def _best_of_blocks(limit: int, at_once: int):
    """Rows in the order of blocks, in each evidence by (rank, id) before requests -> a row for each request and block that has hits for it."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, block, laid_out = None, None, False

        def answered(asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            who, size, where, words, ends = [], [], [], [], [0]
            for k, query in enumerate(asked.column("words").to_pylist()):
                wanted = query.split(" ") if query else []
                found = block.best(wanted, limit)
                if found is not None:
                    who.append(k), size.append(len(wanted)), where.append(found[0]), words.append(found[1]), ends.append(ends[-1] + len(found[0]))
            if who:
                rows, offsets = held.take(pa.array(np.concatenate(where))).combine_chunks(), pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(np.concatenate(words), pa.int32()), rows.column("rank").combine_chunks(), rows.column("evidence_id").combine_chunks())]
                yield pa.RecordBatch.from_arrays([asked.column("request_id").take(pa.array(who)), pa.array(size, pa.int32()), *lists], ["request_id", "size", "n", "rank", "evidence_id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows - 1, bool)
            for c in ("scope", "block", "asked"):
                column = batch.column(c)
                changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                run = batch.slice(begin, end - begin)
                name = (run.column("scope")[0].as_py(), run.column("block")[0].as_py())
                if name != of:
                    of, block, laid_out = name, _Block(), False
                if not run.column("asked")[0].as_py():
                    block.add(run.select(["evidence_id", "rank"]), run.column("words"))
                elif block.n:
                    if not laid_out:
                        block.lay_out()
                        held, laid_out = pa.Table.from_batches(block.rows), True
                    for k in range(0, run.num_rows, at_once):
                        yield from answered(run.slice(k, at_once))

    return best


def search(index: DataFrame, requests: DataFrame, limit: int = LIMIT, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS, part_requests: int = PART_REQUESTS, round_words: int = ROUND_WORDS) -> DataFrame:
    """index of postings(), requests(request_id, scope_type, scope_id, query) -> request_id, kind, evidence_id, score, place.

    kind is HIT, or NO_EVIDENCE_FOUND in the one row of a request without hits: an absence, not a finding that something
    is false. The order of hits is total: words down, strength, id. A request without words of three letters finds nothing.
    """
    # A word holds no space; one text is a fraction of an array's bytes.
    wanted = _stored(wanted_words(requests).where(F.size("words") > 0).withColumns({"size": F.size("words"), "words": F.array_join("words", " ")}))
    words = F.sum("size")
    share = F.greatest(F.least(words / SPREAD, F.lit(block_words)), F.lit(block_words / LEAST_SHARE))
    asked = wanted.groupBy("scope").agg(words.alias("asked"))
    # A row for each scope; stored, so that joins know its size.
    shape = _stored(index.groupBy("scope").agg(F.ceil(words / share).cast("int").alias("blocks"), words.alias("held")).where("blocks > 0").join(asked, "scope"))
    n_blocks, held, copies = shape.agg(F.sum("blocks"), F.sum("held"), F.sum(F.col("asked") * F.col("blocks"))).first()
    rounds = -(-(copies or 0) // max(held or 0, round_words)) or 1
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    none = lambda df, c: F.lit(None).cast(kind(df, c)).alias(c)
    evidence = index.where("size > 0").join(shape, "scope").select("scope", F.pmod(F.xxhash64("evidence_id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asked"), "rank", "evidence_id", none(requests, "request_id"), F.array_join("words", " ").alias("words"))

    def of_round(k: int) -> DataFrame:
        """The hits of every request whose id falls to a round."""
        asking = wanted.where(F.pmod(F.xxhash64("request_id"), F.lit(rounds).cast("long")) == k).join(shape.select("scope", "blocks"), "scope")
        asking = asking.select("scope", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asked"), F.lit(None).cast("int").alias("rank"), none(index, "evidence_id"), "request_id", "words")
        # Several times as many tasks as blocks, so that few have two.
        dealt = evidence.unionByName(asking).repartition(min(4 * (n_blocks or 1), 4000), "scope", "block").sortWithinPartitions("scope", "block", "asked", "rank", "evidence_id")
        near = dealt.mapInArrow(_best_of_blocks(limit, part_requests), f"request_id {kind(requests, 'request_id')}, size int, n array<int>, rank array<int>, evidence_id array<{kind(index, 'evidence_id')}>")
        # A request has a row for each block that it met.
        lists = near.groupBy("request_id").agg(F.collect_list(F.struct("size", "n", "rank", "evidence_id")).alias("found"))
        in_order = lambda x: F.transform(F.arrays_zip(x["n"], x["rank"], x["evidence_id"]), lambda y: F.struct((-y["n"]).alias("less"), y["rank"].alias("rank"), y["evidence_id"].alias("evidence_id"), x["size"].alias("size")))
        hits = lists.select("request_id", F.posexplode(F.slice(F.array_sort(F.flatten(F.transform("found", in_order))), 1, limit)).alias("at", "hit"))
        return hits.select("request_id", "hit.evidence_id", "hit.size", (-F.col("hit.less")).alias("n"), (F.col("at") + 1).alias("place"))

    hits = reduce(DataFrame.unionByName, [_stored(of_round(k)) for k in range(rounds)])
    hits = hits.withColumn("score", F.round(F.col("n") / F.col("size") * LEXICAL_WEIGHT, 6)).where(F.col("score") >= min_score)
    rows = requests.select("request_id").distinct().join(hits.select("request_id", "evidence_id", "score", "place"), "request_id", "left")
    return rows.select("request_id", F.when(F.col("place").isNull(), NO_EVIDENCE).otherwise("HIT").alias("kind"), "evidence_id", "score", "place")
