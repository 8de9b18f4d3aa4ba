"""Content-addressed ids: deterministic, so that a second load creates nothing new."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes in a piece of a long joined text, about.
PIECE = 8_192


def digest(*parts: Column | str, separator: str = "\x1f") -> Column:
    """SHA-256 of the parts joined by a separator that texts do not hold; a null part counts as empty."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]), 256)


def named_id(prefix: str, *parts: Column | str, length: int = 32) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest(*parts), 1, length))


def candidate_id(content_hash: Column) -> Column:
    return F.concat(F.lit("knd_"), F.substring(content_hash, 1, 32))


def fingerprint(rows: Column) -> Column:
    """Aggregate: one digest of a bag of hexadecimal row digests, whatever their order; partial sums only, no sort, no gathering."""
    head = F.conv(F.substring(rows, 1, 15), 16, 10).cast("decimal(38,0)")
    tail = F.conv(F.substring(rows, 16, 15), 16, 10).cast("decimal(38,0)")
    return F.sha2(F.concat_ws("|", F.count(rows).cast("string"), F.coalesce(F.sum(head), F.lit(0)).cast("string"), F.coalesce(F.sum(tail), F.lit(0)).cast("string")), 256)


def joined_md5(rows: DataFrame, group: str, text: str, separator: str = ",") -> DataFrame:
    """(group, n, md5) of each group's texts, sorted and joined by a separator; a null text is none.

    Such a text is never held: rows are sorted over all tasks and joined to pieces there, and one task for each group takes its pieces
    in order, a batch at a time, as a digest of this kind can be told in order only.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, texts = (batch.column(k).cast(pa.string()) for k in (0, 1))
            filled = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // PIECE
            starts = np.flatnonzero(np.concatenate([[True], (filled[1:] != filled[:-1]) | pc.not_equal(groups[1:], groups[:-1]).to_numpy(zero_copy_only=False)]))
            ends = np.append(starts, batch.num_rows).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), texts), separator)
            yield pa.RecordBatch.from_arrays([groups.take(pa.array(starts)), texts.take(pa.array(starts)), pa.array(np.arange(place, place + len(starts))), pa.array(np.diff(ends).astype(np.int64)), joined], ["group", "first", "place", "n", "piece"])
            place += len(starts)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n, digest = None, 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([of], pa.string()), pa.array([n], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["group", "n", "md5"])

        for batch in batches:
            for name, more, piece in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
                if digest is None or name != of:
                    if digest is not None:
                        yield row()
                    of, n, digest = name, 0, hashlib.md5(usedforsecurity=False)
                digest.update((separator if n else "").encode() + piece.encode())
                n += more
        if digest is not None:
            yield row()

    # Equal texts are in one task, so its own count tells the order of pieces that begin alike.
    ordered = rows.where(F.col(group).isNotNull() & F.col(text).isNotNull()).select(group, text).orderBy(group, text)
    cut = ordered.mapInArrow(pieces, "group string, first string, place long, n long, piece string")
    return cut.repartition("group").sortWithinPartitions("group", "first", "place").mapInArrow(told, "group string, n long, md5 string").withColumnRenamed("group", group)
