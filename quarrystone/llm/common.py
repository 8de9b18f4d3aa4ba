"""What the operators share: cut lineage in the shared folder, words of a text, joins with checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows of a few dozen bytes is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
# Fixed value: the pattern for which the faster classes of word_splitter hold.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts without these characters split alike under re's classes and under the pattern's Unicode classes.
UNUSUAL = re.compile("[\x1c-\x1f\x85²³¹¼-¾]|[^\x00-ɏ]")
_FAST = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
#: Rows in an Arrow batch while a table is written.
BATCH_ROWS = 1000
SEED = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all tasks run on this machine, as in tests, a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="quarrystone-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and a lost executor costs no recomputation.

    While it is written, batches of rows for Python are small, so that workers stay small.
    """
    spark, rows = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    before = spark.conf.get(rows)
    spark.conf.set(rows, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(rows, before)
    return spark.read.schema(df.schema).parquet(path)


def as_rows(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one column, row, beside columns of the operator's own, so that no name of the caller's meets one of these."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def fields(docs: DataFrame, **replaced: Column) -> list[Column]:
    """The caller's columns, taken out of row, some of them replaced."""
    return [replaced[c].alias(c) if c in replaced else F.col("row").getField(c).alias(c) for c in docs.columns]


def joined(left: DataFrame, small: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """left joined with small, which is broadcast if its counted rows allow; else both shuffle and skew is split at run time."""
    return left.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed_of(n: int) -> np.uint64:
    """The n-th multiple of SEED modulo 2**64."""
    return np.uint64(int(SEED) * n & 0xFFFFFFFFFFFFFFFF)


def importable(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each session's context."""
    context = spark.sparkContext
    if getattr(context, "_quarrystone_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as held:
        for source in sorted(package.rglob("*.py")):
            held.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._quarrystone_sent = True


def word_splitter(pattern: str) -> Callable[[str], list[str]]:
    """Splits a text by a tokenizer's pattern; ordinary texts take a faster way if the pattern is the known one."""
    exact = regex.compile(pattern)
    if pattern != KNOWN_PATTERN:
        return exact.findall
    return lambda text: (exact.findall if UNUSUAL.search(text) else _FAST.findall)(text)


def cut_at_spaces(pattern: str) -> bool:
    """Whether a text may be cut before each space that no white space follows, as its parts split alike alone.

    So it is for the known pattern: a match never goes on over such a space, as words take one space before them
    only, and of several white-space characters before a word the last one is left to it.
    """
    return pattern == KNOWN_PATTERN


def release() -> None:
    """Gives a worker's free memory back, so that workers which wait for other stages stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has this library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
