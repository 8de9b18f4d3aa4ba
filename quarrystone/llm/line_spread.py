"""Line dedup by distinct-site spread.

Each line has a HyperLogLog sketch of the sites (sources) it stands on; sketches
are merged by aggregation. Lines whose estimate is near the threshold, within
three standard errors, get an exact distinct count. Lines on min_sites sites or
more are boilerplate and leave every document that has other lines, whatever their
share of it. A document without any other line stays as it is. Where boilerplate is more
than max_share of the characters, it may be a copied text rather than a page's
furniture: a line of such documents that no document without other lines holds stays
in the first of them by id and leaves all the others, so the last copy of a text is never lost.

Lines are split at \\n and compared without spaces and tabs at their ends; every
line that is not blank counts. Shorter lines recur by chance: with fewer than min_words
words they are boilerplate from SHORT_FACTOR times as many sites on.
Defined results: a null text stays null; a null source is a site of its own, named
''; repeated rows count once, as sites are counted; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, fields, joined, written
from .native import let

MIN_SITES = 5
MIN_WORDS = 5
SHORT_FACTOR = 2
MAX_SHARE = 0.5
LG_K = 12
#: Three times the relative standard error of a sketch of 2**LG_K registers.
BAND = 3 * 1.04 / 2 ** (LG_K / 2)


def _line_key(line: Column) -> Column:
    """128 bits, so that lines of a whole crawl do not meet by chance."""
    return F.unhex(F.md5(F.btrim(line, F.lit(" \t\r"))))


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, text_key, size, pos, chars, line, short, site) of the lines that are not blank; size is the text's length, short lines have fewer words: one pass over the texts."""
    counts = f"^[ \\t\\x0B\\f\\r]*+(?:[^ \\t\\x0B\\f\\r]++[ \\t\\x0B\\f\\r]++){{{min_words - 1}}}[^ \\t\\x0B\\f\\r]"
    rows = docs.where("text is not null").select(_id(), F.xxhash64("text").alias("_text"), F.length("text").alias("size"), F.xxhash64(F.coalesce("source", F.lit(""))).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    filled = rows.where(F.col("line").rlike("[^ \\t\\x0B\\f\\r]"))
    return filled.select("_id", "_text", "size", "pos", F.length("line").alias("chars"), _line_key(F.col("line")).alias("line"), (~F.col("line").rlike(counts)).alias("short"), "site")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)).cast("long")).alias("_id")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The keys of the lines that stand on min_sites distinct sites or more, short ones on SHORT_FACTOR times as many."""
    sites, needed = F.col("sites"), F.when(F.col("short"), SHORT_FACTOR * min_sites).otherwise(min_sites)
    spread = lines.groupBy("line", "short").agg(F.hll_sketch_agg("site", LG_K).alias("sketch")).select("line", "short", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = written(spread.where(sites >= needed * (1 - BAND) - 0.5))
    near = spread.where(sites <= needed * (1 + BAND) + 0.5).select("line")
    exact = joined(lines, near, ["line"], "left_semi", near.count()).groupBy("line", "short").agg(F.count_distinct("site").alias("sites"))
    return written(spread.join(near, "line", "left_anti").unionByName(exact).where(sites >= needed).select("line"))


def last_copies(pages: DataFrame) -> DataFrame:
    """(id, text_key, kept): the lines that a page keeps, as it is the first of those made mostly of boilerplate and no whole page holds them."""
    stands = pages.where("whole or copied").select("_id", "_text", "whole", F.explode("cut.line").alias("line"))
    first = stands.groupBy("line").agg(F.min(F.struct(~F.col("whole"), "_id", "_text", "whole")).alias("at"))
    return first.where("not at.whole").groupBy("at._id", "at._text").agg(F.collect_set("line").alias("kept"))


def deduplicated(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, max_share: float = MAX_SHARE) -> DataFrame:
    """docs with boilerplate lines taken out of text; n_lines_removed is added (or replaced)."""
    docs = docs.drop("n_lines_removed")
    lines = written(lines_of(docs, min_words))
    marks = boilerplate(lines, min_sites)
    seen = joined(lines, marks.withColumn("marked", F.lit(True)), ["line"], "left", marks.count()).withColumn("marked", F.coalesce("marked", F.lit(False)))
    # A key for each row's text: no group of copies meets in one task, repeated rows share one set of positions.
    places = F.collect_set(F.when(F.col("marked"), F.struct("pos", "chars", "line"))).alias("cut")
    pages = seen.groupBy("_id", "_text").agg(places, F.min("size").alias("size"), F.bool_and("marked").alias("whole")).where(F.size("cut") > 0)
    n_cut = F.aggregate("cut", F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    pages = written(pages.select("_id", "_text", "cut", "whole", (n_cut > max_share * F.col("size")).alias("copied")))
    leave = F.filter("cut", lambda x: ~F.coalesce(F.array_contains("kept", x["line"]), F.lit(False)))
    cut = pages.where("not whole").join(last_copies(pages), ["_id", "_text"], "left").select("_id", "_text", leave.alias("cut")).where(F.size("cut") > 0)
    both = as_rows(docs, _id=_id(), _text=F.xxhash64("text"), text=F.col("text")).join(cut, ["_id", "_text"], "left")
    goes = F.col("cut").isNotNull()

    def stay(lines: Column) -> Column:  # array_except hashes its second side, so many lines cost no more than their number
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform("cut", lambda x: x["pos"])), lambda k: F.get(lines, k))

    rest = F.array_join(let(F.split("text", "\n", -1), stay), "\n")
    return both.select(*fields(docs, text=F.when(goes, rest).otherwise(F.col("text"))), F.when(goes, F.size("cut")).otherwise(0).alias("n_lines_removed"))
