"""Quality rules by distribution divergence, with DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated three-word windows. The
method compares a document's histograms of character classes and of common words
with the reference of its language, the sums over all documents of that language, by
Jensen-Shannon distance. Short documents are noisy histograms: each comparison has
its own least length, below which it rejects nothing.

Words lie between ASCII white space. Defined results: a null text is an empty one
and fails the base rules; a null language is a language of its own; a language
without a list of common words has no word comparison; repeated rows and further
columns are harmless; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, written
from .native import let, total

SPACE = " \\t-\\r"
SYMBOLS = "#*$%&|<>"
#: Common words of four languages.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "que", "est"),
}
N_COMMON = 10
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.3
MIN_COMPARED_WORDS, MAX_WORD_DISTANCE = 100, 0.27
#: Places of a window's number in its packed form; longer texts are sorted by words.
_BITS = 24


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+", -1))


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more.

    Windows are sorted as hash and number in one long; neighbours with equal hashes
    count only if their words are equal. Where different windows meet in a hash, and in
    texts too long for the numbers, they are sorted by their words.
    """
    mask = (1 << _BITS) - 1

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def equal(i: Column, j: Column) -> Column:
        return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))

    def covered(at: Column) -> Column:
        return total(F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(at, k + 1) - p), F.lit(3)).cast("long")))

    numbers = F.sequence(F.lit(0), F.size(words) - 3)

    def packed(s: Column) -> Column:
        def again(x: Column, k: Column, step: int, same: bool = True) -> Column:
            y = F.get(s, k + step)
            words_equal = equal(x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int"))
            return F.coalesce((F.shiftright(x, _BITS) == F.shiftright(y, _BITS)) & (words_equal if same else ~words_equal), F.lit(False))

        met = F.size(F.filter(s, lambda x, k: again(x, k, 1, same=False))) > 0  # different windows with one hash
        found = F.filter(s, lambda x, k: again(x, k, 1) | again(x, k, -1))
        return F.when(met, exact).otherwise(let(F.array_sort(F.transform(found, lambda x: x.bitwiseAND(mask).cast("int"))), covered))

    def sorted_by_words(s: Column) -> Column:
        def again(x: Column, k: Column, step: int) -> Column:
            y = F.get(s, k + step)
            return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

        return let(F.array_sort(F.transform(F.filter(s, lambda x, k: again(x, k, 1) | again(x, k, -1)), lambda x: x["i"])), covered)

    exact = let(F.array_sort(F.transform(numbers, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i")))), sorted_by_words)
    short = let(F.sort_array(F.transform(numbers, lambda i: F.shiftleft(window(i), _BITS).bitwiseOR(i.cast("long")))), packed)
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).when(F.size(words) < 1 << _BITS, short).otherwise(exact)


def _gone(text: Column, pattern: str) -> Column:
    """How many characters match a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Counts and histograms of each whole text: one pass, no shuffle."""
    text = F.coalesce("text", F.lit(""))
    lists = F.coalesce(*[F.when(F.col("lang") == k, F.array(*map(F.lit, v))) for k, v in COMMON_WORDS.items()], F.array().cast("array<string>"))

    def of_words(words: Column) -> Column:
        common = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: F.array_contains(lists, w))
        counts = let(common, lambda c: F.transform(lists, lambda x: F.size(F.filter(c, lambda w: w == x)).cast("long")))
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words"), counts.alias("common"))

    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    doubled = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.length(text).cast("long").alias("n_chars"), _gone(text, f"[{SPACE}]").alias("n_space"), _gone(text, f"[{SYMBOLS}]").alias("n_symbols"),
        _gone(text, "\\p{Ll}").alias("n_lower"), _gone(text, "\\p{Lu}").alias("n_upper"), _gone(text, "[0-9]").alias("n_digit"),
        doubled.alias("n_dup_lines"), let(words_of(text), of_words).alias("w"),
    )
    return rows.select(
        "doc_id", "lang", "n_chars", "n_symbols", "n_dup_lines", F.col("w.n_words").alias("n_words"), F.col("w.n_repeat_words").alias("n_repeat_words"),
        (F.col("n_chars") - F.col("n_space")).alias("word_chars"),
        F.array("n_space", "n_symbols", "n_lower", "n_upper", "n_digit", F.expr("n_chars - n_space - n_symbols - n_lower - n_upper - n_digit")).alias("classes"),
        F.concat("w.common", F.array(F.col("w.n_words") - total(F.col("w.common")))).alias("common"),
    )


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two histograms; null if either is empty."""

    def shares(x: Column) -> Column:
        return let(total(x), lambda n: F.when(n > 0, F.transform(x, lambda v: v / n)))

    def part(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)

    return let(shares(counts), lambda p: let(shares(reference), lambda q: F.sqrt(F.greatest(F.lit(0.0), (part(p, q) + part(q, p)) / 2))))


def references(rows: DataFrame) -> DataFrame:
    """A row for each language: the sums of its documents' histograms."""
    n = 6
    sums = [F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(n)] + [F.sum(F.coalesce(F.get("common", F.lit(k)), F.lit(0))).alias(f"w{k}") for k in range(N_COMMON + 1)]
    summed = rows.groupBy("lang").agg(*sums)
    return summed.select("lang", F.array(*[f"c{k}" for k in range(n)]).alias("ref_classes"), F.array(*[f"w{k}" for k in range(N_COMMON + 1)]).alias("ref_common"))


def judged(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> the counts, the two distances, base_failed and kept for each row."""
    rows = written(measured(docs))
    refs = written(references(rows))
    refs = F.broadcast(refs) if refs.count() <= BROADCAST_ROWS // 100 else refs
    rows = rows.join(refs, "lang", "left")
    both = rows.withColumns(
        {
            "char_distance": F.when(F.col("n_chars") >= MIN_CHARS, distance(F.col("classes"), F.col("ref_classes"))),
            "word_distance": F.when((F.col("n_words") >= MIN_COMPARED_WORDS) & (F.size("common") == N_COMMON + 1), distance(F.col("common"), F.col("ref_common"))),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    far = F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance"
    )
