"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; K ordered
thresholds turn its score into P(grade > k) = sigmoid(score - theta_k).  The
expected grade is the sum of those tails, and one tail selects documents.

Defined results: a null or empty text has no features but the bias-free score 0
and is scored like any text; rows without a doc_id, repeated rows and further
columns pass through; labels that are null or match no document are ignored; if
no rating is left, every threshold is 0 and every document is kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_rows, fields, release

#: Hashed word features; the shape features follow them.
N_WORD = 1 << 18
SHAPES = ("symbols", "capitals", "repeats", "pipes", "bangs")
LEVELS = 9
N_FEATURES = N_WORD + len(SHAPES) * LEVELS
#: The model is fitted on at most so many rated documents, those whose ids hash lowest.
MAX_TRAIN_ROWS = 12_000
_EDGE = re.compile(r"^\W+|\W+$")


class _Words(dict):
    """Word -> feature | shape bits << 20 | (feature of its stem + 1) << 32; forgets everything when it is large."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        core = _EDGE.sub("", word).lower()
        code = zlib.crc32(core.encode("utf-8", "surrogatepass")) % N_WORD if core else N_WORD
        if len(core) >= 6:  # its beginning too, for words of one stem
            code |= zlib.crc32(b"^" + core[:4].encode("utf-8", "surrogatepass")) % N_WORD + 1 << 32
        if any(c in "#*$%&<>^~" for c in word):
            code |= 1 << 20
        if len(core) > 1 and core != word and any(c.isalpha() for c in core) and word.upper() == word:
            code |= 1 << 21
        if word == "|":
            code |= 1 << 22
        if "!!" in word:
            code |= 1 << 23
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = code
        return code


def features(text: str | None, words: _Words) -> np.ndarray:
    """Sorted distinct feature numbers of one whole text."""
    codes = np.array([words[w] for w in (text or "").split()], dtype=np.int64)
    if not len(codes):
        return np.zeros(0, np.int64)
    core = codes & ((1 << 20) - 1)
    stems = codes >> 32
    found = np.unique(np.concatenate([core[core < N_WORD], stems[stems > 0] - 1]))
    shares = (
        np.mean(codes >> 20 & 1),
        np.mean(codes >> 21 & 1),
        np.mean(core[1:] == core[:-1]) if len(core) > 1 else 0.0,
        np.mean(codes >> 22 & 1),
        np.mean(codes >> 23 & 1),
    )
    level = [N_WORD + i * LEVELS + (0 if x <= 0 else int(np.clip(np.ceil(np.log2(x * 256)), 1, LEVELS - 1))) for i, x in enumerate(shares)]
    return np.concatenate([found, np.array(level, np.int64)])


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thetas: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0..K-1, one row per score; falls with k as the thresholds rise."""
        return 1.0 / (1.0 + np.exp(-np.clip(scores[:, None] - self.thetas[None, :], -60, 60)))


def _scores(weights: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[flat], dtype=np.float64)])
    return sums[starts + lengths] - sums[starts]


def objective(scores: np.ndarray, grades: np.ndarray, thetas: np.ndarray, row_weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood, its gradient by score and by threshold."""
    edges = np.concatenate([[-np.inf], thetas, [np.inf]])
    up, low = 1 / (1 + np.exp(np.clip(scores - edges[grades + 1], -60, 60))), 1 / (1 + np.exp(np.clip(scores - edges[grades], -60, 60)))
    p = np.clip(up - low, 1e-12, None)  # P(grade) = F(theta_g - s) - F(theta_{g-1} - s)
    d_up, d_low = up * (1 - up), low * (1 - low)
    by_score = row_weight * (d_up - d_low) / p
    by_theta = np.zeros(len(thetas))
    np.add.at(by_theta, np.minimum(grades, len(thetas) - 1), np.where(grades < len(thetas), -row_weight * d_up / p, 0.0))
    np.add.at(by_theta, np.maximum(grades - 1, 0), np.where(grades > 0, row_weight * d_low / p, 0.0))
    return float(-(row_weight * np.log(p)).sum()), by_score, by_theta


def fit(rows: list[np.ndarray], grades: np.ndarray, min_df: int = 5, min_z: float = 5.0, l2: float = 1e-5, balance: float = 0.0, steps: int = 200, rate: float = 0.2) -> OrdinalModel:
    """Adam over full batches; thresholds stay ordered as first + sum of exp(gaps).

    balance 0 weighs rows alike, 1 weighs grades alike. A word takes part if it is in min_df rows and its score test
    at zero weights, the sum of its rows' score gradients over their root sum of squares, is min_z or more: the many
    words that say nothing of a grade get no weight that a long text could add up.
    """
    n_cut = int(grades.max()) if len(grades) else 0
    weights = np.zeros(N_FEATURES)
    if n_cut < 1:
        return OrdinalModel(weights, np.zeros(max(n_cut, 1)))
    share = np.bincount(grades, minlength=n_cut + 1).astype(float)
    row_weight = (1 / np.maximum(share, 1) ** balance)[grades]
    row_weight /= row_weight.sum()
    above = np.clip(np.array([row_weight[grades > k].sum() for k in range(n_cut)]), 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log(1 / above - 1)) + 1e-3 * np.arange(n_cut)
    at_zero = objective(np.zeros(len(grades)), grades, start, row_weight)[1]
    df, pull, spread = (np.zeros(N_FEATURES) for _ in range(3))
    for at in range(0, len(rows), 1000):  # in parts: all features of all rows at once would be the driver's largest array
        part = rows[at : at + 1000]
        found, by_row = np.concatenate(part), np.repeat(at_zero[at : at + 1000], [len(r) for r in part])
        df += np.bincount(found, minlength=N_FEATURES)
        pull += np.bincount(found, weights=by_row, minlength=N_FEATURES)
        spread += np.bincount(found, weights=by_row**2, minlength=N_FEATURES)
    frequent = (df >= min_df) & (np.abs(pull) / np.sqrt(spread + 1e-300) >= min_z)
    rows = [r[frequent[r]] for r in rows]
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    parameters = np.concatenate([weights, [start[0]], np.log(np.diff(start) + 1e-2)])
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        w, first, gaps = parameters[:N_FEATURES], parameters[N_FEATURES], np.exp(parameters[N_FEATURES + 1 :])
        thetas = first + np.concatenate([[0.0], np.cumsum(gaps)])
        _, by_score, by_theta = objective(_scores(w, flat, starts, lengths), grades, thetas, row_weight)
        tail = by_theta[::-1].cumsum()[::-1]
        gradient = np.concatenate([np.bincount(flat, weights=by_score[owner], minlength=N_FEATURES) + l2 * w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        parameters = parameters - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    gaps = np.exp(parameters[N_FEATURES + 1 :])
    return OrdinalModel(parameters[:N_FEATURES] * frequent, parameters[N_FEATURES] + np.concatenate([[0.0], np.cumsum(gaps)]))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from 0/1 labels: 0 poor, 1 good but toxic, 2 good and not toxic. One grade per doc_id, the lowest."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(F.when(F.col("quality") == 0, 0).when(toxic > 0, 1).otherwise(2)).cast("int").alias("grade"))
    )


def train(docs: DataFrame, ratings: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> OrdinalModel:
    """Fits on the max_rows rated documents whose ids hash lowest; texts become features on the executors."""
    key = F.xxhash64("doc_id")
    picked = ratings.where(F.col("grade").isNotNull()).select("doc_id", "grade").orderBy(key, "doc_id").limit(max_rows)
    rated = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "grade")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "grade": batch.grade, "found": [features(t, words).astype("<i4").tobytes() for t in batch.text]})
            release()

    got = rated.mapInPandas(rows, "doc_id long, grade int, found binary").toPandas().sort_values(["doc_id", "found"], kind="stable")
    got = got.drop_duplicates("doc_id")
    model = fit([np.frombuffer(x, "<i4") for x in got.found], got.grade.to_numpy(np.int64))
    del got
    release()
    return model


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of docs with expected_grade and tail_probability, P(highest grade), added (or replaced)."""
    docs = docs.drop("expected_grade", "tail_probability")
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thetas))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, (w, cuts) = _Words(), sent.value
        for texts in batches:
            raw = np.array([float(w[features(t, words)].sum(dtype=np.float64)) for t in texts], dtype=np.float64)
            tails = OrdinalModel(w, cuts).tails(raw)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_probability": tails[:, -1]})
            del texts
            release()

    # Only texts go to Python and only two numbers come back; not deterministic, so that no plan asks twice.
    score_of = F.pandas_udf(scored, "expected_grade double, tail_probability double").asNondeterministic()
    return as_rows(docs, score=score_of("text")).select(*fields(docs), "score.expected_grade", "score.tail_probability")


def classify(docs: DataFrame, ratings: DataFrame, min_tail: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail_probability and kept (tail_probability >= min_tail) added (or replaced)."""
    return score(docs, train(docs, ratings)).withColumn("kept", F.col("tail_probability") >= min_tail)
