"""Language identification by string kernels.

Blended-spectrum presence kernel: two texts share the n-grams of 1 to 4 characters
that occur in both, over the geometric mean of how many each has. Landmark texts
(Nyström) span the feature space; one-versus-rest kernel ridge regression is fitted
in it; a batch of whole texts is scored by two matrix products, presence by
landmark and kernel by weights.

Texts are lower-cased and everything but letters counts as one space. N-grams of two
characters and more are hashed into a fixed number of places; a very long text fills
most of them, as presence of a whole text does.

Defined results: a text that is null or has no letter is `und` with score 0; rows
without a language, or with a null text, teach nothing; when nothing can be learned
every text is `und`; equal scores go to the alphabetically first language; repeated
rows and further columns are harmless.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UNUSUAL

ORDERS = (1, 2, 3, 4)
PLACES = 1 << 15
#: For each language, so many landmark texts and so many texts that the ridge regression is fitted on.
LANDMARKS, TRAIN_ROWS = 48, 800
RIDGE = 1e-3
UND = "und"
_OTHER = re.compile(r"[\W\d_]+")
#: The same by Unicode's classes, for texts with characters on which the two differ, such as fractions and circled digits.
_NO_LETTER = regex.compile(r"\P{L}+")


def held_out(doc_id: Column) -> Column:
    """Documents that the model never learns from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def presence(text: str | None) -> np.ndarray:
    """Sorted distinct places of a whole text's n-grams; empty if it has no letter."""
    low = text.lower() if text else ""
    plain = (_NO_LETTER if UNUSUAL.search(low) else _OTHER).sub(" ", low).strip(" ")
    if not plain:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    seen = np.zeros(PLACES, bool)
    gram = codes
    for n in ORDERS:
        if n > 1:
            if len(codes) < n:
                break
            gram = gram[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        x = gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        seen[(x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)] = True
    return np.flatnonzero(seen)


@dataclass
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray  # presence of the landmarks, PLACES x L, each over the root of its n-grams
    weights: np.ndarray  # L x languages: the Nyström map and the ridge solution in one
    scale: float

    def kernel(self, found: list[np.ndarray]) -> np.ndarray:
        """Kernel of each text with each landmark: one product of a batch's presence matrix."""
        x = np.zeros((len(found), PLACES), np.float32)
        for row, places in zip(x, found, strict=True):
            row[places] = 1 / np.sqrt(max(len(places), 1))
        return x @ self.landmarks

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        """Probability-like scores of the languages, a row for each text."""
        margins = self.kernel(found).astype(np.float64) @ self.weights * self.scale
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(found: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel | None:
    """Kernel ridge regression on +1/-1 targets; the first texts of each language are its landmarks."""
    found, labels = zip(*[(f, y) for f, y in zip(found, labels, strict=True) if len(f)], strict=True) if any(map(len, found)) else ([], [])
    languages = sorted(set(labels))
    if not languages:
        return None
    picked, taken = [], dict.fromkeys(languages, 0)
    for k, y in enumerate(labels):
        if taken[y] < landmarks:
            picked.append(k)
            taken[y] += 1
    z = np.zeros((PLACES, len(picked)), np.float32)
    for j, k in enumerate(picked):
        z[found[k], j] = 1 / np.sqrt(len(found[k]))
    model = KernelModel(languages, z, np.zeros((len(picked), len(languages))), 1.0)
    values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])  # K_zz ** -1/2
    phi = np.concatenate([model.kernel(list(found[at : at + 256])) for at in range(0, len(found), 256)]).astype(np.float64) @ root
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = np.array([labels.count(c) for c in languages], float)
    w = (1 / share)[[languages.index(c) for c in labels]][:, None]
    w = w / w.mean()
    beta = np.linalg.solve(phi.T @ (w * phi) + ridge * len(found) * np.eye(phi.shape[1]), phi.T @ (w * y))
    return KernelModel(languages, z, root @ beta, 4.0)


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> KernelModel | None:
    """Fits on at most train_rows texts of each language, those whose ids hash lowest; held-out documents are left out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("turn"))
    common = key.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    # Rows of a language above this turn are far too many to be among its first: a fixed bar, not a sample.
    width = [(r["lang"], -(2**63) + min(2**64 - 1, int(2**64 * min(1.0, (3.0 * train_rows + 200) / r["count"])))) for r in common]
    if not width:
        return None
    bars = docs.sparkSession.createDataFrame(width, "lang string, bar long")
    near = key.join(F.broadcast(bars), "lang").where("turn <= bar")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "doc_id"))
    picked = near.withColumn("n", rank).where(F.col("n") <= train_rows).select("doc_id", "lang", "n").dropDuplicates(["doc_id", "lang"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": batch["n"], "lang": batch["lang"], "doc_id": batch["doc_id"], "found": [presence(t).astype("<i4").tobytes() for t in batch["text"]]})

    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])
    got = rows.mapInPandas(read, "n int, lang string, doc_id long, found binary").toPandas().sort_values(["n", "lang", "doc_id", "found"], kind="stable")
    return fit([np.frombuffer(x, "<i4").astype(np.int64) for x in got["found"]], got["lang"].tolist())


def identify(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                found = [presence(t) for t in part["text"]]
                if model is None:
                    pred, score = [UND] * len(part), np.zeros(len(part))
                else:
                    p = model.scores(found)
                    best = p.argmax(axis=1)
                    pred = [model.languages[k] if len(f) else UND for k, f in zip(best, found, strict=True)]
                    score = np.where([len(f) > 0 for f in found], p.max(axis=1), 0.0)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "held_out": part["held_out"].to_numpy(), "lang_pred": pred, "score": score})

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(read, "doc_id long, held_out boolean, lang_pred string, score double")
