"""Quality by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled good and bad documents. A text is
compressed with each, in short blocks so that the dictionary counts all along it and long texts
do not become their own dictionary. The difference of the two sizes, divided by the length of the
text, is the score's only input. A logistic curve over it (one slope, one offset), fitted on
labelled documents that no dictionary has seen, turns it into a probability; scores rise with the difference.

The classifier is fitted on a bounded sample, `per_class` labelled documents of each class
(the smallest hashes of their keys), collected to the driver. Scoring reads every whole text.

Defined results: a NULL or empty text gets the share of good labels; a missing or
unknown label, or a label of a document that is not there, is not learned from; without
labels of both classes every score is the share of good labels (0.5 without any label).
Repeated labels of a document count once, the smaller label. Repeated documents are scored
alike; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_CLASS = 2000
BLOCK = 512
DICTIONARY_BYTES = 110_000
FRAGMENT = 64
LEVEL = 3


def train_dictionary(texts: Sequence[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on shuffled fragments of the texts, as many from each text.

    Fragments are too short to hold a passage, so the dictionary learns how a class is
    written, not what a few of its documents happen to quote.
    """
    rng = random.Random(len(texts))
    each = max(1, 60 * size // FRAGMENT // max(1, len(texts)))
    starts = [(t, rng.randrange(max(1, len(t) - FRAGMENT + 1))) for t in texts for _ in range(each)]
    pieces = [t[a : a + FRAGMENT] for t, a in starts]
    rng.shuffle(pieces)
    samples = [b"".join(pieces[i : i + 16]) for i in range(0, len(pieces), 16)]
    if sum(map(len, samples)) > 10 * size:
        try:
            return zstandard.train_dictionary(size, samples)
        except zstandard.ZstdError:  # too few different fragments
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class CompressionClassifier:
    """Dictionaries of both classes, and the curve from sizes to a probability."""

    def __init__(self, good: zstandard.ZstdCompressionDict, bad: zstandard.ZstdCompressionDict, prior: float):
        self.good, self.bad, self.prior = good.as_bytes(), bad.as_bytes(), prior
        self.kinds = [
            zstandard.DICT_TYPE_AUTO if d.dict_id() else zstandard.DICT_TYPE_RAWCONTENT for d in (good, bad)
        ]
        self.weights: np.ndarray | None = None

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for data, kind in zip((self.good, self.bad), self.kinds):
            d = zstandard.ZstdCompressionDict(data, dict_type=kind)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))
        return made

    @staticmethod
    def differences(compressors: Sequence[zstandard.ZstdCompressor], texts: Sequence[bytes]) -> np.ndarray:
        """By how much the bad dictionary compresses each whole text worse than the good one, a byte of text."""
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            good, bad = (sum(len(c.compress(text[j : j + BLOCK])) for j in range(0, len(text), BLOCK)) for c in compressors)
            out[i] = (bad - good) / max(len(text), 1)
        return out

    def fit_curve(self, texts: Sequence[bytes], labels: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> None:
        """Weighted logistic regression on the difference by Newton steps."""
        x = self.differences(self.compressors(), texts)
        self.mean, self.scale = x.mean(), x.std() or 1.0
        x = np.stack([np.ones(len(x)), (x - self.mean) / self.scale], 1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (labels - p)) - ridge * w
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
            step = np.linalg.solve(h, g)
            step *= min(1.0, 4.0 / np.abs(step).max()) if step.any() else 1.0
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, texts: Sequence[bytes], compressors: Sequence[zstandard.ZstdCompressor]) -> np.ndarray:
        n = np.array([len(t) for t in texts])
        if self.weights is None or not len(n):
            return np.full(len(n), self.prior)
        z = (self.differences(compressors, texts) - self.mean) / self.scale
        p = 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * z, -30, 30)))
        return np.where(n > 0, p, self.prior)


def held_out_expr(key: str) -> Column:
    """Rows that labels are never learned from: crc32 of the key as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
    per_class: int = PER_CLASS,
) -> CompressionClassifier:
    """Learn from at most `per_class` labelled rows of each class outside the held-out rows."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out_expr(key))
        .groupBy(key)
        .agg(F.min(label).cast("int").alias("_label"))
    )
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    # The size of this side is bounded by the sample.
    chosen = [known.where(F.col("_label") == c).orderBy(F.xxhash64(key), key).limit(per_class) for c in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select(key, F.col(text).alias("_text")).join(picked, key).where("_text <> ''").collect()
    rows = sorted({(r._label, r._text.encode("utf-8", "surrogatepass")) for r in rows}, key=lambda r: (r[0], zlib.crc32(r[1])))
    by_class = [[t for c, t in rows if c == k] for k in (0, 1)]
    # Half of each class makes its dictionary, the other half the curve.
    model = CompressionClassifier(*(train_dictionary(by_class[k][::2]) for k in (1, 0)), prior)
    seen = [t for k in (0, 1) for t in by_class[k][1::2]]
    y = np.array([k for k in (0, 1) for _ in by_class[k][1::2]], float)
    if 0 < y.sum() < len(y):
        # Weights restore the shares of the classes in all labels.
        share = {0: (1 - prior) / (y == 0).mean(), 1: prior / (y == 1).mean()}
        model.fit_curve(seen, y, np.where(y == 1, share[1], share[0]))
    return model


def classify(docs: DataFrame, model: CompressionClassifier, text: str = "text", score: str = "score") -> DataFrame:
    """Documents with their score. Python sees the text alone; other columns stay in the JVM."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = model.compressors()
        for batch in batches:
            texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch]
            yield pa.array(model.score(texts, compressors), pa.float64())

    return docs.withColumn(score, scored(F.col(text)))


THRESHOLD = 0.7


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out_expr("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )


ORACLE = None
