"""A quality classifier for graded ratings: ordinal regression with cumulative links.

One weight per hashed text feature is shared by all grades, and ordered thresholds cut
the score: P(grade <= j) = sigmoid(threshold_j - score). The expected grade ranks
documents; the probability of at least a given grade selects them.

Features are the distinct words of a text and binned shares of its characters. The model
is fitted on a bounded sample of rated rows (``SAMPLE``); all documents are scored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import text_of, worker_store
from eventflow.llm.pieces import chunks

WORD = re.compile(r"\w+")
#: Rated rows that a model is fitted on, at most.
SAMPLE = 20_000
BUCKETS = 1 << 20
#: Rated texts in which a bucket must occur to have a weight.
LEAST_TEXTS = 3
STEPS = 200
RATE = 0.2
SHRINK = 0.2
#: Standard errors by which the mean grade of texts with a bucket must differ from that of all; others have no weight.
SIGNAL = 3.3
#: Probability of the wanted grade from which a text is kept.
CUT = 0.6
#: Words a worker remembers with their weight. A full memo starts anew; only speed depends on it.
MEMO_WORDS = 500_000
MARKS = [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n\t "]


def shape(text: str, words: int, distinct: int) -> list[str]:
    """Names of the binned features of a text as a whole."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(data, minlength=256)
    n = max(len(data), 1)
    share = lambda count: int(np.log2(1024 * count / n + 1))
    lines = text.split("\n")
    return [
        f"#words {words.bit_length()}",
        f"#distinct {10 * distinct // max(words, 1)}",
        f"#length {min(n // max(words, 1), 20)}",
        f"#lines {10 * len(set(lines)) // len(lines)}",
        f"#upper {share(counts[65:91].sum())}",
        f"#digits {share(counts[48:58].sum())}",
        f"#beyond {share(counts[128:].sum())}",
        *[f"#{m} {share(counts[m])}" for m in MARKS if counts[m]],
    ]


def features(text: str | None) -> list[str]:
    """The distinct features of a text: its words in lower case, and its shape."""
    text = text or ""
    n, words = 0, set()
    for part in chunks(text):
        found = WORD.findall(part.lower())
        n += len(found)
        words.update(found)
    return [*words, *shape(text, n, len(words))]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Model:
    """Weights by bucket (only those that are not zero) and the grades' thresholds; no thresholds: nothing was rated."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, .. in columns."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, levels: int) -> Model:
    """Fits the model to rows of buckets and grades 0 to levels - 1 by full-batch gradient steps with adaptive rates."""
    if not len(rows):
        return Model(np.empty(0, np.int64), np.empty(0), np.empty(0))
    sizes = np.array([len(r) for r in rows])
    found, column = np.unique(np.concatenate(rows), return_inverse=True)
    column = column.astype(np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    texts = np.bincount(column, minlength=len(found))
    surplus = np.bincount(column, (grades - grades.mean())[row], minlength=len(found)) / np.maximum(np.sqrt(texts) * grades.std(), 1e-9)
    use = ((texts >= LEAST_TEXTS) & (np.abs(surplus) >= SIGNAL))[column]
    column, row, n = column[use], row[use], len(rows)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)).mean()
    # Thresholds start at the grades' frequencies, each counted once more so that none is infinite.
    share = np.cumsum(np.bincount(grades, minlength=levels) + 1.0)[:-1] / (n + levels)
    first, gaps = np.log(share / (1 - share))[0], np.log(np.maximum(np.diff(np.log(share / (1 - share))), 1e-3))
    weights = np.zeros(len(found))
    values = np.concatenate([weights, [first], gaps])
    mean, square = np.zeros_like(values), np.zeros_like(values)
    at_least = grades[:, None] > np.arange(levels - 1)[None, :]
    for step in range(1, STEPS + 1):
        weights, first, gaps = values[: len(found)], values[len(found)], values[len(found) + 1 :]
        thresholds = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
        score = scale * np.bincount(row, weights[column], minlength=n)
        # d log P(grade) / d score, with the limits of the first and last grade open.
        cdf = _sigmoid(thresholds[None, :] - score[:, None])
        low = np.concatenate([np.zeros((n, 1)), cdf], axis=1)[np.arange(n), grades]
        high = np.concatenate([cdf, np.ones((n, 1))], axis=1)[np.arange(n), grades]
        p = np.maximum(high - low, 1e-12)
        by_score = (high * (1 - high) - low * (1 - low)) / p
        density = cdf * (1 - cdf) / p[:, None]
        index = np.arange(levels - 1)[None, :]
        by_threshold = -np.where(index == grades[:, None], density, 0) + np.where(index == grades[:, None] - 1, density, 0)
        by_threshold = by_threshold.sum(axis=0)
        tail_sum = np.cumsum(by_threshold[::-1])[::-1]
        slope = np.concatenate(
            [
                scale * np.bincount(column, by_score[row], minlength=len(found)) + SHRINK * scale * weights,
                [tail_sum[0]],
                tail_sum[1:] * np.exp(gaps),
            ]
        )
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        values = values - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights, first, gaps = scale * values[: len(found)], values[len(found)], values[len(found) + 1 :]
    kept = np.flatnonzero(weights)
    thresholds = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
    return Model(found[kept], weights[kept].astype(np.float32), thresholds)


def fit(docs: DataFrame, ratings: DataFrame, levels: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model of ``ratings`` (doc_id, grade from 0 to levels - 1) of ``docs``.

    Rows without an id or with a grade out of range are left out. Where more than
    ``sample`` ratings exist, those with the lowest hashes of id and grade are taken.
    """
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    rated = rated.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, levels - 1))
    rated = rated.orderBy(F.xxhash64("doc_id", "grade")).limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    joined = texts.join(F.broadcast(rated), "doc_id").select("grade", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array([bucket(f) for f in features(t)], np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["grade", "buckets"])

    # Repeated ids can join more rows than the sample has: the bound holds for what is gathered, too.
    rows = joined.mapInArrow(hashed, "grade int, buckets binary").orderBy(F.xxhash64("grade", "buckets"), "grade", "buckets")
    rows = rows.limit(sample).collect()
    buckets = [np.frombuffer(bytes(r["buckets"]), np.int32) for r in rows]
    return fit_rows(buckets, np.array([r["grade"] for r in rows], np.int64), levels)


class Weights(dict):
    """Weights by feature."""

    def __init__(self, model: tuple):
        super().__init__()
        self.table = np.zeros(BUCKETS, np.float32)
        self.table[model[0]] = model[1]

    def __missing__(self, feature: str) -> float:
        weight = self[feature] = float(self.table[bucket(feature)])
        return weight

    def score(self, text: str) -> float:
        if len(self) > MEMO_WORDS:
            self.clear()
        return sum(map(self.__getitem__, features(text)))


def _weights(key: str, model: tuple) -> Weights:
    store = worker_store("quality-weights")
    if key not in store:
        store.clear()
        store[key] = Weights(model)
    return store[key]


def score(text: Column, model: Model) -> Column:
    """The linear score of a text, computed in the worker from the weights sent along."""
    plain = (model.buckets, model.weights)
    key = hashlib.sha256(model.buckets.tobytes() + model.weights.tobytes()).hexdigest()

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = _weights(key, plain)
        for batch in texts:
            yield pd.Series([weights.score(t) for t in batch], dtype="float64")

    return scored(text)


def _tail(score: Column, threshold: float) -> Column:
    return 1 / (1 + F.exp(F.lit(float(threshold)) - score))


def rate(
    docs: DataFrame, model: Model, least_grade: int, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per row of ``docs``: doc_id, score, expected_grade, tail (P(grade >= least_grade)) and kept (tail >= cut).

    Null texts count as empty and are scored as such; null ids and repeated rows are
    passed on. A model of no ratings keeps everything, with null scores.
    """
    if not len(model.thresholds):
        none = F.lit(None).cast("double")
        return docs.select(
            F.col(id_col).alias("doc_id"), none.alias("score"), none.alias("expected_grade"), none.alias("tail"), F.lit(True).alias("kept")
        )
    scored = docs.select(F.col(id_col).alias("doc_id"), score(text_of(text_col), model).alias("score"))
    expected = sum((_tail(F.col("score"), t) for t in model.thresholds), F.lit(0.0))
    tail = _tail(F.col("score"), model.thresholds[least_grade - 1])
    rated = scored.select("doc_id", "score", expected.alias("expected_grade"), tail.alias("tail"))
    return rated.withColumn("kept", F.col("tail") >= cut)


def accepted(docs: DataFrame, model: Model, least_grade: int, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose P(grade >= least_grade) is at least ``cut``, with all their columns.

    Null texts count as empty, repeated rows share one fate, ids are not read. A model
    without thresholds keeps all rows; an empty table has an empty result.
    """
    if not len(model.thresholds):
        return docs
    return docs.where(_tail(score(text_of(text_col), model), model.thresholds[least_grade - 1]) >= cut)
