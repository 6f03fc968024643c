"""Batch scoring with user-supplied models, and simple models of our own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.sources.context import sized
from eventflow.sources.joins import skew_join

from .batches import BATCH_SIZE
from .quantiles import KEY, keyed, summary_by_key

# Fixed value: how a failed batch is reported.
FAILED = "Batch processing error: "

Predict = Callable[[np.ndarray], np.ndarray]


def feature_vector(*columns: Column) -> Column:
    return F.array(*[c.cast("double") for c in columns])


def score(
    df: DataFrame, features: str, width: int, load: Callable[[], Predict], batch_size: int = BATCH_SIZE, into: str = "prediction"
) -> DataFrame:
    """Score a feature vector column; ``load`` runs once per Python worker.

    The model sees a ``(rows, width)`` array and returns one number per row.
    """
    model = predict_batch_udf(
        load, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    return df.withColumn(into, model(F.col(features)))


def as_result(prediction: Column, input_id: Column, metadata: Column) -> Column:
    """``{prediction, input_id, metadata}``."""
    return F.struct(prediction.alias("prediction"), input_id.alias("input_id"), metadata.alias("metadata"))


def _attempt(predict: Predict, rows: np.ndarray, retries: int) -> np.ndarray:
    for left in range(retries, -1, -1):
        try:
            values = np.asarray(predict(rows), dtype=float)
            if values.shape[:1] != (len(rows),):
                raise ValueError(f"{len(rows)} rows, but predictions of shape {values.shape}")
            return values.reshape(len(rows), -1)[:, 0]
        except Exception:
            if left == 0:
                raise
    raise AssertionError("unreachable")


def _score_rows(predict: Predict, vectors: list, retries: int) -> tuple[list, list]:
    """Score a batch; if it fails (also for vectors that make no matrix), find the rows to blame one by one."""
    try:
        return list(_attempt(predict, np.array(vectors, dtype=float), retries)), [None] * len(vectors)
    except Exception:
        pass
    values, errors = [], []
    for vector in vectors:
        try:
            values.append(float(_attempt(predict, np.array([vector], dtype=float), retries)[0]))
            errors.append(None)
        except Exception as problem:
            values.append(None)
            errors.append(f"{FAILED}{problem}")
    return values, errors


def score_or_error(
    df: DataFrame,
    features: str,
    load: Callable[[], Predict],
    batch_size: int = BATCH_SIZE,
    max_retries: int = 0,
    pre: Callable[[np.ndarray], np.ndarray] | None = None,
    post: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Add ``prediction`` and ``error``; a failing row does not take its batch along."""
    before, after = pre or (lambda rows: rows), post or (lambda values: values)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        predict = lambda rows: after(model(before(rows)))
        for pdf in batches:
            values, errors = [], []
            for start in range(0, len(pdf), batch_size):
                vectors = pdf[features].iloc[start : start + batch_size].tolist()
                got, bad = _score_rows(predict, vectors, max_retries)
                values += got
                errors += bad
            yield pdf.assign(prediction=pd.array(values, dtype="Float64"), error=errors)

    extra = [T.StructField("prediction", T.DoubleType()), T.StructField("error", T.StringType())]
    return df.mapInPandas(run, T.StructType([*df.schema.fields, *extra]))


def linear_of(features: list[Column], weights: list[float], bias: float = 0.0) -> Column:
    """``bias + sum(w * x)`` over columns, as one compiled expression."""
    terms = [x.cast("double") * F.lit(float(w)) for x, w in zip(features, weights, strict=True)]
    return reduce(lambda total, term: total + term, terms, F.lit(float(bias)))


def linear(features: Column, weights: list[float], bias: float = 0.0) -> Column:
    """The same over an array column; NULL if the array is too short."""
    return linear_of([F.get(features, F.lit(i)) for i in range(len(weights))], weights, bias)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def flagged(value: Column, threshold: float) -> Column:
    """True at or above the threshold; a missing score is not flagged."""
    return F.coalesce(value >= F.lit(threshold), F.lit(False))


def robust_zscore(df: DataFrame, keys: list[str], value: str, into: str = "z") -> DataFrame:
    """Distance from the key's median in units of its median absolute deviation; rows with a NULL key are a group."""
    x = F.col(value).cast("double")
    narrow = keyed(df, keys).select(KEY, value)
    centre = summary_by_key(narrow, x, [], {"__med": 0.5})
    distance = F.abs(x - F.col("__med"))
    spread = summary_by_key(skew_join(narrow, centre, [KEY]), distance, [], {"__mad": 0.5})
    known = centre.join(spread, KEY, "left")
    joined = skew_join(keyed(df, keys), known, [KEY], "left")
    return joined.withColumn(into, F.try_divide(distance, F.col("__mad"))).drop(KEY, "__med", "__mad")


def version_order(version: Column) -> Column:
    """Numeric parts of a dotted version, so that 1.10 sorts after 1.9."""
    return F.transform(F.split(version, r"\."), lambda part: part.try_cast("int"))


def latest_models(catalogue: DataFrame, tie: str) -> DataFrame:
    """The newest version per model name."""
    rest = [c for c in catalogue.columns if c != "name"]
    newest = F.max_by(F.struct(*rest), F.struct(version_order(F.col("version")), F.col(tie)))
    return catalogue.groupBy("name").agg(newest.alias("m")).select("name", "m.*")


def resolve_models(df: DataFrame, catalogue: DataFrame, tie: str, name: str = "model", version: str = "wanted") -> DataFrame:
    """Attach the catalogue entry each row asks for: the named version, or the newest if NULL."""
    entries = catalogue.withColumn("__version", F.col("version")).unionByName(
        latest_models(catalogue, tie).withColumn("__version", F.lit(""))
    )
    entries = entries.withColumnRenamed("name", "__name")
    on = (F.col(name) == F.col("__name")) & (F.coalesce(F.col(version), F.lit("")) == F.col("__version"))
    return df.join(sized(entries), on=on, how="left").drop("__name", "__version")


def error_record(agent: str, error: Column, at: Column) -> Column:
    """``{error, timestamp, agent}`` as JSON; NULL where there is no error."""
    return F.when(
        error.isNotNull(), F.to_json(F.struct(error.alias("error"), at.alias("timestamp"), F.lit(agent).alias("agent")))
    )


def token_overlap(left: Column, right: Column) -> Column:
    """Shared words over all words of two texts, 0 if both are empty."""
    a, b = (F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")) for c in (left, right))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
