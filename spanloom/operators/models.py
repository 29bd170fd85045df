"""Models: a hashed-feature classifier by MLlib, Viterbi decoding of tag scores, and run grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.taggers import Batch, viterbi_batch


def viterbi(emissions: np.ndarray, transitions: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[int]:
    """The best tag path of (places, tags) scores; on ties the smallest tag."""
    if not len(emissions):
        return []
    score, back = begin + emissions[0], []
    for row in emissions[1:]:
        paths = score[:, None] + transitions
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0) + row
    path = [int((score + end).argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def decode_paths(df: DataFrame, scores_col: str, transitions: np.ndarray, begin: np.ndarray, end: np.ndarray) -> DataFrame:
    """Adds ``path``: the best tags of an array<array<double>> of scores, null for null; a batch's rows are decoded together."""

    @F.arrow_udf("array<int>")
    def best(scores: pa.Array) -> pa.Array:
        listed = [None if s is None else np.array(s, float).reshape(-1, len(begin)) for s in scores.to_pylist()]
        full = [i for i, s in enumerate(listed) if s is not None and len(s)]
        sizes = np.array([len(listed[i]) for i in full], np.int64)
        full = [full[k] for k in np.argsort(-sizes, kind="stable")]
        out: list = [None if s is None else [] for s in listed]
        if full:
            batch = Batch(np.empty((0, 0)), np.empty(0), np.array([len(listed[i]) for i in full]), np.array(full))
            for i, path in zip(full, viterbi_batch(np.concatenate([listed[i] for i in full]), batch, transitions, begin, end)):
                out[i] = path
        return pa.array(out, pa.list_(pa.int32()))

    return df.withColumn("path", best(scores_col))


def softmax(scores: str):
    """An array of scores as probabilities."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def argmax(scores: str):
    """The zero-based place of the first largest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def train_classifier(df: DataFrame, text_col: str, label_col: str, weight_col: str | None = None, features: int = 1 << 16, rounds: int = 20):
    """A pipeline of word hashing, IDF and logistic regression; its ``transform`` adds ``prediction``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    fit = LogisticRegression(featuresCol="_features", labelCol=label_col, maxIter=rounds, regParam=0.01, **({"weightCol": weight_col} if weight_col else {}))
    steps = [
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        fit,
    ]
    return Pipeline(stages=steps).fit(df)


def balanced_weights(df: DataFrame, label_col: str) -> DataFrame:
    """Adds ``weight`` = N / (2 * n of the row's label)."""
    counts = {r[label_col]: r["count"] for r in df.groupBy(label_col).count().limit(1000).collect()}
    total = sum(counts.values())
    weight = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(total / (2.0 * n)))])
    return df.withColumn("weight", F.element_at(weight, F.col(label_col)))


def run_grid(spark: SparkSession, axes: Mapping[str, Sequence[str]]) -> DataFrame:
    """All combinations of experiment settings, a row each."""
    return spark.createDataFrame(list(product(*axes.values())), ", ".join(f"{k} string" for k in axes))
