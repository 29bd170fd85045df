"""Ordinal cumulative-link regression of graded text quality.

All grades share one weight for each hashed text feature, and ordered thresholds
cut the score z into grades: P(grade <= k) = sigmoid(threshold_k - z). That gives an
expected grade and the tail probability P(grade >= k) by which texts are selected.
The model is fitted on a bounded sample of rated documents; scoring reads every
whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import lean, release, slices

#: Letters, or other characters that are neither digits nor white space, in runs.
_RUN = re.compile(r"[^\W\d_]+|[^\w\s]+")
GRADES = 3
#: Letters of a run's beginnings that are features too, so that other forms of a word count.
BEGINNINGS = (4,)
#: Samples that must have a feature for it to get a weight.
MIN_DOCS = 6
#: Features of samples that are summed up at a time: fitting needs little memory beside the sample's.
PART = 1 << 20
#: Texts whose features are Python objects at a time.
GROUP_TEXTS = 256


def features(text: str | None) -> set[int]:
    """32-bit hashes of a text's distinct lower-cased runs, of the beginnings of longer ones, and of how much it repeats and consists of marks."""
    runs = _RUN.findall((text or "").lower())
    if not runs:
        return set()
    found = set(runs)
    hashed = {zlib.crc32(r.encode()) for r in found}
    hashed.update([zlib.crc32(b) for b in {f"\1{r[:k]}".encode() for r in found for k in BEGINNINGS if len(r) > k}])
    marks = sum(1 for r in runs if not r[0].isalpha())
    # Tenths of distinct runs among the first of many, and of runs that are marks.
    spread = int(10 * len(found) / len(runs) ** 0.75) if len(runs) > 20 else 99
    hashed.add(zlib.crc32(b"\0spread %d" % min(spread, 20)))
    hashed.add(zlib.crc32(b"\0marks %d" % int(10 * marks / len(runs))))
    hashed.add(zlib.crc32(b"\0size %d" % min(len(runs).bit_length(), 12)))
    return hashed


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _thresholds(cuts: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logs of the steps."""
    return np.concatenate(([cuts[0]], cuts[0] + np.cumsum(np.exp(cuts[1:]))))


def loss_gradient(params: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Weighted mean of -log P(grade) with a ridge penalty, and its gradient.

    ``params`` has the features' weights, the first threshold and the logs of the steps to the others; sample ``rows[i]`` has
    feature ``cols[i]``; ``y`` are the samples' grades and ``share`` their shares of the mean.
    """
    size, n = len(params) - (GRADES - 1), len(y)
    w, cuts = params[:size], params[size:]
    parts = [slice(k, k + PART) for k in range(0, max(1, len(rows)), PART)]
    z = sum(np.bincount(rows[p], w[cols[p]], n) for p in parts)
    below = _sigmoid(np.concatenate(([-np.inf], _thresholds(cuts), [np.inf]))[None, :] - z[:, None])
    below[:, 0], below[:, -1] = 0, 1
    up, low = below[np.arange(n), y + 1], below[np.arange(n), y]
    p = np.maximum(up - low, 1e-9)
    d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
    dz = (d_up - d_low) * share  # of the loss -log p
    grad = np.empty_like(params)
    grad[:size] = sum(np.bincount(cols[p], dz[rows[p]], size) for p in parts) + ridge * w
    by_cut = np.array([((np.where(y == k + 1, d_low, 0) - np.where(y == k, d_up, 0)) * share).sum() for k in range(GRADES - 1)])
    grad[size] = by_cut.sum()
    grad[size + 1 :] = [by_cut[k + 1 :].sum() * step for k, step in enumerate(np.exp(cuts[1:]))]
    return float(-(share * np.log(p)).sum() + ridge / 2 * (w**2).sum()), grad


@dataclass
class OrdinalModel:
    """Weights of the features that the sample had often enough, and the ordered thresholds."""

    #: Sorted feature hashes and their weights.
    table: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.empty(0, np.uint32), np.empty(0)))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([-1.0, 1.0]))

    @classmethod
    def fit(
        cls,
        samples: list[tuple[np.ndarray, int, float]],
        min_docs: int = MIN_DOCS,
        rounds: int = 300,
        ridge: float = 2e-4,
        rate: float = 0.05,
    ) -> OrdinalModel:
        """From (distinct features, grade, weight), by full-batch Adam on the mean log loss with a ridge penalty.

        Features in fewer than ``min_docs`` samples are not used, whatever the number of samples.
        """
        samples = [s for s in samples if len(s[0])]
        if len({g for _, g, _ in samples}) < 2:
            return cls()
        every = np.sort(np.concatenate([f for f, _, _ in samples]))
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        names = every[first[np.diff(np.append(first, len(every))) >= min_docs]]
        del every, first
        if not len(names):
            return cls()
        kept = []
        for f, _, _ in samples:
            at = np.searchsorted(names, f).clip(max=len(names) - 1)
            kept.append(at[names[at] == f].astype(np.int32))
        rows, cols = np.repeat(np.arange(len(kept), dtype=np.int32), [len(k) for k in kept]), np.concatenate(kept)
        del kept
        y, n = np.array([g for _, g, _ in samples]), len(samples)
        share = np.array([w for _, _, w in samples], float)
        share /= share.sum()
        # Thresholds: the first one and the logs of the steps, which keeps them ordered.
        params = np.zeros(len(names) + GRADES - 1)
        params[len(names)] = -1.0
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, rounds + 1):
            grad = loss_gradient(params, rows, cols, y, share, ridge)[1]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls((names, params[: len(names)].copy()), _thresholds(params[len(names) :]))

    def score(self, text: str | None) -> tuple[float, list[float]]:
        """Expected grade and P(grade >= k) for k from 1; a text without features has grade 0."""
        found = features(text)
        if not found:
            return 0.0, [0.0] * (GRADES - 1)
        names, weights = self.table
        found = np.fromiter(found, np.uint32, len(found))
        found.sort()
        at = np.searchsorted(names, found).clip(max=max(len(names) - 1, 0))
        z = float(weights[at[names[at] == found]].sum()) if len(names) else 0.0
        tails = (1 - _sigmoid(self.thresholds - z)).tolist()
        return sum(tails), tails


def train(docs: DataFrame, labels: DataFrame, rated_per_grade: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on about ``rated_per_grade`` rated documents of each grade, taken by the hash of their ids.

    Sampled documents weigh as many as they stand for. ``labels`` has ``doc_id, quality,
    toxic``. The grade is 0 for a toxic text, 2 for a good and not toxic one, else
    1. Rows with a null id, or with both ratings null, are not used (one null
    counts as 0); repeated labels of an id count by their smallest grade, and repeated rows of
    a rated id are samples each. Without labels, or with one grade only, the model has no weights.
    """
    toxic, good = F.coalesce(F.col("toxic"), F.lit(0)), F.coalesce(F.col("quality"), F.lit(0))
    rated = (
        labels.where(F.col("doc_id").isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull()))
        .select("doc_id", F.when(toxic == 1, 0).when(good == 1, 2).otherwise(1).alias("grade"))
        .groupBy(F.col("doc_id").alias("rated_id"))
        .agg(F.min("grade").alias("grade"))
    )
    sizes = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}  # three rows at most
    if len(sizes) < 2:
        return OrdinalModel()
    grid = 1 << 24
    share = {g: min(1.0, rated_per_grade / n) for g, n in sizes.items()}
    shares = F.create_map(*[x for g, s in share.items() for x in (F.lit(g), F.lit(int(grid * s)))])
    chosen = rated.where(F.pmod(F.xxhash64("rated_id"), F.lit(grid)) < F.element_at(shares, F.col("grade")))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("i") == F.col("rated_id")).select("i", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, GROUP_TEXTS):
            found = [np.array(sorted(features(t)), "<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["i", "grade", "features"])

    got = rows.mapInArrow(lean(run), f"i {rows.schema['i'].dataType.simpleString()}, grade int, features binary").toLocalIterator()
    samples = sorted((r["i"], r["grade"], bytes(r["features"])) for r in got)
    model = OrdinalModel.fit([(np.frombuffer(f, "<u4"), g, 1 / share[g]) for _, g, f in samples])
    del samples
    release()
    return model


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """``doc_id, expected_grade, p_fair, p_good, keep`` for every row, from its whole text.

    ``keep`` is P(grade = 2) >= ``least``. A null text, or one without a letter or
    mark, has grade 0 and is not kept. Null ids stay null, repeated rows give a row
    each, an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, GROUP_TEXTS):
            found = [model.score(t.as_py()) for t in batch.column(1)]
            grade, fair, good = [e for e, _ in found], [t[0] for _, t in found], [t[1] for _, t in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.float64()) for c in (grade, fair, good)), pa.array([g >= least for g in good], pa.bool_())],
                ["doc_id", "expected_grade", "p_fair", "p_good", "keep"],
            )

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(lean(run), f"doc_id {kind}, expected_grade double, p_fair double, p_good double, keep boolean")


def select(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least: float = 0.6) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, all columns as they are; the whole row passes through Python once.

    Rows with a null text, or one without a letter or mark, go. Repeated rows are judged each, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, GROUP_TEXTS):
            good = [model.score(t.as_py())[1][-1] >= least for t in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(lean(run), docs.schema)
