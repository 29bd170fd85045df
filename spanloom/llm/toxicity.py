"""Toxic texts by a support vector machine on the gap-weighted subsequence kernel.

Two strings are alike by the subsequences of three characters that they share, each weighing less
the longer it is spread out, so an insult with gaps or inserted characters stays like the insult. The kernel is made finite
by landmarks (Nyström): a string is described by its likeness to some strings of the training sentences, whitened by the
landmarks' own likenesses, and a linear SVM with squared hinge loss is trained on that. Since the kernel is a sum over
subsequences, the trained machine is a weight for each subsequence of the landmarks.

Ratings are of documents, but what makes a text toxic is a word or two. So training takes *sentences*, each with its
document's rating, and counts in how many different sentences of either rating a string stands (copies of a text add nothing).
Strings that stand in toxic sentences only, by far more than chance, are the positive examples, strings of clean sentences the negative ones, those
most like insults first. A text is as toxic as the most toxic of its strings.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import discard, lean, materialize, release, slices

#: Decay of a subsequence's weight for each character that it spans.
DECAY = 0.7
#: Strings are looked at in windows of so many characters, each overlapping the last one by half.
WINDOW = 24
#: What stands for the ends of a string.
BEGIN, END = "\x02", "\x03"
#: Landmarks of either kind, rounds in which misjudged clean strings are added, and how many a round.
LANDMARKS, ROUNDS, HARD = 200, 3, 4000
#: What a toxic string weighs in training, and a variant made from one; a clean string weighs 1.
TOXIC, VARIANT = 3.0, 0.1
#: Margins of tokens that a worker keeps.
KEPT_TOKENS = 400_000
#: Texts that are Python objects at a time, strings of one length that are scored at a time.
GROUP_TEXTS, GROUP_UNITS = 64, 2048
#: Subsequences whose weights are gathered at a time: for each landmark, and summed up.
GATHERED, SUMMED = 1 << 22, 1 << 18
#: Entries of a table of all possible subsequences, which is looked up faster than a sorted list.
DENSE = 1 << 22

#: A sentence ends at a line's end, or at a mark behind a word of two letters at least.
_SENTENCE = re.compile(r"\n+|(?<=\w\w[.!?])\s+")
#: Three or more single letters with blanks between them.
_SPELLED = re.compile(r"(?<!\S)\w(?:[^\S\n]+\w){2,}(?!\w)")
_RUN = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def tokens(text: str) -> set[str]:
    """The distinct lower-cased tokens between white space; characters spelled one by one are one token more."""
    lower = text.lower()
    found = set(lower.split())
    found.update("".join(m.split()) for m in _SPELLED.findall(lower))
    return found


def units(token: str) -> list[str]:
    """What of a token is scored: it without marks at its ends, and its runs of letters, in signs for both ends; long ones in windows."""
    if token.isalpha():
        return windows(token) if len(token) > 2 else []
    bare = _EDGE.sub("", token)
    runs = _RUN.findall(bare)
    return [w for u in dict.fromkeys((bare, *runs)) if len(u) > 2 for w in windows(u)] if runs else []


def windows(string: str) -> list[str]:
    """The string in signs for its ends, cut where it is long."""
    string = BEGIN + string + END
    return [string[k : k + WINDOW] for k in range(0, max(1, len(string) - WINDOW // 2), WINDOW // 2)]


def codes(strings: list[str], length: int) -> np.ndarray:
    """Strings of one length as rows of code points."""
    return np.array(strings, f"<U{length}").view(np.uint32).reshape(-1, length)


def self_likeness(s: np.ndarray) -> np.ndarray:
    """K(s, s) of each row, by dynamic programming over prefixes."""
    n, size = s.shape
    same = (s[:, :, None] == s[:, None, :]).astype(np.float64) * DECAY**2
    at = np.arange(size)
    spread = np.where(at[None, :] >= at[:, None], DECAY ** np.maximum(0, at[None, :] - at[:, None]), 0.0)
    # inner[a][:, b]: subsequences of so many characters of the first a and the first b characters, weighed up to their ends.
    inner = np.ones((size + 1, n, size + 1))
    for _ in range(2):
        longer = np.zeros_like(inner)
        for a in range(1, size + 1):
            longer[a, :, 1:] = DECAY * longer[a - 1, :, 1:] + (same[:, a - 1, :] * inner[a - 1, :, :-1]) @ spread
        inner = longer
    return np.einsum("nab,anb->n", same, inner[:-1, :, :-1])


class Triples:
    """Subsequences of three characters of some strings, numbered; looks up those of other strings."""

    def __init__(self, strings: list[str]):
        self.alphabet = np.unique(np.concatenate([codes([s], len(s))[0] for s in strings]))
        n = len(self.alphabet) + 1
        found: list[dict[int, float]] = []
        for s in strings:
            one: dict[int, float] = {}
            c = np.searchsorted(self.alphabet, codes([s], len(s))[0])
            for i, j, k in itertools.combinations(range(len(s)), 3):
                t = int((c[i] * n + c[j]) * n + c[k])
                one[t] = one.get(t, 0.0) + DECAY ** (k - i + 1)
            found.append(one)
        self.names = np.array(sorted(set().union(*found)), np.int64)
        at = {t: i for i, t in enumerate(self.names.tolist())}
        #: Normalized weights: strings x subsequences.
        self.weights = np.zeros((len(strings), len(self.names)))
        for row, one in zip(self.weights, found):
            for t, w in one.items():
                row[at[t]] = w / math.sqrt(sum(x * x for x in one.values()))

    def spelled(self, s: np.ndarray) -> np.ndarray:
        """The names of all subsequences of rows of code points; characters outside the alphabet are its last."""
        n = len(self.alphabet) + 1
        at = np.searchsorted(self.alphabet, s).clip(max=n - 2)
        at = np.where(self.alphabet[at] == s, at, n - 1)
        i, j, k, _ = _places(s.shape[1])
        return (at[:, i] * n + at[:, j]) * n + at[:, k]

    def lookup(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of code points: the number of each of their subsequences (or one behind the last), and what a place weighs."""
        t = self.spelled(s)
        place = np.searchsorted(self.names, t).clip(max=len(self.names) - 1)
        return np.where(self.names[place] == t, place, len(self.names)), _places(s.shape[1])[3]

    def table(self, weights: np.ndarray) -> np.ndarray | None:
        """Weights by name instead of by number, where the alphabet is small enough for that."""
        size = (len(self.alphabet) + 1) ** 3
        if size > DENSE:
            return None
        out = np.zeros(size)
        out[self.names] = weights[:-1]
        return out


@functools.cache
def _places(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of all subsequences of a string of that length, and what each weighs."""
    i, j, k = np.array(list(itertools.combinations(range(size), 3))).T
    return i, j, k, DECAY ** (k - i + 1.0)


def likeness(strings: list[str], triples: Triples) -> np.ndarray:
    """Normalized kernel of each string (of 3 to WINDOW characters) with each of the landmarks."""
    table = np.vstack([triples.weights.T, np.zeros((1, len(triples.weights)))])
    out = np.zeros((len(strings), table.shape[1]))
    for rows, s in _by_length(strings, GATHERED // table.shape[1]):
        place, weigh = triples.lookup(s)
        out[rows] = np.einsum("ntm,t->nm", table[place], weigh) / np.sqrt(self_likeness(s))[:, None]
    return out


def _by_length(strings: list[str], budget: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """The strings' places and code points, by length, so many at a time that their subsequences are ``budget`` at most or one string's."""
    at: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        at.setdefault(len(s), []).append(i)
    for size, rows in at.items():
        step = max(1, min(GROUP_UNITS, budget // math.comb(size, 3)))
        for k in range(0, len(rows), step):
            yield rows[k : k + step], codes([strings[i] for i in rows[k : k + step]], size)


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps over the rows inside the margin. ``y`` is 1 or -1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x1.shape[1]), np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-9  # the bias is free

    def loss(w: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - y * (x1 @ w)) ** 2).sum() + (penalty * w * w).sum())

    for _ in range(50):
        inside = y * (x1 @ w) < 1
        a, b = x1[inside], weight[inside]
        grad = a.T @ (b * (a @ w - y[inside])) + penalty * w
        step = np.linalg.solve((a * b[:, None]).T @ a + np.diag(penalty), grad)
        rate, before = 1.0, loss(w)
        while rate > 1e-4 and loss(w - rate * step) > before:
            rate /= 2
        w = w - rate * step
        if rate * np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


@dataclass
class ToxicModel:
    """Weights of the landmarks' subsequences, the bias, and the line from margin to log odds."""

    triples: Triples | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    bias: float = -1.0
    slope: float = 4.0
    offset: float = 0.0
    #: The weights by subsequence, made where they are used.
    dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None}

    @classmethod
    def fit(cls, landmarks: list[str], positive: list[str], made: list[str], negative: list[str]) -> ToxicModel:
        """From landmarks, toxic strings, variants made from them, and clean strings."""
        triples = Triples(landmarks)
        own = likeness(landmarks, triples)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        big = values > 1e-6 * values.max()
        whiten = vectors[:, big] / np.sqrt(values[big])
        x = likeness([*positive, *made, *negative], triples) @ whiten
        weight = np.repeat([TOXIC, VARIANT, 1.0], [len(positive), len(made), len(negative)])
        y = np.repeat([1.0, -1.0], [len(positive) + len(made), len(negative)])
        w, bias = fit_svm(x, y, weight)
        folded = np.append((whiten @ w) @ triples.weights, 0.0)
        triples.weights = np.empty((0, 0))  # what goes to the tasks is one weight a subsequence
        return cls(triples, folded, bias)

    @property
    def least(self) -> float:
        """The margin of what is clean beyond doubt: strings outside the machine's margin count alike."""
        return max(self.bias, -1.0)

    def margins(self, strings: list[str]) -> np.ndarray:
        """Signed distances of strings, ``least`` for those below it."""
        out = np.full(len(strings), self.least)
        if self.triples is None:
            return out
        if self.dense is None:
            self.dense = self.triples.table(self.weights)
        for rows, s in _by_length(strings, SUMMED):
            weigh = _places(s.shape[1])[3]
            sums = (self.weights[self.triples.lookup(s)[0]] if self.dense is None else self.dense[self.triples.spelled(s)]) @ weigh
            # K(s, s) is no less than the squares of its subsequences' weights, so the others can't come above ``least``.
            near = np.flatnonzero(self.bias + np.maximum(sums, 0) / math.sqrt(weigh @ weigh) > self.least)
            if len(near):
                exact = self.bias + sums[near] / np.sqrt(self_likeness(s[near]))
                out[np.array(rows)[near]] = np.maximum(exact, self.least)
        return out

    def probability(self, margin: float) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * margin + self.offset))))


class Scorer:
    """Margins of texts; a token that was met is not scored again."""

    def __init__(self, model: ToxicModel):
        self.model, self.kept = model, {}

    def __call__(self, texts: list[str | None]) -> list[float]:
        found = [tokens(t) if t else set() for t in texts]
        new = set().union(*found).difference(self.kept)
        if len(self.kept) + len(new) > KEPT_TOKENS:
            self.kept, new = {}, set().union(*found)
        plain = [t for t in new if t.isalpha() and 2 < len(t) < WINDOW - 1]  # these are one string each
        other = [(t, units(t)) for t in new.difference(plain)]
        scored = self.model.margins([*(BEGIN + t + END for t in plain), *(u for _, us in other for u in us)]).tolist()
        self.kept.update(zip(plain, scored))
        at = len(plain)
        for t, us in other:
            self.kept[t] = max(scored[at : at + len(us)], default=self.model.least)
            at += len(us)
        return [max(map(self.kept.__getitem__, f), default=self.model.least) for f in found]


def _unit_counts(rated: DataFrame) -> DataFrame:
    """``unit, toxic, clean``: in how many different sentences of either rating a string stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, GROUP_TEXTS):
            got: list[list] = [[], [], []]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for sentence in set(_SENTENCE.split(text or "")):
                    found = {u for t in tokens(sentence) for u in units(t)}
                    got[0] += found
                    got[1] += [sentence] * len(found)
                    got[2] += [toxic] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.string()), pa.array([hash_of(s) for s in got[1]], pa.int64()), pa.array(got[2], pa.int32())], ["unit", "sentence", "toxic"])

    each = rated.select("text", "toxic").mapInArrow(lean(run), "unit string, sentence long, toxic int")
    # A sentence that documents of both ratings share speaks for neither.
    once = each.groupBy("unit", "sentence").agg(F.min("toxic").alias("toxic"))
    return once.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def hash_of(sentence: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(sentence.encode()) - (1 << 63)


def variants(unit: str) -> list[str]:
    """The string with a mark between all its letters, with each letter doubled, and with a mark at each place."""
    bare = unit.strip(BEGIN + END)
    out = ["*".join(bare), *[bare[:k] + bare[k - 1] + bare[k:] for k in range(1, len(bare))], *[bare[:k] + "*" + bare[k:] for k in range(1, len(bare))]]
    return [w for u in out for w in windows(u)[:1] if len(u) + 2 <= WINDOW]


def train(
    docs: DataFrame, labels: DataFrame, toxic_docs: int = 4000, clean_docs: int = 12000, most: int = 1000, id_col: str = "doc_id", text_col: str = "text"
) -> ToxicModel:
    """Fit on about ``toxic_docs`` toxic and ``clean_docs`` clean rated documents, taken by the hash of their ids.

    ``labels`` has ``doc_id, toxic``. Rows with a null id or rating are not used, repeated ratings of an id count by their largest, repeated
    rows of an id once. The driver gets at most ``most`` positive strings, some thousands of negative ones, and a number for each sampled
    document. Without toxic or without clean ratings, or without any telling string, the model finds nothing toxic.
    """
    spark = docs.sparkSession
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("rated_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"))
    sizes = {r["toxic"]: r["count"] for r in rows.select("i").join(rated, F.col("i") == F.col("rated_id")).groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return ToxicModel()
    grid = 1 << 24
    share = {g: min(1.0, n / sizes[g]) for g, n in ((1, toxic_docs), (0, clean_docs))}
    limit = F.when(F.col("toxic") == 1, int(grid * share[1])).otherwise(int(grid * share[0]))
    chosen = rated.where(F.pmod(F.xxhash64("rated_id"), F.lit(grid)) < limit)
    picked = rows.join(F.broadcast(chosen), F.col("i") == F.col("rated_id")).select("i", "text", "toxic").dropDuplicates(["i"])
    sample = materialize(picked, "rated")
    counts = materialize(_unit_counts(sample), "units")

    # Chance: a string that has nothing to do with ratings stands in toxic sentences as often as any other.
    n, toxic, clean = counts.agg(F.count("*"), F.sum("toxic"), F.sum("clean")).first()
    if not toxic or not clean:
        discard(sample, counts)
        return ToxicModel()
    odds, need = math.log((toxic + clean) / toxic), math.log(max(n, 2) / 0.01)
    telling = counts.where(F.col("clean") <= 0.02 * F.col("toxic")).orderBy(F.desc("toxic"), "unit")
    positive = [r["unit"] for r in telling.where(F.col("toxic") * odds >= need).limit(most).collect()]
    positive = positive or [r["unit"] for r in telling.where("toxic >= 2").limit(20).collect()]
    if not positive:
        discard(sample, counts)
        return ToxicModel()

    # Strings of clean sentences: of all kinds at first, then those that the machine so far takes for toxic.
    usable = counts.where(F.col("clean") > F.lit(0.1) * F.col("toxic"))
    negative = {r["unit"] for r in usable.orderBy(F.xxhash64("unit"), "unit").limit(HARD).collect()}
    made = [v for u in positive[:LANDMARKS] for v in variants(u)]
    hard = sorted(negative)
    for k in range(ROUNDS + 1):
        model = ToxicModel.fit([*positive[:LANDMARKS], *hard[:LANDMARKS]], positive, made, sorted(negative))
        if k == ROUNDS:
            break
        worst = usable.select("unit").mapInArrow(_unit_margins(model), "unit string, margin double").orderBy(F.desc("margin"), "unit").limit(HARD)
        hard = [r["unit"] for r in worst.collect() if r["margin"] > model.least] or hard
        negative |= set(hard)
    got = score(sample.select(F.col("i").alias("doc_id"), "text", "toxic"), model, carried=("toxic",)).select("margin", "toxic").toArrow()
    margin, label = got.column(0).to_numpy(), got.column(1).to_numpy()
    model.slope, model.offset = _calibrate(margin, label, np.where(label == 1, 1 / share[1], 1 / share[0]))
    discard(sample, counts)
    release()
    return model


def _unit_margins(model: ToxicModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.margins(batch.column(0).to_pylist()))], ["unit", "margin"])

    return lean(run)


def _calibrate(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log odds by Newton's method, with a little ridge that keeps separable cases finite."""
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    weight = weight / weight.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - label)) + 1e-4 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (4.0, 0.0)


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score, predicted, margin`` (and ``carried`` columns) for every row, from its whole text.

    A text without a string of three characters with a letter in it (null and empty texts too) has the least margin there is. Null ids
    stay null, repeated rows give a row each, an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, GROUP_TEXTS):
            margins = scorer(batch.column(1).to_pylist())
            p = [model.probability(m) for m in margins]
            out = [batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(margins, pa.float64())]
            yield pa.RecordBatch.from_arrays([*out, *(batch.column(2 + k) for k in range(len(carried)))], ["doc_id", "score", "predicted", "margin", *carried])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried)
    more = "".join(f", `{c}` {slim.schema[c].dataType.simpleString()}" for c in carried)
    return slim.mapInArrow(lean(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double, predicted int, margin double{more}")
