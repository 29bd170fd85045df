"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word's likelihood is the sum over all of its segmentations into pieces, found by a
forward algorithm that rescales its sums as it goes, so that a run of letters may have any
length; piece probabilities are fitted by expectation maximisation, with the backward pass
giving expected piece counts. Words of one length are scored together, all languages at once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import lean, slices
from spanloom.llm.piece_model import SPACE, PieceModel

#: Maximal runs of letters.
WORD = re.compile(r"[^\W\d_]+")
#: Longer words are scored like any other, but are not learned from and not kept.
LONG_WORD = 64
#: Places between two rescalings of the forward sums.
RESCALE = 16
#: A model has no more languages than this.
MOST_LANGUAGES = 1000
#: Probability of a letter that is no piece, the same in all languages.
FOREIGN = 1e-7


class Pieces:
    """The letters-only pieces of a public vocabulary, optionally at a word's start."""

    def __init__(self, path: str):
        found = PieceModel(path).ids
        self.ids = {p: k for k, p in enumerate(sorted(p for p in found if p.strip(SPACE).isalpha() and p == p.lower()))}
        self.longest = max(map(len, self.ids))
        #: After all pieces: no piece, and a letter that is no piece.
        self.none, self.foreign = len(self.ids), len(self.ids) + 1
        self.size = len(self.ids) + 2

    def lattice(self, words: list[str]) -> np.ndarray:
        """For words of one length: the piece of each length that ends at each place, shape (words, places, lengths)."""
        get, none, n, longest = self.ids.get, self.none, len(words[0]), self.longest
        spans = [(e, k) for e in range(1, n + 1) for k in range(1, min(longest, e) + 1)]
        out = np.full((len(words), n + 1, longest + 1), none, np.int32)
        flat = np.array([[get(w[e - k : e], none) for e, k in spans] for w in words], np.int32)
        ends, lengths = np.array(spans).T
        out[:, ends, lengths] = flat
        one = out[:, 1:, 1]
        one[one == none] = self.foreign
        return out


def _forward(lattice: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums over the segmentations of each prefix, shape (places, words, languages); ``p``: (pieces, languages)."""
    words, places, width = lattice.shape
    a = np.zeros((places, words, p.shape[1]))
    a[0] = 1
    for e in range(1, places):
        for k in range(1, min(width - 1, e) + 1):
            a[e] += a[e - k] * p[lattice[:, e, k]]
    return a


def log_likelihoods(lattice: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logs of the sums over all segmentations of whole words of any length, shape (words, languages)."""
    words, places, width = lattice.shape
    recent, log = [np.ones((words, p.shape[1]))], np.zeros((words, p.shape[1]))
    for e in range(1, places):
        total = np.zeros_like(log)
        for k in range(1, min(width - 1, e) + 1):
            ids = lattice[:, e, k]
            if (some := np.flatnonzero(ids != len(p) - 2)).size:  # no piece: nothing to add
                total[some] += recent[-k][some] * p[ids[some]]
        recent = [*recent[2 - width :], total] if width > 2 else [total]
        if e % RESCALE == 0 or e == places - 1:
            high = np.maximum.reduce(recent)
            log += np.log(high)
            recent = [r / high for r in recent]
    return log + np.log(recent[-1])


def _expected(lattice: np.ndarray, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words that occur ``weights`` (words, languages) times."""
    a = _forward(lattice, p)
    places = len(a)
    b = np.zeros_like(a)
    b[-1] = 1
    for e in range(places - 1, 0, -1):
        for k in range(1, min(lattice.shape[2] - 1, e) + 1):
            b[e - k] += b[e] * p[lattice[:, e, k]]
    scale = np.divide(weights, a[-1], out=np.zeros_like(weights), where=a[-1] > 0)
    out = np.zeros_like(p)
    for e in range(1, places):
        for k in range(1, min(lattice.shape[2] - 1, e) + 1):
            ids = lattice[:, e, k]
            np.add.at(out, ids, a[e - k] * p[ids] * b[e] * scale)
    return out


def split_words(text: str | None) -> list[str]:
    """Lower-cased marked words."""
    return [SPACE + w for w in WORD.findall((text or "").lower())]


class LanguageModel:
    """Piece probabilities by language."""

    def __init__(self, pieces: Pieces, languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = pieces, languages, p
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    @classmethod
    def fit(cls, pieces: Pieces, counts: dict[str, dict[str, int]], rounds: int = 3, smooth: float = 0.05) -> LanguageModel:
        """From word counts by language."""
        languages = sorted(counts)
        weights: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
        for k, lang in enumerate(languages):
            for w, n in counts[lang].items():
                weights[w][k] = n
        p = np.full((pieces.size, len(languages)), 1.0 / pieces.size)
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in weights:
            by_length[len(w)].append(w)
        groups = [(pieces.lattice(ws), np.array([weights[w] for w in ws])) for ws in by_length.values()]
        for _ in range(rounds):
            p[pieces.none] = 0
            p[pieces.foreign] = FOREIGN
            n = sum((_expected(lattice, p, w) for lattice, w in groups), np.zeros_like(p)) + smooth
            n[pieces.none :] = 0
            p = n / n.sum(axis=0)
        p[pieces.foreign] = FOREIGN
        return cls(pieces, languages, p)

    def learn(self, words: set[str], most: int = 300_000) -> dict[str, np.ndarray]:
        """Log likelihoods of words that are not known yet; the number kept is bounded, long ones are only returned."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > most:
            self.known, self.scores, new = {}, self.scores[:0], words
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in new:
            by_length[len(w)].append(w)
        scores, once = [self.scores], {}
        for n, ws in by_length.items():
            for i in range(0, len(ws), step := max(1, (1 << 17) // n)):
                part = ws[i : i + step]
                found = np.maximum(log_likelihoods(self.pieces.lattice(part), self.p), -1e4 * n)
                if n > LONG_WORD:
                    once.update(zip(part, found))
                else:
                    self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
                    scores.append(found)
        self.scores = np.concatenate(scores)
        return once

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share of the likelihood) of each text; ``und`` and 0 without a letter."""
        split = [split_words(t) for t in texts]
        once = self.learn(set().union(*split))
        out = []
        for words in split:
            if not self.languages or not any(ch.isalpha() for w in words for ch in w):
                out.append(("und", 0.0))
                continue
            total = self.scores[[self.known[w] for w in words if w in self.known]].sum(axis=0)
            for w in words if once else ():
                if w in once:
                    total = total + once[w]
            best = int(total.argmax())  # on ties the first in alphabetical order
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def train(docs: DataFrame, model_path: str, docs_per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on about ``docs_per_language`` documents of each language, taken by the hash of their ids.

    Rows with a null text or language are not used; more than ``MOST_LANGUAGES`` languages
    raise, none give a model that predicts ``und``. Words of more than ``LONG_WORD`` characters are
    not learned from. Only the sample's word counts come to the driver; their number is bounded by the sample.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("t").isNotNull() & F.col("lang").isNotNull()
    )
    sizes = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if not sizes:
        return LanguageModel.fit(Pieces(model_path), {})
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    grid = 1 << 20
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(docs_per_language * grid / r["count"]))])
    sample = rows.where(F.pmod(F.xxhash64("i"), F.lit(grid)) < F.element_at(share, F.col("lang"))).select("lang", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                for w in split_words(text):
                    if len(w) <= LONG_WORD:
                        found[lang, w] += 1
            if found:
                langs, words = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in sample.mapInArrow(lean(run), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    return LanguageModel.fit(Pieces(model_path), counts)


def predict(docs: DataFrame, model: LanguageModel, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row from its whole text.

    ``score`` is the likelihood's share among the languages. A text that is null or
    has no letter, or a model without languages, gives ``und`` and 0. Ties go
    to the alphabetically first language. Null ids stay null, repeated rows give a row each, an
    empty table gives none; other columns are not read.
    """
    p, languages = model.p.astype(np.float32), model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(Pieces(model_path), languages, p.astype(np.float64))
        for part in slices(batches, 256):
            langs, scores = zip(*own.predict(part.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lean(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
