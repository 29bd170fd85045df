"""Context-triggered piecewise hashing of texts.

A rolling hash over the last bytes ends a chunk wherever it is congruent to -1
modulo the block size; each chunk's hash is one symbol of the signature. Block
sizes are 3 times powers of two, so that signatures of texts of one size or of twice
the size can be compared. The fingerprint holds the signatures at a block size and
at its double. Likeness is one minus the edit distance (insertions and
deletions) over the signatures' joint length, at the best common block size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import lean, materialize, shuffle_partitions, slices

WINDOW = 7
MIN_BLOCK = 3
SIGNATURE = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = [a + b for a in ALPHABET for b in ALPHABET]
#: A fixed pseudo-random number for each byte value (multiplicative hashing).
_BYTES = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.uint32)


def rolling(data: bytes) -> np.ndarray:
    """Cyclic-polynomial hash of the (at most) seven bytes that end at each byte."""
    x = _BYTES[np.frombuffer(data, np.uint8)]
    h = x.copy()
    for k in range(1, min(WINDOW, len(x))):
        r = np.uint32(5 * k % 32)
        y = x[:-k]
        h[k:] ^= (y << r) | (y >> np.uint32(32 - int(r)))
    # Mix, so that the remainders by small block sizes depend on all bits.
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def _signature(data: bytes, ends: np.ndarray) -> str:
    view, start, out = memoryview(data), 0, []
    for end in ends.tolist():
        out.append(_PAIRS[zlib.crc32(view[start:end]) & 4095])
        start = end
    if start < len(data):
        out.append(_PAIRS[zlib.crc32(view[start:]) & 4095])
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """``block:signature:signature at twice the block``, two characters a chunk; ``3::`` for an empty text."""
    data = (text or "").encode()
    block = MIN_BLOCK
    while block * SIGNATURE < len(data):
        block *= 2
    if not data:
        return f"{block}::"
    h = rolling(data)

    def ends(b: int) -> np.ndarray:
        return np.flatnonzero(h % np.uint32(b) == np.uint32(b - 1)) + 1

    cuts = ends(block)
    while block > MIN_BLOCK and len(cuts) < SIGNATURE // 2:  # too few chunks: a smaller block
        block //= 2
        cuts = ends(block)
    return f"{block}:{_signature(data, cuts)}:{_signature(data, ends(2 * block))}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit of an integer for each symbol of ``a``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & places.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _likeness(a: str, b: str) -> float:
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    return 2 * _common(x, y) / (len(x) + len(y)) if x or y else 1.0


def likeness(a: str, b: str) -> float:
    """Likeness from 0 to 1 of two fingerprints; 0 where their block sizes are not compatible."""
    if a == b:
        return 1.0
    (p, a1, a2), (q, b1, b2) = a.split(":"), b.split(":")
    if p == q:
        return max(_likeness(a1, b1), _likeness(a2, b2))
    if int(p) == 2 * int(q):
        return _likeness(a1, b2)
    if int(q) == 2 * int(p):
        return _likeness(a2, b1)
    return 0.0


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness, a row for every row of ``docs``.

    The next document is the one before in ascending id order (after the
    smallest id comes the largest; a single document follows itself). The edited
    text has its last third of code points replaced by as many of the next
    text's first ones, or all of them. A null text counts as empty, two empty texts are
    alike (1.0); a null id comes last, and rows that repeat an id follow each
    other in order of text hash. An empty table gives no rows; other columns are
    not read. Ids are cast to bigint: one that is no number raises.

    Texts are shuffled once, to ranges of ids, and streamed in order; a worker holds two at
    a time. A range's last row waits for the first one of the next range that has
    rows: those rows, two a range, are put aside and meet in a join afterwards.
    """
    n = shuffle_partitions(docs.sparkSession)
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), rank.alias("rank"), F.col(text_col).alias("text"))
    ordered = slim.repartitionByRange(n, F.col("rank").desc()).sortWithinPartitions(F.col("rank").desc(), F.xxhash64("text")).select("doc_id", "text")
    rows = materialize(ordered.mapInArrow(lean(_stream), f"{SCHEMA}, part int, role int, text string"), "fingerprints")
    heads = rows.where(F.col("role") == HEAD).select(F.col("part").alias("next"), F.col("text").alias("following"))
    # A row a range, of numbers only, in one place; behind the last range comes the first.
    parts = heads.select(F.col("next").alias("part"))
    every = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(every), F.first("part").over(every)).alias("next"))
    open_ends = rows.where(F.col("role") == TAIL).select("doc_id", "text", "part").join(F.broadcast(after), "part").join(heads, "next").select("doc_id", "text", "following")
    return rows.where(F.col("role") == DONE).select(*_NAMES).unionByName(open_ends.mapInArrow(lean(_close), SCHEMA))


DONE, HEAD, TAIL = 0, 1, 2


def _batch(rows: list[tuple], part: int, role: int, text: str | None = None) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)]
    n = len(rows)
    return pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.array([role] * n, pa.int32()), pa.array([text] * n, pa.string())], [*_NAMES, "part", "role", "text"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: those whose next one is in it, and its first and last text."""
    part, held = TaskContext.get().partitionId(), None
    for batch in slices(batches, 256):
        rows = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = (doc_id, text or "", fingerprint(text))
            if held is None:
                yield _batch([(doc_id, *[None] * 6)], part, HEAD, own[1])
            else:
                rows.append(_row(held, own[1], own[2]))
            held = own
        if rows:
            yield _batch(rows, part, DONE)
    if held is not None:
        yield _batch([(held[0], *[None] * 6)], part, TAIL, held[1])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        rows = [_row((doc_id, text, fingerprint(text)), following) for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _row(own: tuple, following: str, next_print: str | None = None) -> tuple:
    doc_id, text, print_ = own
    edited = edit(text, following)
    edited_print = fingerprint(edited)
    next_print = fingerprint(following) if next_print is None else next_print
    sha = hashlib.sha256(edited.encode()).hexdigest()
    return doc_id, len(text), sha, print_, edited_print, likeness(print_, edited_print), likeness(print_, next_print)
