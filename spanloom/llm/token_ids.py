"""Token ids in plane-shuffled binary segments.

A segment holds the ids of consecutive documents as unsigned 32-bit integers in
blocks of a fixed size. Each block is transposed into byte planes (or bit planes)
and every plane is compressed with zstandard; the segment's index lists where each
block's planes end. Segments are rows of a Parquet table in the shared folder, in
ascending document order within files that are numbered by range partition, so a
lost task's file is written anew by Spark's commit protocol.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, shuffle_partitions, slices, worker_keeps

BLOCK_IDS = 1 << 14
SEGMENT_IDS = 1 << 18
SEGMENT_DOCS = 1 << 14
#: Texts whose new words are encoded together, each once, and words that the library gets in a row.
GROUP_TEXTS = 1024
UNITS_IN_A_ROW = 256
#: A blank as the first character of a byte-level piece.
BLANK = "\u0120"
#: White space but the blank and the line feed.
ODD_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
SEGMENT_SCHEMA = (
    "part int, segment int, first_id bigint, n_ids bigint, block_ids int, plane_bits int, "
    "doc_ids array<bigint>, doc_lengths array<bigint>, plane_ends array<bigint>, payload binary"
)


def _planes(block: np.ndarray, bits: int) -> list[bytes]:
    raw = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [raw[:, k].tobytes() for k in range(4)]
    each = np.unpackbits(raw, axis=1)
    return [np.packbits(each[:, k]).tobytes() for k in range(32)]


def _block(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        raw = np.packbits(np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1), axis=1)
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def pack(ids: np.ndarray, bits: int = 8, block_ids: int = BLOCK_IDS, level: int = 1) -> tuple[bytes, list[int]]:
    """Payload of a segment and the offsets at which its planes end (block by block)."""
    if bits not in (1, 8):
        raise ValueError("planes are of 1 or 8 bits")
    zip_ = zstandard.ZstdCompressor(level=level).compress
    parts = [zip_(p) for i in range(0, len(ids), block_ids) for p in _planes(ids[i : i + block_ids], bits)]
    return b"".join(parts), np.cumsum([len(p) for p in parts], dtype=np.int64).tolist()


def unpack(payload: bytes, ends: list[int], n_ids: int, bits: int = 8, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The ids of a segment."""
    unzip, per = zstandard.ZstdDecompressor().decompress, 32 // bits
    starts, out = [0, *ends[:-1]], []
    for k in range(0, len(ends), per):
        n = min(block_ids, n_ids - (k // per) * block_ids)
        out.append(_block([unzip(payload[a:b]) for a, b in zip(starts[k : k + per], ends[k : k + per])], n, bits))
    return np.concatenate(out) if out else np.empty(0, "<u4")


class UnitEncoder:
    """A byte-level BPE of the tokenizers library that keeps the ids of words it has met.

    The library splits text before every single blank that stands between
    other characters, and around a single line feed; texts with other runs of
    white space, or with a special token's string, go to the library whole. Up to
    ``max_units`` words are kept, the first ones met, which are the frequent ones; none
    of more than ``max_chars`` characters is, so memory is bounded.
    """

    def __init__(self, path: str, max_units: int = 600_000, max_chars: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        before = self.tokenizer.pre_tokenizer
        self.plain = (
            type(before).__name__ == "ByteLevel" and not before.add_prefix_space and before.use_regex and self.tokenizer.normalizer is None
        )
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        special = "|".join(map(re.escape, self.special))
        self.regular = re.compile(rf"(?!.*(?:{special}))\n?\S+" if special else r"\n?\S+").fullmatch
        #: Ids of pieces that begin with a blank.
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for piece, i in vocabulary.items() if piece[:1] == BLANK]] = True
        #: None for a unit whose text must go to the library whole.
        self.known: dict[str, bytes | None] = {}
        self.max_units, self.max_chars = max_units, max_chars

    def _run(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> dict[str, bytes]:
        """Ids of regular units. Those behind a blank are encoded many in a row: only their first pieces begin with one."""
        found = {}
        if lines := [u for u in units if u[0] == "\n"]:
            found.update(zip(lines, self._run(lines)))
            units = [u for u in units if u[0] != "\n"]
        for i in range(0, len(units), UNITS_IN_A_ROW):
            part = units[i : i + UNITS_IN_A_ROW]
            ids = np.array(self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False).ids, "<u4")
            ends = [*(np.flatnonzero(self.begins[ids]) * 4).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            found.update(zip(part, [raw[a:b] for a, b in zip(ends, ends[1:])]))
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.plain:
            return self._run(texts)
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        seen: set[str] = set()
        for units in split:
            seen.update(units[1:])
        new = list(seen.difference(self.known))
        joined = "\n".join(texts)
        # Without special tokens and odd white space only empty units and lone line feeds are irregular.
        usual = not any(x in joined for x in (*self.special, *ODD_BLANKS))
        regular = [u for u in new if u and u != "\n"] if usual else [u for u in new if self.regular(u)]
        if len(regular) < len(new):
            self.known.update(dict.fromkeys(new))
        self.known.update(self._units(regular))
        firsts, get, out = self._run([units[0] for units in split]), self.known.__getitem__, []
        for text, units, first in zip(texts, split, firsts):
            try:
                if units[0] and not self.regular(units[0]):
                    raise TypeError
                out.append(first + b"".join(map(get, units[1:])))
            except TypeError:  # a unit without ids of its own
                out.append(self._run([text])[0])
        full = len(self.known) > self.max_units
        for u in new:
            if full or len(u) > self.max_chars:
                del self.known[u]
        return out


def write_token_ids(
    docs: DataFrame, tokenizer_path: str, end_id: int, bits: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the segments of all documents in ascending id order; the table of segments, read back.

    Every document's ids are followed by ``end_id``. A null or empty text has the
    end id only. Null ids come first; repeated rows are documents of their own,
    in order of text hash. An empty table gives no segments. Other columns are not read. The
    tokenizer file must be at ``tokenizer_path`` on every executor.
    """
    n = shuffle_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_keeps(UnitEncoder, tokenizer_path), TaskContext.get().partitionId()
        end = np.asarray([end_id], "<u4").tobytes()
        done = segment = pending = 0
        doc_ids: list = []
        lengths: list[int] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal done, segment, pending
            ids = np.frombuffer(b"".join(held), "<u4")
            payload, ends = pack(ids, bits)
            row = (part, segment, done, len(ids), BLOCK_IDS, bits, doc_ids.copy(), lengths.copy(), ends, payload)
            done, segment, pending = done + len(ids), segment + 1, 0
            held.clear(), doc_ids.clear(), lengths.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            names = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for rows in slices(batches, GROUP_TEXTS):
            for i, ids in zip(rows.column(0).to_pylist(), encoder.encode_all([t or "" for t in rows.column(1).to_pylist()])):
                held.append(ids + end)
                doc_ids.append(i)
                lengths.append(len(ids) // 4 + 1)
                pending += lengths[-1]
                if pending >= SEGMENT_IDS or len(lengths) >= SEGMENT_DOCS:
                    yield flush()
        if held:
            yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = slim.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(run, SEGMENT_SCHEMA), "token-ids")


def read_token_ids(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in a table of segments.

    ``start`` counts the ids of all documents before; only one number for each
    part of the table is summed up in one place and broadcast.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["plane_ends"], row["n_ids"], row["plane_bits"], row["block_ids"])
                lengths = np.asarray(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist())]
                start = ends - lengths + row["first_id"] + row["part_start"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = segments.join(F.broadcast(offsets), "part").drop("part", "segment")
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
