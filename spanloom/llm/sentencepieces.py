"""SentencePiece encoding and decoding with a public model file.

Each Arrow batch's distinct marked words are sorted, which is their trie in
depth-first order, and segmented by a Viterbi search that keeps the forward values
of the prefix shared with the word before (see ``piece_model``). Texts are then
put together from their words' ids. Words stay known from batch to batch up to
a bound.
"""

from __future__ import annotations

import array
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.common import slices, worker_keeps
from spanloom.llm.piece_model import SPACE, PieceModel, Segmenter, words_of

#: Texts whose words are sorted together: the more, the more prefixes are shared.
GROUP_TEXTS = 1024


class Codec:
    """Encodes texts to piece ids and back.

    Words stay known up to ``max_words``, the first ones met, which are the frequent
    ones; longer ones than ``max_chars`` are segmented each time, so memory is bounded.
    """

    def __init__(self, path: str, max_words: int = 120_000, bpe: bool | None = None, max_chars: int = 64):
        self.model = PieceModel(path)
        self.segmenter, self.max_words, self.max_chars = Segmenter(self.model, bpe), max_words, max_chars
        #: Unit (see ``units``) to the bytes of its ids.
        self.known: dict[str, bytes] = {}
        bytes_of = {i: b for b, i in self.model.byte_ids.items()}
        self.raw = [
            bytes([bytes_of[i]]) if i in bytes_of else p.replace(SPACE, " ").encode() if self.model.kinds[i] == 1 else b""
            for i, p in enumerate(self.model.pieces)
        ]
        self.raw[self.model.unknown] = " ⁇ ".encode()

    @staticmethod
    def units(text: str) -> list[str] | None:
        """Words without their blank, line feeds before what follows them; None where blanks come in runs."""
        if "  " in text or text[:1] == " " or SPACE in text:
            return None
        return text.replace("\n", " \n").split(" ")

    def _ids(self, unit: str) -> bytes:
        return array.array("I", self.segmenter.segment(unit if unit[:1] == "\n" else SPACE + unit)).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.units(t) for t in texts]
        known = self.known
        new = sorted(set().union(*filter(None, split)).difference(known))
        for unit in new:
            known[unit] = self._ids(unit)
        get = known.__getitem__
        out = [
            b"" if not text else b"".join(map(get, units)) if units else array.array("I", [i for w in words_of(text) for i in self.segmenter.segment(w)]).tobytes()
            for text, units in zip(texts, split)
        ]
        full = len(known) > self.max_words
        for unit in new:
            if full or len(unit) > self.max_chars:
                del known[unit]
        return out

    def encode(self, text: str) -> list[int]:
        return list(array.array("I", self.encode_all([text])[0]))

    def decode(self, ids) -> str:
        """The text of ids; the blank put before the first word goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _lists(found: list[bytes], nulls: list[bool] | None = None) -> pa.ListArray:
    """Lists of ids from their bytes, without a Python object for each id."""
    ends = np.cumsum([0] + [len(b) // 4 for b in found], dtype=np.int32)
    mask = None if nulls is None else pa.array(nulls, pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)), mask=mask)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) for every row.

    A null text has null ids, an empty one none. Ids equal the SentencePiece
    library's for the model. Null ids of documents stay null, repeated rows give a row each, an
    empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_keeps(Codec, model_path)
        for part in slices(batches, GROUP_TEXTS):
            texts = part.column(1).to_pylist()
            found = codec.encode_all([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(found, [t is None for t in texts])], ["doc_id", "ids"])

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids; null ids give a null text. Ids that the model lacks raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_keeps(Codec, model_path)
        for part in slices(batches, GROUP_TEXTS):
            texts = [None if i is None else codec.decode(i) for i in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    slim = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = 120_000) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_crc32, decoded_sha256, same`` for every row: the ids, and what they decode to.

    A null text counts as empty and has no ids. ``ids_crc32`` is of the ids as little-endian
    unsigned 32-bit integers, ``decoded_sha256`` of the decoded text, and ``same`` says whether that is
    the text itself. Repeated rows give a row each, an empty table gives none. One pass; a worker
    keeps the ids of up to ``max_words`` words, which changes its memory and time only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_keeps(Codec, model_path, max_words)
        for part in slices(batches, GROUP_TEXTS):
            texts = [t or "" for t in part.column(1).to_pylist()]
            found, rows = codec.encode_all(texts), []
            for text, ids in zip(texts, found):
                back = codec.decode(memoryview(ids).cast("I"))
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text))
            n, crc, sha, same = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), _lists(found), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)],
                ["doc_id", "ids", "n_tokens", "ids_crc32", "decoded_sha256", "same"],
            )

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, same boolean")
