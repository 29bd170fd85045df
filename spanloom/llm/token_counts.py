"""Token counts by a tokenizer compiled to a deterministic transducer.

A state is what the segmentation so far leaves open: the last characters that may
still grow into a piece, and for each place among them where such a piece would
begin, the piece that ends there and the count there, relative to the present one.
A transition reads a character and carries the change of the token count.
Transitions are compiled when first met; their number is bounded.

Texts are cut into chunks of equal length, wherever that falls. What a chunk does is a
map from the incoming state to the outgoing one and a count. Behind the first
place where the transducer is back at its start whatever came before (a blank after
another character, a character spelled in bytes, the end of a text) the map is constant, so
all chunks run side by side from there on. The maps of the parts before such places, and of chunks without one, are
composed along the text: each is evaluated at the state that the map before gives, all of them side by side, beginning with a
guess where that is not known yet, and again only where it turns out another. A chunk mostly forgets what
came before it, so that two rounds do; a chain that never forgets costs as many rounds as chunks, and stays right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import slices, worker_keeps
from spanloom.llm.piece_model import SPACE, PieceModel, Segmenter

CHUNK_CHARS = 256
#: Characters that are read side by side: a text is never cut here, so one longer text is a group of its own.
GROUP_CHARS = 1 << 20
GROUP_TEXTS = 512
#: Fewer lanes than this are run one after the other.
FEW_LANES = 12
#: Ends a text; beyond all code points.
END = 0x110000
_CODE_BITS = 21
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_EMIT_BITS, _EMIT_ZERO = 16, 1 << 15


class _Steps:
    """(state, character) to (state, emitted tokens), as an open-addressing table that grows."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the places of keys that are missing."""
        at = self._slots(keys)
        found = self.keys[at]
        values = self.values[at]
        todo = np.flatnonzero(found != keys)
        missing = []
        mask = (1 << self.bits) - 1
        at = at[todo]
        while len(todo):
            empty = self.keys[at] == -1
            missing.append(todo[empty])
            todo, at = todo[~empty], (at[~empty] + 1) & mask
            hit = self.keys[at] == keys[todo]
            values[todo[hit]] = self.values[at[hit]]
            todo, at = todo[~hit], at[~hit]
        return values, np.concatenate(missing) if missing else todo

    def one(self, key: int) -> int | None:
        mask = (1 << self.bits) - 1
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)
        while (k := self.keys[at].item()) != key:
            if k == -1:
                return None
            at = at + 1 & mask
        return self.values[at].item()

    def put(self, key: int, value: int) -> None:
        if 2 * self.n >= 1 << self.bits:
            old = self.keys >= 0
            keys, values = self.keys[old], self.values[old]
            self.__init__(self.bits + 1)
            for k, v in zip(keys.tolist(), values.tolist()):
                self._place(k, v)
        self._place(key, value)

    def _place(self, key: int, value: int) -> None:
        mask = (1 << self.bits) - 1
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)
        while self.keys[at] != -1:
            at = at + 1 & mask
        self.keys[at], self.values[at] = key, value
        self.n += 1


class CountTransducer:
    """Counts a BPE model's pieces in whole texts."""

    def __init__(self, segmenter: Segmenter, max_steps: int = 1_000_000):
        if not segmenter.bpe:
            raise ValueError("only a BPE model's segmentation is a finite-state function of the prefix")
        seg = self.segmenter = segmenter
        self.max_steps = max_steps
        blank = [p for p in seg.ids if SPACE in p[1:]]
        rest = [seg.model.scores[i] for p, i in seg.ids.items() if len(p) > 1 and SPACE not in p[1:]]
        if any(p.strip(SPACE) for p in blank) or (blank and rest and max(seg.model.scores[seg.ids[p]] for p in blank) >= min(rest)):
            raise ValueError("only models whose runs of blanks merge last, and with nothing else, are supported")
        #: Tokens of a run of blanks: up to twice the longest such piece; beyond, each further longest piece adds one.
        self.run = max((len(p) for p in blank), default=1)
        self.blanks = [len(seg.merge(SPACE * k)) if k else 0 for k in range(4 * self.run + 2)]
        if any(self.blanks[k + self.run] != self.blanks[k] + 1 for k in range(self.run, 3 * self.run + 2)):
            raise ValueError("runs of blanks are not periodic")
        #: What could still grow into a longer piece.
        self.open = {p[:k] for p in seg.ids if seg.ids[p] in seg.stable and SPACE not in p[1:] for k in range(1, len(p))}
        self.is_char = np.zeros(END + 1, bool)
        self.is_char[[ord(c) for c in seg.chars]] = True
        self._reset()

    def _reset(self) -> None:
        #: Open characters; (place, piece before it, count there less the present one) for each open place, the present one last; blanks in a row.
        self.info: list[tuple[str, tuple[tuple[int, int, int], ...], int]] = [("", ((0, -1, 0),), 0)]
        self.numbers = {self.info[0]: 0}
        self.steps = _Steps()

    def _number(self, info: tuple) -> int:
        number = self.numbers.setdefault(info, len(self.info))
        if number == len(self.info):
            self.info.append(info)
        return number

    def _compile(self, key: int) -> int:
        """The step of a key: 2 ** 16 times the next state, plus the emitted tokens and 2 ** 15."""
        state, code = key >> _CODE_BITS, key & (1 << _CODE_BITS) - 1
        seg, (window, places, run) = self.segmenter, self.info[state]
        if code == END:
            number, emit = 0, 0
        elif not self.is_char[code]:  # spelled in bytes
            number, emit = 0, len(chr(code).encode()) if len(seg.model.byte_ids) == 256 else 1
        elif chr(code) == SPACE:  # state 0, or a run that goes on
            longer = run + 1 if run <= 2 * self.run else run + 1 - self.run
            emit = self.blanks[longer] - self.blanks[longer - 1]
            piece = seg.ids[SPACE]
            number = self._number((SPACE, ((0, -1, -emit), (1, piece, 0)), longer))
        else:
            text = window + chr(code)
            for start, last, before in places:
                piece = seg.ids.get(text[start:], -1)
                if piece in seg.stable and (last < 0 or seg._agree(last, piece)):
                    break
            emit = before + 1
            live = [(s, p, c - emit) for s, p, c in places if text[s:] in self.open]
            cut = live[0][0] if live else len(text)
            number = self._number((text[cut:], (*[(s - cut, p, c) for s, p, c in live], (len(text) - cut, piece, 0)), 0))
        return number << _EMIT_BITS | emit + _EMIT_ZERO

    def _learn(self, keys: list[int]) -> None:
        for key in keys:
            if self.steps.one(key) is None:
                self.steps.put(key, self._compile(key))

    def _read(self, codes: np.ndarray, keep: np.ndarray, emitted: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Read ``codes[start:end]`` of each lane from its state; the states behind. ``keep`` is 0 where a state is forgotten first."""
        order = np.argsort(start - end, kind="stable")  # longest first, so that running lanes stay in front
        at, left, now = start[order], (end - start)[order], state[order].astype(np.int64)
        lanes = len(at)
        for k in range(int(left[0]) if lanes else 0):
            lanes = np.searchsorted(-left[:lanes], -k, "left")
            if lanes < FEW_LANES:
                break
            here = at[:lanes] + k
            keys = (now[:lanes] * keep[here]) << _CODE_BITS | codes[here]
            value, missing = self.steps.get(keys)
            if len(missing):
                self._learn(np.unique(keys[missing]).tolist())
                value[missing] = self.steps.get(keys[missing])[0]
            emitted[here] = (value & (1 << _EMIT_BITS) - 1) - _EMIT_ZERO
            now[:lanes] = value >> _EMIT_BITS
        else:
            lanes = 0
        for lane in range(lanes):  # few long ones
            q = now[lane].item()
            for here in range(at[lane].item() + k, at[lane].item() + left[lane].item()):
                key = (q if keep[here] else 0) << _CODE_BITS | codes[here].item()
                value = self.steps.one(key)
                if value is None:
                    self._learn([key])
                    value = self.steps.one(key)
                emitted[here], q = (value & (1 << _EMIT_BITS) - 1) - _EMIT_ZERO, value >> _EMIT_BITS
            now[lane] = q
        out = np.empty_like(now)
        out[order] = now
        return out

    def count_all(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        if not texts:
            return []
        if self.steps.n > self.max_steps:
            self._reset()
        marked = "".join([f"{SPACE}{t}\0" if t else "\0" for t in texts])
        codes = np.frombuffer(marked.encode("utf-32-le"), "<u4").astype(np.int64)
        codes[codes == 32] = ord(SPACE)
        ends = np.cumsum([len(t) + 2 if t else 1 for t in texts])
        codes[ends - 1] = END
        blank = codes == ord(SPACE)
        # Where the state before does not matter.
        forget = ~self.is_char[codes]
        forget[0] = True
        forget[1:] |= blank[1:] & ~blank[:-1]
        keep, emitted, n = (~forget).astype(np.int64), np.zeros(len(codes), np.int16), len(codes)
        start = np.arange(0, n, CHUNK_CHARS)
        end = np.append(start[1:], n)
        places = np.flatnonzero(forget)
        first = np.append(places, n)[np.searchsorted(places, start)]  # the place from which a chunk's map is constant
        cut = first < end
        first = np.minimum(first, end)
        state = np.full(len(start), -1, np.int64)  # behind each chunk
        state[cut] = self._read(codes, keep, emitted, first[cut], end[cut], np.zeros(cut.sum(), np.int64))
        # Composition: the part before that place, or the whole chunk, is a map of the state that the chunk before hands on. All maps are
        # taken at once, of the states that are known or of a guess, and again of those that turn out to be handed on, until none differs.
        todo = np.flatnonzero(first > start)
        through, enter, differs = ~cut[todo], np.maximum(state[todo - 1], 0), np.ones(len(todo), bool)
        while differs.any():
            now = todo[differs]
            found = self._read(codes, keep, emitted, start[now], first[now], enter[differs])
            state[now[through[differs]]] = found[through[differs]]
            handed = state[todo - 1]
            differs, enter = handed != enter, handed
        total = np.concatenate(([0], np.cumsum(emitted, dtype=np.int64)[ends - 1]))
        return np.diff(total).tolist()

    def groups(self, texts: list[str]) -> Iterator[list[str]]:
        """Texts in groups of about ``GROUP_CHARS`` characters."""
        group, chars = [], 0
        for t in texts:
            if group and chars + len(t) > GROUP_CHARS:
                yield group
                group, chars = [], 0
            group.append(t)
            chars += len(t)
        if group:
            yield group

    def count(self, text: str) -> int:
        return self.count_all([text])[0]


def transducer_of(path: str) -> CountTransducer:
    return CountTransducer(Segmenter(PieceModel(path)))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Counts are those of the SentencePiece model's own encoding without begin and
    end marks. A null or empty text has 0 bytes and 0 tokens; null ids stay null;
    repeated rows give a row each; an empty table gives none. Other columns are
    not read. The model file must be at ``model_path`` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = worker_keeps(transducer_of, model_path)
        for part in slices(batches, GROUP_TEXTS):
            texts = [t or "" for t in part.column(1).to_pylist()]
            counts = [n for group in transducer.groups(texts) for n in transducer.count_all(group)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    # Only (id, bytes) pairs return beside the counts: the text does not come back from Python.
    slim = docs.select(
        F.struct(F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes")).alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_tokens bigint"
    return slim.mapInArrow(run, schema).select(
        F.col("doc_id.id").alias("doc_id"),
        F.col("doc_id.n_bytes").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
