"""Reading a public SentencePiece model and segmenting marked words with it.

``Segmenter`` finds for every prefix of a word the best segmentation's last
piece (Viterbi's back pointers). For a unigram model the score of a prefix is
the largest sum of piece scores. For a BPE model the admissible segmentations
are those in which each pair of neighbouring pieces is one that the merges leave
standing; exactly one segmentation of a prefix has that property, so the forward
step needs no sum. Words are taken in sorted order, which walks their trie
depth first: the forward values of the prefix shared with the last word stay.
"""

from __future__ import annotations

import heapq
import re
import struct

SPACE = "▁"
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = b[i]
        i += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, i
        shift += 7


def _fields(b: bytes):
    """(number, value) of each field of a protobuf message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """The pieces of a model file with their scores and kinds."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.is_bpe, self.dummy_prefix, self.squeeze, normalizer = False, True, True, ""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                self.is_bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                normalizer = spec.get(1, b"").decode()
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if normalizer != "identity" or self.squeeze or not self.dummy_prefix:
            raise ValueError("only models with identity normalization, a dummy prefix and kept blanks are supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == _NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == _BYTE}
        self.unknown = self.kinds.index(_UNKNOWN)


class Segmenter:
    """Segments words (strings in which a blank is U+2581) into piece ids."""

    def __init__(self, model: PieceModel, bpe: bool | None = None):
        self.model, self.bpe = model, model.is_bpe if bpe is None else bpe
        self.ids = model.ids
        self.longest = max(len(p) for p in self.ids)
        self.lengths = [len(p) for p in model.pieces]
        #: What can still grow into a piece.
        self.open = frozenset(p[:k] for p in self.ids for k in range(1, len(p)))
        #: Characters that are pieces; any other one is spelled in bytes and ends what is around it.
        self.chars = frozenset(p for p in self.ids if len(p) == 1)
        self.foreign = re.compile("([^" + re.escape("".join(sorted(self.chars))) + "])")
        self.pairs: dict[tuple[int, int], bool] = {}
        if self.bpe:
            self._order()
        #: Of the last word: the best piece that ends at each place, its score, and the starts of what could still grow there.
        self.word, self.last, self.score, self.live = "", [-1], [0.0], [[]]

    def _order(self) -> None:
        """Rank pieces by the time of their merge and find the pair that each is merged from."""
        multi = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.model.scores[self.ids[p]])
        self.rank = {self.ids[c]: 0 for c in self.chars}
        self.rank |= {self.ids[p]: k + 1 for k, p in enumerate(multi)}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.stable = {self.ids[c] for c in self.chars}
        for p in multi:
            i = self.ids[p]
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a in self.stable and b in self.stable and self.rank[a] < self.rank[i] > self.rank[b] and self._stands(a, b):
                    self.split[i], self.merged[a, b] = (a, b), i
                    self.stable.add(i)
                    break
        self.pairs.clear()

    def _stands(self, a: int, b: int) -> bool:
        """Whether no merge across the seam of pieces ``a`` and ``b`` comes before their own.

        Undo the later of the two pieces' merges, one at a time: the parts that
        touch the seam then are the ones that stood there at that time.
        """
        rank, split, merged = self.rank, self.split, self.merged
        limit = 1 << 60
        while True:
            both = merged.get((a, b))
            if both is not None and rank[both] < limit:
                return False
            if a not in split and b not in split:
                return True
            # On equal rank (two of the same piece) the left one was merged first, so undo the right one.
            if rank[a] > rank[b]:
                limit = rank[a]
                a = split[a][1]
            else:
                limit = rank[b] + 1
                b = split[b][0]

    def _agree(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 250_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._stands(a, b)
        return known

    def forward(self, word: str) -> list[int]:
        """Back pointers of ``word``, whose characters are all pieces; values of the prefix shared with the last call stay."""
        old, last, score, live = self.word, self.last, self.score, self.live
        n, k = len(word), 0
        for x, y in zip(old, word):
            if x != y:
                break
            k += 1
        del last[k + 1 :], score[k + 1 :], live[k + 1 :]
        get, opened, bpe, scores = self.ids.get, self.open, self.bpe, self.model.scores
        pairs = self.pairs
        stable = self.stable if bpe else ()
        for end in range(k + 1, n + 1):
            best, high, grows = -1, 0.0, []
            for start in (*live[end - 1], end - 1):
                part = word[start:end]
                if part in opened:
                    grows.append(start)
                if bpe and best >= 0 or (piece := get(part)) is None:
                    continue
                if bpe:
                    if piece in stable:
                        if start:
                            fits = pairs.get((last[start], piece))
                            if not (self._agree(last[start], piece) if fits is None else fits):
                                continue
                        best = piece
                elif best < 0 or score[start] + scores[piece] > high:
                    best, high = piece, score[start] + scores[piece]
            last.append(best)
            score.append(high)
            live.append(grows)
        self.word = word
        return last

    def known(self, word: str) -> list[int]:
        """Piece ids of a word whose characters are all pieces."""
        if self.bpe and SPACE * 2 in word:  # the pieces of blanks share one score: merge by hand
            return self.merge(word)
        last, out, end, lengths = self.forward(word), [], len(word), self.lengths
        while end:
            piece = last[end]
            out.append(piece)
            end -= lengths[piece]
        out.reverse()
        return out

    def merge(self, word: str) -> list[int]:
        """The merges in the order of the model's scores, leftmost first: what ``forward`` must equal."""
        ids, scores = self.ids, self.model.scores
        parts, left, right = list(word), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] < len(parts) and (both := parts[i] + parts[right[i]]) in ids:
                heapq.heappush(heap, (-scores[ids[both]], i, both))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not parts[i] or right[i] >= len(parts) or parts[i] + parts[right[i]] != both:
                continue
            gone = right[i]
            parts[i], parts[gone], right[i] = both, "", right[gone]
            if right[i] < len(parts):
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [ids[p] for p in parts if p]

    def segment(self, word: str) -> list[int]:
        """Piece ids of any word; a character that is no piece becomes its bytes' pieces."""
        if word and not self.foreign.search(word):
            return self.known(word)
        out: list[int] = []
        for part in self.foreign.split(word):
            if not part:
                continue
            if part in self.chars or len(part) > 1 or not self.foreign.match(part):
                out += self.known(part)
            else:
                spelled = [self.model.byte_ids.get(b) for b in part.encode()]
                out += [self.model.unknown] if None in spelled else spelled
        return out

    def segment_all(self, words) -> dict[str, list[int]]:
        """Segments distinct words in sorted order, so that shared prefixes are scored once."""
        return {w: self.segment(w) for w in sorted(words)}


#: Cuts marked text before each blank that follows another character: no piece crosses there.
CUT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def mark(text: str) -> str:
    """Marked text: a blank put before it, blanks shown as U+2581; nothing for an empty text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def words_of(text: str) -> list[str]:
    """The marked words whose concatenation is ``mark(text)``."""
    if not text:
        return []
    if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
        return [SPACE + w for w in text.split(" ")]
    return CUT.findall(mark(text))
