"""Pieces of many texts at a time, cut as the byte-level pattern cuts them, and a cache of their ids.

Over ASCII the pattern sees five classes of bytes, so that starts of pieces are found by
comparing neighbours in numpy; Arrow then numbers the distinct pieces, and only those not
kept yet are encoded. A word with other characters stays one piece here and is cut by the
pattern itself. Texts with white space beyond ASCII are left to ``Units``. A process keeps
the ids of a bounded number of pieces, others are encoded again, so that the ids do not
depend on what is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from citegrid.llm.units import uncollected

#: The pattern of byte-level BPE, the only one whose cuts are known here.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space, or what some libraries take for it, beyond 0x09-0x0D and space.
_STRANGE = (r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The longest piece that is kept, in characters; pieces looked up at a time.
LONGEST = 48
STEP = 1 << 20

_BEYOND, _LETTER, _DIGIT, _MARK, _SPACE, _WHITE, _EDGE = range(7)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[128:] = _BEYOND
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[9:14] = _WHITE
_CLASS[32] = _SPACE
_AFTER_ONE = np.isin(np.arange(256), list(b"stmd"))


def strange(texts: pa.Array) -> np.ndarray:
    """Whether each text has white space beyond ASCII."""
    return pc.match_substring_regex(texts, _STRANGE).to_numpy(zero_copy_only=False)


def starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start in texts that lie one after the other in UTF-8.

    ``ends`` has a zero, then the end of each text. A word with a byte beyond ASCII,
    and the space before it, is one piece.
    """
    edge = ends[:-1][np.diff(ends) > 0]
    kind = _CLASS[data]
    before, behind = np.empty_like(kind), np.empty_like(kind)
    before[1:], behind[:-1] = kind[:-1], kind[1:]
    before[edge], behind[edge - 1] = _EDGE, _EDGE
    white = kind >= _SPACE
    new = (kind != before) & (before != _SPACE)
    # Of several white characters all but the last are a piece, at the end of a text all.
    double = np.flatnonzero(white & (before >= _SPACE) & (before != _EDGE))
    new[double] = behind[double] < _SPACE
    quotes = np.flatnonzero(new & (data == 39))
    if len(quotes):
        # Another text's bytes, or none, don't count.
        at = np.minimum(quotes[:, None] + [1, 2], len(data) - 1)
        here = (before[at] != _EDGE) & (at > quotes[:, None] + [0, 1])
        one, two = np.where(here, data[at], 0).T
        two = np.where(here[:, 0], two, 0)
        short = _AFTER_ONE[one]
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        new[quotes[short | long] + 1] = False
        rest = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        new[rest[rest < len(data)]] = True
    beyond = kind == _BEYOND
    found = np.flatnonzero(new)
    if beyond.any():
        word = white[found] | (before[found] >= _WHITE)
        first = found[word]
        plain = ~np.logical_or.reduceat(beyond, first)
        found = found[word | plain[np.cumsum(word) - 1]]
    return found


class Pieces:
    """Encode texts by their distinct pieces.

    ``encode_pieces`` gives the ids of each piece, one by one as byte-level BPE does;
    ``kept`` is the number of pieces whose ids are kept.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[list[int]]], kept: int):
        self.encode_pieces, self.kept = encode_pieces, kept
        self.pattern = regex.compile(BYTE_LEVEL)
        self.known: dict[str, int] = {}
        # Ids of the kept pieces, one after the other; piece k ends at ends[k + 1].
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and of words beyond ASCII, one after the other, and how many each has."""
        split = [[w] if w.isascii() else self.pattern.findall(w) for w in words]
        found = self.encode_pieces([p for pieces in split for p in pieces])
        many = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.concatenate([[0], np.cumsum(many)])
        last = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return np.array([i for ids in found for i in ids], "<u4"), np.diff(ends[last], prepend=0)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; no text may be ``strange``."""
        with uncollected():
            return self._texts(texts)

    def _texts(self, texts: pa.Array) -> list[bytes]:
        texts = texts.cast(pa.large_string())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if len(texts) == 0 or ends[-1] == ends[0]:
            return [b""] * len(texts)
        data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        at = starts(data, ends)
        found = [self._ids(data, np.append(at[k:k + STEP], at[k + STEP] if k + STEP < len(at) else len(data)))
                 for k in range(0, len(at), STEP)]
        ids = np.concatenate([ids for ids, _ in found])
        total = np.concatenate([[0], np.cumsum(np.concatenate([many for _, many in found]))])
        cut = total[np.searchsorted(at, ends)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]

    def _ids(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces between the cuts, one after the other, and how many each has."""
        pieces = pa.LargeStringArray.from_buffers(
            len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        numbers = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        fresh = [words[i] for i in new.tolist()]
        ids, many = self._encode(fresh)
        # New pieces stand behind the kept ones here.
        numbers[new] = len(self.ends) - 1 + np.arange(len(new))
        all_ids = np.concatenate([self.ids, ids])
        all_ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(many)])
        self._keep(fresh, ids, many)
        order = numbers[pieces.indices.to_numpy()]
        first = all_ends[order]
        length = all_ends[order + 1] - first
        last = np.cumsum(length)
        return all_ids[np.repeat(first - last + length, length) + np.arange(last[-1])], length

    def _keep(self, words: list[str], ids: np.ndarray, many: np.ndarray) -> None:
        room = self.kept - len(self.known)
        keep = np.fromiter(map(len, words), np.int64, len(words)) <= LONGEST
        keep[np.flatnonzero(keep)[max(room, 0):]] = False
        if keep.any():
            begin = len(self.known)
            self.known.update(zip([words[i] for i in np.flatnonzero(keep).tolist()], range(begin, self.kept)))
            self.ids = np.concatenate([self.ids, ids[np.repeat(keep, many)]])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(many[keep])])
