"""Texts in units that a tokenizer may encode one by one, and a cache of encoded units.

The split pattern of byte-level BPE always starts a new piece at a single space between
two other characters, so a text may be cut there. Units repeat far more often than
texts; a process keeps the ids of a bounded number of them, and others are encoded
again, so that the ids do not depend on what is kept. Pieces, the pattern's matches in
new units, repeat more often still and are kept likewise.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import regex

_CUT = re.compile(r"(?<=\S)(?= \S)")

# Units and pieces kept, and the longest unit.
KEPT = 100_000
PIECES = 100_000
LONGEST = 48
_MARKS = (".", ",", ";", ":", "!", "?")


def _spaced(text: str) -> list[str] | None:
    """Units cut at every space, if no white space touches other white space or an end of the text."""
    words = text.split()
    if len(" ".join(words)) != len(text):
        return None
    if text.count(" ") != len(words) - 1:
        words = text.split(" ")
    return [words[0], *[" " + w for w in words[1:]]]


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles: millions of new lists and strings have none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _clean(unit: str) -> bool:
    """No white space but a leading space touches the ends, so its neighbours don't matter."""
    body = unit[1:] if unit[0] == " " else unit
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


class Units:
    """Encode texts by units, and new units by the pieces that the pattern finds in them.

    ``encode_pieces`` gives the ids of new pieces as bytes; each piece is encoded by
    itself, as byte-level BPE does.
    """

    def __init__(self, pattern: str, encode_pieces: Callable[[list[str]], list[bytes]],
                 kept: int | None = None, pieces: int | None = None):
        self.most_units = KEPT if kept is None else kept
        self.most_pieces = PIECES if pieces is None else pieces
        self.pattern = regex.compile(pattern)
        self.encode_pieces = encode_pieces
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _split(self, unit: str) -> list[str]:
        """The pattern's matches; a word, or one with a common mark behind it, needs no pattern."""
        body = unit[1:] if unit[0] == " " else unit
        if body.isalpha():
            return [unit]
        if body[-1:] in _MARKS and body[:-1].isalpha():
            return [unit[:-1], unit[-1]]
        return self.pattern.findall(unit)

    def _encode(self, units: list[str]) -> list[bytes]:
        split = [self._split(u) for u in units]
        known = self.pieces
        new = list(dict.fromkeys([p for pieces in split for p in pieces if p not in known]))
        before = len(known)
        known.update(zip(new, self.encode_pieces(new)))
        out = [known[p[0]] if len(p) == 1 else b"".join([known[x] for x in p]) for p in split]
        for p in new[max(self.most_pieces - before, 0):]:
            del known[p]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        with uncollected():
            return self._texts(texts)

    def _texts(self, texts: list[str]) -> list[bytes]:
        known = self.known
        split: list[list[str]] = []
        new: dict[str, None] = {}
        unsure: set[str] = set()
        for text in texts:
            if not text:
                split.append([])
                continue
            units = _spaced(text)
            if units is not None:
                unseen = [u for u in set(units) if u not in known]
            else:
                units = _CUT.split(text)
                unseen = [u for u in units if u not in known]
                unsure.update(u for u in unseen if not _clean(u))
            new.update(dict.fromkeys(unseen))
            split.append(units)
        before = len(known)
        known.update(zip(new, self._encode(list(new))))
        out = [b"".join(map(known.__getitem__, units)) for units in split]
        room = self.most_units - before
        for unit in new:
            if room > 0 and len(unit) <= LONGEST and unit not in unsure:
                room -= 1
            else:
                del known[unit]
        return out
