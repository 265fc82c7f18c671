"""Byte-level BPE encoding and decoding with a segment tree per piece.

A piece is a match of the split pattern. Its byte positions are the leaves of a segment
tree; a live position holds the rank of the pair that it makes with its next live
neighbour, and a node the smallest (rank, position) below it, so the root is the
leftmost pair of lowest rank. A merge changes three leaves - the merged position, the
one swallowed, the one before - and so a logarithmic number of nodes. Trees of many
pieces of like length are stepped together in numpy arrays. Texts are independent of
each other: the job is one scan without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.llm.store import short_batches
from citegrid.llm.units import Units
from citegrid.llm.words import parts

# Cells of the trees that are stepped together; texts handled at a time, in characters.
CELLS = 1 << 20
SLAB = 1 << 20
_SHIFT = 17


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number on each line."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_stream(at) as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines() if line)}


class Codec:
    """Encoder and decoder for the ranks of one file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        joined: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    joined[left << _SHIFT | right] = rank
        self.pair_keys = np.array(sorted(joined), np.int64)
        self.pair_ranks = np.array([joined[k] for k in sorted(joined)], np.int64)
        self.bytes_to_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.none = max(ranks.values()) + 1
        self.units = Units(pattern, self._encode_pieces)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of joined neighbours; ``none`` where they don't join or the right one is missing (-1)."""
        key = (left.astype(np.int64) << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (right >= 0)
        return np.where(hit, self.pair_ranks[at], self.none)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has.

        Pieces are padded to one power of two; arrays are flat, a piece takes a row.
        """
        wide = max(2, 1 << (max(map(len, pieces)) - 1).bit_length())
        many, bits = len(pieces), wide.bit_length()
        kind = np.int32 if self.none < 1 << (31 - bits) else np.int64
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join([p.ljust(wide, b"\0") for p in pieces]), np.uint8).reshape(many, wide)
        place = np.arange(wide)
        # One more column stands for "no neighbour".
        ids = np.full((many, wide + 1), -1, np.int32)
        ids[:, :wide] = np.where(place < lengths[:, None], self.bytes_to_ids[raw], -1)
        after = np.where(place + 1 < lengths[:, None], place + 1, wide).astype(np.int32).ravel()
        before = np.tile(place - 1, (many, 1)).astype(np.int32).ravel()
        tree = np.empty((many, 2 * wide), kind)
        tree[:, wide:] = (self._rank(ids[:, :-1], ids[:, 1:]) << bits) | place
        level = wide
        while level > 1:
            half = level // 2
            np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2], out=tree[:, half:level])
            level = half
        ids, tree = ids.ravel(), tree.ravel()
        rows = np.arange(many)
        while True:
            best = tree[rows * (2 * wide) + 1]
            going = (best >> bits) < self.none
            rows, best = rows[going], best[going]
            if len(rows) == 0:
                break
            at, rank = best & (2 * wide - 1), best >> bits
            cell, token, root = rows * wide, rows * (wide + 1), rows * (2 * wide)
            gone = after[cell + at]
            beyond = after[cell + gone]
            ids[token + at], ids[token + gone] = rank, -1
            after[cell + at] = beyond
            inner = beyond < wide
            before[(cell + beyond)[inner]] = at[inner]
            self._set(tree, root, gone, self.none, wide, bits)
            self._set(tree, root, at, self._rank(rank, ids[token + beyond]), wide, bits)
            ahead = before[cell + at]
            has = ahead >= 0
            ahead = ahead[has]
            self._set(tree, root[has], ahead, self._rank(ids[token[has] + ahead], rank[has]), wide, bits)
        ids = ids.reshape(many, wide + 1)
        live = ids >= 0
        return ids[live], live.sum(axis=1)

    @staticmethod
    def _set(tree, root, at, rank, wide, bits):
        """Point update: a leaf of each tree, then its ancestors."""
        node = at.astype(np.int64) + wide
        tree[root + node] = (rank << bits) | at
        while wide > 1:
            node >>= 1
            wide >>= 1
            below = root + 2 * node
            tree[root + node] = np.minimum(tree[below], tree[below + 1])

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        data = [p.encode("utf-8") for p in pieces]
        whole = [self.ranks.get(d) for d in data]
        out = [b"" if r is None else r.to_bytes(4, "little") for r in whole]
        todo: dict[int, list[int]] = {}
        for i, r in enumerate(whole):
            if r is None:
                todo.setdefault((len(data[i]) - 1).bit_length(), []).append(i)
        for size, group in todo.items():
            step = max(1, CELLS >> (size + 1))
            for k in range(0, len(group), step):
                part = group[k:k + step]
                ids, many = self.merge([data[i] for i in part])
                flat, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(many)).tolist()
                for i, a, b in zip(part, [0] + ends, ends):
                    out[i] = flat[a:b]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.units(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once per process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def slabs(texts: list[str], limit: int = SLAB) -> Iterator[list[str]]:
    """Consecutive texts of about ``limit`` characters."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def _rows(path: str, pattern: str, keep: bool):
    def run(batches):
        tool = codec(path, pattern)
        for batch in parts(batches):
            at = 0
            for texts in slabs([t or "" for t in batch.column(1).to_pylist()]):
                ids = tool.encode(texts)
                plain = [tool.decode(x) for x in ids]
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in plain])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())),
                                pa.array(plain, pa.binary()).cast(pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(texts)
    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, with ``ids`` and ``decoded`` on request.

    One row per input row. Null and empty texts have no ids; equal rows give equal rows;
    an empty table gives an empty result; further columns are not read.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    short_batches(docs.sparkSession)
    if keep_ids:
        schema += ", ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _rows(path, pattern, keep_ids), schema)
