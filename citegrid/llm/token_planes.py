"""Token ids in binary files of bit planes.

A file holds blocks of a fixed number of ids. A block is transposed into bit planes
(plane k has bit k of every id) or byte planes, each compressed by itself with zstandard;
planes of zeros take no bytes. After the blocks come the documents of the file and the
chunk index, so that any block, and any plane of it, can be read alone:

    magic | planes of block 0 | planes of block 1 | ...
    | doc ids (int64, zstandard) | lengths (uint32, zstandard) | index (JSON) | index bytes (uint64) | magic

Documents are written in ascending order of id: the table is range-partitioned and
sorted, each task streams its documents into files of bounded size and returns one
manifest row per file. Only files named by the manifest count, so files of lost or
repeated attempts are ignored. A file's offset is the sum over the manifest rows before.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm import store
from citegrid.llm.bpe import slabs
from citegrid.llm.pieces import BYTE_LEVEL, Pieces, strange
from citegrid.llm.units import Units
from citegrid.llm.words import parts
from citegrid.session import Scratch

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
FILE_IDS = 1 << 26
LEVEL = 3
# Pieces that a process keeps: the library's encoder is the larger part of the work here,
# so more than elsewhere; some 200 bytes each.
KEPT_PIECES = 1_000_000
SLAB = 1 << 22


def split_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Bit or byte planes of a block, lowest first."""
    top = int(ids.max(initial=0))
    wide = 2 if top < 1 << 16 else 4
    octets = ids.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide)
    if mode == "byte":
        return [octets[:, k].tobytes() for k in range(wide)]
    # Bits of the octets, lowest first: bit k of an id is column k.
    flags = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(flags[:, k], bitorder="little").tobytes() for k in range(top.bit_length())]


def join_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    """The ids of a block."""
    if mode == "byte":
        octets = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                octets[:, k] = np.frombuffer(plane, np.uint8)
        return octets.view("<u4").ravel()
    flags = np.zeros((n, 32), np.uint8)
    for k, plane in enumerate(planes):
        if plane:
            flags[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
    return np.packbits(flags, axis=1, bitorder="little").view("<u4").ravel()


class PlaneWriter:
    """Streams documents into one file."""

    def __init__(self, stream, mode: str = "bit", block: int = BLOCK, level: int = LEVEL):
        self.stream, self.mode, self.block = stream, mode, block
        self.pack = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.waiting, self.n_ids, self.at = 0, 0, 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.blocks: list[dict] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            ids = np.concatenate(self.held)
            full = len(ids) // self.block * self.block
            for k in range(0, full, self.block):
                self._block(ids[k:k + self.block])
            self.held, self.waiting = [ids[full:]], len(ids) - full

    def _block(self, ids: np.ndarray) -> None:
        entry = {"at": self.at, "n": len(ids), "planes": []}
        for plane in split_planes(ids, self.mode):
            data = self.pack.compress(plane) if any(plane) else b""
            self._put(data)
            entry["planes"].append(len(data))
        self.blocks.append(entry)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.held))
        index = {"mode": self.mode, "block": self.block, "blocks": self.blocks, "n_docs": len(self.doc_ids),
                 "null_ids": [i for i, d in enumerate(self.doc_ids) if d is None], "docs_at": self.at}
        ids = self.pack.compress(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        lengths = self.pack.compress(np.array(self.lengths, "<u4").tobytes())
        index |= {"ids_bytes": len(ids), "lengths_bytes": len(lengths)}
        tail = json.dumps(index).encode()
        self._put(ids + lengths + tail + len(tail).to_bytes(8, "little") + MAGIC)
        self.stream.close()


class PlaneReader:
    """Documents or single blocks of a file, by its chunk index."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        end = self._read(size - 16, 16)
        if end[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a file of id planes, or cut off")
        length = int.from_bytes(end[:8], "little")
        self.index = json.loads(self._read(size - 16 - length, length))
        self.unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        return self.source.read_at(n, at)

    def block(self, k: int) -> np.ndarray:
        entry = self.index["blocks"][k]
        data = self._read(entry["at"], sum(entry["planes"]))
        planes, at = [], 0
        for n in entry["planes"]:
            planes.append(self.unpack.decompress(data[at:at + n]) if n else b"")
            at += n
        return join_planes(planes, entry["n"], self.index["mode"])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ix = self.index
        at = ix["docs_at"]
        ids = np.frombuffer(self.unpack.decompress(self._read(at, ix["ids_bytes"])), "<i8").tolist()
        lengths = np.frombuffer(self.unpack.decompress(
            self._read(at + ix["ids_bytes"], ix["lengths_bytes"])), "<u4").tolist()
        for i in ix["null_ids"]:
            ids[i] = None
        rest, k = np.empty(0, "<u4"), 0
        for doc_id, n in zip(ids, lengths):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id, rest[:n]
            rest = rest[n:]


_ENCODERS: dict[str, Units] = {}
_TEXT_ENCODERS: dict[tuple[str, str], Callable[[list[str]], list[bytes]]] = {}


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves, the other bytes, in order, for the
    characters from 256 on.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)}


def piece_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of each piece by the model of a ``tokenizers`` file."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path).model
    chars = np.array([ord(c) for _, c in sorted(byte_chars().items())], "<u2")

    def encode_pieces(pieces: list[str]) -> list[list[int]]:
        # The pieces are split already, so the library's model gets them in its spelling of
        # bytes; they are spelled together, apart by a byte that UTF-8 never has.
        data = b"\xff".join([p.encode() for p in pieces])
        spelled = chars[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le").split("\xff")
        return [[t.id for t in model.tokenize(p)] for p in spelled] if pieces else []

    return encode_pieces


def encoder(path: str, pattern: str) -> Units:
    """Encoder of a ``tokenizers`` file with byte-level pre-tokens by ``pattern``, read once per process."""
    if path not in _ENCODERS:
        encode = piece_encoder(path)
        _ENCODERS[path] = Units(pattern, lambda pieces: [np.array(ids, "<u4").tobytes() for ids in encode(pieces)])
    return _ENCODERS[path]


def text_encoder(path: str, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Encoder of whole texts, as the library's ``encode`` without special tokens around them.

    A text that holds one of the file's added tokens, such as ``<|endoftext|>``, goes
    through the library whole, which sets those apart before the pattern splits the rest.
    Other texts are cut in pieces together, or by ``Units`` where only the pattern can tell.
    """
    if (path, pattern) not in _TEXT_ENCODERS:
        from tokenizers import Tokenizer

        tool, units = Tokenizer.from_file(path), encoder(path, pattern)
        pieces = Pieces(piece_encoder(path), KEPT_PIECES)
        added = [t.content for t in tool.get_added_tokens_decoder().values() if t.content]

        def encode(texts: list[str]) -> list[bytes]:
            whole = np.array([any(a in t for a in added) for t in texts], bool)
            column = pa.array(texts, pa.large_string())
            odd = strange(column) if pattern == BYTE_LEVEL else np.ones(len(texts), bool)
            quick = iter(pieces(column.filter(pa.array(~whole & ~odd))))
            slow = iter(units([t for t, w, o in zip(texts, whole, odd) if o and not w]))
            return [np.array(tool.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w
                    else next(slow if o else quick) for t, w, o in zip(texts, whole, odd)]

        _TEXT_ENCODERS[path, pattern] = encode
    return _TEXT_ENCODERS[path, pattern]


def _write(path: str, pattern: str, end_id: int, root: str, mode: str, block: int, file_ids: int):
    end = np.array([end_id], "<u4")

    def run(batches):
        encode = text_encoder(path, pattern)
        part, number = TaskContext.get().partitionId(), 0
        writer, uri = None, ""

        def manifest():
            writer.close()
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([uri]),
                pa.array([len(writer.lengths)], pa.int64()), pa.array([writer.n_ids], pa.int64())],
                names=["part", "number", "uri", "n_docs", "n_ids"])

        for batch in parts(batches, 2_048):
            doc_ids, at = batch.column(0).to_pylist(), 0
            for texts in slabs([t or "" for t in batch.column(1).to_pylist()], SLAB):
                for ids in encode(texts):
                    if writer is None:
                        uri = f"{root}/{store.new_name(f'ids-{part:05d}-{number:04d}', '.planes')}"
                        writer = PlaneWriter(store.create(uri), mode, block)
                    writer.add(doc_ids[at], np.concatenate([np.frombuffer(ids, "<u4"), end]))
                    at += 1
                    if writer.n_ids >= file_ids:
                        yield manifest()
                        writer, number = None, number + 1
        if writer is not None:
            yield manifest()
    return run


def write_ids(docs: DataFrame, path: str, pattern: str, end_id: int, mode: str = "bit", block: int = BLOCK,
              file_ids: int = FILE_IDS, scratch: Scratch | None = None) -> DataFrame:
    """Write the ids of all texts; returns the manifest with each file's first position.

    ``path`` names a byte-level BPE file of the ``tokenizers`` library, ``pattern`` is how
    it splits texts, ``end_id`` closes each document.
    Rows are ordered by doc_id, then text; null ids come first, null texts are empty and
    repeated rows are written as often as they occur.
    """
    spark = docs.sparkSession
    store.short_batches(spark)
    scratch = scratch or Scratch(spark, "token-planes")
    root = store.folder(spark, "id-files")
    manifest = scratch.save(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(_write(path, pattern, end_id, root, mode, block, file_ids),
                    "part int, number int, uri string, n_docs bigint, n_ids bigint"), "manifest")
    # One row per file.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches):
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            columns: list[list] = [[], [], [], []]
            with store.open_file(uri) as source:
                for doc_id, ids in PlaneReader(source).documents():
                    for c, v in zip(columns, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        c.append(v)
                    start += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_index(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("uri", "start").repartition(n, "uri").mapInArrow(
        _read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def planes_round_trip(docs: DataFrame, path: str, pattern: str, end_id: int, mode: str = "bit", **options) -> DataFrame:
    """Write all documents and read them back. An empty table writes no file and gives no row."""
    return read_index(write_ids(docs, path, pattern, end_id, mode, **options))
