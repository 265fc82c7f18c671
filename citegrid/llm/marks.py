"""Marks: a table of bits, of bounded size, for the hashes that occur often enough.

The place of a hash is its lowest bits. Tasks send small entries (place, count), which
Spark sums in slices of places; a place whose sum reaches the need gets its bit. Places are
shared, so a mark may be too many but none is missing: whoever looks a hash up must settle
by other means what the mark lets through. The driver joins the slices to one value, which
is broadcast; its size is chosen from counts, up to ``MOST_PLACES`` bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Places of a table: at most 128 MB of bits.
LEAST_PLACES, MOST_PLACES = 1 << 20, 1 << 30
# Slices of a table, whatever its size, and bytes of entries that a group may hold in the mean.
SLICES, GROUP_BYTES = 256, 1 << 24
# Inside a slice places are counted from the last multiple of this.
_STEP = 1 << 15
_ENTRY = np.dtype([("place", "<u2"), ("n", "u1")])
ENTRIES = "slice int, salt int, entries binary"


def places_for(n: int, most: int = MOST_PLACES) -> int:
    """A power of two, from ``n`` on, within the bounds."""
    return max(8 * SLICES, min(max(LEAST_PLACES, 1 << max(n - 1, 0).bit_length()), most))


def salts_for(n: int, group_bytes: int = GROUP_BYTES) -> int:
    """Groups that the entries of a slice are dealt into when ``n`` entries come in."""
    return max(1, -(-_ENTRY.itemsize * n // (SLICES * group_bytes)))


def entries(hashes: np.ndarray, counts: np.ndarray, places: int, salt: int) -> pa.RecordBatch:
    """A row per slice with a task's hashes; counts above 255 become 255.

    A row has the number of entries at each step of the slice, then the entries.
    """
    wide = places // SLICES
    steps = max(1, wide // _STEP)
    place = (hashes & np.uint64(places - 1)).astype(np.int64)
    order = np.argsort(place)
    place = place[order]
    packed = np.empty(len(place), _ENTRY)
    packed["place"], packed["n"] = place % min(wide, _STEP), np.minimum(counts[order], 255)
    per = np.bincount(place // min(wide, _STEP), minlength=SLICES * steps).reshape(SLICES, steps)
    cut = np.concatenate([[0], np.cumsum(per.sum(axis=1))]).tolist()
    slices = [s for s in range(SLICES) if cut[s] < cut[s + 1]]
    return pa.RecordBatch.from_arrays([
        pa.array(slices, pa.int32()), pa.array([salt] * len(slices), pa.int32()),
        pa.array([per[s].astype("<u4").tobytes() + packed[cut[s]:cut[s + 1]].tobytes() for s in slices], pa.binary())],
        names=["slice", "salt", "entries"])


def _summed(column: pa.ChunkedArray, places: int) -> np.ndarray:
    wide = places // SLICES
    steps = max(1, wide // _STEP)
    place, n = [], []
    for row in column.to_pylist():
        found = np.frombuffer(row, _ENTRY, offset=4 * steps)
        place.append(np.repeat(np.arange(0, wide, min(wide, _STEP), dtype=np.int32), np.frombuffer(row, "<u4", steps)) + found["place"])
        n.append(found["n"])
    return np.bincount(np.concatenate(place), np.concatenate(n), wide)


def _bits(sums: np.ndarray, need: int) -> bytes:
    return np.packbits(sums >= need, bitorder="little").tobytes()


def _mark_slice(need: int, places: int):
    def run(table: pa.Table) -> pa.Table:
        return pa.table({"slice": table["slice"][:1], "marks": pa.array([_bits(_summed(table["entries"], places), need)])})
    return run


def _sum_slice(places: int):
    def run(table: pa.Table) -> pa.Table:
        sums = np.minimum(_summed(table["entries"], places), 255).astype(np.uint8)
        return pa.table({"slice": table["slice"][:1], "sums": pa.array([sums.tobytes()])})
    return run


def _mark_sums(need: int):
    def run(table: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(x, np.uint8) for x in table["sums"].to_pylist()], axis=0, dtype=np.int64)
        return pa.table({"slice": table["slice"][:1], "marks": pa.array([_bits(sums, need)])})
    return run


def mark(found: DataFrame, need: int, places: int, salts: int = 1):
    """The broadcast table of marks of entries ``found``; ``need`` is at most 255."""
    out = "slice int, marks binary"
    if salts == 1:
        rows = found.groupBy("slice").applyInArrow(_mark_slice(need, places), out)
    else:
        rows = (found.groupBy("slice", "salt").applyInArrow(_sum_slice(places), "slice int, sums binary")
                .groupBy("slice").applyInArrow(_mark_sums(need), out))
    table = bytearray(places // 8)
    wide = places // SLICES // 8
    for r in rows.collect():
        table[r["slice"] * wide:(r["slice"] + 1) * wide] = r["marks"]
    return found.sparkSession.sparkContext.broadcast(bytes(table))


def marked(marks, hashes: np.ndarray) -> np.ndarray:
    """Flags of the hashes whose place is marked; ``marks`` is the broadcast table."""
    table = np.frombuffer(marks.value, np.uint8)
    place = (hashes & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
