"""Substring dedup: remove every passage of ``width`` words that also occurs elsewhere.

Rabin-Karp hashes of all word windows are counted in Spark; the repeated windows of a
text merge into maximal intervals, whose words go. To count fewer rows, windows are
told apart in two exact steps:

1. Each window has an *anchor*, the smallest hash of the ``gram``-word runs inside it.
   Equal windows have equal anchors, and neighbours mostly share theirs, so a text has
   one anchor per dozen words. A window whose anchor occurs once cannot be repeated.
2. The windows of repeated anchors are counted by their own hash.

Texts that are equal are handled once, with their number of copies: all windows of a
text that has copies are repeated. A window repeated inside its own text needs no
partner. Both are settled where the text is, so no row per copy is shuffled. Counts are
combined before shuffling, and what is joined to them is a plain stored table, so that
Spark can split a hot hash. Texts are compared by 128-bit digests, windows by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.llm.store import short_batches
from citegrid.llm.words import binary, parts, rolling, word_hashes
from citegrid.session import Scratch

WIDTH = 35
GRAM = 8
BATCH = 100_000
BROADCAST_ROWS = 1_000_000


def anchors(words: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all grams, per window its anchor)."""
    grams = rolling(words, gram)
    span = width - gram + 1
    windows = len(words) - width + 1
    if windows <= 0:
        return grams, np.empty(0, np.uint64)
    low, have = grams, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return grams, np.minimum(low[:windows], low[span - have:span - have + windows])


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Flags of the words in maximal intervals: those under any window from ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:-1]) > 0


def _emit(keys: pa.Array, columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """Columns as a batch; the first has positions in ``keys``."""
    first, *rest = (pa.array(np.concatenate(c)) for c in columns)
    return pa.RecordBatch.from_arrays([keys.take(first), *rest], names=names)


def _anchor_rows(width: int, gram: int):
    def run(batches):
        for batch in parts(batches):
            keys = batch.column(0)
            out, rows = [[], [], []], 0
            for at, words in enumerate(word_hashes(binary(batch.column(1)))):
                grams, low = anchors(words, width, gram)
                if len(low) == 0:
                    continue
                distinct = np.unique(low)
                ordered = np.sort(grams)
                times = np.searchsorted(ordered, distinct, "right") - np.searchsorted(ordered, distinct, "left")
                for c, values in zip(out, (np.full(len(distinct), at), distinct.view(np.int64), times)):
                    c.append(values)
                rows += len(distinct)
                if rows >= BATCH:
                    yield _emit(keys, out, ["key", "anchor", "n"])
                    out, rows = [[], [], []], 0
            if rows:
                yield _emit(keys, out, ["key", "anchor", "n"])
    return run


def _suspects(words: np.ndarray, repeated: np.ndarray, width: int, gram: int):
    """Windows of repeated anchors: (distinct hashes, first starts, repeated inside the text, all starts, index)."""
    _, low = anchors(words, width, gram)
    at = np.flatnonzero(np.isin(low, repeated))
    if len(at) == 0:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, np.empty(0, bool), empty, empty
    hashes = rolling(words, width)[at]
    distinct, first, index, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    return distinct, at[first], times > 1, at, index


def _window_rows(width: int, gram: int):
    """(key, hash, start, n): n is 2 where the window is known to be repeated."""
    def run(batches):
        for batch in parts(batches):
            keys, (copies, marks) = batch.column(0), (batch.column(i).to_pylist() for i in (2, 3))
            out, rows = [[], [], [], []], 0
            for at, (many, marked, words) in enumerate(zip(copies, marks, word_hashes(binary(batch.column(1))))):
                distinct, first, inner, _, _ = _suspects(words, np.array(marked, np.int64).view(np.uint64), width, gram)
                if len(distinct) == 0:
                    continue
                known = np.where(inner | (many > 1), 2, 1)
                for c, values in zip(out, (np.full(len(distinct), at), distinct.view(np.int64),
                                           first.astype(np.int32), known.astype(np.int32))):
                    c.append(values)
                rows += len(distinct)
                if rows >= BATCH:
                    yield _emit(keys, out, ["key", "hash", "start", "n"])
                    out, rows = [[], [], [], []], 0
            if rows:
                yield _emit(keys, out, ["key", "hash", "start", "n"])
    return run


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _cut_rows(width: int, gram: int):
    def run(batches):
        for batch in parts(batches):
            keys, copies, marks, hits = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            texts = binary(batch.column(1))
            out: list[list] = [[], [], [], []]
            for key, text, many, marked, found, hashes in zip(keys, texts, copies, marks, hits, word_hashes(texts)):
                words = text.split()
                n = len(words)
                if many > 1:
                    starts = np.arange(max(n - width + 1, 0))
                else:
                    _, _, inner, at, index = _suspects(hashes, np.array(marked, np.int64).view(np.uint64), width, gram)
                    starts = np.concatenate([at[inner[index]], np.array(found or [], np.int64)])
                if len(starts) == 0:
                    continue
                gone = covered(starts, width, n)
                left = [w for w, g in zip(words, gone.tolist()) if not g]
                for c, v in zip(out, (key, int(gone.sum()), _digest(left), b" ".join(left))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                pa.array(out[3], pa.binary()).cast(pa.string())], names=["key", "n_removed", "kept_sha256", "kept"])
    return run


def _whole_rows(batches):
    for batch in parts(batches):
        counts, digests = [], []
        for text in binary(batch.column(2)):
            words = text.split()
            counts.append(len(words))
            digests.append(_digest(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "key", "n_words", "sha256"])


def digest(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(*more, digest(text).alias("key"), text.alias("text"))


def repeated_texts(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, scratch: Scratch | None = None,
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Texts that lose words: ``(key, n_removed, kept_sha256, kept)`` with ``key = digest(text)``."""
    short_batches(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "substring-dedup")
    gram = min(gram, width)
    texts = _keyed(docs).where(F.col("text").isNotNull())

    posted = texts.mapInArrow(_anchor_rows(width, gram), "key binary, anchor bigint, n bigint")
    shared = scratch.save(posted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "shared")
    marked, seen = scratch.measure(
        posted.select("key", "anchor").join(shared, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("marks")),
        "marked", F.count(F.lit(1)).alias("rows"))
    scratch.drop("shared")

    wanted = marked.select("key")
    if seen["rows"] <= broadcast_rows:
        wanted = F.broadcast(wanted)
    held = scratch.save(
        texts.join(wanted, "key", "left_semi").groupBy("key")
        .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        .join(marked, "key").select("key", "text", "copies", "marks"), "held")
    windows = held.mapInArrow(_window_rows(width, gram), "key binary, hash bigint, start int, n int")
    repeated = scratch.save(
        windows.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"), "repeated")
    hits = scratch.save(
        windows.where("n = 1").join(repeated, "hash").groupBy("key").agg(F.collect_set("start").alias("starts")), "hits")
    cut = scratch.save(
        held.join(hits, "key", "left").select("key", "text", "copies", "marks", "starts")
        .mapInArrow(_cut_rows(width, gram), "key binary, n_removed bigint, kept_sha256 string, kept string"), "cut")
    scratch.drop("marked", "held", "repeated", "hits")
    return cut


def removal_report(docs: DataFrame, width: int = WIDTH, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``, one row per input row.

    Null, empty and blank texts have no words and lose none; texts shorter than
    ``width`` words lose none. Repeated rows are copies of each other and lose all
    words from ``width`` words on. An empty table gives an empty result; further
    columns of ``docs`` are not read.
    """
    cut = repeated_texts(docs, width, scratch=scratch)
    whole = _keyed(docs, "doc_id").select("doc_id", "key", "text").mapInArrow(
        _whole_rows, "doc_id bigint, key binary, n_words bigint, sha256 string")
    return whole.join(cut.select("key", "n_removed", "kept_sha256"), "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the repeated passages taken out of ``text``; other columns stay.

    A text that loses words becomes its kept words joined by one space; others stay as
    they are. ``n_chars``, if there, follows the text.
    """
    cut = repeated_texts(docs, width, scratch=scratch).select("key", F.col("kept").alias("_llm_kept"))
    out = (docs.withColumn("_llm_key", digest(F.col("text").cast("string")))
           .join(cut.withColumnRenamed("key", "_llm_key"), "_llm_key", "left")
           .withColumn("text", F.coalesce("_llm_kept", "text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_llm_kept").isNotNull(), F.length("text").cast("bigint"))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
