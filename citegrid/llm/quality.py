"""Quality classifier: naive Bayes support vectors (NBSVM).

Indicators of n-grams - runs of three bytes, words, pairs of neighbouring words, and
pairs of one word, these for once, twice, four times and so on - are hashed into a fixed number of dimensions. Each indicator
is scaled by its class log-count ratio r, the logarithm of its smoothed share among
good texts over that among bad ones, and a linear hinge-loss model is fitted to the
scaled, length-normalised vectors by dual coordinate descent. A sigmoid fitted to
margins of rows left out turns margins into scores.

The counts behind r cover all labelled training rows, summed per task and then in
Spark. The linear model is fitted in one task to a bounded sample of them: the first
``fit_rows`` in hash order, as long as they hold at most ``fit_features`` indicators.
What leaves that task is one weight per dimension, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.llm.store import short_batches
from citegrid.llm.words import SLAB, binary, parts, word_hashes
from citegrid.session import Scratch

BITS = 17
DIMS = 1 << BITS
FIT_ROWS = 10_000
FIT_FEATURES = 1 << 24
THRESHOLD = 0.7
SMOOTHING = 1.0
BROADCAST_ROWS = 1_000_000
# First of the dimensions that say how often, in powers of two, a word follows itself.
_AGAIN = 1


def indicators(text: bytes, words: np.ndarray) -> np.ndarray:
    """The dimensions that a text sets, ascending."""
    flags = np.zeros(DIMS, bool)
    for at in range(0, len(text), SLAB):
        a = np.frombuffer(text[at:at + SLAB + 2], np.uint8).astype(np.uint32)
        grams = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
        flags[(grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    if len(words):
        flags[(words >> np.uint64(64 - BITS)).astype(np.int64)] = True
        pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ words[1:]
        again = words[:-1] == words[1:]
        flags[((pairs * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)[~again]] = True
        flags[_AGAIN:_AGAIN + int(again.sum()).bit_length()] = True
    return np.flatnonzero(flags)


def _texts(column) -> Iterator[tuple[bytes, np.ndarray]]:
    texts = binary(column)
    return zip(texts, word_hashes(texts))


def _count(batches):
    counts = np.zeros((2, DIMS), np.int64)
    for batch in parts(batches):
        for label, (text, words) in zip(batch.column(1).to_pylist(), _texts(batch.column(0))):
            counts[label, indicators(text, words)] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])],
                                     names=["dim", "bad", "good"])


def log_ratio(bad: np.ndarray, good: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Class log-count ratio of every dimension."""
    p, q = good + smoothing, bad + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: np.ndarray,
                 rounds: int = 100, tolerance: float = 0.05, seed: int = 7) -> np.ndarray:
    """Weights of the hinge-loss model by dual coordinate descent (Hsieh et al., 2008).

    A row is its indicators scaled by ``ratio`` over the root of their number. Ends when
    no projected gradient of a round is above ``tolerance``, or after ``rounds``.
    """
    values = [ratio[x] / np.sqrt(max(len(x), 1)) for x in rows]
    norms = np.array([float(v @ v) for v in values])
    weights, alpha = np.zeros(len(ratio)), np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in draw.permutation(np.flatnonzero(norms > 0)).tolist():
            at, v = rows[i], values[i]
            slope = signs[i] * float(weights[at] @ v) - 1.0
            if (alpha[i] <= 0 and slope >= 0) or (alpha[i] >= cost[i] and slope <= 0):
                continue
            worst = max(worst, abs(slope))
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost[i])
            weights[at] += (new - alpha[i]) * signs[i] * v
            alpha[i] = new
        if worst < tolerance:
            break
    return weights


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of a logistic curve through margins, by damped Newton steps."""
    positive, negative = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels == 1, (positive + 1.0) / (positive + 2.0), 1.0 / (negative + 2.0))
    scale = float(np.abs(margins).max()) or 1.0
    x = np.stack([margins / scale, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, 0.0])

    def loss(b):
        z = x @ b
        return float(np.sum(np.logaddexp(0, z) - goal * z)) + 1e-3 * float(b @ b)

    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (p - goal) + 2e-3 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(beta[0]) / scale, float(beta[1])


def _fit(ratio: np.ndarray, fit_features: int, cost: float):
    def run(batches):
        rows, labels, held = [], [], 0
        for batch in parts(batches):
            for label, (text, words) in zip(batch.column(1).to_pylist(), _texts(batch.column(0))):
                x = indicators(text, words)
                if held + len(x) > fit_features:
                    break
                held += len(x)
                rows.append(x)
                labels.append(label)
        y = np.array(labels)
        if len(set(labels)) == 2:
            signs = np.where(y == 1, 1.0, -1.0)
            weight = np.full(len(y), cost)
            # Every fifth row is left out to fit the sigmoid, then all rows give the weights.
            out = np.arange(len(y)) % 5 == 4
            if len(set(y[out].tolist())) < 2:
                out = np.ones(len(y), bool)
            keep = np.flatnonzero(~out) if not out.all() else np.arange(len(y))
            part = dual_descent([rows[i] for i in keep], signs[keep], ratio, weight[keep])
            margins = np.array([part[rows[i]] @ ratio[rows[i]] / np.sqrt(max(len(rows[i]), 1))
                                for i in np.flatnonzero(out)])
            a, b = sigmoid_fit(margins, y[out])
            model = dual_descent(rows, signs, ratio, weight) * ratio
        else:
            share = (sum(labels) + 1.0) / (len(labels) + 2.0)
            a, b, model = 1.0, float(np.log(share / (1 - share))), np.zeros(DIMS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a]), pa.array([b]), pa.array([model.astype("<f4").tobytes()], pa.binary())],
            names=["slope", "offset", "weights"])
    return run


def _score(slope: float, offset: float, weights: np.ndarray, threshold: float):
    def run(batches):
        for batch in parts(batches):
            margins = []
            for text, words in _texts(batch.column(2)):
                x = indicators(text, words)
                margins.append(float(weights[x].sum(dtype=np.float64)) / max(len(x), 1) ** 0.5)
            z = np.clip(slope * np.array(margins, float) + offset, -500, 500)
            score = 1.0 / (1.0 + np.exp(-z))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])
    return run


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES,
              cost: float = 1.0, scratch: Scratch | None = None) -> tuple[float, float, np.ndarray]:
    """(slope, offset, weight per dimension), from rows whose ``fold_of`` is not 2."""
    short_batches(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    known, seen = scratch.measure(
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & (fold_of(F.col("doc_id")) != 2))
        .groupBy("doc_id").agg(F.max("quality").alias("quality")), "known", F.count(F.lit(1)).alias("rows"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small = F.broadcast(known) if seen["rows"] <= BROADCAST_ROWS else known
    counts = (
        texts.join(small, "doc_id").select("text", "quality")
        .mapInArrow(_count, "dim bigint, bad bigint, good bigint")
        .groupBy("dim").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas())
    bad, good = np.zeros(DIMS), np.zeros(DIMS)
    bad[counts["dim"]], good[counts["dim"]] = counts["bad"], counts["good"]
    ratio = log_ratio(bad, good)
    # At most fit_rows ids, so they may be broadcast.
    chosen = F.broadcast(known.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(fit_rows))
    found = (
        texts.join(chosen, "doc_id").select("text", "quality", "turn").repartition(1).sortWithinPartitions("turn", "text")
        .select("text", "quality").mapInArrow(_fit(ratio, fit_features, cost), "slope double, offset double, weights binary")
        .collect())
    scratch.drop("known")
    if not found:  # no training row
        return 1.0, 0.0, np.zeros(DIMS, np.float32)
    return found[0]["slope"], found[0]["offset"], np.frombuffer(found[0]["weights"], "<f4")


def score_texts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fit) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row.

    Null and empty texts set no indicator and get the score of margin 0. Equal texts
    have equal scores. A row without ``doc_id`` is held out and scored. Labels other than
    0 and 1 are ignored, the higher of two labels counts; with one class only the score
    is its smoothed share. An empty table gives an empty result; further columns are
    not read.
    """
    slope, offset, weights = fit_model(docs, labels, **fit)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(True)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(slope, offset, weights, threshold),
                           "doc_id bigint, held_out boolean, score double, predicted int")


def _keep(slope: float, offset: float, weights: np.ndarray, least: float, text: int):
    score = _score(slope, offset, weights, least)

    def run(batches):
        for batch in parts(batches):
            ids = pa.nulls(batch.num_rows, pa.int64())
            columns = pa.RecordBatch.from_arrays(
                [ids, pa.nulls(batch.num_rows, pa.bool_()), batch.column(text).cast(pa.string())], names=["a", "b", "c"])
            for scored in score([columns]):
                yield batch.filter(pa.compute.equal(scored.column(3), 1))
    return run


def keep_good(docs: DataFrame, labels: DataFrame, least: float = THRESHOLD, **fit) -> DataFrame:
    """Rows of ``docs`` whose score is at least ``least``, all columns as they are."""
    slope, offset, weights = fit_model(docs, labels, **fit)
    return docs.mapInArrow(_keep(slope, offset, weights, least, docs.columns.index("text")), docs.schema)
