"""Ranked lexical search as maximum inner products over norm buckets (after LEMP: Teflioudi,
Gemulla, Mykytiuk, 2015).

A document is the vector of its terms' impacts, cut to the terms that any query of the
block has; a query is the vector of its terms' weights, and a score is their inner product.
To even out common and rare terms both sides carry the square root of the weight.

Every task orders its vectors by length and takes them bucket by bucket, longest first.
A query leaves a bucket, and with it all later ones, once Cauchy-Schwarz bounds every
score there below its k-th best so far. Inside a bucket a query reads the postings of its
few largest coordinates; those and Cauchy-Schwarz on the rest bound each document's score.
What survives is scored exactly in integers. Tasks return k documents per query, so no
group is larger than k times the tasks.

Queries are taken in blocks of bounded size, one after the other; all documents meet all
blocks. Documents are split into terms once per block, statistics come from the written
vectors, and lost tasks are repeated from them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm.store import short_batches
from citegrid.llm.words import binary
from citegrid.session import Scratch

K = 50
# Queries of a block, and bytes of their texts.
BLOCK_ITEMS, BLOCK_BYTES = 1_024, 1 << 23
SLAB = 1 << 22
# Vectors of a bucket, and entries of all of them.
BUCKET_ROWS, BUCKET_ENTRIES = 4_096, 1 << 20
# Coordinates of a query that the filter inside a bucket reads.
FOCUS = 8
# Bounds are doubles; a bound this much too small is still no reason to leave a document out.
_SLACK = 1.0 + 1e-9

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _slabs(texts: list[bytes], size: int) -> Iterator[list[tuple[int, bytes]]]:
    """(index of the text, piece) in groups of about ``size`` bytes; long texts are cut outside terms."""
    group, held = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(at + size, len(text))
            while end < len(text) and _INSIDE[text[end]]:
                end += 1
            group.append((i, text[at:end]))
            held += end - at
            at = end
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def _terms(pieces: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(all terms in order, the index of the piece of each)."""
    data = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
    inside = _INSIDE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside]]))]).dictionary_encode()
    begin = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    return terms, np.searchsorted(begin, starts, side="right") - 1


def term_counts(texts: list[bytes], vocabulary: pa.Array, size: int = SLAB):
    """(terms of each text, rows, term numbers, counts): the entries of the sparse matrix in order."""
    total = np.zeros(len(texts), np.int64)
    v = max(len(vocabulary), 1)
    keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for group in _slabs(texts, size):
        terms, piece = _terms([p for _, p in group])
        row = np.array([i for i, _ in group])[piece]
        total += np.bincount(row, minlength=len(texts))
        known = pc.fill_null(pc.index_in(terms.dictionary, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        number = known[terms.indices.to_numpy()]
        here = number >= 0
        k, n = np.unique(row[here] * v + number[here], return_counts=True)
        keys.append(k)
        counts.append(n)
    key, index = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(index, np.concatenate(counts), len(key)).astype(np.int64)
    return total, key // v, key % v, count


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _vector_rows(vocabulary: pa.Array, size: int):
    """(doc_id, n, terms, counts) of every text that has a term."""
    def run(batches):
        for batch in batches:
            total, rows, terms, counts = term_counts(binary(batch.column(1)), vocabulary, size)
            some = pa.array(np.flatnonzero(total > 0))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(some), pa.array(total).take(some), _lists(terms, rows, len(total)).take(some),
                _lists(np.minimum(counts, 2**31 - 1), rows, len(total)).take(some)], names=["doc_id", "n", "terms", "counts"])
    return run


def _frequency_rows(n_terms: int):
    def run(batches):
        found = np.zeros(n_terms, np.int64)
        for batch in batches:
            found += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["term", "df"])
    return run


def impact(tf, n, n_docs: int, n_terms: int):
    """A term's part of a score without its weight; integers, rounded down."""
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _impact_rows(weights: np.ndarray, n_docs: int, n_terms: int):
    """(doc_id, terms, impacts, length); vectors of length 0 score 0 everywhere and stay away."""
    def run(batches):
        for batch in batches:
            terms, counts = batch.column(2), batch.column(3)
            offsets = terms.offsets.to_numpy()
            flat, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
            size = np.diff(offsets)
            value = impact(tf, np.repeat(batch.column(1).to_numpy(), size), n_docs, n_terms)
            row = np.repeat(np.arange(len(size)), size)
            length = np.sqrt(np.bincount(row, weights[flat] * value.astype(float) ** 2, len(size))) * _SLACK
            cut = offsets - offsets[0]
            out = pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat)),
                pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(value.astype(np.int32))), pa.array(length)],
                names=["doc_id", "terms", "impacts", "length"])
            yield out.filter(pa.array(length > 0))
    return run


class Queries:
    """A block of queries: ids, terms (largest weight first) and lengths."""

    def __init__(self, ids: list[int], terms: list[np.ndarray], weights: np.ndarray, focus: int = FOCUS):
        self.ids, self.weights = ids, weights
        order = [t[np.lexsort((t, -weights[t]))] for t in terms]
        self.focus, self.terms = [t[:focus] for t in order], order
        self.length = np.array([math.sqrt(weights[t].sum()) for t in order])
        self.rest = np.array([math.sqrt(weights[t[focus:]].sum()) for t in order])


class Best:
    """The k best (score, smallest id) of one query; null ids come last."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score, self.order, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, score: np.ndarray, order: np.ndarray, ids: np.ndarray) -> None:
        score, order, ids = (np.concatenate(p) for p in ((self.score, score), (self.order, order), (self.id, ids)))
        first = np.lexsort((ids, order, -score))[:self.k]
        self.score, self.order, self.id = score[first], order[first], ids[first]
        if len(first) == self.k:
            self.floor = int(self.score[-1])


def search_bucket(queries: Queries, best: list[Best], alive: np.ndarray, ids: np.ndarray, null: np.ndarray, terms: np.ndarray,
                  impacts: np.ndarray, cut: np.ndarray, length: np.ndarray) -> int:
    """Let the queries ``alive`` search a bucket; returns how many scores were computed."""
    n = len(ids)
    row = np.repeat(np.arange(n), np.diff(cut))
    order = np.argsort(terms, kind="stable")
    rows, values = row[order], impacts[order].astype(np.int64)
    edges = np.searchsorted(terms[order], np.arange(len(queries.weights) + 1))
    weights, square, scored = queries.weights, length * length, 0
    for q in alive.tolist():
        part, seen = np.zeros(n), np.zeros(n)
        for t in queries.focus[q].tolist():
            at = slice(edges[t], edges[t + 1])
            part[rows[at]] += weights[t] * values[at]
            seen[rows[at]] += weights[t] * values[at].astype(float) ** 2
        bound = (part + queries.rest[q] * np.sqrt(np.maximum(square - seen, 0.0))) * _SLACK
        left = np.flatnonzero(bound >= best[q].floor)
        if len(left) == 0:
            continue
        scored += len(left)
        place = np.full(n, -1)
        place[left] = np.arange(len(left))
        score = np.zeros(len(left), np.int64)
        for t in queries.terms[q].tolist():
            at = slice(edges[t], edges[t + 1])
            here = place[rows[at]]
            score[here[here >= 0]] += int(weights[t]) * values[at][here >= 0]
        good = score >= best[q].floor
        best[q].add(score[good], null[left[good]], ids[left[good]])
    return scored


def _search_rows(queries: Queries, k: int, bucket_rows: int, bucket_entries: int):
    """(query, doc_id, score): the k best documents of this task for each query."""
    def buckets(batches):
        held, entries, rows = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sizes = np.cumsum(pc.list_value_length(batch.column(1).slice(at)).to_numpy())
                take = min(bucket_rows - rows, max(1, int(np.searchsorted(sizes, bucket_entries - entries, side="right"))))
                held.append(batch.slice(at, take))
                rows, entries, at = rows + len(sizes[:take]), entries + int(sizes[:take][-1]), at + take
                if rows >= bucket_rows or entries >= bucket_entries:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, entries, rows = [], 0, 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        best = [Best(k) for _ in queries.ids]
        for bucket in buckets(batches):
            length = bucket["length"].to_numpy()
            floors = np.array([b.floor for b in best])
            # Vectors come in falling order of length, so who leaves now leaves for good.
            alive = np.flatnonzero(queries.length * length[0] * _SLACK >= floors)
            if len(alive) == 0:
                break
            lists = bucket["terms"].chunk(0)
            offsets = lists.offsets.to_numpy()
            null = bucket["doc_id"].is_null().to_numpy().astype(np.int64)
            search_bucket(queries, best, alive, pc.fill_null(bucket["doc_id"], 0).to_numpy(), null, lists.flatten().to_numpy(),
                          bucket["impacts"].chunk(0).flatten().to_numpy(), offsets - offsets[0], length)
        for q, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(b.score), q, np.int32)), pa.array(b.id, mask=b.order.astype(bool)), pa.array(b.score)],
                    names=["query", "doc_id", "score"])
    return run


def _search_block(texts: DataFrame, items: list, k: int, scratch: Scratch, name: str, sizes: dict) -> DataFrame | None:
    found = [term_counts_of(r["text"]) for r in items]
    vocabulary = sorted(set().union(*found)) if found else []
    if not vocabulary:
        return None
    number = {t: i for i, t in enumerate(vocabulary)}
    known = pa.array(vocabulary, pa.binary())
    vectors = scratch.save(texts.mapInArrow(
        _vector_rows(known, sizes["slab"]), "doc_id bigint, n bigint, terms array<int>, counts array<int>"), f"vectors-{name}")
    whole = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not whole["docs"]:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select("terms").mapInArrow(_frequency_rows(len(vocabulary)), "term int, df bigint").groupBy("term").agg(
            F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([weight(int(x), whole["docs"]) for x in df], np.int64)
    queries = Queries([r["item_id"] for r in items], [np.array(sorted(number[t] for t in f), np.int64) for f in found], weights,
                      sizes["focus"])
    lists = "doc_id bigint, terms array<int>, impacts array<int>, length double"
    hits = scratch.save(
        vectors.mapInArrow(_impact_rows(weights, whole["docs"], whole["terms"]), lists)
        .sortWithinPartitions(F.col("length").desc())
        .mapInArrow(_search_rows(queries, k, sizes["rows"], sizes["entries"]), "query int, doc_id bigint, score bigint"),
        f"hits-{name}")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ids = texts.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "query int, item_id bigint")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score"))


def term_counts_of(text: str | None) -> set[bytes]:
    """The distinct terms of one text."""
    return set(_terms([(text or "").encode()])[0].dictionary.to_pylist())


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, scratch: Scratch | None = None, focus: int = FOCUS,
                   bucket_rows: int = BUCKET_ROWS, bucket_entries: int = BUCKET_ENTRIES, block_items: int = BLOCK_ITEMS,
                   block_bytes: int = BLOCK_BYTES, slab: int = SLAB) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item the ``k`` documents with the highest score above 0.

    Equal scores go by ascending ``doc_id``, null ids last. Every row of ``docs`` is a
    document, also rows that repeat an id; null texts and texts without a term count
    nowhere and are not found. Items without id or without a term have no rows; of items that
    repeat an id the smallest text counts. Empty tables give an empty result; further
    columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    scratch = scratch or Scratch(spark, "lexical-search")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = scratch.save(items.where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").cast("bigint").alias("item_id"))
                         .agg(F.min(F.col("text").cast("string")).alias("text")), "items")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-(size["bytes"] or 0) // block_bytes))
    sizes = {"slab": slab, "focus": focus, "rows": bucket_rows, "entries": bucket_entries}
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for b in range(blocks if size["n"] else 0):
        block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        ranked = _search_block(texts, block, k, scratch, f"{b}", sizes)
        if ranked is not None:
            out = out.unionByName(ranked)
    return out


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def search_sql(k: int = K) -> str:
    """The same for DuckDB."""
    def terms(column):
        return (f"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
                f" '{TERM}')")

    return rf"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {terms('text')} AS t FROM documents),
d AS (SELECT row, doc_id, len(t)::BIGINT AS n FROM t WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({terms('text')}) AS term FROM benchmark WHERE item_id IS NOT NULL),
f AS MATERIALIZED (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS term FROM t) u
  WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
i AS (SELECT row, f.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))) AS part
  FROM f JOIN w USING (term) JOIN d USING (row), s),
r AS (SELECT item_id, row, sum(part)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY 1, 2 HAVING sum(part) > 0),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
  FROM r JOIN d USING (row))
SELECT * FROM o WHERE rank <= {k}
"""
