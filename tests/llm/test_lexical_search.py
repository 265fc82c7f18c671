"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from citegrid.llm import lexical_search as L


def terms(text):
    return re.findall(L.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        if item is None:
            continue
        scores = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def ranked(docs, items, **options):
    return sorted((tuple(r) for r in L.rank_documents(docs, items, **options).collect()), key=str)


def corpus(seed, docs=120):
    draw = random.Random(seed)
    vocab = [f"t{i}" for i in range(60)] + ["Éa", "éa", "x1", "The", "the"]
    text = lambda most: "".join(draw.choice(vocab[: draw.choice([5, 20, 65])]) + draw.choice([" ", "-", ", ", "\x00", "\n"])
                                for _ in range(draw.randrange(most)))
    return ([(i, text(draw.choice([3, 30, 200]))) for i in range(docs)], [(i, text(25)) for i in range(15)])


@pytest.mark.parametrize("options", [
    {}, {"k": 7, "bucket_rows": 5}, {"k": 3, "focus": 1, "bucket_entries": 40}, {"k": 5, "focus": 100, "bucket_rows": 9},
    {"k": 4, "block_items": 4, "bucket_rows": 16}, {"k": 5, "slab": 16}, {"k": 5, "focus": 0, "bucket_rows": 7},
])
def test_matches_brute_force(spark, options):
    docs, items = corpus(3)
    docs += [(None, docs[5][1]), (7, docs[5][1]), (500, docs[5][1]), (501, None), (502, " .. ")]  # ties, repeats, no terms
    got = ranked(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
                 spark.createDataFrame(items, "item_id bigint, text string"), **options)
    assert got == brute(docs, items, options.get("k", 50))


def test_awkward_rows(spark, texts, plain):
    items = [(1, "quick FOX"), (2, None), (3, ""), (4, "nowhere"), (None, "dog"), (5, "w1x1 p3 vital words"), (6, "x" * 5_000)]
    clash = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in items], "item_id bigint, text string, query int, n int, rank string")
    got = ranked(texts, clash)
    assert got == brute([(i, t) for i, t, _ in plain], items) and {g[0] for g in got} == {1, 5, 6}


def test_empty_tables_and_repeated_items(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "b"), (1, "a")], "item_id bigint, text string")
    assert [r[:3] for r in ranked(docs, items)] == [(1, 1, 1)]  # the smallest text counts
    assert ranked(docs.limit(0), items) == [] and ranked(docs, items.limit(0)) == []
    assert L.rank_documents(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_spare_scores():
    rng = np.random.default_rng(1)
    n, v = 4_000, 400
    weights = rng.integers(1, 9_000, v)
    rows = [np.sort(rng.choice(v, rng.integers(1, 40), replace=False)) for _ in range(n)]
    queries = L.Queries([0], [rows[10]], weights)
    best, scored, tried = [L.Best(5)], 0, 0
    value = [rng.integers(100_000, 500_000, len(r)) // rng.choice([1, 1_000]) for r in rows]
    length = np.array([math.sqrt((weights[r] * x.astype(float) ** 2).sum()) for r, x in zip(rows, value)]) * L._SLACK
    order = np.argsort(-length)
    for at in range(0, n, 500):
        part = order[at:at + 500]
        if queries.length[0] * length[part[0]] < best[0].floor:
            break
        tried += len(part)
        scored += L.search_bucket(
            queries, best, np.array([0]), part, np.zeros(len(part), int), np.concatenate([rows[i] for i in part]),
            np.concatenate([value[i] for i in part]), np.cumsum([0] + [len(rows[i]) for i in part]), length[part])
    exact = np.array([sum(int(weights[t]) * int(x) for t, x in zip(r, vals) if t in set(rows[10].tolist())) for r, vals in zip(rows, value)])
    first = np.lexsort((np.arange(n), -exact))[:5]
    assert best[0].id.tolist() == first.tolist() and best[0].score.tolist() == exact[first].tolist()
    assert tried < n and scored < tried / 2
