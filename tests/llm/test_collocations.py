"""Collocation mining against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from citegrid.llm import collocations as C


def brute(rows, longest=3, support=10, top=2_000):
    """The specification over (lang, text) pairs, with Python's exact integers."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        over = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    over[p[i:i + k]] = max(over[p[i:i + k]], a)
        rank = []
        for p, a in found.items():
            if p in over and 100 * over[p] >= 50 * a:
                continue
            score, cut = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for r, (score, a, phrase, left, right) in enumerate(sorted(rank)[:top], 1):
            out.append((lang, r, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


def corpus(seed, docs=150):
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)] + ["É", "é", "New", "york", "x\x00y"]
    fixed = ["new York city", "as well as", "deep blue sea", "ha ha ha ha"]
    rows = []
    for _ in range(docs):
        text = ""
        for _ in range(draw.randrange(25)):
            text += draw.choice(fixed) if draw.random() < 0.2 else draw.choice(vocab)
            text += draw.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "!"])
        rows.append((draw.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [("en", None), ("en", ""), (None, " \t"), ("fr", "...")]


@pytest.mark.parametrize("options", [
    {},
    {"shard_bytes": 60},  # many shards with a support below the global one
    {"shard_bytes": 400, "large": 0},  # every language counts as large
    {"shard_bytes": 200, "group_bytes": 1},  # counters are summed in two steps
    {"shard_bytes": 60, "most_places": 1},  # few places, shared by many phrases
    {"longest": 4, "support": 4, "shard_bytes": 300},
    {"longest": 2, "top": 3},
])
def test_matches_brute_force(spark, options):
    rows = corpus(11)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    bounds = {k: options[k] for k in ("longest", "support", "top") if k in options}
    want = brute(rows, **bounds)
    assert len(want) > 5 and mined(df, **options) == want


def test_awkward_rows(spark, texts, plain):
    # No column ``lang`` in the fixture: sources serve as languages; other columns clash with names inside.
    df = texts.withColumnRenamed("source", "lang").withColumnsRenamed({"key": "phrase", "n": "words", "hash": "f"})
    want = brute([(s, t) for _, t, s in plain])
    assert want and mined(df) == want


def test_empty_tables_and_ties(spark):
    schema = "lang string, text string"
    assert mined(spark.createDataFrame([], schema)) == []
    assert mined(spark.createDataFrame([(None, None)], schema)) == []
    tied = [("en", " ".join([a, b])) for a in "abcdef" for b in ["é", "z", "~", "Ω", "😀"] for _ in range(10)]
    assert mined(spark.createDataFrame(tied, schema), top=4) == brute(tied, top=4)


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", "x", 1, big + 7), ("en", "y", 1, big + 11), ("en", "x y", 2, big)]
    got = C.scored_phrases(spark.createDataFrame(rows, "lang string, phrase string, words int, f bigint"), 2).first()
    assert got["score"] == 1_000_000 * big * big // ((big + 7) * (big + 11)) and (got["l"], got["r"]) == (big + 7, big + 11)


def test_local_supports_cover_the_global_one():
    for parts in ([1] * 30, [5, 5], [100, 1, 1], [3, 9, 27, 81]):
        assert sum(C.local_support(p, sum(parts), 10) - 1 for p in parts) < 10
