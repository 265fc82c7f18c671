"""Titles: extraction, similarity and search."""

import random

import pytest
from pyspark.sql import functions as F

from citegrid.functions import similarity as S
from citegrid.functions import titles as T
from citegrid.operators import linkage as L


def plain_lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, line[j] = line[j], prev + 1 if x == y else max(line[j], line[j - 1])
    return line[-1]


def test_lcs_against_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 90))) for _ in "ab")
        assert S.lcs_length(a, b) == plain_lcs(a, b)


def test_known_pair(spark):
    a = "amap assessment 2015 human health in the arctic"
    b = "AMAP assessment 2015: human health in the Arctic"
    df = spark.createDataFrame([(a, b), (None, b), (" A ", "a")], "a string, b string")
    raw = [r[0] for r in df.select(S.similarity_ratio(F.col("a"), F.col("b"))).collect()]
    assert raw[0] == pytest.approx(0.8842105263157894, abs=1e-15) and raw[1] is None
    low = [r[0] for r in df.select(S.title_similarity(F.col("a"), F.col("b"))).collect()]
    assert low[0] > 0.98 and low[1:] == [0.0, 1.0]


@pytest.mark.parametrize("reference, title", [
    ("Doe, J., 2019: A title: part. J. Tests.", "A title: part"),
    ("no opening here. at all", ""), ("Doe: no close", "no clos"), ("Doe: ", ""), ("a. b: c. d", "c"),
])
def test_extract_title(spark, reference, title):
    df = spark.createDataFrame([(reference,)], "r string")
    assert df.select(T.extract_title(F.col("r"))).first()[0] == title


def test_normalize_deletes_punctuation(spark):
    df = spark.createDataFrame([("A-b: C'd? (E)\\f",)], "t string")
    row = df.select(T.normalize(F.col("t")), T.query_text(F.col("t")), T.tokens(F.col("t"))).first()
    assert row[0] == "ab cd ef" and row[1] == "A b  C d  (E)\\f" and row[2] == ["ab", "cd", "ef"]


@pytest.fixture(scope="module")
def search_data(spark):
    rng = random.Random(3)
    words = ["the", "ice", "sea", "of", "rare", "melt", "rise", "heat"]
    catalog = [(f"W{i}", " ".join(["The"] + rng.choices(words, k=rng.randint(1, 5))), float(rng.randint(1, 4)))
               for i in range(60)]
    catalog += [(f"C{i}", "Hot: Copy, title", 1.0) for i in range(30)]    # copies of one title
    asked = [(i, " ".join(rng.choices(words + ["unknown"], k=rng.randint(0, 3)))) for i in range(40)]
    asked += [(100 + i, "copy title") for i in range(30)] + [(200, None), (201, "  "), (202, "the")]
    return (catalog, asked, spark.createDataFrame(asked, "row_idx long, title string"),
            spark.createDataFrame(catalog, "oa_id string, oa_title string, relevance_score double"))


@pytest.mark.parametrize("block_rows", [2, 10_000])
def test_search_against_brute_force(search_data, rows, block_rows):
    catalog, asked, queries, snapshot = search_data
    clean = str.maketrans("", "", ":,")
    sets = [(oa, set(t.lower().translate(clean).split()), s) for oa, t, s in catalog]
    want = []
    for i, title in asked:
        if not (title or "").strip():
            continue
        hits = [(-s, oa) for oa, w, s in sets if set(title.split()) <= w]
        want.append((i, len(hits), min(hits)[1] if hits else None))
    found = L.search(queries, snapshot, block_rows)
    got = [tuple(r) for r in found.select("row_idx", "count", "oa_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    missing = {r.row_idx for r in L.unmatched(queries, found).collect()}
    assert missing == {i for i, _ in asked} - {i for i, n, _ in want if n}


def test_length_bound_drops_no_match(spark):
    pairs = [("abcd", "abcd"), ("abcd", "abcdefghijkl"), ("", ""), ("xy", "ab")]
    df = spark.createDataFrame(pairs, "title string, oa_title string")
    kept = {r.title + r.oa_title for r in L.similar_pairs(df, 0.85).collect()}
    assert kept == {"abcdabcd", ""}
