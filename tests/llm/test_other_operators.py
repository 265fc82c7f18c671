"""Archives, classifier and vector searches against brute force; the queries and the pipeline."""

import base64
import hashlib
import importlib
import math
import operator
import os
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citegrid.llm import permutation_index, quality, topk_nra, warc
from citegrid.llm import queries as registered
from compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


# --- WARC -------------------------------------------------------------------------------

PAGES = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""),
         (5, "u", "long " * 40_000), (6, "u", "unlike"), (7, "u", "<p>é</p>"), (7, "u", "<p>é</p>"),
         (None, "u", "unlike"), (None, "u", "nobody"), (None, "u", "nobody")]


@pytest.mark.parametrize("min_bytes", [0, 7])
def test_archives_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id bigint, url string, html string, digest int")
    got = warc.archive_round_trip(pages, min_bytes=min_bytes, archive_bytes=3_000, sample_bytes=1_000)
    want = []
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        known = [i for i, _, h in PAGES if (h or "").encode() == payload and i is not None]
        many = sum((h or "").encode() == payload for _, _, h in PAGES)
        last = max(known) if known and many > 1 and len(payload) >= min_bytes else None
        revisit = last is not None and (page_id is None or page_id < last)
        want.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                     "revisit" if revisit else "response", last if revisit else None))
    rows = [tuple(r)[:5] for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_archive_has_its_dictionary_and_single_frames():
    import io

    import zstandard

    records = [warc.build_record(i, f"http://h/{i}", f"<html>page {i % 7} common words</html>".encode() * 40, None)
               for i in range(400)]
    out = io.BytesIO()
    out.close = lambda: None
    writer = warc.ArchiveWriter(out, dictionary_bytes=4_096, sample_bytes=100_000)
    for r in records:
        writer.add(r)
    writer.close()
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    size = int.from_bytes(data[4:8], "little")
    assert data[8:12] == bytes.fromhex("37a430ec")  # a trained dictionary
    assert list(warc.read_records(pa.BufferReader(data))) == records
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size])).decompressobj()
    assert first.decompress(data[8 + size:]) == records[0]
    with pytest.raises(ValueError):
        list(warc.read_records(pa.BufferReader(data[:-5])))
    with pytest.raises(ValueError):
        warc.parse_record(records[0].replace(b"common", b"uncommon"))


def test_no_pages_no_archive(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# --- classifier -------------------------------------------------------------------------

def test_dual_descent_reaches_the_optimum():
    draw = np.random.default_rng(0)
    rows = [np.sort(draw.choice(30, 6, replace=False)) for _ in range(80)]
    truth = draw.normal(size=30)
    signs = np.array([1.0 if truth[r].sum() > 0 else -1.0 for r in rows])
    ratio, cost = np.ones(30), np.full(80, 1.0)
    weights = quality.dual_descent(rows, signs, ratio, cost, rounds=3_000, tolerance=1e-7)
    x = np.zeros((80, 30))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(6)

    def loss(w):
        return 0.5 * w @ w + np.maximum(0, 1 - signs * (x @ w)).sum()

    best = loss(weights)
    for _ in range(300):
        assert loss(weights + draw.normal(size=30) * draw.choice([1e-3, 1e-2, 0.1])) >= best - 1e-9


def test_log_ratio_and_sigmoid():
    r = quality.log_ratio(np.array([9.0, 0.0]), np.array([0.0, 9.0]))
    assert r[1] == pytest.approx(np.log(10)) and r[0] == -r[1]
    margins = np.linspace(-3, 3, 400)
    labels = (np.random.default_rng(1).random(400) < 1 / (1 + np.exp(-(2 * margins + 0.5)))).astype(int)
    slope, offset = quality.sigmoid_fit(margins, labels)
    assert slope == pytest.approx(2, abs=0.6) and offset == pytest.approx(0.5, abs=0.5)


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


@pytest.fixture(scope="module")
def judged(spark):
    draw = np.random.default_rng(4)
    good, bad = [f"good{i}" for i in range(60)], [f"junk{i}###" for i in range(60)]
    data = [(i, " ".join(draw.choice(good if i % 3 else bad, 30)), "clash") for i in range(300)]
    data += [(300, None, ""), (301, "", ""), (302, "word " * 50_000, ""), (None, "good1 good2", ""), (0, "good3 good4 good5", "")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, quality string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, 1, 0), (7, None, 0), (9, 4, 0), (None, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_classifier_separates_held_out_texts(judged):
    docs, labels = judged
    got = quality.score_texts(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is None or fold(r["doc_id"]) == 2)
        assert r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert len(held) > 40 and all((r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in held)
    kept = quality.keep_good(docs, labels, 0.5)
    assert kept.columns == docs.columns
    assert kept.where("doc_id < 300").count() == sum(r["score"] >= 0.5 for r in got if r["doc_id"] is not None and r["doc_id"] < 300)


def test_held_out_labels_are_not_learned(judged):
    docs, labels = judged
    turned = labels.withColumn("quality", F.when(quality.fold_of(F.col("doc_id")) == 2, 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    one, two = (sorted(map(str, quality.score_texts(docs, x).collect())) for x in (labels, turned))
    assert one == two


def test_classifier_without_two_classes(spark, judged):
    docs, labels = judged
    for known in (labels.where("quality = 1"), labels.where("doc_id < 0")):
        scores = {r["score"] for r in quality.score_texts(docs, known).collect()}
        assert len(scores) == 1
    assert quality.score_texts(docs.limit(0), labels).count() == 0


# --- vectors ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(6)
    data = [(i, draw.normal(size=8).round(1).tolist(), 1) for i in range(600)]
    data += [(600, None, 1), (601, [1.0] * 7 + [None], 1), (602, [float("nan")] * 8, 1), (603, [float("inf")] * 8, 1),
             (604, [], 1), (605, [0.0] * 8, 1), (606, data[3][1], 1), (607, data[3][1], 1), (50, data[50][1], 1),
             (None, [1.0] * 8, 1), (650, [1.0, 2.0], 1), (700, [0.5, 0.5], 1), (651, [2.0, -1.0], 1)]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<float>, rank int")


def usable(vectors):
    out = {}
    for i, v, _ in vectors.collect():
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            out[i] = np.array(v, float)
    return out


@pytest.mark.parametrize("cell_rows", [4096, 37])
def test_exact_top_k(vectors, cell_rows):
    known = {i: np.floor(1024 * v) for i, v in usable(vectors).items()}
    want = []
    for q in sorted(known):
        if q % 100 == 0:
            scored = sorted((-int(known[q] @ v), i) for i, v in known.items() if i != q and len(v) == len(known[q]))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:10])]
    got = topk_nra.top_inner_products(vectors, cell_rows=cell_rows, cell_queries=3)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_bounds_stop_before_the_lists_end():
    rows = np.concatenate([np.full((20, 4), 500.0), np.random.default_rng(0).integers(0, 50, (400, 4)).astype(float)])
    found = topk_nra.best_rows(rows, np.arange(420), np.ones((1, 4)), np.array([-1]), 5, depths=(0.1,), scale=1)
    assert [(j, s) for _, j, s in found] == [(j, 2000) for j in range(5)] or found == []
    found = topk_nra.best_rows(rows, np.arange(420), np.ones((1, 4)), np.array([-1]), 5, scale=1)
    assert [(j, s) for _, j, s in found] == [(j, 2000) for j in range(5)]


def test_bounds_of_all_lists_at_once():
    """Many queries cost products of matrices, not a pass over the rows per list."""
    draw = np.random.default_rng(5)
    rows, ids = np.abs(draw.normal(size=(4_096, 64))) ** 3, np.arange(4_096)
    start = time.process_time()
    found = topk_nra.best_rows(rows, ids, rows[::4], ids[::4], 10)
    assert time.process_time() - start < 7
    score = np.floor(rows * 1024) @ np.floor(rows[:40:4] * 1024).T
    for q in range(10):
        score[4 * q, q] = -1
        want = np.lexsort((ids, -score[:, q]))[:10]
        assert sorted((j, s) for i, j, s in found if i == q) == sorted((j, int(score[j, q])) for j in want.tolist())


@pytest.mark.parametrize("cell_rows", [4096, 5])
def test_exact_top_k_of_very_large_components(spark, cell_rows):
    """Beyond 2^53, beyond 64 bits and far beyond doubles, beside plain rows."""
    draw = random.Random(3)
    data = [(i, [2.0**17 + draw.randrange(4) / 1024 for _ in range(3)]) for i in range(90, 140)]
    data += [(i, [draw.choice([-1, 1]) * 2.0**draw.randrange(20, 40) for _ in range(3)]) for i in range(190, 215)]
    data += [(i, [1.0, float(i), -2.0]) for i in range(290, 330)]
    data += [(400, [1e300, 1e308, -3.0]), (401, [-1e300, 5.0, 1.0]), (402, [1e300, 1e300, 0.0]), (403, [2.0**400, 0.0, 0.5])]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")

    def scaled(v):
        return [math.floor(Fraction(x) * 1024) for x in v]

    known, want = {i: scaled(v) for i, v in data}, []
    for q in (100, 200, 300, 400):
        scores = [(-min(max(sum(map(operator.mul, known[q], v)), -2**63), 2**63 - 1), i) for i, v in known.items() if i != q]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:10])]
    got = topk_nra.top_inner_products(table, cell_rows=cell_rows, cell_queries=2)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(2**53 < abs(s) < 2**63 - 1 for *_, s in want) and any(s == 2**63 - 1 for *_, s in want)


def test_cells_are_dealt_to_tasks(vectors):
    found = topk_nra.in_cells(topk_nra.usable(vectors), F.col("vec_id") % 100 == 0, topk_nra._cell(3, 1024),
                              "query_id bigint, vec_id bigint, score bigint", cell_rows=60, cell_queries=3)
    assert found.rdd.getNumPartitions() >= 10  # a cell per pair of blocks, whatever their bytes


def test_footrule_from_inverted_files():
    draw = np.random.default_rng(2)
    prefix, n = 5, 40
    near = np.stack([draw.permutation(12)[:prefix] for _ in range(n)])
    asked = draw.permutation(12)[:prefix]
    files = [(np.flatnonzero((near == p).any(axis=1)),
              np.array([prefix - list(r).index(p) for r in near if p in r], np.int32)) for p in range(12)]

    def place(order, p):
        return list(order).index(p) if p in order else prefix

    footrule = np.array([sum(abs(place(asked, p) - place(r, p)) for p in range(12)) for r in near])
    assert (prefix * (prefix + 1) - permutation_index.footrule_gain(files, asked, n, prefix) == footrule).all()


@pytest.mark.parametrize("cell_rows", [4096, 200])
def test_permutation_index(vectors, cell_rows):
    known = {i: v for i, v in usable(vectors).items() if v.any()}
    got = permutation_index.nearest(vectors, pivots=32, prefix=16, share=0.3, cell_rows=cell_rows).collect()
    hits = asked = 0
    for q in (i for i in known if i % 50 == 0):
        cosine = {i: float(v @ known[q] / np.linalg.norm(v) / np.linalg.norm(known[q]))
                  for i, v in known.items() if i != q and len(v) == len(known[q])}
        best = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        assert all(s == pytest.approx(cosine[i], abs=1e-12) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(best))
        asked += len(best)
    assert hits / asked >= 0.9


@pytest.mark.parametrize("cell_rows", [4096, 1000])
def test_permutation_index_where_a_third_is_one_vector(spark, cell_rows):
    draw = np.random.default_rng(12)
    hot = draw.normal(size=8)
    known = {i: hot if draw.random() < 1 / 3 else draw.normal(size=8) for i in range(3_000)}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in known.items()], "vec_id bigint, embedding array<double>")
    found: dict[int, list] = {}
    for r in permutation_index.nearest(table, pivots=32, prefix=16, cell_rows=cell_rows).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    copies = [i for i, v in known.items() if v is hot]
    unit = np.stack([v / np.linalg.norm(v) for v in known.values()])
    hits = asked = 0
    for q in range(0, 3_000, 50):
        cosine = (unit * unit[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(3_000), -cosine)).tolist() if i != q][:5]
        if known[q] is hot:
            assert found[q] == [i for i in copies if i != q][:5]
        else:
            hits += len(set(best) & set(found[q]))
            asked += 5
    assert hits / asked >= 0.9


def test_searches_of_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk_nra.top_inner_products(empty).count() == 0
    assert permutation_index.nearest(empty).count() == 0


# --- queries and pipeline ------------------------------------------------------------------

@tables
@pytest.mark.parametrize("name", sorted(registered.CHECKS))
def test_query_against_sql(spark, name):
    ok, message = compare(spark, connect(SF_DIR), name, registered.QUERIES[name], registered.CHECKS[name], SF_DIR)
    assert ok, message


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES) == list(range(1, 14))


@tables
def test_recall_of_the_index_query(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    got = registered.QUERIES["op9_permutation_index"](spark, SF_DIR).collect()
    hits = asked = 0
    for q in (i for i in rows if i % 50 == 0):
        cosine = {i: float(v @ rows[q] / np.linalg.norm(v) / np.linalg.norm(rows[q])) for i, v in rows.items() if i != q}
        best = set(sorted(cosine, key=lambda i: (-cosine[i], i))[:5])
        hits += len(best & {r["vec_id"] for r in got if r["query_id"] == q})
        asked += len(best)
    assert hits / asked >= 0.9


@tables
def test_pipeline_stage_by_stage(spark):
    from test_text_operators import BPE, components, removed, words_of

    import public_tokenizers
    import tiktoken
    from citegrid.llm import bpe, mixing

    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixture", "token_ids"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF_DIR).cache()
        rows = out.collect()
        if name == "quality":
            labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
            scores = {r["doc_id"]: r["score"] for r in quality.score_texts(docs, labels).collect()}
            assert {r["doc_id"] for r in rows} == {i for i, s in scores.items() if s >= pipeline.LEAST_SCORE}
            assert all(r == before[r["doc_id"]] for r in rows)
        elif name == "near_duplicates":
            found = components([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert {r["doc_id"] for r in rows} == {i for i, (_, c) in found.items() if i == c}
        elif name == "repeated_passages":
            ids = sorted(before)
            expected = dict(zip(ids, removed([words_of(before[i]["text"]) for i in ids], 35)))
            for r in rows:
                n, gone, digest = expected[r["doc_id"]]
                assert hashlib.sha256(b" ".join(words_of(r["text"]))).hexdigest() == digest
                assert gone or r == before[r["doc_id"]]
        elif name == "mixture":
            taken = {r["doc_id"]: r["copies"] for r in mixing.mix_report(docs).collect()}
            copies = {}
            for r in rows:
                copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
                assert r == before[r["doc_id"]]
            assert copies == {i: n for i, n in taken.items() if n}
        else:
            tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(BPE),
                                     special_tokens={})
            assert len(rows) == docs.count()
            for r in rows:
                ids = np.array(tool.encode_ordinary(before[r["doc_id"]]["text"]), "<u4")
                assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
            break
        assert out.columns == columns
        docs, before = out, {r["doc_id"]: r for r in rows}
    assert pipeline.run(spark, SF_DIR).count() == len(rows)
