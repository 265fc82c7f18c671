"""Text operators against brute force on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter
from importlib.resources import files

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from citegrid.llm import bpe, license_scan, mixing, ngram_join, pieces, substring_dedup, token_planes, units
from citegrid.llm.words import word_hashes

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words_of(text):
    return (text or "").encode().split()


# --- words ----------------------------------------------------------------------------

def test_word_hashes_follow_words_and_case(monkeypatch):
    texts = [b"a b  c", b"", b" \n", b"A b c", b"b a", "é  x".encode(), b"long " * 50 + b"tail"]
    plain = [h.tolist() for h in word_hashes(texts)]
    assert [len(h) for h in plain] == [len(t.split()) for t in texts]
    assert plain[0][1:] == plain[3][1:] and plain[0][0] != plain[3][0]
    assert plain[4] == [plain[0][1], plain[0][0]]
    assert list(word_hashes(texts, fold=True))[0].tolist() == list(word_hashes(texts, fold=True))[3].tolist()
    monkeypatch.setattr("citegrid.llm.words.SLAB", 16)  # long texts are cut and joined
    assert [h.tolist() for h in word_hashes(texts)] == plain


# --- substring dedup --------------------------------------------------------------------

def removed(texts, width):
    windows = Counter(tuple(w[i:i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if windows[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("width", [35, 5])
def test_substring_dedup_matches_brute_force(texts, plain, rows, width):
    got = [tuple(r) for r in substring_dedup.removal_report(texts, width).collect()]
    want = [(i, *r) for (i, _, _), r in zip(plain, removed([words_of(t) for _, t, _ in plain], width))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_substring_dedup_on_random_words(spark):
    draw = random.Random(3)
    data = [(i, " ".join(draw.choice("ab") for _ in range(draw.randrange(60)))) for i in range(60)]
    got = sorted(tuple(r) for r in substring_dedup.removal_report(
        spark.createDataFrame(data, "doc_id bigint, text string"), 9).collect())
    assert got == [(i, *r) for (i, _), r in zip(data, removed([words_of(t) for _, t in data], 9))]


def test_remove_repeats_keeps_other_texts(texts, plain):
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(texts).collect()}
    assert substring_dedup.remove_repeats(texts).columns == texts.columns
    assert out[9] == "start a b c end of nine" and out[1] == "" and out[3] is None
    assert out[7] == "one two" and out[5] == " \t\n "


# --- n-gram Jaccard join ----------------------------------------------------------------

def components(data, shingle, num):
    sets = {}
    for i, text in data:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join_on_awkward_rows(texts, plain):
    got = ngram_join.jaccard_components(texts).collect()
    assert len(got) == len(plain)
    want = components([(i, t) for i, t, _ in plain if i is not None], 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] is None) == [0, 3]
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


@pytest.mark.parametrize("pairs_per_row", [4, 0])
def test_jaccard_join_finds_every_link(spark, monkeypatch, pairs_per_row):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", pairs_per_row)
    draw = random.Random(5)
    data = []
    for base in range(12):
        words = [f"b{base}w{k}" for k in range(draw.randrange(3, 90))]
        for _ in range(8):
            copy = list(words)
            for _ in range(draw.randrange(0, 4)):
                copy[draw.randrange(len(copy))] = f"z{draw.randrange(50)}"
            data.append((len(data), " ".join(copy)))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(
        docs, shingle=2, similarity=(80, 100), block_bytes=2_000).collect()}
    assert got == components(data, 2, 80)


def test_one_per_component_keeps_columns(texts):
    out = ngram_join.one_per_component(texts)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == texts.columns
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 9, 10, 11, 13, 14] and ids.count(None) == 2


# --- byte-level BPE ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def reference_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(BPE),
                             special_tokens={})


def test_codec_matches_the_library(reference_encoding):
    draw = random.Random(1)
    data = ["", " ", "a  b", "a   b", " \n x", "it's we'll", "x" * 5_000, "日本語 テスト 123", "<|endoftext|> x", "a\u0085 b\x1c c"]
    data += ["".join(draw.choice("ab c  \n\t1'sé日.") for _ in range(draw.randrange(80))) for _ in range(800)]
    tool = bpe.codec(BPE, public_tokenizers.PATTERN)
    for text, ids in zip(data, tool.encode(data)):
        assert np.frombuffer(ids, "<u4").tolist() == reference_encoding.encode_ordinary(text), text
        assert tool.decode(ids) == text.encode()


def test_units_match_the_tokenizers_library():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tool.encode_special_tokens = True
    encode = token_planes.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    draw = random.Random(9)
    data = ["", " ", "a  b", "a   b", "it's  we'll\n\n x", "<|endoftext|> x", "日本語 テスト"]
    data += ["".join(draw.choice("ab c  \n\t1'sé日.!") for _ in range(draw.randrange(80))) for _ in range(800)]
    for text, ids in zip(data, encode(data)):
        assert np.frombuffer(ids, "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids, text


def test_kept_units_do_not_change_ids(monkeypatch, reference_encoding):
    monkeypatch.setattr(units, "KEPT", 3)
    monkeypatch.setattr(units, "PIECES", 3)
    tool = bpe.Codec(bpe.load_ranks(BPE), public_tokenizers.PATTERN)
    for text in ("alpha beta gamma delta", "delta alphabetical gammas", "a  b   c"):
        assert np.frombuffer(tool.encode([text])[0], "<u4").tolist() == reference_encoding.encode_ordinary(text)


def test_encode_texts(texts, plain, reference_encoding):
    want = []
    for i, text, _ in plain:
        ids = reference_encoding.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.encode_texts(texts, BPE, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = bpe.encode_texts(texts.where("doc_id = 9"), BPE, public_tokenizers.PATTERN, keep_ids=True).first()
    assert kept["decoded"] == plain[8][1] and len(kept["ids"]) == kept["n_tokens"]


def awkward_texts(seed):
    draw = random.Random(seed)
    fixed = ["", " ", "\n\n", "'", "'s", "'r", "'re", "s", "'l", "l", "a", "it's  we'll\n\n x", "\u00a0 x", "a\x1c b", "日本語 テスト"]
    kinds = ("ab c  \n\t1'sé日.!", "a 's't're've'm'll'd \n'\"x9,é\r\x0b\x0c", "a b  \x1c\x1f\u0085\u00a0\u3000\ufeff'é ½³ⅷ")
    data = fixed + ["".join(draw.choice(kinds[k % 3]) for _ in range(draw.randrange(60))) for k in range(1_500)]
    draw.shuffle(data)
    return data


def test_pieces_are_cut_as_by_the_pattern():
    import pyarrow as pa
    import regex

    assert pieces.BYTE_LEVEL == public_tokenizers.PATTERN
    data = [t for seed in (3, 4) for t in awkward_texts(seed)]
    data = [t for t, odd in zip(data, pieces.strange(pa.array(data, pa.large_string()))) if t.isascii() and not odd]
    raw, ends = "".join(data).encode(), np.cumsum([0] + [len(t) for t in data])
    cuts = [*pieces.starts(np.frombuffer(raw, np.uint8), ends).tolist(), len(raw)]
    got = [raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])]
    assert len(data) > 400 and got == [p for t in data for p in regex.findall(public_tokenizers.PATTERN, t)]


@pytest.mark.parametrize("kept, step", [(1_000_000, 1 << 20), (5, 7)])
def test_texts_encoded_by_pieces_match_the_tokenizers_library(monkeypatch, kept, step):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_planes, "KEPT_PIECES", kept)
    monkeypatch.setattr(token_planes, "_TEXT_ENCODERS", {})
    monkeypatch.setattr(pieces, "STEP", step)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool, encode = Tokenizer.from_file(path), token_planes.text_encoder(path, public_tokenizers.PATTERN)
    for seed in (5, 6):
        data = awkward_texts(seed)
        for text, ids in zip(data, encode(data), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids, text


def test_each_distinct_piece_is_encoded_once():
    import pyarrow as pa

    seen = []
    encode = pieces.Pieces(lambda new: seen.extend(new) or [list(p.encode()) for p in new], 3)
    text = "one two, two one two\nthree " * 50
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(pa.array([text, "", text]))] == [list(text.encode()), [], list(text.encode())]
    assert sorted(seen) == sorted({"one", " one", " two", ",", "\n", "three", " "})
    seen.clear()
    assert np.frombuffer(encode(pa.array([text]))[0], "<u4").tolist() == list(text.encode())
    assert len(encode.known) == 3 and len(seen) == len(set(seen)) == 4


# --- id planes --------------------------------------------------------------------------

@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("top", [1, 300, 70_000, 1 << 31])
def test_planes_of_a_block(mode, top):
    ids = np.random.default_rng(top).integers(0, top, 1_003).astype("<u4")
    planes = token_planes.split_planes(ids, mode)
    assert (token_planes.join_planes(planes, len(ids), mode) == ids).all()


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_id_files_round_trip(texts, plain, mode):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tool.encode_special_tokens = True
    ordered = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, text, _ in ordered:
        ids = np.array(tool.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = token_planes.planes_round_trip(texts, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2, mode,
                                         block=256, file_ids=5_000).orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_id_files_hold_added_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    data = [(1, "a <|endoftext|> b"), (2, "plain words"), (3, "<|endoftext|>"), (4, "x  <|endoftext|><|endoftext|>\n é"),
            (5, "<|endoftext |> <|ENDOFTEXT|>"), (6, ""), (7, "it's" + "<|endoftext|>" * 3 + "  end")]
    want, at = [], 0
    for i, text in data:
        ids = np.array(tool.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert tool.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = token_planes.planes_round_trip(spark.createDataFrame(data, "doc_id bigint, text string"), path,
                                         public_tokenizers.PATTERN, 2).orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_cut_off_id_file_is_refused(tmp_path):
    import io

    import pyarrow as pa

    data = io.BytesIO()
    data.close = lambda: None
    writer = token_planes.PlaneWriter(data, block=8)
    writer.add(5, np.arange(20, dtype="<u4"))
    writer.close()
    reader = token_planes.PlaneReader(pa.BufferReader(data.getvalue()))
    assert reader.block(1).tolist() == list(range(8, 16))
    with pytest.raises(ValueError):
        token_planes.PlaneReader(pa.BufferReader(data.getvalue()[:-3]))


# --- licences ---------------------------------------------------------------------------

def test_license_scan(spark, texts):
    mit = license_scan.MIT
    data = [
        (1, mit), (2, mit.upper().replace("\n\n", "\n\n   ")), (3, mit.replace("sublicense", "sub-licence")),
        (4, mit.replace("Copyright (c) <year> <copyright holders>", "Copyright 2019-2021 A. Person\n© 2022 B\nAll rights reserved.")),
        (5, mit + " extra"), (6, "“Released” under the MIT licence!"), (7, None), (8, ""), (9, mit),
        (10, license_scan.UNLICENSE.replace("recognize", "recognise").replace("non-commercial", "noncommercial")),
        (11, license_scan.UNLICENSE.replace("https", "http"))]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(
        spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: None, 6: "notice: MIT", 7: None, 8: None, 9: "MIT",
                   10: "Unlicense", 11: "Unlicense"}
    assert license_scan.scan(texts).count() == texts.count()


def test_license_scan_knows_the_common_licences(spark):
    def whole(name):
        return files("citegrid.llm").joinpath("licenses", f"{name}.txt").read_text()

    long = ["Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-3-Clause"]
    data = [(name, whole(name)) for name in long]
    data += [("Apache-2.0", whole("Apache-2.0").split("   APPENDIX")[0]),
             ("Apache-2.0", whole("Apache-2.0").replace("[yyyy] [name of copyright owner]", "2020 A. Person")),
             ("GPL-2.0", whole("GPL-2.0").split("Version 2, June 1991")[1].replace("\n", "\r\n")),
             ("MPL-2.0", whole("MPL-2.0").split("==\n")[1]), ("CC0-1.0", whole("CC0-1.0").split("Legal Code")[1]),
             (None, whole("GPL-3.0") + " extra"), (None, whole("Apache-2.0")[:5_000])]
    named = {"MIT": "The MIT License (MIT)", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License",
             "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "Zlib": "zlib License", "Unlicense": "The Unlicense"}
    bodies = {"MIT": license_scan.MIT.removeprefix("MIT License\n"), "Zlib": license_scan.ZLIB, "Unlicense": license_scan.UNLICENSE,
              "BSD-2-Clause": license_scan._BSD_HEAD + license_scan._BSD_TAIL,
              "BSD-3-Clause": license_scan._BSD_HEAD + license_scan._BSD_NAMES + license_scan._BSD_TAIL,
              "ISC": license_scan._ISC_GRANT + ", provided that the above copyright notice and this permission notice "
                     "appear in all copies." + license_scan._ISC_TAIL,
              "0BSD": license_scan._ISC_GRANT + "." + license_scan._ISC_TAIL}
    data += [(name, title + "\n\n" + bodies[name]) for name, title in named.items()] + list(bodies.items())
    data += [("BSD-3-Clause", bodies["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "))]
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(data)], "doc_id bigint, text string"))
    assert {r["doc_id"]: r["license"] for r in got.collect()} == {i: name for i, (name, _) in enumerate(data)}


def test_license_scan_runs_without_python(texts):
    plan = license_scan.scan(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- mixing -----------------------------------------------------------------------------

def test_targets_share_what_full_sources_leave(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 50)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    # 1 740 words by 5, 2, 1, 5: "a" and null stop at 20 and 100, "b" at 200, "c" takes the rest.
    assert got == {"a": 20.0, None: 100.0, "b": 200.0, "c": 1740.0 - 320.0}


def test_mix_report(texts, plain):
    got = mixing.mix_report(texts).collect()
    again = mixing.mix_report(texts.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(plain)
    sizes = Counter()
    for _, text, source in plain:
        sizes[source] += len(words_of(text))
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-9
    assert {r["source_size"] for r in got} == set(sizes.values())


@pytest.mark.parametrize("lean", [None, "lean"])
def test_sources_come_near_their_targets(spark, lean):
    draw = random.Random(2)
    data = [(i, "w " * draw.randrange(1, 60), draw.choice(["a", "a", "a", "b", "c", None]), draw.random() + 0.1)
            for i in range(3_000)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string, lean double")
    got = mixing.mix_report(docs, lean=lean).toPandas()
    for _, part in got.groupby("source_size"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 60
    rows = mixing.mix(docs, lean=lean)
    assert rows.columns == docs.columns
    assert rows.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == got["taken"].sum()
    if lean:  # documents that lean more are taken more often
        got = got.merge(docs.select("doc_id", "lean").toPandas(), on="doc_id")
        assert got[got.lean > 0.8]["copies"].mean() > got[got.lean < 0.4]["copies"].mean()


# --- empty tables ------------------------------------------------------------------------

def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert substring_dedup.removal_report(empty).count() == 0
    assert ngram_join.jaccard_components(empty).count() == 0
    assert bpe.encode_texts(empty, BPE, public_tokenizers.PATTERN).count() == 0
    assert token_planes.planes_round_trip(empty, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2).count() == 0
    assert license_scan.scan(empty).count() == 0
    assert mixing.mix_report(empty).count() == 0


# --- words and texts that are easily taken for each other -----------------------------

def opposite_words(bits):
    """The Thue-Morse word over a and b and its complement, 2^bits letters each."""
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [10, 11, 12, 16])
def test_opposite_words_have_different_hashes(bits):
    x, y = word_hashes([w.encode() for w in opposite_words(bits)])
    assert x[0] != y[0]


def test_hashes_of_a_word_longer_than_unreduced_sums_hold(monkeypatch):
    texts = [b"ab" * 5_000 + b" " + b"ab" * 5_000 + b"c", "é".encode() * 4_000]
    plain = [h.tolist() for h in word_hashes(texts)]
    monkeypatch.setattr("citegrid.llm.words._UNREDUCED", 100)
    assert [h.tolist() for h in word_hashes(texts)] == plain


def test_opposite_words_stay_apart_in_both_joins(spark):
    x, y = opposite_words(10)
    rest = " ".join(f"r{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, x), (4, y)], "doc_id bigint, text string")
    assert {r["n_removed"] for r in substring_dedup.removal_report(docs).collect()} == {0}
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert found[3] == 3 and found[4] == 4


# --- tiles --------------------------------------------------------------------------------

def test_hardly_any_set_posts_an_empty_tile():
    draw = np.random.default_rng(2)
    for n in (6, 12, 33, 64, 128, 500):
        sets = [np.unique(draw.integers(0, 2**63, n).astype(np.uint64)) for _ in range(400)]
        shared = Counter(k for s in sets for k in set(ngram_join._posts(s, (85, 100)).tolist()))
        assert sum(c for c in shared.values() if c > 1) <= 12, n


@pytest.mark.parametrize("salts", [1, 3])
def test_marks_miss_nothing(spark, salts):
    from citegrid.llm import marks

    draw = np.random.default_rng(4)
    hashes = draw.integers(0, 2**63, 5_000).astype(np.uint64)
    often = hashes[:1_000]
    places = marks.places_for(1 << 18)
    batches = [marks.entries(h, np.ones(len(h), np.int64), places, i % salts) for i, h in enumerate((hashes, often, often))]
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    table = marks.mark(spark.createDataFrame(rows, marks.ENTRIES), 3, places, salts)
    assert marks.marked(table, often).all() and marks.marked(table, hashes[1_000:]).mean() < 0.05
