"""Quality rules against brute force on awkward rows."""

import random
import re
from collections import Counter

import pytest

from citegrid.llm import quality_rules
from citegrid.llm.quality_rules import RULES, Rule

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_stop_words", "n_lines"]


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, under = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            under |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stops = set(quality_rules.stop_forms())
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(under),
        "n_marks": len(re.findall("[!?]", text)), "n_stop_words": sum(w.rstrip(".,;:!?") in stops for w in words),
        "n_lines": len(lines)}


def verdict(c, rules=RULES):
    failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
    met = all(c[r.base] == 0 or ((r.least is None or 100 * c[r.count] >= r.least * c[r.base])
                                 and (r.most is None or 100 * c[r.count] <= r.most * c[r.base])) for r in rules)
    return failed, not failed and met


def check(df, pairs):
    got = sorted((str(r["doc_id"]), *(r[c] for c in COUNTS), r["base_failed"], r["kept"])
                 for r in quality_rules.judge(df).collect())
    want = []
    for i, text in pairs:
        c = counts(text)
        want.append((str(i), *(c[k] for k in COUNTS), *verdict(c)))
    assert got == sorted(want)


def test_counts_on_awkward_rows(texts, plain):
    check(texts, [(i, t) for i, t, _ in plain])


def test_counts_on_repeats_lines_and_symbols(spark):
    draw = random.Random(7)
    odd = ["a\n b\nb\n b\n\n\n", "é # * $ % & | < > ü!?", "x\x0by\x0cz\r\nx\x0by\x0cz\r\n", "a b   c",
           "The, THE the! Der? tHe", "a b c d e", "a b c d e f a b c d e", "a a a a a a"]
    data = [(i, t) for i, t in enumerate(odd)]
    for _ in range(80):
        words = [draw.choice("abc") for _ in range(draw.randrange(40))]
        data.append((len(data), "".join(w + draw.choice([" ", "\n", "\t", "  "]) for w in words)))
    check(spark.createDataFrame(data, "doc_id bigint, text string"), data)


def test_windows_alike_by_their_bits_are_compared_by_words(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_PLACE", 62)  # two bits of the hash are left
    draw = random.Random(9)
    data = [(i, " ".join(draw.choice("abcdefgh") for _ in range(60))) for i in range(30)]
    check(spark.createDataFrame(data, "doc_id bigint, text string"), data)


def test_empty_table_and_kept_rows(spark, texts, plain):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality_rules.judge(empty).collect() == []
    kept = quality_rules.keep_good(texts)
    assert kept.columns == texts.columns
    want = [i for i, t, _ in plain if verdict(counts(t))[1]]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, want))


@pytest.mark.parametrize("text, kept", [
    ("The house of the old man was by the sea and it was not far from the town.", True),
    ("house### of*** the old$$$ man%%% was by the sea&&& and it was not### far", False),
    ("houses | prices | numbers | totals | amounts | places | counts | values | items | units | names", False),
    ("THE!! HOUSE!! OF!! THE!! OLD!! MAN!! WAS!! BY!! THE!! SEA!! AND!! IT!! WAS!!", False),
    ("too few words", False),
])
def test_rules_part_prose_from_junk(spark, text, kept):
    assert quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["kept"] is kept


def test_plan_is_one_projection_and_own_tables_work(spark, texts):
    plan = quality_rules.judge(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "Join" not in plan
    strict = quality_rules.judge(texts, (Rule("never", "n_words", "n_words", least=101),))
    assert not any(r["kept"] for r in strict.collect())
