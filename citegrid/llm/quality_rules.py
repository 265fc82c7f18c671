"""Quality rules: a table of thresholds compiled into one projection.

Each rule bounds a ratio of two counts of a text. The counts are built-in expressions, the
rules are compared as integers (per hundred), and all of it becomes columns of one
projection over the table: no shuffle, no join and no user function.

A word is a maximal run of characters other than space and 0x09-0x0D, a line what lies
between line feeds, a window five consecutive words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MARK = r"[!?]"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

#: Frequent function words of the languages that the rules serve.
STOP_WORDS = {
    "en": "the of and to a in that is was for with on as it be this are by from at or an have not".split(),
    "fr": "le la les de des du et un une que qui est pour dans par sur au en ce il".split(),
    "de": "der die das und ist ein eine zu den von mit dem des auf für im nicht sich es auch als".split(),
    "es": "el la los las de del que y en un una es por con para se su al lo no".split(),
}
#: Stripped from the end of a word before it is looked up.
STOPS = ".,;:!?"


@dataclass(frozen=True)
class Rule:
    """``least <= 100 * count / base <= most``; None leaves a side open. Base 0 passes."""

    name: str
    count: str
    base: str
    least: int | None = None
    most: int | None = None


#: Thresholds per hundred of the base. They leave room on the clean side: a rule is to
#: reject what no prose of the four languages reaches.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1_500),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("marks", "n_marks", "n_words", most=50),
    Rule("stop_words", "n_stop_words", "n_words", least=4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=40),
)


def stop_forms() -> list[str]:
    """The stop words in lower case, capitalised and in capitals."""
    words = sorted({w for group in STOP_WORDS.values() for w in group})
    return sorted({form for w in words for form in (w, w.capitalize(), w.upper())})


#: Bits of a window's position in its packed form; the bits above are the window's hash.
_PLACE = 31


def _windows(words: Column, width: int) -> Column:
    """A number per window, ascending: bits of its hash, then its position."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    packed = F.transform(F.array(hashes), lambda h: F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(0))),
        lambda x, i: F.shiftleft(F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]), _PLACE).bitwiseOR(i.cast("bigint"))))
    return F.sort_array(packed[0])


def _alike(windows: Column) -> Column:
    """Windows that share the bits of their hash with a neighbour, hence with any window."""
    def same(x, k):
        return F.coalesce(F.shiftright(x, _PLACE) == F.shiftright(F.get(windows, k), _PLACE), F.lit(False))

    return F.filter(windows, lambda x, k: same(x, k - 1) | same(x, k + 1))


def _repeated_words(words: Column, alike: Column, width: int) -> Column:
    """Words under windows that occur twice or more.

    Windows that are alike by hash are sorted with their words, so equal ones are
    neighbours; of the positions kept, in order, each adds the words not under the one
    before.
    """
    place = F.lit((1 << _PLACE) - 1).cast("bigint")
    order = F.array_sort(F.transform(alike, lambda x: F.struct(
        F.shiftright(x, _PLACE).alias("h"),
        F.slice(words, x.bitwiseAND(place).cast("int") + 1, F.lit(width)).alias("g"),
        x.bitwiseAND(place).cast("int").alias("i"))))

    def twice(ordered):
        def same(x, k):
            y = F.get(ordered, k)
            return F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))

        return F.array_sort(F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def under(starts):
        return F.aggregate(starts, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).alias("last")),
                           lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")),
                           lambda acc: acc["n"])

    # Each step is the one element of an array, so that it is computed once.
    found = F.transform(F.transform(F.array(order), twice), under)[0]
    return F.when(F.size(alike) > 0, found).otherwise(F.lit(0).cast("bigint"))


def _step(keep: list[Column | str], **columns: Column) -> list[Column | str]:
    """``keep`` and the columns, computed once per row.

    They are the fields of a one-element array taken apart: an optimizer that moves a
    condition below a projection would put each expression in the place of every use.
    """
    return [*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))]


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the counts that rules refer to, one row per row of ``docs``."""
    kept = list(keep)
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = rows.select(*_step(
        [*kept, "_text"], _words=F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)),
        _lines=F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD))))
    rows = rows.select(*_step([*kept, "_text", "_words", "_lines"], _windows=_windows(F.col("_words"), WINDOW)))
    rows = rows.select(*_step([*kept, "_text", "_words", "_lines"], _alike=_alike(F.col("_windows"))))
    stops = stop_forms()
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length("_text") - F.regexp_count("_text", F.lit(SPACE)),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOL)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeated_words(F.col("_words"), F.col("_alike"), WINDOW),
        "n_marks": F.regexp_count("_text", F.lit(MARK)),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.rtrim(w, F.lit(STOPS)).isin(stops))),
        "n_lines": F.size("_lines"),
    }
    return rows.select(*_step(kept, **{name: c.cast("bigint") for name, c in counts.items()}))


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of rules as one condition."""
    met = F.lit(True)
    for rule in rules:
        share = 100 * F.col(rule.count)
        for bound, holds in ((rule.least, lambda x: share >= x), (rule.most, lambda x: share <= x)):
            if bound is not None:
                met = met & ((F.col(rule.base) == 0) | holds(F.lit(bound) * F.col(rule.base)))
    return met


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` and the
    further counts, one row per row of ``docs``.

    Null, empty and blank texts have no words, so they fail the base and are not kept.
    Repeated rows are judged alike, a null ``doc_id`` stays null, an empty table gives an
    empty result, and further columns, whatever their names, are not read.
    """
    failed = base_failed()
    return measures(docs, "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passes(rules)).alias("kept"), "n_marks", "n_stop_words", "n_lines")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("text"))
    return measures(row, "_row").where(~base_failed() & passes(rules)).select("_row.*")


def judge_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table for DuckDB."""
    def quoted(words):
        return ", ".join("'" + w + "'" for w in words)

    met = " AND ".join(f"({r.base} = 0 OR 100 * {r.count} {sign} {bound} * {r.base})" for r in rules
                       for sign, bound in ((">=", r.least), ("<=", r.most)) if bound is not None)
    failed = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM documents),
g AS (SELECT k, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t WHERE len(w) >= {WINDOW}) p),
h AS (SELECT k, unnest(list(i)) AS i FROM g GROUP BY k, g HAVING count(*) > 1),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + {WINDOW})) AS j FROM h) x GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{SYMBOL}'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '{MARK}'))::BIGINT AS n_marks,
    len(list_filter(w, lambda x: list_contains([{quoted(stop_forms())}], rtrim(x, '{STOPS}'))))::BIGINT AS n_stop_words,
    len(l)::BIGINT AS n_lines FROM t LEFT JOIN r USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,
  NOT {failed} AND {met} AS kept, n_marks, n_stop_words, n_lines FROM m
"""
