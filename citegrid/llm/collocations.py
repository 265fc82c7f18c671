"""Phrase collocation mining by the partition method (SON: Savasere, Omiecinski, Navathe, 1995).

Texts fall into pieces at punctuation and line ends, pieces into words; a phrase is a run
of words of one piece, counted per language. A phrase with global support f occurs in
some shard at least as often as that shard's share of f, so:

1. Every task mines its texts shard by shard, each shard completely: phrases that reach
   the shard's proportional support are its locally frequent ones. In a large language a
   shard's part of the support is below one occurrence, so there all phrases are.
2. Locally frequent phrases are united, as places in a table of counters: the hash of a
   phrase is its place. Counters are summed in slices; places whose sum, with what the
   shards may have left out, reaches the support are marked. The table of marks, a bit per
   place and of bounded size, is the only thing that goes back to the tasks.
3. A second pass over the texts counts the phrases whose place and whose parts' places are
   marked, now by their words. These counts are exact and decide; a mark too many, as
   places are shared, costs a row and changes nothing.

Inside a shard words and phrases are numbered, so its counts are exact as well. A part of
a phrase is at least as frequent as the phrase, so all counts that a score needs are among
those of step 3; they are looked up by joins of stored tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm import marks
from citegrid.llm.store import short_batches
from citegrid.llm.words import binary, mix
from citegrid.session import Scratch

LONGEST = 3
SUPPORT = 10
TOP = 2_000
NO_LANG = "und"
#: Per hundred of its own count that a longer phrase must reach to take a shorter one's place.
NESTED = 50
# Bytes of text in a shard.
SHARD_BYTES = 1 << 21
# Words of a language from which on every phrase counts as locally frequent, and languages
# whose totals are sent to the tasks; the shards of others have a support of one.
LARGE_LANG, MOST_LANGS = 10_000_000, 10_000
BATCH = 200_000
# Parts of a language that are ranked before the whole.
PARTS = 8

#: Word runs of a text, for counting them without splitting.
RUN = r"[^\x20\x09\x0A-\x0D.,;:!?]+"
_INSIDE = np.ones(256, bool)
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE[_BREAK] = False
_INSIDE[list(b" \t")] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAKS = bytes(np.flatnonzero(_BREAK).astype(np.uint8))


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """(languages, texts) of about ``size`` bytes; longer texts are cut where a piece ends."""
    langs, texts, held = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
            at = 0
            while at < len(text):
                end = min(at + size, len(text))
                while end < len(text) and text[end - 1] not in _BREAKS:
                    end += 1
                langs.append(lang)
                texts.append(text[at:end])
                held += end - at
                at = end
                if held >= size:
                    yield langs, texts
                    langs, texts, held = [], [], 0
    if texts:
        yield langs, texts


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each key, distinct keys, their counts)."""
    coded = pa.array(keys).dictionary_encode()
    index = coded.indices.to_numpy()
    return index, coded.dictionary.to_numpy(), np.bincount(index, minlength=len(coded.dictionary))


class Shard:
    """Phrases of a shard by length: their parts' numbers, language, count and hash."""

    def __init__(self, langs: list[str], texts: list[bytes], longest: int):
        self.langs = list(dict.fromkeys(langs))
        number = {lang: i for i, lang in enumerate(self.langs)}
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = _INSIDE[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edge[::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [
            None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside]]))]).dictionary_encode()
        self.vocab = words.dictionary
        piece = np.cumsum(_BREAK[data])[starts] if len(starts) else np.empty(0, np.int64)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        lang = np.array([number[x] for x in langs])[np.searchsorted(begin, starts, side="right") - 1]
        self.n_words = np.bincount(lang, minlength=len(self.langs))

        v = max(len(self.vocab), 1)
        own, keys, counts = _numbered(lang * v + words.indices.to_numpy().astype(np.int64))
        self.word, self.lang = keys % v, keys // v
        of_word = np.array([xxhash.xxh3_64_intdigest(w) for w in self.vocab.cast(pa.binary()).to_pylist()], np.uint64)
        of_lang = np.array([xxhash.xxh3_64_intdigest(x, seed=1) for x in self.langs], np.uint64)
        single = mix(of_word[self.word] ^ mix(of_lang[self.lang]))
        # Per length: (first parts, last words, counts, hashes); parts are numbers of the length before.
        self.levels = [(np.arange(len(keys)), np.arange(len(keys)), counts, single)]
        heads, hashes, u = own.astype(np.int64), single, max(len(keys), 1)
        for k in range(1, longest):
            n = max(len(own) - k, 0)
            here = np.flatnonzero((heads[:n] >= 0) & (piece[:n] == piece[k:k + n]))
            index, keys, counts = _numbered(heads[here] * u + own[here + k])
            first, last = keys // u, keys % u
            hashes = mix(hashes[first] * np.uint64(0x9E3779B97F4A7C15) + mix(single[last] + np.uint64(k)))
            self.levels.append((first, last, counts, hashes))
            heads = np.full(n, -1, np.int64)
            heads[here] = index

    def lang_of(self, level: int, at: np.ndarray) -> np.ndarray:
        """Language numbers of the phrases ``at`` of a level."""
        return self.lang[self.levels[level][1][at]]

    def phrases(self, level: int, at: np.ndarray) -> pa.Array:
        """Their words joined by one space."""
        parts = []
        for k in range(level, -1, -1):
            first, last = self.levels[k][:2]
            parts.append(self.vocab.take(pa.array(self.word[last[at]])))
            at = first[at]
        return pc.binary_join_element_wise(*reversed(parts), pa.scalar(" ")) if level else parts[0]


def local_support(words: int, total: int, support: int) -> int:
    """Least count in a shard of ``words`` out of ``total`` words that some shard must reach."""
    return max(1, -(-support * words // max(total, 1)))


def _local_rows(longest: int, support: int, totals: dict[str, int], size: int, large: int, places: int, salts: int):
    """(slice, salt, entries) of each shard's locally frequent phrases."""
    def run(batches):
        salt = TaskContext.get().partitionId() % salts
        for langs, texts in shards(batches, size):
            shard = Shard(langs, texts, longest)
            small = [totals.get(x, large) < large for x in shard.langs]
            least = np.array([local_support(int(n), totals[x], support) if s else 1
                              for x, n, s in zip(shard.langs, shard.n_words, small)])
            # What all shards together may leave out of a phrase is below the support.
            spare = np.array([support - 1 if s else 0 for s in small])
            found, n = [], []
            for level, (_, _, counts, hashes) in enumerate(shard.levels):
                lang = shard.lang_of(level, np.arange(len(counts)))
                keep = counts >= least[lang]
                found.append(hashes[keep])
                n.append(np.minimum(counts[keep], 255) + spare[lang[keep]])
            yield marks.entries(np.concatenate(found), np.concatenate(n), places, salt)
    return run


def _counted_rows(longest: int, known, size: int):
    """(lang, phrase, words, n) of each shard's marked phrases."""
    def run(batches):
        for langs, texts in shards(batches, size):
            shard = Shard(langs, texts, longest)
            names = pa.array(shard.langs, pa.string())
            passed = []
            for level, (first, last, counts, hashes) in enumerate(shard.levels):
                good = marks.marked(known, hashes)
                if level:
                    good &= passed[-1][first] & passed[0][last]
                passed.append(good)
                keep = np.flatnonzero(good)
                for a in range(0, len(keep), BATCH):
                    at = keep[a:a + BATCH]
                    yield pa.RecordBatch.from_arrays([
                        names.take(pa.array(shard.lang_of(level, at))), shard.phrases(level, at),
                        pa.array(np.full(len(at), level + 1, np.int32)), pa.array(counts[at].astype(np.int64))],
                        names=["lang", "phrase", "words", "n"])
    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.col("text").cast("string").alias("text"))


def lang_words(docs: DataFrame) -> DataFrame:
    """``(lang, n)``: all words of each language."""
    return _texts(docs).groupBy("lang").agg(
        F.sum(F.coalesce(F.regexp_count("text", F.lit(RUN)), F.lit(0))).cast("bigint").alias("n"))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT, scratch: Scratch | None = None,
                     shard_bytes: int = SHARD_BYTES, large: int = LARGE_LANG, most_places: int = marks.MOST_PLACES,
                     group_bytes: int = marks.GROUP_BYTES) -> DataFrame:
    """``(lang, phrase, words, f)`` of all phrases of up to ``longest`` words with f >= ``support``.

    ``support`` is at most 246. Beyond some 10^9 different phrases most places are marked
    and the second pass counts nearly all of them; counts stay exact.
    """
    spark = docs.sparkSession
    short_batches(spark)
    scratch = scratch or Scratch(spark, "collocations")
    sizes = scratch.save(lang_words(docs), "lang-words")
    totals = {r["lang"]: r["n"] for r in sizes.orderBy("n", "lang").limit(MOST_LANGS).collect()}
    words = sizes.agg(F.sum("n")).first()[0] or 0
    places = marks.places_for(2 * words, most_places)
    salts = marks.salts_for(longest * words, group_bytes)
    texts = _texts(docs).where(F.col("text").isNotNull())
    known = marks.mark(texts.mapInArrow(
        _local_rows(longest, support, totals, shard_bytes, large, places, salts), marks.ENTRIES), support, places, salts)
    counted = texts.mapInArrow(_counted_rows(longest, known, shard_bytes),
                               "lang string, phrase string, words int, n bigint")
    return scratch.save(counted.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.sum("n").alias("f"))
                        .where(F.col("f") >= support), "frequent")


def _span(words: Column, at: int, n: int) -> Column:
    return F.array_join(F.slice(words, at + 1, n), " ")


def scored_phrases(frequent: DataFrame, longest: int = LONGEST, scratch: Scratch | None = None) -> DataFrame:
    """``(lang, phrase, a, cut, l, r, score)`` of all candidates, by the lowest-scoring cut."""
    scratch = scratch or Scratch(frequent.sparkSession, "collocation-scores")
    found = frequent.where("words > 1").select("lang", "phrase", "words", F.split("phrase", " ").alias("w"))
    asked = [found.where(F.col("words") == n).select(
        "lang", "phrase", F.inline(F.array(*[F.struct(F.lit(2 * cut + side).alias("slot"), part.alias("part"))
                                             for cut in range(1, n)
                                             for side, part in enumerate((_span(F.col("w"), 0, cut), _span(F.col("w"), cut, n - cut)))])))
        for n in range(2, longest + 1)]
    requests = asked[0]
    for more in asked[1:]:
        requests = requests.unionByName(more)
    counts = frequent.select("lang", F.col("phrase").alias("part"), "f")
    answers = requests.join(counts, ["lang", "part"]).select("lang", "phrase", "slot", "f")
    own = frequent.where("words > 1").select("lang", "phrase", F.lit(0).alias("slot"), "f")
    slots = [F.max(F.when(F.col("slot") == s, F.col("f"))).alias(f"f{s}") for s in (0, *range(2, 2 * longest))]
    sides = own.unionByName(answers).groupBy("lang", "phrase").agg(*slots)
    cuts = [F.when(F.col(f"f{2 * k}").isNotNull(), F.struct(
        F.expr(f"(cast(1000000 * cast(f0 as decimal(15,0)) as decimal(22,0)) * cast(f0 as decimal(15,0))) div (cast(f{2 * k} as decimal(15,0)) * cast(f{2 * k + 1} as decimal(15,0)))").alias("score"),
        F.lit(k).alias("cut"), F.col(f"f{2 * k}").alias("l"), F.col(f"f{2 * k + 1}").alias("r"))) for k in range(1, longest)]
    best = F.array_min(F.array_compact(F.array(*cuts)))
    return scratch.save(sides.select("lang", "phrase", F.col("f0").alias("a"), best.alias("best"))
                        .select("lang", "phrase", "a", "best.cut", "best.l", "best.r", "best.score"), "scored")


def nested(frequent: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``(lang, phrase, top)``: the count of the most frequent longer candidate around each phrase."""
    rows = None
    for n in range(3, longest + 1):
        w = F.split("phrase", " ")
        inner = [_span(w, at, k) for k in range(2, n) for at in range(n - k + 1)]
        part = frequent.where(F.col("words") == n).select("lang", F.explode(F.array(*inner)).alias("phrase"), F.col("f").alias("top"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = frequent.where("false").select("lang", "phrase", F.col("f").alias("top"))
    return rows.groupBy("lang", "phrase").agg(F.max("top").alias("top"))


def collocations(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT, top: int = TOP,
                 scratch: Scratch | None = None, **mining) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase's score is that of its lowest-scoring cut (ties: after fewest words),
    floor(10^6 a a / (l r)). Phrases inside a longer candidate with at least half their
    count drop out. Order: score, then ``a``, both descending, then the phrase's bytes.
    Null and empty texts have no phrase; a null language is ``und``; repeated rows count
    as often as they occur; an empty table gives an empty result; ``doc_id`` and further
    columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    frequent = frequent_phrases(docs, longest, support, scratch, **mining)
    scored = scored_phrases(frequent, longest, scratch)
    inside = scratch.save(nested(frequent, longest), "nested")
    left = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("top").isNull() | (100 * F.col("top") < NESTED * F.col("a")))
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    # First the best of each of a few parts, so that one task orders a bounded number of rows.
    some = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("at") <= top)
    order = Window.partitionBy("lang").orderBy(*best)
    first = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = lang_words(docs)
    return first.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(top: int = TOP, support: int = SUPPORT) -> str:
    """The same for DuckDB, phrases of two and three words."""
    return rf"""
WITH p AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {support}),
s AS (SELECT lang, phrase, k, a, cut, array_to_string(w[:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y
  FROM c, (VALUES (1), (2)) v(cut) WHERE cut < k),
z AS (SELECT s.lang, s.phrase, s.a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM s JOIN f l ON l.lang = s.lang AND l.phrase = x JOIN f r ON r.lang = s.lang AND r.phrase = y),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, x AS phrase, max(a) AS top FROM (SELECT lang, array_to_string(w[:2], ' ') AS x, a FROM c WHERE k = 3
  UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM c WHERE k = 3) i GROUP BY 1, 2),
q AS (SELECT b.lang, phrase, a, l, r, score::BIGINT AS score FROM b LEFT JOIN o USING (lang, phrase) WHERE top IS NULL OR 100 * top < {NESTED} * a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
  phrase, a, l, r, n, score FROM q JOIN n USING (lang)) t WHERE rank <= {top}
"""
