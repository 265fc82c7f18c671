"""Title search against a catalogue table, and checks of what it found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.functions import titles as T
from citegrid.functions.similarity import match_flag, similarity_ratio, title_similarity
from citegrid.operators.skew import BLOCK_ROWS, grid_join

_HIT = ("doi", "is_oa", "license", "url")


def extract_titles(references: DataFrame, column: str = "reference") -> DataFrame:
    """Adds the normalised title of each reference."""
    return references.withColumn("title", T.normalize(T.extract_title(F.col(column))))


def search(queries: DataFrame, catalog: DataFrame, block_rows: int = BLOCK_ROWS,
           spaced: str | None = None) -> DataFrame:
    """Number of catalogue titles that contain all words of the query, and the best of them.

    ``queries(row_idx, title, …)``, ``catalog(oa_id, oa_title, relevance_score, …)``. Adds
    ``count`` (0 without a hit), ``oa_id``, ``oa_title``, ``relevance_score`` and the best
    hit's access columns. Blank titles are skipped; equal scores go to the smaller id.
    Punctuation joins the parts of a word unless it is among ``spaced``, characters that
    stand for a space on both sides (``titles.QUERY_PUNCTUATION`` or its short form).

    Both sides collapse to distinct word sets first: copies of a title cost one
    comparison. A query is looked up under its rarest catalogue word only, and words
    that stay frequent are spread over a grid of blocks.
    """
    def words(title: str) -> Column:
        return T.tokens(T.query_text(F.col(title), spaced) if spaced else F.col(title))

    extra = [c for c in _HIT if c in catalog.columns]
    asked = queries.where(T.has_text(F.col("title"))).withColumn("q_words", words("title"))
    wanted = asked.select("q_words").distinct().where(F.size("q_words") > 0)

    # Scores rank first, then the smaller id, without an order-reversing string key.
    hit = F.struct("oa_id", "oa_title", "relevance_score", *extra)
    sets = (
        catalog.withColumn("c_words", words("oa_title"))
        .groupBy("c_words").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct((-F.col("relevance_score")).alias("rank"), F.col("oa_id").alias("tie"),
                           hit.alias("hit"))).alias("best"))
    )
    postings = sets.select(F.explode("c_words").alias("word"), "c_words")
    frequency = postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # A word the catalogue lacks rules out any hit, so only fully known queries go on.
    lookups = (
        wanted.select("q_words", F.explode("q_words").alias("word"))
        .join(frequency, "word")
        .groupBy("q_words").agg(F.min(F.struct("df", "word")).alias("rarest"), F.count(F.lit(1)).alias("known"))
        .where(F.col("known") == F.size("q_words"))
        .select("q_words", F.col("rarest.word").alias("word"))
    )
    anchored = postings.join(lookups.select("word").distinct(), "word", "left_semi")
    contained = grid_join(lookups, anchored, "word", "q_words", "c_words", block_rows).where(
        F.size(F.array_except("q_words", "c_words")) == 0
    ).select("q_words", "c_words")
    found = (
        contained.join(sets, "c_words").groupBy("q_words")
        .agg(F.sum("n").alias("count"), F.min("best").alias("best"))
        .select("q_words", "count", "best.hit.*")
    )
    return (
        asked.join(found, "q_words", "left").drop("q_words")
        .withColumn("count", F.coalesce("count", F.lit(0)))
    )


def single_or_multiple(results: DataFrame) -> DataFrame:
    """Hits only, marked by whether there was exactly one."""
    return results.where(F.col("count") > 0).withColumn(
        "bucket", F.when(F.col("count") == 1, "single").otherwise("multiple"))


def unmatched(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Query rows without any hit, blank titles included."""
    hits = results.where(F.col("count") > 0).select("row_idx")
    return queries.join(hits, "row_idx", "left_anti")


def check_titles(pairs: DataFrame, asked: str = "title", found: str = "oa_title",
                 threshold: float = 0.85) -> DataFrame:
    """Similarity of the asked and the found title, and the match flag."""
    return pairs.withColumn("title_similarity", title_similarity(F.col(asked), F.col(found))).withColumn(
        "title_check_flag", match_flag(F.col("title_similarity"), threshold))


def sequence_ratio(pairs: DataFrame, asked: str = "title", found: str = "oa_title") -> DataFrame:
    """Similarity of the titles as they are."""
    return pairs.withColumn("levenshtein", similarity_ratio(F.col(asked), F.col(found)))


def similar_pairs(pairs: DataFrame, threshold: float, asked: str = "title",
                  found: str = "oa_title") -> DataFrame:
    """Pairs that reach the threshold; the length bound spares the others the comparison."""
    possible = pairs.where(T.ratio_bound(F.trim(F.lower(asked)), F.trim(F.lower(found))) >= threshold)
    return check_titles(possible, asked, found, threshold).where("title_check_flag = 1")
