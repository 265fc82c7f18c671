"""Title extraction, search and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrid.functions import titles as T
from citegrid.operators import enrich as E
from citegrid.operators import linkage as L
from citegrid.operators import reports as R
from citegrid.plans.catalogue import query
from citegrid.plans.doi_queries import rounded

_TITLE = """CASE WHEN strpos(reference, ': ') = 0 THEN ''
    WHEN strpos(substr(reference, strpos(reference, ': ') + 2), '. ') = 0
      THEN substr(reference, strpos(reference, ': ') + 2, greatest(length(reference) - strpos(reference, ': ') - 2, 0))
    ELSE substr(reference, strpos(reference, ': ') + 2,
                strpos(substr(reference, strpos(reference, ': ') + 2), '. ') - 1) END"""
_PUNCT = """!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"""


def _norm(column: str) -> str:
    return f"translate(lower({column}), '{_PUNCT}', '')"


def _words(column: str) -> str:
    return f"list_filter(list_distinct(string_split_regex(trim({column}), '\\s+')), lambda w: w <> '')"


SEARCH = f""", titled AS (SELECT row_idx, reference, {_norm(_TITLE)} AS title FROM raw_refs),
    asked AS (SELECT *, {_words('title')} AS q_words FROM titled),
    cat AS (SELECT *, {_words(_norm('oa_title'))} AS words FROM catalog),
    hits AS (SELECT a.row_idx, c.*, row_number() OVER (PARTITION BY a.row_idx ORDER BY c.relevance_score DESC, c.oa_id) AS rn,
      count(*) OVER (PARTITION BY a.row_idx) AS n FROM asked a JOIN cat c ON list_has_all(c.words, a.q_words)
      WHERE trim(a.title) <> ''),
    results AS (SELECT a.row_idx, a.reference, a.title, coalesce(h.n, 0) AS count, h.oa_id, h.oa_title,
      h.relevance_score, h.doi, h.is_oa, h.license, h.url
      FROM asked a LEFT JOIN hits h ON a.row_idx = h.row_idx AND h.rn = 1 WHERE trim(a.title) <> '')"""
VIEWS = "raw_refs catalog"


def _results(t):
    return L.search(L.extract_titles(t.raw_refs), t.catalog)


@query("title_extract", f"SELECT row_idx, {_TITLE} AS title FROM raw_refs", "raw_refs")
def title_extract(t):
    return t.raw_refs.select("row_idx", T.extract_title(F.col("reference")).alias("title"))


@query("title_normalize", f"""SELECT row_idx, {_norm(_TITLE)} AS title, translate({_TITLE}, ':;?-.,''', '       ') AS query_text,
    translate({_TITLE}, ':;?-''', '     ') AS query_text_short FROM raw_refs""", "raw_refs")
def title_normalize(t):
    title = T.extract_title(F.col("reference"))
    return t.raw_refs.select(
        "row_idx", T.normalize(title).alias("title"), T.query_text(title).alias("query_text"),
        T.query_text(title, T.QUERY_PUNCTUATION_SHORT).alias("query_text_short"))


@query("title_search", SEARCH + " SELECT * FROM results", VIEWS)
def title_search(t):
    return _results(t)


@query("title_search_split", SEARCH + """ SELECT row_idx, oa_id, count,
    CASE WHEN count = 1 THEN 'single' ELSE 'multiple' END AS bucket FROM results WHERE count > 0""", VIEWS)
def title_search_split(t):
    return L.single_or_multiple(_results(t)).select("row_idx", "oa_id", "count", "bucket")


@query("title_unmatched", SEARCH + """ SELECT row_idx, reference FROM raw_refs WHERE row_idx NOT IN
    (SELECT row_idx FROM results WHERE count > 0)""", VIEWS)
def title_unmatched(t):
    return L.unmatched(t.raw_refs, _results(t))


@query("title_search_summary", SEARCH + """ SELECT count(*) AS titles, count(*) FILTER (count > 0) AS matched
    FROM results""", VIEWS)
def title_search_summary(t):
    return R.search_summary(_results(t))


@query("title_in_corpus", """SELECT l.title, l.row_idx, l.title IN (SELECT oa_title FROM catalog) AS match
    FROM listed_titles l""", "listed_titles catalog")
def title_in_corpus(t):
    return E.listed_in_corpus(t.listed_titles, t.catalog.withColumnRenamed("oa_title", "title"))


@query("doi_fill", """, known AS (SELECT title, min(doi) AS doi FROM (
      SELECT oa_title AS title, concat('10.9999/f.', oa_id) AS doi FROM all_titles) k GROUP BY title)
    SELECT c.oa_id, c.oa_title AS orig_title, coalesce(c.doi, k.doi) AS doi FROM all_titles c
    LEFT JOIN known k ON c.oa_title = k.title""", "all_titles")
def doi_fill(t):
    inputs = t.all_titles.select(
        F.col("oa_title").alias("title"), F.concat(F.lit("10.9999/f."), F.col("oa_id")).alias("doi"))
    results = t.all_titles.select("oa_id", F.col("oa_title").alias("orig_title"), "doi")
    return E.fill_missing(results, inputs)


# The check fills the table of common subsequence lengths one character of the first
# string per round; within a row a running maximum stands for the left neighbour.
_LCS = """, pairs AS (SELECT DISTINCT {a} AS a, {b} AS b FROM results WHERE count > 0),
    grid AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: 0) AS line FROM pairs
      UNION ALL
      SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_slice(
        list_transform(range(1, length(b) + 2), lambda k: greatest(line[k], CASE WHEN k > 1 AND
          substr(b, CAST(k - 1 AS INT), 1) = substr(a, i + 1, 1) THEN line[k - 1] + 1 ELSE 0 END)), 1, j)))
      FROM grid WHERE i < length(a)),
    ratios AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0
      ELSE 2.0 * line[length(b) + 1] / (length(a) + length(b)) END AS ratio FROM grid WHERE i = length(a))"""


@query("title_similarity", SEARCH + _LCS.format(a="trim(lower(title))", b="trim(lower(oa_title))") + """
    SELECT r.row_idx, r.oa_id, round(s.ratio, 6) AS title_similarity,
      CAST(s.ratio >= 0.85 AS INT) AS title_check_flag
    FROM results r JOIN ratios s ON trim(lower(r.title)) = s.a AND trim(lower(r.oa_title)) = s.b""", VIEWS)
def title_similarity(t):
    checked = L.check_titles(_results(t).where("count > 0"))
    return rounded(checked.select("row_idx", "oa_id", "title_similarity", "title_check_flag"), "title_similarity")


@query("title_sequence_ratio", SEARCH + _LCS.format(a="title", b="oa_title") + """
    SELECT r.row_idx, r.oa_id, round(s.ratio, 6) AS levenshtein
    FROM results r JOIN ratios s ON r.title = s.a AND r.oa_title = s.b""", VIEWS)
def title_sequence_ratio(t):
    scored = L.sequence_ratio(_results(t).where("count > 0"))
    return rounded(scored.select("row_idx", "oa_id", "levenshtein"), "levenshtein")


@query("title_flag_counts", SEARCH + _LCS.format(a="trim(lower(title))", b="trim(lower(oa_title))") + """
    SELECT CAST(s.ratio >= 0.85 AS INT) AS title_check_flag, count(*) AS count
    FROM results r JOIN ratios s ON trim(lower(r.title)) = s.a AND trim(lower(r.oa_title)) = s.b GROUP BY 1""", VIEWS)
def title_flag_counts(t):
    return R.count_by(L.check_titles(_results(t).where("count > 0")), "title_check_flag")


@query("title_similar_pairs", SEARCH + _LCS.format(a="trim(lower(title))", b="trim(lower(oa_title))") + """
    SELECT r.row_idx, r.oa_id FROM results r JOIN ratios s ON trim(lower(r.title)) = s.a
    AND trim(lower(r.oa_title)) = s.b WHERE s.ratio >= 0.70""", VIEWS)
def title_similar_pairs(t):
    return L.similar_pairs(_results(t).where("count > 0"), 0.70).select("row_idx", "oa_id")


def _spaced(column: str) -> str:
    return f"translate({column}, ':;?-.,\'\'', '       ')"


@query("title_search_spaced", f""", asked AS (SELECT p_partkey AS row_idx, concat(p_name, '-', p_type) AS title,
      {_words(_norm(_spaced("concat(p_name, '-', p_type)")))} AS q_words FROM part),
    cat AS (SELECT oa_id, relevance_score, {_words(_norm(_spaced('oa_title')))} AS words FROM catalog),
    hits AS (SELECT a.row_idx, c.oa_id, row_number() OVER (PARTITION BY a.row_idx ORDER BY c.relevance_score DESC, c.oa_id) AS rn,
      count(*) OVER (PARTITION BY a.row_idx) AS n FROM asked a JOIN cat c ON list_has_all(c.words, a.q_words))
    SELECT a.row_idx, a.title, coalesce(h.n, 0) AS count, h.oa_id FROM asked a
    LEFT JOIN hits h ON a.row_idx = h.row_idx AND h.rn = 1""", "catalog")
def title_search_spaced(t):
    """Titles with a hyphen between the words of the catalogue."""
    asked = t.part.select(F.col("p_partkey").alias("row_idx"), F.concat_ws("-", "p_name", "p_type").alias("title"))
    return L.search(asked, t.catalog, spaced=T.QUERY_PUNCTUATION).select("row_idx", "title", "count", "oa_id")
