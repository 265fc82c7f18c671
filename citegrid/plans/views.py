"""Bibliographic input tables derived from the given parquet tables.

Each view is plain SQL over whole tables and runs both in Spark and, as a common
table expression, in the SQL checks. ``{S}`` is the string type of the dialect,
other braces name base tables or views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # Works are parts; every line item is a citation, with repeated pairs and self-citations.
    "works": """
        SELECT p_partkey AS id, concat('https://openalex.org/W', CAST(p_partkey AS {S})) AS openalex_id
        FROM {part}""",
    "core_works": """
        SELECT concat('https://openalex.org/W', CAST(p_partkey AS {S})) AS openalex_work_id
        FROM {part} WHERE p_size <= 30""",
    "core_ids": "SELECT p_partkey AS id FROM {part} WHERE p_size <= 30",
    "citations": """
        SELECT l_partkey AS citing_id,
               (l_orderkey * 7 + l_linenumber) % (SELECT count(*) FROM {part}) AS cited_id
        FROM {lineitem}""",
    # A thinner citation table on the same works: every order is a citation.
    "order_citations": """
        SELECT o_custkey AS citing_id, (o_orderkey * 7 + 3) % (SELECT count(*) FROM {part}) AS cited_id
        FROM {orders}""",
    # Works are conversation turns citing the two turns before them: many components.
    "thread_works": """
        SELECT conv_id * 100000 + turn AS id,
               concat('https://openalex.org/T', CAST(conv_id * 100000 + turn AS {S})) AS openalex_id
        FROM {conversations}""",
    "thread_citations": """
        SELECT conv_id * 100000 + turn AS citing_id, conv_id * 100000 + turn - 1 AS cited_id
        FROM {conversations} WHERE turn >= 1
        UNION ALL
        SELECT conv_id * 100000 + turn AS citing_id, conv_id * 100000 + turn - 2 AS cited_id
        FROM {conversations} WHERE turn >= 2""",
    # One kind of dirt per class of row numbers, many repeated identifiers.
    "raw_dois": """
        SELECT row_idx, CASE row_idx % 16
            WHEN 0 THEN concat('https://doi.org/', d) WHEN 1 THEN concat('http://doi.org/', d)
            WHEN 2 THEN concat('http://dx.doi.org/', d) WHEN 3 THEN replace(d, '/', '%2F')
            WHEN 4 THEN concat(d, '..') WHEN 5 THEN concat('/', d) WHEN 6 THEN concat(d, '/')
            WHEN 7 THEN concat(d, ' (accessed)') WHEN 8 THEN 'NF' WHEN 9 THEN 'NA'
            WHEN 10 THEN concat('DOI:', d) WHEN 11 THEN concat('doi:', d)
            WHEN 12 THEN concat('10.1.1.86.', CAST(k AS {S}))
            WHEN 13 THEN concat('10.5555/t', CAST(k AS {S}))
            WHEN 14 THEN concat(d, 'https://doi.org/', d) ELSE d END AS doi
        FROM (SELECT o_orderkey AS row_idx, o_custkey AS k,
                     concat('10.', CAST(1000 + o_custkey % 900 AS {S}), '/j.', CAST(o_custkey AS {S})) AS d
              FROM {orders}) x""",
    "doi_overrides": """
        SELECT o_orderkey AS row_idx,
               CASE WHEN o_totalprice >= 495000 THEN NULL
                    ELSE concat('10.7202/', CAST(o_orderkey AS {S}), 'ar') END AS doi
        FROM {orders} WHERE o_totalprice >= 490000""",
    "registry": """
        SELECT concat('10.', CAST(1000 + c_custkey % 900 AS {S}), '/j.', CAST(c_custkey AS {S})) AS doi,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'DataCite' ELSE 'Crossref' END AS agency
        FROM {customer} WHERE c_acctbal >= 0""",
    # References without an identifier, and the catalogue their titles are searched in.
    "raw_refs": """
        SELECT p_partkey AS row_idx, CASE p_partkey % 5 WHEN 0 THEN p_name
            WHEN 1 THEN concat('Doe, J., 2019: ', p_name, ' ', p_type)
            ELSE concat('Doe, J., 2019: A ', p_name, ': the ', p_type, ' case ',
                        CAST(p_partkey % 97 AS {S}), '. J. Tests, 1.') END AS reference
        FROM {part}""",
    "all_titles": """
        SELECT concat('https://openalex.org/W', CAST(p_partkey AS {S})) AS oa_id,
               concat('A ', p_name, ': The ', p_type, ' Case ', CAST(p_partkey % 97 AS {S})) AS oa_title,
               p_retailprice AS relevance_score,
               CASE WHEN p_size > 40 THEN NULL ELSE concat('https://doi.org/10.1234/p.', CAST(p_partkey AS {S})) END AS doi,
               p_size > 25 AS is_oa,
               CASE WHEN p_size > 25 THEN lower(p_type) END AS license,
               CASE WHEN p_size > 25 THEN concat('http://x/', CAST(p_partkey AS {S}), '.pdf') END AS url
        FROM {part}""",
    "catalog": """
        SELECT concat('https://openalex.org/W', CAST(p_partkey AS {S})) AS oa_id,
               concat('A ', p_name, ': The ', p_type, ' Case ', CAST(p_partkey % 97 AS {S})) AS oa_title,
               p_retailprice AS relevance_score,
               CASE WHEN p_size > 40 THEN NULL ELSE concat('https://doi.org/10.1234/p.', CAST(p_partkey AS {S})) END AS doi,
               p_size > 25 AS is_oa,
               CASE WHEN p_size > 25 THEN lower(p_type) END AS license,
               CASE WHEN p_size > 25 THEN concat('http://x/', CAST(p_partkey AS {S}), '.pdf') END AS url
        FROM {part} WHERE p_size > 12""",
    "works_meta": """
        SELECT o_orderkey AS work_id, CAST(extract(year FROM o_orderdate) AS INT) AS publication_year,
               o_orderpriority AS type, o_custkey % 50 AS source_id,
               CASE WHEN o_custkey % 50 = 0 THEN NULL
                    ELSE concat('Journal ', CAST(o_custkey % 50 AS {S})) END AS source_name,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS oa_status
        FROM {orders}""",
    "affiliations": """
        SELECT c_custkey AS author_id,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 40 END AS institution_id,
               CASE WHEN c_custkey % 13 = 0 THEN NULL
                    ELSE concat(c_mktsegment, ' Inst ', CAST(c_custkey % 40 AS {S})) END AS institution_display_name,
               n_name AS institution_country_code
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "iso_codes": "SELECT n_name AS a2_code, concat('X', CAST(n_nationkey AS {S})) AS a3_code FROM {nation}",
    "listed_titles": "SELECT concat('A ', p_name, ': The ', p_type, ' Case ', CAST(p_size AS {S})) AS title, p_partkey AS row_idx FROM {part}",
    "author_links": """
        SELECT l_orderkey AS work_id, l_suppkey AS author_id FROM {lineitem}""",
}

# Nested records exist only on the Spark side; the checks state their scalars directly.
METADATA = """
    SELECT p_partkey AS row_idx, concat('https://openalex.org/W', CAST(p_partkey AS STRING)) AS id,
      named_struct('openalex', concat('https://openalex.org/W', CAST(p_partkey AS STRING)),
                   'mag', CAST(p_partkey * 10 AS STRING)) AS ids,
      CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE named_struct('is_oa', p_partkey % 2 = 0,
        'license', CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END,
        'pdf_url', concat('http://x/', p_name)) END AS best_oa_location,
      CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE named_struct('source', p_brand, 'version', p_type) END AS primary_location,
      named_struct('min', p_size, 'max', p_size + 10) AS cited_by_percentile_year,
      transform(sequence(1, 1 + p_size % 3), i -> named_struct(
        'author', named_struct('display_name',
           CASE WHEN (p_partkey + i) % 9 = 0 THEN '' ELSE concat(p_brand, '-', CAST(i AS STRING)) END),
        'institutions', transform(sequence(1, i), j -> named_struct(
           'display_name', concat('Inst ', CAST((p_partkey + j) % 40 AS STRING)),
           'ror', concat('r', CAST((p_partkey + j) % 40 AS STRING)))))) AS authorships,
      CASE WHEN p_partkey % 5 = 0 THEN array()
           ELSE array(named_struct('display_name', p_type, 'score', 0.5D)) END AS sustainable_development_goals,
      transform(split(p_name, ' '), w -> named_struct('id', w, 'display_name', upper(w), 'score', 0.1D)) AS keywords
    FROM {part}"""

# A record with its reference list spelled as a list literal, as spreadsheets keep it.
REFERENCE_LISTS = """
    SELECT concat('https://openalex.org/W', CAST(citing_id AS STRING)) AS id,
      concat('[', array_join(transform(sort_array(collect_list(cited_id)),
             x -> concat("'https://openalex.org/W", x, "'")), ', '), ']') AS referenced_works
    FROM {citations} GROUP BY citing_id"""

# The words of a text are placed, sorted and cut where the word changes inside one row, so that
# no row per word is grouped.
INVERTED_INDEX = """
    SELECT doc_id, map_from_entries(transform(starts, (s, k) -> struct(placed[s].word,
             transform(slice(placed, s + 1, coalesce(get(starts, k + 1), size(placed)) - s), p -> p.pos)))) AS abstract_inverted_index
    FROM (SELECT doc_id, placed, filter(sequence(0, size(placed) - 1),
                 i -> i = 0 OR get(placed, i).word <> get(placed, i - 1).word) AS starts
          FROM (SELECT doc_id, sort_array(flatten(transform(texts,
                         t -> transform(split(trim(regexp_replace(t, '[ \\\\t\\\\n\\\\r]+', ' ')), ' '),
                                        (w, i) -> named_struct('word', w, 'pos', i))))) AS placed
                FROM (SELECT doc_id, collect_list(text) AS texts FROM {documents} WHERE text IS NOT NULL GROUP BY doc_id)))"""


def _names(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n != "S"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view by name."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = {"metadata": METADATA, "reference_lists": REFERENCE_LISTS,
           "inverted_index": INVERTED_INDEX}.get(name) or VIEWS[name]
    parts = {n: view(spark, sf_dir, n) for n in _names(sql)}
    return spark.sql(sql.replace("{S}", "STRING"), **parts)


def with_views(body: str, *names: str) -> str:
    """SQL of a check: ``body`` preceded by the named views as common table expressions."""
    ctes = []
    for name in names:
        sql = VIEWS[name].replace("{S}", "VARCHAR")
        for part in _names(VIEWS[name]):
            sql = sql.replace("{" + part + "}", part)
        ctes.append(f"{name} AS ({sql})")
    glue = "" if body.lstrip().startswith(",") else " "
    return f"WITH RECURSIVE {', '.join(ctes)}{glue}{body.lstrip()}"
