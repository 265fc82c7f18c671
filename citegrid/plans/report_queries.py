"""Descriptive reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrid.functions.nested import best_location
from citegrid.operators import enrich as E
from citegrid.operators import reports as R
from citegrid.plans.catalogue import query
from citegrid.plans.doi_queries import rounded


def _count_sql(key: str, table: str, name: str = "count") -> str:
    return f"SELECT {key}, count(*) AS {name} FROM {table} WHERE {key} IS NOT NULL GROUP BY 1"


@query("works_by_year", "SELECT publication_year AS year, count(*) AS count FROM works_meta GROUP BY 1", "works_meta")
def works_by_year(t):
    return R.count_by(t.works_meta, "publication_year").withColumnRenamed("publication_year", "year").orderBy("year")


@query("works_by_type", _count_sql("type", "works_meta"), "works_meta")
def works_by_type(t):
    return R.descending(R.count_by(t.works_meta, "type"), "type")


@query("works_by_source", """SELECT source_name, count(source_id) AS count FROM works_meta
    WHERE source_name IS NOT NULL GROUP BY 1""", "works_meta")
def works_by_source(t):
    return R.descending(R.count_by(t.works_meta, "source_name", "source_id"), "source_name")


@query("oa_status_pct", """, c AS (SELECT oa_status, count(*) AS count FROM works_meta
      WHERE oa_status IS NOT NULL GROUP BY 1)
    SELECT oa_status, count, round(100.0 * count / (SELECT sum(count) FROM c), 6) AS percentage FROM c""", "works_meta")
def oa_status_pct(t):
    return rounded(R.descending(R.with_share(R.count_by(t.works_meta, "oa_status")), "oa_status"), "percentage")


@query("country_counts", _count_sql("institution_country_code", "affiliations"), "affiliations")
def country_counts(t):
    return R.count_by(t.affiliations, "institution_country_code")


@query("country_iso", """SELECT a.institution_country_code, count(*) AS count, i.a3_code FROM affiliations a
    JOIN iso_codes i ON a.institution_country_code = i.a2_code GROUP BY 1, 3""", "affiliations iso_codes")
def country_iso(t):
    key = "institution_country_code"
    return R.descending(R.country_names(R.count_by(t.affiliations, key), t.iso_codes, key), key)


@query("top_institutions", """SELECT institution_display_name, count(*) AS count FROM affiliations
    WHERE institution_display_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "affiliations")
def top_institutions(t):
    key = "institution_display_name"
    return R.top(R.count_by(t.affiliations, key), key, 10)


@query("unknown_institutions", """SELECT count(*) FILTER (institution_id IS NULL) AS unknown_institutions,
    count(*) AS total_rows FROM affiliations""", "affiliations")
def unknown_institutions(t):
    return R.unknown_institutions(t.affiliations)


@query("sdg_pct", """WITH labelled AS (SELECT CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS sdg FROM part),
    c AS (SELECT sdg, count(*) AS count FROM labelled WHERE sdg IS NOT NULL GROUP BY 1)
    SELECT sdg, count, round(100.0 * count / (SELECT sum(count) FROM c), 6) AS percentage FROM c""")
def sdg_pct(t):
    labelled = t.metadata.select(F.get("sustainable_development_goals", F.lit(0))["display_name"].alias("sdg"))
    return rounded(R.descending(R.with_share(R.count_by(labelled, "sdg")), "sdg"), "percentage")


def _located(t):
    return t.metadata.select("id", *best_location(F.col("best_oa_location")))


@query("license_pct", """WITH c AS (SELECT CASE WHEN p_partkey % 6 = 0 OR p_partkey % 3 = 0 THEN NULL ELSE p_type END
      AS license FROM part)
    SELECT license, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM c), 6) AS percentage
    FROM c GROUP BY 1""")
def license_pct(t):
    return rounded(R.licences(_located(t)), "percentage")


@query("oa_counts", """SELECT count(*) FILTER (p_partkey % 6 <> 0 AND p_partkey % 2 = 0) AS oa_true,
    count(*) FILTER (p_partkey % 6 <> 0 AND p_partkey % 2 <> 0) AS oa_false,
    round(100.0 * count(*) FILTER (p_partkey % 6 <> 0 AND p_partkey % 2 = 0) / count(*), 6) AS pct_oa FROM part""")
def oa_counts(t):
    return rounded(R.open_access(_located(t)), "pct_oa")


@query("doi_coverage", """SELECT count(*) AS total, count(doi) AS with_value,
    round(100.0 * count(doi) / count(*), 6) AS pct FROM all_titles""", "all_titles")
def doi_coverage(t):
    return rounded(R.coverage(t.all_titles, "doi"), "pct")


@query("core_works_by_type", """SELECT p_type AS type, count(*) AS count FROM core_works c
    JOIN (SELECT concat('https://openalex.org/W', CAST(p_partkey AS VARCHAR)) AS openalex_work_id, p_type FROM part) p
    ON c.openalex_work_id = p.openalex_work_id GROUP BY 1""", "core_works")
def core_works_by_type(t):
    works = t.part.select(
        F.concat(F.lit("https://openalex.org/W"), F.col("p_partkey").cast("string")).alias("openalex_work_id"),
        F.col("p_type").alias("type"))
    return R.descending(R.count_by(E.core_subset(works, t.core_works), "type"), "type")


@query("cluster_top_terms", """, c AS (SELECT oa_status AS cluster, source_name AS term, count(*) AS count
      FROM works_meta WHERE source_name IS NOT NULL GROUP BY 1, 2)
    SELECT cluster, term, count, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER
      (PARTITION BY cluster ORDER BY count DESC, term) AS rank FROM c) r WHERE rank <= 5""", "works_meta")
def cluster_top_terms(t):
    members = t.works_meta.select(F.col("oa_status").alias("cluster"), F.col("source_name").alias("term"))
    return R.top_terms(members, "cluster", "term", 5)


@query("criteria_combinations", """SELECT CAST(oa_status IS NOT NULL AS INT) AS has_status,
    CAST(source_name IS NOT NULL AS INT) AS has_source, CAST(publication_year >= 1998 AS INT) AS recent,
    CAST(starts_with(type, '1') AS INT) AS urgent, count(*) AS n_rows FROM works_meta GROUP BY ALL""", "works_meta")
def criteria_combinations(t):
    return R.criteria_combinations(t.works_meta, {
        "has_status": F.col("oa_status").isNotNull(), "has_source": F.col("source_name").isNotNull(),
        "recent": F.col("publication_year") >= 1998, "urgent": F.col("type").startswith("1"),
    })


@query("works_sample", """SELECT id, openalex_id FROM works
    ORDER BY md5(concat('7:', CAST(id AS VARCHAR))), id LIMIT 100""", "works")
def works_sample(t):
    return R.fixed_sample(t.works, "id", 100, seed=7)
