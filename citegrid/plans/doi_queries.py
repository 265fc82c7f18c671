"""Queries over DOI lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrid.functions import doi as D
from citegrid.operators import doi_quality as Q
from citegrid.operators import enrich as E
from citegrid.operators import reports as R
from citegrid.plans.catalogue import query

REPAIR = ("ltrim(rtrim(replace(regexp_replace(doi, 'https://doi.org/|http://doi.org|http://dx.doi.org/', '', 'g'),"
          " '%2F', '/'), '.'), '/')")
TEST = "10.5555|10.88888|10.30444|10.30446|10.30447|10.30448|10.30449|10.50505|10.30443"
CLEAN = f""", fixed AS (SELECT row_idx, {REPAIR} AS doi FROM raw_dois),
    overridden AS (SELECT f.row_idx, CASE WHEN o.row_idx IS NOT NULL THEN o.doi ELSE f.doi END AS doi
      FROM fixed f LEFT JOIN doi_overrides o ON f.row_idx = o.row_idx),
    blanked AS (SELECT row_idx, CASE WHEN doi = 'NF' OR regexp_matches(doi, '{TEST}') THEN NULL ELSE doi END AS doi
      FROM overridden),
    first_rows AS (SELECT row_idx, doi FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY row_idx) AS rn
      FROM blanked) r WHERE rn = 1),
    cleaned AS (SELECT row_idx, regexp_replace(doi, '^DOI:|doi:', '', 'g') AS doi FROM first_rows),
    agencies AS (SELECT c.row_idx, c.doi, CASE WHEN c.doi IS NOT NULL
      THEN coalesce(g.agency, 'Resource not found') END AS registration_agency
      FROM cleaned c LEFT JOIN registry g ON c.doi = g.doi)"""
CLEAN_VIEWS = "raw_dois doi_overrides registry"


def _clean(t):
    return Q.clean(t.raw_dois, corrections=t.doi_overrides)


def _agency(t):
    return E.registration_agency(_clean(t), t.registry)


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


@query("doi_profile", """SELECT count(*) AS total, count(*) - count(doi) AS missing, count(doi) AS filled,
    round(100.0 * count(doi) / count(*), 6) AS pct_filled, round(avg(length(doi)), 6) AS mean_len,
    round(stddev_samp(length(doi)), 6) AS std_len, min(length(doi)) AS min_len,
    quantile_cont(CAST(length(doi) AS DOUBLE), 0.25) AS q25_len, quantile_cont(CAST(length(doi) AS DOUBLE), 0.5) AS q50_len,
    quantile_cont(CAST(length(doi) AS DOUBLE), 0.75) AS q75_len, max(length(doi)) AS max_len
    FROM (SELECT nullif(nullif(doi, 'NA'), 'NF') AS doi FROM raw_dois) d""", "raw_dois")
def doi_profile(t):
    null_out = F.when(F.col("doi").isin("NA", "NF"), None).otherwise(F.col("doi"))
    return rounded(Q.profile(t.raw_dois.withColumn("doi", null_out)), "pct_filled", "mean_len", "std_len")


@query("doi_resolvers", """SELECT count(*) AS total,
    count(*) FILTER (starts_with(doi, 'https://doi.org/') OR starts_with(doi, 'http://doi.org/')) AS with_resolver,
    round(100.0 * count(*) FILTER (starts_with(doi, 'https://doi.org/') OR starts_with(doi, 'http://doi.org/')) / count(*), 6) AS pct_resolver,
    count(*) FILTER (starts_with(doi, 'https:') OR starts_with(doi, 'http:')) AS with_scheme,
    round(100.0 * count(*) FILTER (starts_with(doi, 'https:') OR starts_with(doi, 'http:')) / count(*), 6) AS pct_scheme
    FROM raw_dois""", "raw_dois")
def doi_resolvers(t):
    return rounded(Q.resolver_report(t.raw_dois), "pct_resolver", "pct_scheme")


_FLAGS = {
    "is_resolver": "regexp_replace(doi, 'https://doi.org/|http://doi.org|http://dx.doi.org/', '', 'g') <> doi",
    "is_two_dois": r"regexp_matches(doi, '10\.\d{4,9}/.*10\.\d{4,9}/')",
    "is_encoded_slash": "contains(doi, '%2F')", "is_trailing_period": "ends_with(doi, '.')",
    "is_outer_slash": "starts_with(doi, '/') OR ends_with(doi, '/')", "is_space": "contains(doi, ' ')",
    "is_not_available": "starts_with(doi, 'NA') OR starts_with(doi, 'NF')",
    "is_dotted_structure": r"regexp_matches(doi, '^10\.\d+\.\d+\.\d+')",
    "is_test_prefix": f"regexp_matches(doi, '{TEST}')", "is_label": "regexp_matches(doi, '^DOI:|doi:')",
}
_FLAG_SQL = ", ".join(f"CAST({sql} AS INT) AS {name}" for name, sql in _FLAGS.items())


@query("doi_error_flags", f"SELECT row_idx, doi, CAST(doi IS NULL AS INT) AS is_missing, {_FLAG_SQL} FROM raw_dois",
       "raw_dois")
def doi_error_flags(t):
    return Q.error_flags(t.raw_dois)


@query("doi_error_report", f""", flags AS (SELECT CAST(doi IS NULL AS INT) AS is_missing, {_FLAG_SQL} FROM raw_dois),
    per_doi AS (SELECT doi, count(*) AS n FROM raw_dois WHERE doi IS NOT NULL GROUP BY doi) """ + " UNION ALL ".join(
    f"SELECT '{n[3:]}' AS fault, CAST(sum({n}) AS BIGINT) AS n_rows FROM flags" for n in ["is_missing", *_FLAGS]) + """
    UNION ALL SELECT 'duplicated', CAST(sum(n) AS BIGINT) FROM per_doi WHERE n > 1
    UNION ALL SELECT 'unregistered', CAST(sum(n) AS BIGINT) FROM per_doi WHERE doi NOT IN (SELECT doi FROM registry)""",
       "raw_dois registry")
def doi_error_report(t):
    return Q.error_report(t.raw_dois, t.registry)


@query("doi_not_available", """, v AS (SELECT doi, count(*) AS n FROM raw_dois
      WHERE starts_with(doi, 'NA') OR starts_with(doi, 'NF') GROUP BY doi)
    SELECT CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
      (SELECT doi FROM v ORDER BY n DESC, doi DESC LIMIT 1) AS top, max(n) AS freq FROM v""", "raw_dois")
def doi_not_available(t):
    return Q.not_available_report(t.raw_dois)


@query("doi_repair", f"SELECT row_idx, {REPAIR} AS doi FROM raw_dois", "raw_dois")
def doi_repair(t):
    return t.raw_dois.withColumn("doi", D.repair(F.col("doi")))


@query("doi_invalid", r"SELECT row_idx, doi FROM raw_dois WHERE regexp_matches(doi, '^10\.\d+\.\d+\.\d+')", "raw_dois")
def doi_invalid(t):
    return t.raw_dois.where(D.has_dotted_structure(F.col("doi")))


@query("doi_test_prefix", f"""SELECT row_idx, CASE WHEN regexp_matches(doi, '{TEST}') THEN NULL ELSE doi END AS doi,
    CASE WHEN regexp_matches(doi, '^(10\\.5555|10\\.88888|10\\.30444|10\\.30446|10\\.30447|10\\.30448|10\\.30449|10\\.50505|10\\.30443)/')
    THEN NULL ELSE doi END AS strict_doi FROM raw_dois""", "raw_dois")
def doi_test_prefix(t):
    raw = t.raw_dois.withColumn("strict_doi", F.col("doi"))
    return Q.blank_test_prefixes(Q.blank_test_prefixes(raw), "strict_doi", strict=True)


@query("doi_duplicates", """SELECT r.row_idx, r.doi, d.n_rows FROM raw_dois r JOIN
    (SELECT doi, count(*) AS n_rows FROM raw_dois GROUP BY doi HAVING count(*) > 1) d ON r.doi = d.doi""", "raw_dois")
def doi_duplicates(t):
    return Q.duplicates(t.raw_dois).orderBy("doi", "row_idx")


@query("doi_dedup", CLEAN + " SELECT row_idx, doi FROM first_rows", CLEAN_VIEWS)
def doi_dedup(t):
    fixed = Q.override(t.raw_dois.withColumn("doi", D.repair(F.col("doi"))), t.doi_overrides)
    return Q.keep_first(Q.blank_test_prefixes(Q.blank_not_found(fixed)))


@query("doi_dedup_keep_nulls", CLEAN + """ SELECT row_idx, doi FROM first_rows WHERE doi IS NOT NULL
    UNION ALL SELECT row_idx, doi FROM blanked WHERE doi IS NULL""", CLEAN_VIEWS)
def doi_dedup_keep_nulls(t):
    fixed = Q.override(t.raw_dois.withColumn("doi", D.repair(F.col("doi"))), t.doi_overrides)
    return Q.keep_first(Q.blank_test_prefixes(Q.blank_not_found(fixed)), keep_nulls=True)


@query("doi_dedup_report", """, d AS (SELECT doi, count(*) AS n FROM raw_dois GROUP BY doi)
    SELECT count(*) AS rows_left, count(*) FILTER (doi IS NOT NULL AND n > 1) AS dois_with_duplicates,
    CAST(sum(n - 1) FILTER (doi IS NOT NULL AND n > 1) AS BIGINT) AS rows_removed FROM d""", "raw_dois")
def doi_dedup_report(t):
    return Q.dedup_report(t.raw_dois)


@query("doi_override", """SELECT r.row_idx, CASE WHEN o.row_idx IS NOT NULL THEN o.doi ELSE r.doi END AS doi
    FROM raw_dois r LEFT JOIN doi_overrides o ON r.row_idx = o.row_idx""", "raw_dois doi_overrides")
def doi_override(t):
    return Q.override(t.raw_dois, t.doi_overrides)


@query("doi_exclude_rows", "SELECT * FROM raw_dois WHERE row_idx NOT IN (SELECT row_idx FROM doi_overrides)",
       "raw_dois doi_overrides")
def doi_exclude_rows(t):
    return Q.exclude_rows(t.raw_dois, t.doi_overrides)


@query("doi_clean", CLEAN + " SELECT row_idx, doi FROM cleaned", CLEAN_VIEWS)
def doi_clean(t):
    return _clean(t)


@query("doi_agency", CLEAN + " SELECT * FROM agencies", CLEAN_VIEWS)
def doi_agency(t):
    return _agency(t)


@query("doi_registration", CLEAN + """ SELECT row_idx, doi, CASE WHEN registration_agency = 'Resource not found'
    THEN registration_agency WHEN registration_agency IS NOT NULL THEN 'ok' END AS registration_check FROM agencies""",
       CLEAN_VIEWS)
def doi_registration(t):
    return E.registration_status(_clean(t), t.registry)


@query("doi_period_check", """SELECT row_idx, doi, CASE WHEN doi IN (SELECT doi FROM registry) THEN 'found'
    ELSE 'Resource not found' END AS status FROM raw_dois WHERE ends_with(doi, '.')""", "raw_dois registry")
def doi_period_check(t):
    return E.trailing_period_check(t.raw_dois, t.registry)


@query("agency_counts", CLEAN + """ SELECT registration_agency, count(*) AS count FROM agencies
    WHERE registration_agency IS NOT NULL GROUP BY 1""", CLEAN_VIEWS)
def agency_counts(t):
    return R.descending(R.count_by(_agency(t), "registration_agency"), "registration_agency")


@query("doi_unresolved", CLEAN + """ SELECT row_idx, doi, registration_agency FROM agencies
    WHERE registration_agency = 'Resource not found'""", CLEAN_VIEWS)
def doi_unresolved(t):
    return E.unresolved(_agency(t))


@query("doi_agency_repeats", CLEAN + """, twice AS (SELECT doi, min(agency) AS agency FROM (
      SELECT doi, agency FROM registry UNION ALL SELECT doi, concat('Old ', agency) FROM registry) g GROUP BY doi)
    SELECT c.row_idx, c.doi, CASE WHEN c.doi IS NOT NULL THEN coalesce(g.agency, 'Resource not found') END AS registration_agency
    FROM cleaned c LEFT JOIN twice g ON c.doi = g.doi""", CLEAN_VIEWS)
def doi_agency_repeats(t):
    """A registry that lists each DOI twice must not multiply rows."""
    old = t.registry.withColumn("agency", F.concat(F.lit("Old "), "agency"))
    return E.registration_agency(_clean(t), t.registry.unionByName(old))


@query("doi_override_repeats", """, fixes AS (SELECT row_idx, doi, 1 AS turn FROM doi_overrides
      UNION ALL SELECT row_idx, concat('10.1/second.', CAST(row_idx AS VARCHAR)), 2 FROM doi_overrides WHERE row_idx % 2 = 0),
    last AS (SELECT row_idx, doi FROM (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY turn DESC) AS rn FROM fixes) f
      WHERE rn = 1)
    SELECT r.row_idx, CASE WHEN o.row_idx IS NOT NULL THEN o.doi ELSE r.doi END AS doi
    FROM raw_dois r LEFT JOIN last o ON r.row_idx = o.row_idx""", "raw_dois doi_overrides")
def doi_override_repeats(t):
    """Of several corrections of a row the last one counts."""
    first = t.doi_overrides.select("row_idx", "doi", F.lit(1).alias("turn"))
    second = t.doi_overrides.where("row_idx % 2 = 0").select(
        "row_idx", F.concat(F.lit("10.1/second."), F.col("row_idx").cast("string")).alias("doi"), F.lit(2).alias("turn"))
    return Q.override(t.raw_dois, first.unionByName(second), order="turn")
