"""Nested records, reference lists and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrid.functions import nested as X
from citegrid.functions.doi import strip_resolver_prefix
from citegrid.operators import enrich as E
from citegrid.operators import keys as K
from citegrid.operators import reports as R
from citegrid.plans.catalogue import query
from citegrid.session import Scratch
from citegrid.sources import readers, schemas, writers

_OA = "concat('https://openalex.org/W', CAST({} AS VARCHAR))"
_ID = _OA.format("p_partkey")

# First appearance: own ids in row order, then cited ids in list order.
_WORKS = f""", own AS (SELECT DISTINCT citing_id AS k FROM citations),
    listed AS (SELECT citing_id AS r, cited_id AS k,
      row_number() OVER (PARTITION BY citing_id ORDER BY cited_id) AS pos FROM citations),
    seen AS (SELECT k, 0 AS kind, k AS r, 0 AS pos FROM own UNION ALL SELECT k, 1, r, pos FROM listed),
    placed AS (SELECT k, min((kind, r, pos)) AS place FROM seen GROUP BY k),
    numbered AS (SELECT {_OA.format('k')} AS openalex_id, k, row_number() OVER (ORDER BY place) AS id FROM placed)"""


def _reference_lists(t):
    """Rows numbered by their work number, as a file of records would be."""
    return t.reference_lists.withColumn("row_idx", F.regexp_extract("id", r"W(\d+)$", 1).cast("bigint"))


@query("works_from_refs", _WORKS + " SELECT openalex_id, id FROM numbered", "citations")
def works_from_refs(t):
    return K.build_works(_reference_lists(t))


@query("works_from_refs_all", f"""{_WORKS} SELECT {_OA.format('k')} AS openalex_id,
    row_number() OVER (ORDER BY kind, r, pos) AS id FROM seen""", "citations")
def works_from_refs_all(t):
    """Every occurrence gets an id of its own; equal references differ in position only."""
    return K.build_works(_reference_lists(t), dedup=False)


@query("citations_from_refs", _WORKS + """ SELECT a.id AS citing_id, b.id AS cited_id FROM citations c
    JOIN numbered a ON c.citing_id = a.k JOIN numbered b ON c.cited_id = b.k""", "citations")
def citations_from_refs(t):
    records = _reference_lists(t)
    return K.build_citations(records, K.build_works(records))


@query("citations_rekeyed", """SELECT c.citing_id, c.cited_id FROM citations c
    JOIN core_ids a ON c.citing_id = a.id JOIN core_ids b ON c.cited_id = b.id""", "citations core_ids")
def citations_rekeyed(t):
    """Text ids to integers, both ends known."""
    link = lambda c: F.concat(F.lit("https://openalex.org/W"), F.col(c).cast("string"))
    links = t.citations.select(link("citing_id").alias("citing"), link("cited_id").alias("cited"))
    works = t.core_ids.select(link("id").alias("openalex_id"), "id")
    return K.rekey(links, works)


@query("sequential_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS id FROM orders")
def sequential_ids(t):
    orders = t.orders.select("o_custkey", "o_orderkey")
    return K.dense_id(orders, ["o_custkey", "o_orderkey"]).select("o_orderkey", "id")


@query("flatten_ids", f"""SELECT {_ID} AS id, {_ID} AS ids_openalex, CAST(p_partkey * 10 AS VARCHAR) AS ids_mag,
    p_size AS cited_by_pct_yearmin, p_size + 10 AS cited_by_pct_yearmax,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS source,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS version FROM part""")
def flatten_ids(t):
    flat = X.unnest(X.unnest(X.unnest(t.metadata, "ids", "ids_"), "cited_by_percentile_year", "cited_by_pct_year"),
                    "primary_location")
    return flat.select("id", "ids_openalex", "ids_mag", "cited_by_pct_yearmin", "cited_by_pct_yearmax",
                       "source", "version")


@query("best_locations", f"""SELECT {_ID} AS id, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 2 = 0 END AS is_oa,
    CASE WHEN p_partkey % 6 <> 0 AND p_partkey % 3 <> 0 THEN p_type END AS license,
    CASE WHEN p_partkey % 6 <> 0 THEN concat('http://x/', p_name) END AS url FROM part""")
def best_locations(t):
    return t.metadata.select("id", *X.best_location(F.col("best_oa_location")))


@query("author_names", f"""SELECT {_ID} AS id, coalesce(array_to_string(list_transform(list_filter(
    range(1, 2 + p_size % 3), lambda i: (p_partkey + i) % 9 <> 0), lambda i: concat(p_brand, '-', i)), '|'), '') AS authors
    FROM part""")
def author_names(t):
    return t.metadata.select("id", F.array_join(X.author_names(F.col("authorships")), "|").alias("authors"))


def _inst(j: str) -> str:
    return f"concat('Inst ', (p_partkey + {j}) % 40, '/r', (p_partkey + {j}) % 40)"


@query("institutions", f"""SELECT {_ID} AS id, array_to_string(flatten(list_transform(range(1, 2 + p_size % 3),
    lambda i: list_transform(range(1, i + 1), lambda j: {_inst('j')}))), '|') AS institutions,
    array_to_string(list_transform(range(1, 2 + p_size % 3), lambda i: {_inst('i')}), '|') AS last_institutions FROM part""")
def institutions(t):
    def joined(last_only):
        found = X.institutions(F.col("authorships"), last_only)
        return F.array_join(F.transform(found, lambda i: F.concat_ws("/", i["display_name"], i["ror"])), "|")

    return t.metadata.select("id", joined(False).alias("institutions"), joined(True).alias("last_institutions"))


@query("abstract_rebuild", """SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS abstract
    FROM documents""")
def abstract_rebuild(t):
    return t.inverted_index.select("doc_id", X.abstract_text(F.col("abstract_inverted_index")).alias("abstract"))


@query("first_sdg", f"SELECT {_ID} AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS sdgs FROM part")
def first_sdg(t):
    return t.metadata.select("id", X.first_display_name(F.col("sustainable_development_goals")).alias("sdgs"))


@query("keywords_long", f"""SELECT id, CAST(pos - 1 AS INT) AS pos, upper(words[pos]) AS keyword FROM (
    SELECT {_ID} AS id, string_split(p_name, ' ') AS words,
    unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS pos FROM part) k""")
def keywords_long(t):
    return X.keywords_long(t.metadata)


@query("keywords_wide", f"""SELECT {_ID} AS id, upper(split_part(p_name, ' ', 1)) AS keyword_0,
    nullif(upper(split_part(p_name, ' ', 2)), '') AS keyword_1,
    nullif(upper(split_part(p_name, ' ', 3)), '') AS keyword_2 FROM part""")
def keywords_wide(t):
    return X.keywords_wide(t.metadata, 3)


@query("json_batches", """SELECT CAST(p_partkey // 100 AS BIGINT) AS batch_id, count(*) AS n_rows,
    min(p_partkey) AS first_row, max(p_partkey) AS last_row FROM part GROUP BY 1""")
def json_batches(t):
    return K.batches(t.metadata).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))


@query("id_from_link", "SELECT openalex_id, concat('W', CAST(id AS VARCHAR)) AS short_id FROM works", "works")
def id_from_link(t):
    return t.works.select("openalex_id", X.id_from_link(F.col("openalex_id")).alias("short_id"))


@query("strip_resolver", "SELECT oa_id, replace(doi, 'https://doi.org/', '') AS doi FROM all_titles", "all_titles")
def strip_resolver(t):
    return t.all_titles.select("oa_id", strip_resolver_prefix(F.col("doi")).alias("doi"))


@query("records_by_id", f"""SELECT w.openalex_id AS id, c.oa_title, c.is_oa FROM works w
    LEFT JOIN catalog c ON w.openalex_id = c.oa_id""", "works catalog")
def records_by_id(t):
    ids = t.works.select(F.col("openalex_id").alias("id"))
    return E.records_by_id(ids, t.catalog.select(F.col("oa_id").alias("id"), "oa_title", "is_oa"))


@query("labels_by_id", f"""SELECT c.openalex_work_id AS id, string_split(upper(p.p_name), ' ')[1] AS first_keyword,
    CASE WHEN p.p_partkey % 5 <> 0 THEN p.p_type END AS first_goal FROM core_works c
    LEFT JOIN part p ON c.openalex_work_id = {_OA.format('p.p_partkey')}""", "core_works")
def labels_by_id(t):
    ids = t.core_works.select(F.col("openalex_work_id").alias("id"))
    return E.labels_by_id(ids, t.metadata).select(
        "id", X.first_display_name(F.col("keywords")).alias("first_keyword"),
        X.first_display_name(F.col("sustainable_development_goals")).alias("first_goal"))


@query("records_to_columns", f"""SELECT {_ID} AS id, CAST(pos - 1 AS INT) AS pos, words[pos] AS word_id,
    upper(words[pos]) AS display_name, 0.1::DOUBLE AS score FROM (
    SELECT p_partkey, string_split(p_name, ' ') AS words, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS pos FROM part) k""")
def records_to_columns(t):
    renamed = t.metadata.select("id", F.transform("keywords", lambda k: F.struct(
        k["id"].alias("word_id"), k["display_name"], k["score"])).alias("keywords"))
    return X.records_to_columns(renamed, "keywords", ("word_id", "display_name", "score"))


# Values that delimited text must quote: separators, quotes, backslashes, line breaks and blanks.
_ODD_SQL = """SELECT o_orderkey AS row_idx, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN concat('a "q", b', chr(9), 'c')
    WHEN 2 THEN concat('back', chr(92), 'slash', chr(92)) WHEN 3 THEN concat('line', chr(10), 'break') WHEN 4 THEN '  blanks  ' WHEN 5 THEN '"'
    WHEN 6 THEN 'a|b;c' ELSE concat('plain ', CAST(o_custkey AS {S})) END AS value FROM orders"""
_ODD_SCHEMA = schemas.table(row_idx=schemas.LONG, value=schemas.STRING)


# The same with characters that Latin-1 spells by one byte.
_LATIN_SQL = f"SELECT row_idx, CASE WHEN value IS NOT NULL THEN concat(chr(233), value, chr(223)) END AS value FROM ({_ODD_SQL}) x"


def _odd(t, sql=_ODD_SQL):
    return t.spark.sql(sql.replace("{S}", "STRING").replace("FROM orders", "FROM {orders}"), orders=t.orders)


def _round_trip(name, write, read, sql=_ODD_SQL, **options):
    @query(name, sql.replace("{S}", "VARCHAR"))
    def round_trip(t):
        path = Scratch(t.spark, name).base
        write(_odd(t, sql), path, **options)
        return read(t.spark, path, _ODD_SCHEMA, multi_line=True)


_round_trip("roundtrip_tsv", writers.write_tsv, readers.read_tsv)
_round_trip("roundtrip_csv", writers.write_csv, readers.read_csv)
_round_trip("roundtrip_piped", writers.write_csv, readers.read_piped, sep="|")
_round_trip("roundtrip_latin1", writers.write_csv, readers.read_latin1_tsv, _LATIN_SQL, sep="\t", encoding="ISO-8859-1")


@query("roundtrip_json_batches", """SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) // 100 AS batch_id,
    CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS row_idx, p_name AS name FROM part""")
def roundtrip_json_batches(t):
    """Rows numbered, written in batches as JSON and read back."""
    path = Scratch(t.spark, "json-batches").base
    numbered = K.dense_id(t.part.select("p_partkey", F.col("p_name").alias("name")), ["p_partkey"], "row_idx", 0)
    writers.write_json_batches(numbered, path)
    return readers.read_json_lines(t.spark, path, schemas.table(
        batch_id=schemas.LONG, row_idx=schemas.LONG, name=schemas.STRING))


_PARTS_SQL = """SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS row_idx, p_name AS name,
    CASE WHEN p_size % 4 <> 0 THEN p_size END AS size FROM part"""


def _part_files(t, label: str) -> str:
    """Parts as JSON arrays in numbered files."""
    path = Scratch(t.spark, label).base
    rows = t.part.select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("size"))
    writers.write_json_arrays(K.dense_id(rows, ["p_partkey"], "row_idx", 0).drop("p_partkey"), path)
    return path


@query("roundtrip_json_records", f"SELECT name, size FROM ({_PARTS_SQL}) p")
def roundtrip_json_records(t):
    """Files of JSON arrays read as one set."""
    return readers.read_json_records(t.spark, _part_files(t, "json-records"), t.part.select(
        F.col("p_name").alias("name"), F.col("p_size").alias("size")).schema)


@query("roundtrip_json_chunks", _PARTS_SQL)
def roundtrip_json_chunks(t):
    """The same files as one table in their order."""
    return readers.read_json_chunks(t.spark, _part_files(t, "json-chunks"), t.part.select(
        F.col("p_name").alias("name"), F.col("p_size").alias("size")).schema)


@query("roundtrip_link_alias", "SELECT openalex_id, id FROM works", "works")
def roundtrip_link_alias(t):
    """A works file whose link column has another name."""
    path = f"{Scratch(t.spark, 'link-alias').base}/works.csv"
    writers.write_csv(t.works.select(F.col("openalex_id").alias("openalex_work"), "id"), path)
    return readers.read_works(t.spark, path).select("openalex_id", "id")


@query("roundtrip_report", """SELECT type, count(*) AS n FROM works_meta GROUP BY type""", "works_meta")
def roundtrip_report(t):
    path = Scratch(t.spark, "report-file").base
    writers.write_report(R.count_by(t.works_meta, "type", name="n"), path)
    return readers.read_csv(t.spark, path, schemas.table(type=schemas.STRING, n=schemas.LONG))


@query("roundtrip_nested", f"""SELECT {_ID} AS id, coalesce(array_to_string(list_transform(list_filter(
    range(1, 2 + p_size % 3), lambda i: (p_partkey + i) % 9 <> 0), lambda i: concat(p_brand, '-', i)), '|'), '') AS authors,
    CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS source FROM part""")
def roundtrip_nested(t):
    """Nested records written and read back as they are."""
    path = Scratch(t.spark, "nested").base
    writers.write_nested(t.metadata.select("id", "authorships", "primary_location"), path)
    return t.spark.read.parquet(path).select(
        "id", F.array_join(X.author_names(F.col("authorships")), "|").alias("authors"), F.col("primary_location.source").alias("source"))
