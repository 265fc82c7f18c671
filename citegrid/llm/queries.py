"""Queries over whole tables, one per operator, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

#: Words are maximal runs of characters other than space and 0x09-0x0D.
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with its SQL check."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


@query("op8_ngram_jaccard_join", f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * common >= 85 * (nx.n + ny.n - common)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) m ON m.id = d.doc_id
""")
def _ngram_jaccard_join(spark, sf_dir):
    from citegrid.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op4_substring_dedup", f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
p AS (SELECT doc_id, words, unnest(CASE WHEN len(words) >= 35 THEN range(1, len(words) - 33) ELSE [] END) AS i FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM p),
c AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
b AS (SELECT h.doc_id, list(h.i) AS pos FROM h JOIN c USING (h) GROUP BY 1),
g AS (SELECT doc_id, list_distinct(flatten(list_transform(pos, lambda i: range(i, i + 35)))) AS gone FROM b)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words
    ELSE list_filter(words, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
""")
def _substring_dedup(spark, sf_dir):
    from citegrid.llm.substring_dedup import removal_report

    return removal_report(table(spark, sf_dir, "documents"))


@query("op7_byte_bpe")
def _byte_bpe(spark, sf_dir):
    import public_tokenizers

    from citegrid.llm.bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                        public_tokenizers.PATTERN)


@query("op3_token_planes")
def _token_planes(spark, sf_dir):
    import public_tokenizers

    from citegrid.llm.token_planes import planes_round_trip

    return planes_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.PATTERN, end_id=2)


@query("op10_pareto_mixing", f"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size,
    (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
-- Sources in the order in which a rising common level fills them.
f AS (SELECT *, 2.0::DOUBLE * source_size AS room, row_number() OVER w AS k,
    sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)),
l AS (SELECT coalesce(min_by(rest / open, k) FILTER (WHERE rest / open * weight <= room), max(rest / open)) AS level FROM f),
g AS (SELECT source, source_size, CASE WHEN weight * level > room THEN room ELSE weight * level END AS target FROM f, l),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size::DOUBLE) ELSE 0 END AS expected
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS p FROM e),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM p),
r AS (SELECT *, odds / (1 + odds) AS rank, round(target)::BIGINT - sum(whole * size) OVER (PARTITION BY source) AS need FROM o),
c AS (SELECT *, coalesce(sum(size) FILTER (WHERE rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank NULLS LAST, size, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM r),
t AS (SELECT *, rank IS NOT NULL AND ahead < need AND 2 * ahead + size <= 2 * need AS taken FROM c),
m AS (SELECT *, need - coalesce(sum(size) FILTER (WHERE taken) OVER (PARTITION BY source), 0) AS short FROM t),
x AS (SELECT source, min({{'left': abs(short - CASE WHEN taken THEN -size ELSE size END), 'rank': rank}}).rank AS swap
  FROM m WHERE rank IS NOT NULL AND need > 0 AND abs(short - CASE WHEN taken THEN -size ELSE size END) < abs(short) GROUP BY source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (SELECT m.*, (whole + (taken <> coalesce(rank = swap, false))::INT)::INT AS copies
  FROM m LEFT JOIN x ON m.source IS NOT DISTINCT FROM x.source) q
""")
def _pareto_mixing(spark, sf_dir):
    from citegrid.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


@query("op6_quality_nbsvm")
def _quality_nbsvm(spark, sf_dir):
    from citegrid.llm.quality import score_texts

    return score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_nra_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def _nra_topk(spark, sf_dir):
    from citegrid.llm.topk_nra import top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings"))


@query("op9_permutation_index")
def _permutation_index(spark, sf_dir):
    from citegrid.llm.permutation_index import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query("op2_warc_dictionary")
def _warc_dictionary(spark, sf_dir):
    from citegrid.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def _register_license_scan() -> None:
    from citegrid.llm.license_scan import scan, scan_sql

    query("op1_license_scan", scan_sql())(lambda spark, sf_dir: scan(table(spark, sf_dir, "documents")))


_register_license_scan()


def _register_quality_rules() -> None:
    from citegrid.llm.quality_rules import judge, judge_sql

    query("op11_quality_rules", judge_sql())(lambda spark, sf_dir: judge(table(spark, sf_dir, "documents")))


_register_quality_rules()


def _register_collocations() -> None:
    from citegrid.llm.collocations import collocations, collocations_sql

    query("op13_collocations", collocations_sql())(
        lambda spark, sf_dir: collocations(table(spark, sf_dir, "documents")))


_register_collocations()


def _register_lexical_search() -> None:
    from citegrid.llm.lexical_search import rank_documents, search_sql

    query("op12_lexical_search", search_sql())(lambda spark, sf_dir: rank_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_register_lexical_search()
