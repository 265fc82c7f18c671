"""DOI rules that surprise."""

import pytest
from pyspark.sql import functions as F

from citegrid.functions import doi as D
from citegrid.operators import doi_quality as Q
from citegrid.operators import enrich as E


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, doi string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("doi"))).collect()]


@pytest.mark.parametrize("raw, want", [
    ("https://doi.org/10.1/a", "10.1/a"),
    ("http://doi.org/10.1/a", "10.1/a"),                       # its slash goes with the leading ones
    ("10.1/ahttp://dx.doi.org/10.2/b", "10.1/a10.2/b"),          # removed anywhere
    ("https://dx.doi.org/10.1/a", "https://dx.doi.org/10.1/a"),  # not covered
    ("10.1%2Fa..", "10.1/a"), ("10.1%2fa", "10.1%2fa"), ("//10.1/a/", "10.1/a/"), (None, None),
])
def test_repair(spark, raw, want):
    assert apply(spark, D.repair, [raw]) == [want]


def test_label_rule_is_anchored_in_upper_case_only(spark):
    assert apply(spark, D.strip_label, ["DOI:10.1/a", "xDOI:1", "doi:1", "xdoi:1"]) == ["10.1/a", "xDOI:1", "1", "x1"]


def test_test_prefix_matches_anywhere_unless_strict(spark):
    values = ["10.5555/x", "10.1/10.5555", "1005555", "10.55555/x"]
    assert apply(spark, D.has_test_prefix, values) == [True, True, True, True]
    assert apply(spark, lambda c: D.has_test_prefix(c, strict=True), values) == [True, False, False, False]


def test_dedup_collapses_nulls_by_default(spark, rows):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (0, None), (4, "b")], "row_idx long, doi string")
    assert sorted(r[0] for r in rows(Q.keep_first(df), "row_idx")) == [0, 1, 4]
    assert sorted(r[0] for r in rows(Q.keep_first(df, keep_nulls=True), "row_idx")) == [0, 1, 2, 4]
    report = Q.dedup_report(df).first()
    assert (report.rows_left, report.dois_with_duplicates, report.rows_removed) == (3, 1, 1)


def test_dedup_limits_groups_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "row_idx long, doi string")
    plan = Q.keep_first(df)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "WindowGroupLimit" in plan


def test_label_comes_off_after_dedup(spark, rows):
    df = spark.createDataFrame([(0, "DOI:10.1/a"), (1, "10.1/a"), (2, "NF"), (3, "10.5555/t")], "row_idx long, doi string")
    assert rows(Q.clean(df).where("doi is not null")) == [(0, "10.1/a"), (1, "10.1/a")]
    assert Q.clean(df).where("doi is null").count() == 1


def test_override_can_empty_and_ignores_unknown_rows(spark, rows):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row_idx long, doi string")
    fixes = spark.createDataFrame([(0, None), (1, "x"), (9, "y")], "row_idx long, doi string")
    got = {r.row_idx: r.doi for r in Q.override(df, fixes).collect()}
    assert got == {0: None, 1: "x", 2: "c"}


def test_profile_of_empty_and_small_input(spark):
    empty = spark.createDataFrame([], "doi string")
    assert Q.profile(empty).first().total in (0, None)
    df = spark.createDataFrame([("a",), ("bb",), ("ccc",), ("dddd",), (None,)], "doi string")
    r = Q.profile(df).first()
    assert (r.total, r.missing, r.pct_filled) == (5, 1, 80.0)
    assert (r.q25_len, r.q50_len, r.q75_len) == (1.75, 2.5, 3.25)
    assert r.std_len == pytest.approx(1.2909944487358056)


def test_agency(spark):
    df = spark.createDataFrame([(0, "a"), (1, "z"), (2, None)], "row_idx long, doi string")
    registry = spark.createDataFrame([("a", "Crossref")], "doi string, agency string")
    got = {r.row_idx: r.registration_agency for r in E.registration_agency(df, registry).collect()}
    assert got == {0: "Crossref", 1: "Resource not found", 2: None}
    assert [r.doi for r in E.unresolved(E.registration_agency(df, registry)).collect()] == ["z"]


def test_fill_never_multiplies_rows(spark, rows):
    results = spark.createDataFrame([("t", None), ("u", "d0"), ("v", None)], "orig_title string, doi string")
    inputs = spark.createDataFrame([("t", "d1"), ("t", "d2"), ("v", None)], "title string, doi string")
    got = {r.orig_title: r.doi for r in E.fill_missing(results, inputs).collect()}
    assert got == {"t": "d1", "u": "d0", "v": None}
