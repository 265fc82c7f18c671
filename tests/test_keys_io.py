"""Row numbers, reference lists, readers and writers."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citegrid.functions import nested as X
from citegrid.operators import keys as K
from citegrid.plans import build, views
from citegrid.sources import readers, schemas, writers


def test_dense_id(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(6)
    got = K.dense_id(df, ["k"], start=5).collect()
    assert sorted((r.k, r.id) for r in got) == [(i, i + 5) for i in range(1000)]


def test_row_idx_follows_the_file(spark, tmp_path):
    path = str(tmp_path / "dois.txt")
    with open(path, "w") as f:
        f.write("doi\n" + "".join(f"10.1/{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.read_tsv(spark, path, schemas.DOIS, row_idx=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.doi == f"10.1/{r.row_idx}" for r in got) and len(got) == 5000


def test_works_and_citations_from_lists(spark, rows):
    records = spark.createDataFrame(
        [(0, "u/W1", "['u/W2', 'u/W3']"), (1, "u/W2", "['u/W3', 'u/W9']"), (2, "u/W4", "[]"), (3, "", "['u/W1', '']")],
        "row_idx long, id string, referenced_works string")
    works = K.build_works(records)
    assert rows(works, "id", "openalex_id") == [(1, "u/W1"), (2, "u/W2"), (3, "u/W4"), (4, "u/W3"), (5, "u/W9")]
    every = K.build_works(records, dedup=False)
    assert every.count() == 3 + 5 and rows(every, "id") == [(i,) for i in range(1, 9)]
    assert rows(K.build_citations(records.where("id <> ''"), works)) == [(1, 2), (1, 4), (2, 4), (2, 5)]


def test_nested(spark):
    df = spark.sql("""SELECT map('b', array(1, 3), 'a', array(0, 2)) AS inv,
        array(named_struct('author', named_struct('display_name', 'X'), 'institutions',
                array(named_struct('display_name', 'I', 'ror', 'r1'), named_struct('display_name', 'J', 'ror', 'r2'))),
              named_struct('author', named_struct('display_name', ''), 'institutions',
                array())) AS au, CAST(array() AS array<struct<display_name:string>>) AS sdg""")
    r = df.select(
        X.abstract_text(F.col("inv")).alias("t"), X.author_names(F.col("au")).alias("n"),
        X.institutions(F.col("au")).alias("i"), X.institutions(F.col("au"), True).alias("l"),
        X.first_display_name(F.col("sdg")).alias("s")).first()
    assert r.t == "a b a b" and r.n == ["X"] and r.s is None
    assert [x.ror for x in r.i] == ["r1", "r2"] and [x.ror for x in r.l] == ["r2"]


def test_missing_value_spellings_and_delimiters(spark, tmp_path, rows):
    for sep, read in (("|", readers.read_piped), (",", readers.read_csv), ("\t", readers.read_tsv)):
        path = str(tmp_path / f"t{ord(sep)}.csv")
        with open(path, "w") as f:
            f.write(sep.join(("Title", "DOI")) + "\n" + sep.join(('"a ""q""\nb"', "NA")) + "\n" + sep.join(("n/a", "10.1/NF")) + "\n")
        got = {(r.Title, r.DOI) for r in read(spark, path, schemas.TITLES, multi_line=True).collect()}
        assert got == {('a "q"\nb', None), (None, "10.1/NF")}


def test_broken_record_fails(spark, tmp_path):
    with open(tmp_path / "b.csv", "w") as f:
        f.write('Title,DOI\n"a\nb",10.1/x\n')
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_csv(spark, str(tmp_path / "b.csv"), schemas.TITLES).collect()


def test_latin1(spark, tmp_path):
    path = str(tmp_path / "l.tsv")
    with open(path, "wb") as f:
        f.write(b"openalex_work_id\nW\xe9\n")
    assert readers.read_latin1_tsv(spark, path, schemas.CORE_WORKS).first()[0] == "Wé"


def test_missing_file_fails(spark, tmp_path):
    with pytest.raises(PySparkException):
        readers.read_csv(spark, str(tmp_path / "none.csv"), schemas.WORKS).collect()


def test_json_batches_round_trip(spark, tmp_path, rows):
    df = spark.range(2_500).select(F.col("id").alias("row_idx"), F.concat(F.lit("W"), "id").alias("id"))
    out = str(tmp_path / "batches")
    writers.write_json_batches(df, out)
    assert len([f for f in os.listdir(out) if f.endswith(".json")]) <= 8
    back = spark.read.json(out)
    assert back.where("batch_id = 1").count() == 100 and back.count() == 2_500
    for i in range(2):
        with open(tmp_path / f"chunk_{i}.json", "w") as f:
            json.dump([{"id": f"W{i}", "keywords": [{"id": "k", "display_name": "K", "score": 0.5}],
                        "sustainable_development_goals": []}], f)
    back = readers.read_json_records(spark, str(tmp_path / "chunk_*.json"), schemas.LABELS)
    assert sorted(r.id for r in back.collect()) == ["W0", "W1"]


def test_chunks_come_back_in_numeric_order(spark, tmp_path):
    for start in (0, 100, 20, 3):
        with open(tmp_path / f"data_{start}_{start + 2}.json", "w") as f:
            json.dump([{"id": f"W{start + i}", "keywords": [], "sustainable_development_goals": []} for i in range(2)], f)
    rows = readers.read_json_chunks(spark, str(tmp_path / "data_*.json"), schemas.LABELS).orderBy("row_idx").collect()
    assert [r.id for r in rows] == ["W0", "W1", "W3", "W4", "W20", "W21", "W100", "W101"]


def test_json_arrays_are_many_files_of_few_tasks(spark, tmp_path):
    """Tasks, and so the cells of the shuffle before them, follow the data and not the files; order is kept."""
    rows = spark.range(2_403).select(F.col("id").alias("row_idx"), F.concat(F.lit("W"), "id").alias("id"))
    out = str(tmp_path / "arrays")
    writers.write_json_arrays(rows.repartition(3), out, size=4)
    files = sorted(f for f in os.listdir(out) if f.endswith(".txt"))
    assert len(files) == 601 and len({f.split("-")[1] for f in files}) <= 8
    held = [[r["id"] for r in json.load(open(os.path.join(out, f)))] for f in files]
    assert held == [[f"W{i}" for i in range(k, min(k + 4, 2_403))] for k in range(0, 2_403, 4)]
    back = readers.read_json_chunks(spark, out, schemas.table(id=schemas.STRING)).orderBy("row_idx").collect()
    assert [(r.row_idx, r.id) for r in back] == [(i, f"W{i}") for i in range(2_403)]


def test_text_comes_back_as_it_was(spark, tmp_path):
    odd = ['a "q", b', "tab\there", "back\\slash\\", "line\nbreak", " blank ", '"', "x|y", None]
    df = spark.createDataFrame(list(enumerate(odd)), "i long, v string")
    schema = schemas.table(i=schemas.LONG, v=schemas.STRING)
    for k, (write, read) in enumerate(((writers.write_csv, readers.read_csv), (writers.write_tsv, readers.read_tsv),
                                       (writers.write_report, readers.read_csv))):
        write(df, str(tmp_path / f"t{k}"))
        back = {r.i: r.v for r in read(spark, str(tmp_path / f"t{k}"), schema, multi_line=True).collect()}
        assert [back[i] for i in range(len(odd))] == odd


def test_network_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "net_bc.csv").write_text("target,source,type,weight\n2,1,x,3\n")
    (tmp_path / "net_h.csv").write_text("weight,source,target\n5,1,4\n")
    got = {tuple(r) for r in readers.read_networks(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, 3, "x", "bc"), (1, 4, 5, None, "h")}
    (tmp_path / "net_bad.csv").write_text("source,target,weight\n1,2,oops\n")
    with pytest.raises(PySparkException):
        readers.read_networks(spark, str(tmp_path)).collect()


def test_tsv_spells_missing_values(spark, tmp_path):
    out = str(tmp_path / "tsv")
    writers.write_tsv(spark.createDataFrame([("a", None)], "doi string, agency string").coalesce(1), out)
    part = [f for f in os.listdir(out) if f.endswith(".csv")][0]
    with open(os.path.join(out, part)) as f:
        assert f.read() == "doi\tagency\na\tNA\n"


def test_network_files_by_prefix(spark, tmp_path):
    for n in ("bc", "dc"):
        with open(tmp_path / f"net_{n}.csv", "w") as f:
            f.write("source,target,weight,type\n1,2,3,x\n")
    assert {r.network for r in readers.read_networks(spark, str(tmp_path)).collect()} == {"bc", "dc"}


def test_run_writes_edges_and_nodes(spark, tmp_path):
    with open(tmp_path / "works.csv", "w") as f:
        f.write("openalex_work_id,id\n" + "".join(f"W{i},{i}\n" for i in range(1, 6)))
    with open(tmp_path / "citations.csv", "w") as f:
        f.write("citing_id,cited_id\n1,2\n3,2\n3,4\n5,4\n5,2\n1,77\n3,77\n")
    out = str(tmp_path / "out")
    build.run(spark, str(tmp_path / "works.csv"), str(tmp_path / "citations.csv"), out)
    edges, nodes = spark.read.parquet(f"{out}/edges"), spark.read.parquet(f"{out}/nodes")
    assert {r.network for r in edges.select("network").distinct().collect()} == set(
        ("bc", "dc", "cc", "bc_cc_dc", "bc_cc", "bc_dc", "cc_dc"))
    bc = {(r.source, r.target): r.weight for r in edges.where("network = 'bc'").collect()}
    assert bc == {(1, 3): 2, (1, 5): 1, (3, 5): 2}
    assert nodes.where("Label is null").count() == 0


def test_inverted_index_groups_no_row_per_word(spark, tmp_path):
    rows = [(1, "b a\n\tb"), (1, "a c"), (2, None), (3, ""), (None, " x  x y "), (4, "z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    index = views.view(spark, str(tmp_path), "inverted_index")
    got = {r.doc_id: {w: sorted(p) for w, p in r.abstract_inverted_index.items()} for r in index.collect()}
    assert got == {1: {"a": [0, 1], "b": [0, 2], "c": [1]}, 3: {"": [0]}, None: {"x": [0, 1], "y": [2]}, 4: {"z": [0]}}
    assert "Generate" not in index._jdf.queryExecution().toString()
