"""Sources and sinks (S1-S17): round trips into fresh temp folders."""

import glob
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from taintrank.operators import metrics
from taintrank.sources import jsonio, profile, trec, triples


def test_triples_roundtrip_gzip(spark, tmp_out):
    df = spark.createDataFrame([("1", "10", "11"), ("2", "20", "21")], "query_id string, doc_id_a string, doc_id_b string")
    path = os.path.join(tmp_out, "triples")
    triples.write_triples(df, path)
    assert any(f.endswith(".gz") for f in os.listdir(path))
    back = triples.read_triples(spark, path, partitions=3)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_triples_list_negatives_written_joined(spark, tmp_out):
    df = spark.createDataFrame([("1", "10", ["11", "12"])], "query_id string, doc_id_a string, doc_id_b array<string>")
    path = os.path.join(tmp_out, "t2")
    triples.write_triples(df, path, compression=None)
    assert triples.read_triples(spark, path).collect()[0]["doc_id_b"] == "11,12"


def test_json_extension_rule(spark, tmp_out):
    for name, lines, comp in (("a.json", False, None), ("a.jsonl", True, None), ("a.json.gz", False, "gzip"),
                              ("a.jsonl.gz", True, "gzip")):
        assert jsonio.json_kind(name) == (lines, comp)
    with pytest.raises(ValueError):
        jsonio.json_kind("scores.txt")
    p = os.path.join(tmp_out, "single.json")
    with open(p, "w") as f:
        json.dump([{"qid": "1", "docno": "a", "score": 1.5}, {"qid": "1", "docno": "b", "score": -2.0}], f)
    got = jsonio.load_json(spark, p, "qid string, docno string, score double").collect()
    assert sorted(r["docno"] for r in got) == ["a", "b"]
    out = os.path.join(tmp_out, "recs.jsonl.gz")
    jsonio.write_score_records(spark.createDataFrame(got), out)
    assert jsonio.read_score_records(spark, out).count() == 2
    with pytest.raises(ValueError):
        jsonio.save_json(spark.createDataFrame(got), os.path.join(tmp_out, "x.csv"))


def test_lookup_and_score_map(spark, tmp_out):
    p = os.path.join(tmp_out, "lookup.json")
    with open(p, "w") as f:
        json.dump({"1": "one", "2": "two"}, f, indent=4)
    lk = jsonio.read_lookup(spark, p)
    assert sorted(map(tuple, lk.collect())) == [("1", "one"), ("2", "two")]
    out = os.path.join(tmp_out, "lookup_out.jsonl")
    jsonio.write_lookup(lk, out, rows_per_object=1)
    assert sorted(map(tuple, jsonio.read_lookup(spark, out).collect())) == [("1", "one"), ("2", "two")]

    sm = os.path.join(tmp_out, "scores.json.gz")
    with gzip.open(sm, "wt") as f:
        json.dump({"q1": {"a": 1.0, "b": -0.5}, "q2": {"c": 3.0}}, f)
    long = jsonio.read_score_map(spark, sm)
    assert sorted(map(tuple, long.collect())) == [("q1", "a", 1.0), ("q1", "b", -0.5), ("q2", "c", 3.0)]
    # duplicates keep the last (largest seq); big queries split over lines
    dup = spark.createDataFrame([("q1", "a", 1.0, 0), ("q1", "a", 7.0, 1)] +
                                [("q3", str(i), float(i), 0) for i in range(25)],
                                "qid string, docno string, score double, seq int")
    out = os.path.join(tmp_out, "maps.jsonl")
    jsonio.write_score_map(dup, out, seq="seq", buckets=10)
    back = {(r["qid"], r["docno"]): r["score"] for r in jsonio.read_score_map(spark, out).collect()}
    assert back[("q1", "a")] == 7.0 and len(back) == 26
    lines = spark.read.text(out).count()
    assert lines >= 4  # q1 + q3 in at least three pieces


def test_trec_runs_directory_and_metrics_table(spark, tmp_out):
    d = os.path.join(tmp_out, "runs")
    os.makedirs(d)
    for name in ("teacher", "cert"):
        with open(os.path.join(d, f"{name}.trec"), "w") as f:
            f.write("q1 Q0 a 0 2.0 x\nq1 Q0 b 1 1.0 x\n")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("not a run\n")
    runs = trec.read_run(spark, d, name_from_file=True)
    assert sorted({r["name"] for r in runs.collect()}) == ["cert", "teacher"]  # no letters stripped
    qrels = spark.createDataFrame([("q1", "a", 1)], "qid string, docno string, relevance int")
    wide = metrics.evaluate(runs, qrels)
    out = os.path.join(tmp_out, "metrics")
    trec.write_metrics(wide, out)
    back = trec.read_metrics(spark, out)
    assert back.columns[0] == "AP(rel=1)" and back.columns[-1] == "name" and back.count() == 2
    # S13 + S16
    run_out = os.path.join(tmp_out, "run_out")
    r = runs.where(F.col("name") == "cert").drop("name")
    trec.write_run(r, run_out, tag="mine")
    trec.write_run(r.limit(0), run_out, overwrite=False)  # existing output is left alone
    lines = [x["value"] for x in spark.read.text(run_out).collect()]
    assert sorted(lines) == ["q1 Q0 a 0 2.0 mine", "q1 Q0 b 1 1.0 mine"]


def test_profile_and_collection(spark, tmp_out):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "qid string, docno string")
    p = profile.profile(df, ["qid", "docno"]).collect()[0]
    assert (p["n_rows"], p["n_distinct_qid"], p["n_distinct_docno"]) == (3, 2, 2)
    assert profile.preview(df, 2).count() == 2
    path = os.path.join(tmp_out, "docs")
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(path)
    c = triples.read_collection(spark, docs=path)
    assert c["docs"].columns == ["docno", "text"] and c["docs"].collect()[0]["docno"] == "1"


def test_many_runs_written_and_read_in_one_scan(spark, tmp_out):
    runs = spark.createDataFrame([("teacher", "q1", "a", 0, 2.0), ("teacher", "q1", "b", 1, 1.0),
                                  ("student", "q1", "b", 0, 0.5)],
                                 "name string, qid string, docno string, rank int, score double")
    path = os.path.join(tmp_out, "runs_layout")
    trec.write_runs(runs, path)
    back = trec.read_runs(spark, path)
    got = sorted((r["name"], r["docno"], r["rank"], r["score"]) for r in back.collect())
    assert got == [("student", "b", 0, 0.5), ("teacher", "a", 0, 2.0), ("teacher", "b", 1, 1.0)]


def test_many_runs_keep_line_order(spark, tmp_out):
    rows = [("a", q, f"d{r}", r, 100.0 - r) for q in ("q1", "q2") for r in range(30)] + [("b", "q1", "d0", 0, 1.0)]
    runs = spark.createDataFrame(rows, "name string, qid string, docno string, rank int, score double").repartition(5)
    trec.write_runs(runs, tmp_out + "/runs")
    lines = []
    for f in sorted(glob.glob(tmp_out + "/runs/name=a/part-*")):
        with open(f) as fh:
            lines += [x.split(" ") for x in fh.read().splitlines()]
    assert [(x[0], int(x[3])) for x in lines] == [(q, r) for q in ("q1", "q2") for r in range(30)]
    assert trec.read_runs(spark, tmp_out + "/runs").count() == 61


def test_written_tables_can_be_released(spark):
    from taintrank.session import Scratch, cut_lineage, release_tables
    tmp = Scratch(spark, "test")
    kept, gone = tmp.table(spark.range(5).toDF("x"), "kept"), tmp.table(spark.range(5).toDF("x"), "gone")
    tmp.drop(gone)
    assert kept.count() == 5 and cut_lineage(spark.range(3), "cut").count() == 3
    with pytest.raises(Exception):
        gone.collect()
    assert release_tables(spark) >= 2 and release_tables(spark) == 0
