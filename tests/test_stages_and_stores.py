"""Saved pipelines of scorers, encoders and poolers; vectors by content; bucketed tables."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from taintrank.operators import scoring, stages, vector_store
from taintrank.plans import distill
from taintrank.sources import bucketed

BASE = "taintrank.operators.scoring"
ROWS = [("q1", "d1", "red fox", "the red fox runs"), ("q1", "d2", "red fox", "a blue whale"), ("q2", "d1", "whale", "the red fox runs"),
        ("q2", "d1", "whale", "the red fox runs"), ("q3", "d3", None, ""), ("q3", "d4", "fox", None)]
SCHEMA = "qid string, docno string, query string, text string"
W = [[((i + j) % 3 - 1) * 0.5 for i in range(16)] for j in range(2)]


def whole():
    return PipelineModel([stages.CrossScorer(model=f"{BASE}:TokenOverlapScorer", outputCol="cross"),
                          stages.CrossScorer(model=f"{BASE}:OverlapLogitsScorer", outputCol="logits", logits=True, batchSize=2),
                          *stages.bi_encoder(f"{BASE}:HashedBowEncoder", {"dim": 16}, weights=W, bias=[1.0, -1.0], rank=True)])


def result(df):
    return sorted((r.qid, r.docno, r.query or "", r.text or "", r.cross, tuple(r.logits), r.score, r["rank"]) for r in df.collect())


def test_pipeline_scores(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = result(whole().transform(df))
    assert len(got) == len(ROWS)
    enc = scoring.HashedBowEncoder(16)
    overlap = scoring.TokenOverlapScorer()
    for qid, docno, q, t, cross, logits, score, _ in got:
        x, y = (np.array(W) @ enc([s])[0] + [1.0, -1.0] for s in (q, t))
        assert cross == overlap([q], [t])[0] and logits == (-cross, cross)
        assert score == pytest.approx(float(x @ y), abs=1e-12)
    assert whole().transform(df.limit(0)).count() == 0


def test_saved_pipeline_gives_the_same_in_a_fresh_session(spark, tmp_out):
    whole().write().overwrite().save(f"{tmp_out}/model")
    back = PipelineModel.load(f"{tmp_out}/model")
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = result(whole().transform(df))
    assert result(back.transform(df)) == want
    kept = {type(s).__name__: {p.name: v for p, v in s.extractParamMap().items()} for s in back.stages}
    assert json.loads(kept["TextEncoder"]["settings"]) == {"dim": 16} and kept["Pooler"]["weights"] == W and kept["CrossScorer"]["batchSize"] == 2
    df.write.parquet(f"{tmp_out}/rows")
    code = ("import sys; from taintrank.session import local_session; from pyspark.ml import PipelineModel; s = local_session(2, 2); "
            "d = PipelineModel.load(sys.argv[1] + '/model').transform(s.read.parquet(sys.argv[1] + '/rows')); "
            "print(sorted((r.qid, r.docno, r.query or '', r.text or '', r.cross, tuple(r.logits), r.score, r['rank']) for r in d.collect()))")
    run = subprocess.run([sys.executable, "-c", code, tmp_out], capture_output=True, text=True, timeout=180, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.strip().splitlines()[-1] == repr(want)


def test_stage_parameters(spark, tmp_out):
    with pytest.raises(ValueError, match="module:name"):
        stages.make_model("no_colon", "{}")
    with pytest.raises(ValueError, match="as many rows"):
        stages.Pooler(inputCol="v", weights=[[1.0]], bias=[0.0, 1.0]).transform(spark.createDataFrame([([1.0],)], "v array<double>"))
    with pytest.raises(ValueError):
        stages.VectorDot(outputCol="other", rank=True)
    states = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "s array<array<double>>")
    for mode, want in (("cls", [1.0, 2.0]), ("mean", [2.0, 4.0]), ("none", [[1.0, 2.0], [3.0, 6.0]])):
        stage = stages.Pooler(inputCol="s", outputCol="p", mode=mode)
        stage.write().overwrite().save(f"{tmp_out}/{mode}")
        assert stages.Pooler.load(f"{tmp_out}/{mode}").transform(states).first().p == want


def test_fitted_scorer_is_a_stage(spark, tmp_out):
    f = spark.createDataFrame([("1", f"d{i}", [float(i), float(i * i % 7)]) for i in range(8)], "qid string, docno string, phi array<double>")
    t = spark.createDataFrame([("1", f"d{i}", f"d{j}") for i in range(4, 8) for j in range(4)], "query_id string, doc_id_a string, doc_id_b string")
    fitted = distill.train_teacher(t, f, reg=0.1)
    PipelineModel([stages.LinearScorer.of(fitted)]).write().overwrite().save(f"{tmp_out}/linear")
    got = PipelineModel.load(f"{tmp_out}/linear").transform(f).select("docno", "score").collect()
    want = {r.docno: r.score for r in distill.apply_linear(f, fitted).collect()}
    assert {r.docno: r.score for r in got} == want


def counting(folder):
    """A factory of encoders that write down each text they encode."""
    def factory():
        def model(texts):
            import uuid
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                json.dump(list(texts), f)
            return scoring.HashedBowEncoder(8)(texts)
        return model
    return factory


def asked(folder):
    out = []
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as f:
            out += json.load(f)
    return sorted(out)


def test_store_encodes_a_text_once(spark, tmp_path):
    store = vector_store.VectorStore(spark, str(tmp_path / "store"))
    seen = tmp_path / "seen"
    seen.mkdir()

    factory = counting(str(seen))
    docs = [("d1", "one two"), ("d2", "one two"), ("d2", "three"), ("d3", None), ("d4", "")] + [(f"x{i}", f"text {i}") for i in range(20)]
    df = spark.createDataFrame(docs, "docno string, text string")
    texts = {t or "" for _, t in docs}
    assert store.attach(df).where("vec is not null").count() == 0
    assert store.add(df, factory, waves=3) == len(texts) and asked(seen) == sorted(texts)
    assert store.add(df, factory) == 0 and len(asked(seen)) == len(texts)            # a second run encodes nothing
    changed = spark.createDataFrame([(d, "other " + t if d == "x3" else t) for d, t in docs], "docno string, text string")
    assert store.add(changed, factory) == 1
    assert sorted(set(asked(seen)) - texts) == ["other text 3"]
    plain = scoring.HashedBowEncoder(8)
    got = store.attach(df.withColumn("vec_id", F.lit(1))).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.vec == plain([r.text or ""])[0].tolist()
    with pytest.raises(ValueError, match="taken"):
        store.attach(df.withColumn("h1", F.lit(1)))


def test_store_goes_on_after_a_lost_job(spark, tmp_path):
    store = vector_store.VectorStore(spark, str(tmp_path / "store"))
    seen = tmp_path / "seen"
    seen.mkdir()
    df = spark.createDataFrame([(f"text {i}",) for i in range(40)], "text string")

    def breaks(bad=df.select("text", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(4)).alias("w")).where("w = 2").first().text):
        def model(texts):
            if bad in texts:
                raise RuntimeError("lost")
            return scoring.HashedBowEncoder(8)(texts)
        return model

    with pytest.raises(Exception, match="lost"):
        store.add(df, breaks, waves=4)
    kept = store.size()
    assert 0 < kept < 40                                                                # waves 0 and 1
    assert store.add(df, counting(str(seen)), waves=4) == 40 - kept == len(asked(seen))
    spark.read.parquet(store.path).limit(5).write.mode("append").parquet(store.path + "-copy")
    spark.read.parquet(store.path + "-copy").write.mode("append").parquet(store.path)    # as a second writer leaves it
    assert store.vectors().count() == 40 and store.attach(df).count() == 40


def test_bucketed_side_is_not_shuffled(spark, tmp_path):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(200)] + [("d7", "again"), (None, "none")], "docno string, text string")
    vecs = spark.createDataFrame([(f"d{i}", [float(i), 1.0]) for i in range(0, 200, 2)], "docno string, vec array<double>")
    pairs = spark.createDataFrame([(f"q{i % 5}", f"d{i}") for i in range(0, 230, 3)], "qid string, docno string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = bucketed.write_bucketed(docs, "bucketed_docs", "docno", str(tmp_path / "docs"), n)
        b = bucketed.write_bucketed(vecs, "bucketed_vecs", "docno", str(tmp_path / "vecs"), n)
        assert len([f for f in os.listdir(tmp_path / "docs") if f.endswith(".parquet")]) <= n
        assert a.count() == 202

        def exchanges(df):
            return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

        assert exchanges(a.join(b, "docno")) == 0
        both = pairs.join(a, "docno", "left").join(b, "docno", "left")
        assert exchanges(both) == 1                                                     # the pairs alone
        want = pairs.join(docs, "docno", "left").join(vecs, "docno", "left")
        assert exchanges(want) == 3
        assert sorted(map(repr, both.collect())) == sorted(map(repr, want.collect()))
        assert exchanges(a.groupBy("docno").count()) == 0
        again = bucketed.write_bucketed(docs.limit(3), "bucketed_docs", "docno", str(tmp_path / "docs"), n)
        assert again.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for t in ("bucketed_docs", "bucketed_vecs"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
    assert bucketed.bucket_count(0, 8) == 8 and bucketed.bucket_count(10 << 30, 8) == 40
