"""One-document ``.json`` sources and sinks: what is written is valid JSON and read back whole, in splits of any size."""

import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from taintrank.sources import jsonio, jsonobject

NASTY = ['plain', '', 'a "quoted" \\ word', 'back\\', '\\"', '{"not": [a, b], }', ',', '}', 'line\nend\ttab', 'é日本 \U0001F642', '"', '\\\\"', ' [1, 2] ']


@pytest.fixture
def small_splits(spark):
    """File splits of a few bytes, so that they start inside strings, keys and numbers."""
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def opened(path):
    with (gzip.open(path, "rt", encoding="utf-8") if path.endswith(".gz") else open(path, encoding="utf-8")) as f:
        return json.load(f)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("ext", [".json", ".json.gz", ".jsonl", ".jsonl.gz"])
def test_thousand_rows_round_trip(spark, tmp_out, ext):
    lookup = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit('t"\\,}'), F.col("id").cast("string")).alias("text")).repartition(7)
    jsonio.write_lookup(lookup, f"{tmp_out}/lookup{ext}")
    assert rows(jsonio.read_lookup(spark, f"{tmp_out}/lookup{ext}")) == rows(lookup)
    scores = spark.range(1000).select((F.col("id") % 13).cast("string").alias("qid"), F.col("id").cast("string").alias("docno"), (F.col("id") / 7).alias("score")).repartition(5)
    jsonio.write_score_map(scores, f"{tmp_out}/scores{ext}")
    assert rows(jsonio.read_score_map(spark, f"{tmp_out}/scores{ext}")) == rows(scores)
    jsonio.write_score_records(scores, f"{tmp_out}/records{ext}")
    assert rows(jsonio.read_score_records(spark, f"{tmp_out}/records{ext}")) == rows(scores)
    assert rows(jsonio.load_json(spark, f"{tmp_out}/records{ext}").select("qid", "docno", "score")) == rows(scores)
    if ext.startswith(".json") and "jsonl" not in ext:
        assert opened(f"{tmp_out}/lookup{ext}") == {r.id: r.text for r in lookup.collect()}
        assert len(opened(f"{tmp_out}/records{ext}")) == 1000
        nested = opened(f"{tmp_out}/scores{ext}")
        assert len(nested) == 13 and sum(map(len, nested.values())) == 1000
        assert not [x for x in os.listdir(tmp_out) if "-parts-" in x]


def test_a_million_rows(spark, tmp_out, small_splits):
    small_splits(1 << 22)
    df = spark.range(1_000_000).select((F.col("id") % 97).cast("string").alias("qid"), F.col("id").cast("string").alias("docno"), (F.col("id") * 0.5).alias("score"))
    jsonio.write_score_map(df, f"{tmp_out}/s.json")
    back = jsonio.read_score_map(spark, f"{tmp_out}/s.json")
    check = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("qid", "docno", "score").cast("decimal(38,0)"))).first())
    assert check(back) == check(df)
    texts = df.select(F.col("docno").alias("id"), F.concat(F.lit('say "'), "docno", F.lit('", }')).alias("text"))
    for ext in (".json",):
        jsonio.write_lookup(texts, f"{tmp_out}/l{ext}")
        total = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("id", "text").cast("decimal(38,0)"))).first())
        assert total(jsonio.read_lookup(spark, f"{tmp_out}/l{ext}")) == total(texts)


def documents(rng, n):
    lookup = {f'{k}"{rng.choice(NASTY)}': "".join(rng.choice(NASTY) for _ in range(rng.randrange(6))) for k in range(n)}
    scores = {f"q{k}{rng.choice(NASTY)}": {f"d{j}{rng.choice(NASTY)}": rng.choice([1, -0.5, 2e-9]) for j in range(rng.choice([0, 1, 5, 12]))} for k in range(n)}
    records = [{"qid": rng.choice(NASTY), "docno": str(i), "score": i / 3} for i in range(n)]
    return lookup, scores, records


def read_in_splits(text, wanted, cuts):
    """What :func:`jsonobject.members` does with splits that start at the given quotes, without Spark."""
    segments = text.split('"')
    out, glue, before, depth, inside = [], None, None, 0, False
    bounds = [0, *cuts, len(segments)]
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        m = jsonobject.Members(wanted, depth, inside, whole=k == 0)
        for v in segments[lo:hi]:
            m.feed(v)
        depth, inside = m.depth, m.inside
        if not m.started:
            glue = (glue[0] + "".join(m.since), *glue[1:])
            continue
        if k:
            found, last = jsonobject.glued(glue[0] + m.head, wanted, *glue[1:])
            out += [(key or before, raw) for key, raw in found]
            before = last or before
        glue = ("".join(m.since), m.since_depth, m.since_key)
        found = m.take() + (m.pending if hi == len(segments) else [])
        out += [(key or before, raw) for key, raw in found]
        before = m.key or before
        if hi == len(segments):
            return out
    found, _ = jsonobject.glued(glue[0], wanted, *glue[1:])
    return out + [(key or before, raw) for key, raw in found]


@pytest.mark.parametrize("indent", [None, 4])
def test_any_splits_give_the_members(indent):
    rng = random.Random(5)
    for _ in range(60):
        lookup, scores, records = documents(rng, rng.choice([1, 4, 9]))
        for value, wanted in ((lookup, 1), (scores, 2), (records, 1)):
            text = json.dumps(value, indent=indent, ensure_ascii=rng.random() < 0.5)
            n = text.count('"')
            for cuts in ([], [n // 2], sorted(rng.sample(range(1, n), min(n - 1, 6))), list(range(1, n))) if n > 2 else ([],):
                got = read_in_splits(text, wanted, cuts)
                if wanted == 2:
                    assert [(json.loads(k), json.loads("{" + r + "}")) for k, r in got] == [(q, {d: x}) for q, docs in value.items() for d, x in docs.items()]
                elif value is lookup:
                    assert [json.loads("{" + r + "}") for _, r in got] == [{k: v} for k, v in value.items()]
                else:
                    assert [json.loads(r) for _, r in got] == value


def test_small_file_splits(spark, tmp_out, small_splits):
    lookup, scores, records = documents(random.Random(3), 12)
    for name, value in (("lookup", lookup), ("scores", scores), ("records", records)):
        with open(f"{tmp_out}/{name}.json", "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2)
    small_splits(120)
    assert rows(jsonio.read_lookup(spark, f"{tmp_out}/lookup.json")) == sorted(lookup.items(), key=str)
    assert rows(jsonio.read_score_map(spark, f"{tmp_out}/scores.json")) == sorted(
        ((q, d, float(s)) for q, docs in scores.items() for d, s in docs.items()), key=str)
    assert rows(jsonio.read_score_records(spark, f"{tmp_out}/records.json")) == sorted((tuple(r.values()) for r in records), key=str)
    assert jsonobject._segments(spark, f"{tmp_out}/scores.json").select("block").distinct().count() > 5


def test_odd_documents(spark, tmp_out):
    def wrote(text):
        with open(f"{tmp_out}/x.json", "w") as f:
            f.write(text)
        return f"{tmp_out}/x.json"
    assert jsonio.read_lookup(spark, wrote("{}")).count() == 0 and jsonio.read_score_map(spark, wrote(" { } ")).count() == 0
    assert jsonio.read_score_records(spark, wrote("[]")).count() == 0
    assert rows(jsonio.read_lookup(spark, wrote('{"a": null, "b": "x"}'))) == [("a", None), ("b", "x")]
    one = jsonio.load_json(spark, wrote('{"a": {"b": [1, 2]},\n "c": "x"}')).collect()
    assert len(one) == 1 and one[0].c == "x" and list(one[0].a.b) == [1, 2]
    assert jsonio.load_json(spark, wrote('{"a": 1}\n{"a": 2}\n{"a": 3}'), "a int").count() == 3      # lines under the wrong name
    empty = spark.createDataFrame([], "id string, text string")
    jsonio.write_lookup(empty, f"{tmp_out}/e.json")
    assert opened(f"{tmp_out}/e.json") == {} and jsonio.read_lookup(spark, f"{tmp_out}/e.json").count() == 0
    none = spark.createDataFrame([], "qid string, docno string, score double")
    jsonio.write_score_map(none, f"{tmp_out}/s.json")
    jsonio.write_score_records(none, f"{tmp_out}/r.json.gz")
    assert opened(f"{tmp_out}/s.json") == {} and opened(f"{tmp_out}/r.json.gz") == []
    twice = spark.createDataFrame([("q", "a", 1.0, 0), ("q", "a", 7.0, 1)], "qid string, docno string, score double, seq int")
    jsonio.write_score_map(twice, f"{tmp_out}/s.json", seq="seq")
    assert opened(f"{tmp_out}/s.json") == {"q": {"a": 7.0}}
    with pytest.raises(FileExistsError):
        jsonio.write_lookup(empty, f"{tmp_out}/e.json", mode="error")
