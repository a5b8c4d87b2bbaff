"""``.json.gz`` documents are written as many gzip members and read in file splits of any size."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from taintrank.sources import blockgzip, jsonio, jsonobject

NASTY = ['plain', '', 'a "quoted" \\ word', 'back\\', '\\"', '{"not": [a, b], }', ',', '}', 'line\nend\ttab', 'é日本 \U0001F642', '"', ' [1, 2] ']


@pytest.fixture
def small_splits(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def in_members(text: bytes, size: int) -> bytes:
    parts = [text[i:i + size] for i in range(0, len(text), size)] + [b""]
    return b"".join(blockgzip.HEADER + blockgzip.member(p) for p in parts)


def test_a_written_document_is_read_in_splits(spark, tmp_out, small_splits):
    texts = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).repartition(5)
    path = f"{tmp_out}/lookup.json.gz"
    jsonio.write_lookup(texts, path)
    with gzip.open(path, "rt", encoding="utf-8") as f:
        assert json.load(f) == {r.id: r.text for r in texts.collect()}
    assert rows(spark.read.text(path).agg(F.count("*")))[0][0] > 20_000        # any gzip reader of Spark's, too
    small_splits(100_000)
    read = jsonio.read_lookup(spark, path)
    assert rows(read) == rows(texts)
    per_split = blockgzip.in_splits(spark, path).groupBy("block").agg(F.sum(F.length("value")).alias("n")).agg(F.count("*"), F.max("n"), F.sum("n")).first()
    assert per_split[0] > 10 and per_split[1] < per_split[2] / 8


def test_members_cut_anywhere(spark, tmp_out, small_splits):
    rng = random.Random(8)
    n = 15
    lookup = {f'{k}"{rng.choice(NASTY)}': "".join(rng.choice(NASTY) for _ in range(rng.randrange(6))) for k in range(n)}
    lookup["long"] = "without a quote, é, " * 60
    scores = {f"q{k}{rng.choice(NASTY)}": {f"d{j}{rng.choice(NASTY)}": rng.choice([1, -0.5, 2e-9]) for j in range(rng.choice([0, 1, 5]))} for k in range(n)}
    records = [{"qid": rng.choice(NASTY), "docno": str(i), "score": i / 3} for i in range(n)]
    for member, splits in ((1, 7), (90, 12), (100_000, 5)):
        for name, value in (("lookup", lookup), ("scores", scores), ("records", records)):
            data = in_members(json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])).encode(), member)
            with open(f"{tmp_out}/{name}.json.gz", "wb") as f:
                f.write(data)
            small_splits(len(data) // splits)
            if name == "lookup":
                assert rows(jsonio.read_lookup(spark, f"{tmp_out}/lookup.json.gz")) == sorted(lookup.items(), key=str)
            elif name == "scores":
                assert rows(jsonio.read_score_map(spark, f"{tmp_out}/scores.json.gz")) == sorted(
                    ((q, d, float(s)) for q, docs in scores.items() for d, s in docs.items()), key=str)
            else:
                assert rows(jsonio.read_score_records(spark, f"{tmp_out}/records.json.gz")) == sorted((tuple(r.values()) for r in records), key=str)


def test_a_header_among_the_bytes_and_other_gzip(spark, tmp_out):
    def wrote(data):
        with open(f"{tmp_out}/x.json.gz", "wb") as f:
            f.write(data)
        return f"{tmp_out}/x.json.gz"
    import pyarrow as pa
    odd = b"a" + blockgzip.HEADER + b"b"
    bodies = blockgzip.member(odd, stored=True).split(blockgzip.HEADER) + [blockgzip.member(b"c")]
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 3), pa.array([0] * 3), pa.array(bodies, pa.binary())], names=["file", "block", "value"])
    assert [blockgzip.text_of(b) for _, b in blockgzip._bodies([batch])] == [odd, b"c"]
    lookup = {"a": "x", "b": None}
    text = json.dumps(lookup).encode()
    for data in (gzip.compress(text), gzip.compress(text[:5]) + gzip.compress(text[5:]),
                 blockgzip.HEADER + blockgzip.member(text[:5]) + gzip.compress(text[5:]), in_members(text, 3)[:-len(blockgzip.HEADER) - 12]):
        assert rows(jsonio.read_lookup(spark, wrote(data))) == [("a", "x"), ("b", None)]
    assert blockgzip.in_splits(spark, wrote(gzip.compress(text))) is None
    assert rows(jsonio.read_lookup(spark, wrote(in_members(b"\xef\xbb\xbf" + text, 4)))) == [("a", "x"), ("b", None)]
    broken = bytearray(in_members(text, 4))
    broken[len(blockgzip.HEADER) + 5] ^= 1
    with pytest.raises(Exception):
        jsonio.read_lookup(spark, wrote(bytes(broken))).collect()
    empty = spark.createDataFrame([], "id string, text string")
    jsonio.write_lookup(empty, f"{tmp_out}/e.json.gz")
    assert gzip.open(f"{tmp_out}/e.json.gz").read() == b"{}" and jsonio.read_lookup(spark, f"{tmp_out}/e.json.gz").count() == 0
    assert jsonobject.members(spark, f"{tmp_out}/e.json.gz", 1).count() == 0
