"""The pipeline: every stage on what its predecessor kept."""

import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from taintrank.llm import neardup, pii, queries, rules

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], SF)
        out.write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(f.columns == columns for f in frames[:-1])
    start, good, one, safe, mixed, last = ([r.asDict() for r in f.collect()] for f in frames)
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert ids(good) == {r.doc_id for r in rules.judge(docs).collect() if r.kept} and len(good) < len(start)
    assert ids(one) == {r.doc_id for r in neardup.near_duplicates(frames[1]).collect() if r.kept}
    spans = {r.doc_id: r.spans for r in pii.find(frames[2], pii.train(frames[2])).collect()}
    before = {r["doc_id"]: r["text"] for r in one}
    for r in safe:
        found = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in filter(None, spans[r["doc_id"]].split(",")))]
        assert r["text"] == pii.redacted(before[r["doc_id"]], found) and r["n_chars"] == len(r["text"])
        assert not any(pii.base_spans(r["text"]).values())
    assert ids(safe) == ids(one) and ids(mixed) <= ids(safe) and max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    text = {r["doc_id"]: r["text"] for r in safe}
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in mixed)
    for r in last:
        raw = tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(raw), hashlib.sha256(np.array(raw, "<u4").tobytes()).hexdigest())


def test_stages_take_odd_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "a b", "en", "a", 3), (3, "w " * 20_000, "en", "a", 40_000)]
    df = spark.createDataFrame([(*r, True, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _size int, id int")
    for _, stage in corpus_pipeline.STAGES:
        for part in (df, df.limit(0)):
            out = stage(spark, part, SF)
            assert out.count() <= 2 * len(rows)


def test_run_returns_digests(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
