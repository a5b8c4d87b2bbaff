"""Operators 3, 6, 7, 8, 9, 10: against plain versions on small tables, and odd rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taintrank.llm import _text, bpe, chat, mixing, neardup, queries, topk, training_order
from taintrank.session import Scratch

DOCS = "doc_id long, text string, lang string, source string, kept boolean, _size long, id long"
ODD = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", None), (4, "one two", None, "a"), (4, "one two", None, "a"),
       (None, "a b c d e f g h i j k", "en", "a"), (6, "x" * 100_000, "en", "a"), (7, "w " * 30_000, "de", "b"),
       (8, "été naïve 日本語 \U0001F642 ok", "fr", "b"), (9, "one two", "en", "a"), (10, "ONE two", "en", "a")]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, lang, s, True, 7, 1) for i, t, lang, s in rows], DOCS)


# ---------------------------------------------------------------- near-duplicates

def plain_groups(rows, threshold=75):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def edited(rng, words, share):
    return [f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_near_duplicates_match_all_pairs(spark):
    """Families with links near the threshold, chains, exact copies, a shared passage."""
    rng = random.Random(4)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for family in range(6):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(25):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))))
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):                       # each text overlaps the next one alone
        rows.append(" ".join(chain[step * 6:] + [f"d{step * 6 - k}" for k in range(step * 6)]))
    rows += [" ".join([f"q{rng.randrange(10**6)}" for _ in range(60)] + passage) for _ in range(30)]
    rows += [rows[3]] * 5 + ["a b", "A B", "a  b\n", "a b c", "", "  "]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == plain_groups(list(enumerate(rows)))


def test_near_duplicates_odd_rows(spark):
    got = neardup.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (1, 2, 3))
    assert by[9].component_id == by[10].component_id == 4 and by[None].kept and by[None].component_id is None
    left = neardup.drop_near_duplicates(odd(spark))
    assert left.columns == odd(spark).columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 4, 6, 7, 8]
    assert neardup.near_duplicates(odd(spark).limit(0)).count() == 0


def test_components_of_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501), (501, 502), (500, 502)], "a long, b long")
    comp = neardup.components(Scratch(spark, "test"), edges).collect()
    assert len(comp) == n + 3 and {r.comp for r in comp} == {0, 500}


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(2)
    for size, share in ((60, 0.75), (300, 0.75), (300, 0.3), (8, 0.75)):
        errors = []
        for _ in range(60):
            both = round(2 * size * share / (1 + share))
            pool = rng.integers(0, 2**64, 2 * size - both, dtype=np.uint64)
            a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[:both], pool[size:]]))
            true = both / len(pool)
            errors.append((neardup.registers(a) == neardup.registers(b)).mean() - true)
        assert abs(np.mean(errors)) < 0.03


def test_digest_keeps_short_pairs(spark):
    """Sets of 4 and 3 shingles, 3 of them shared, are links at 0.75; the digest test must let all of them through."""
    rng = np.random.default_rng(6)
    rows, apart = [], []
    for _ in range(3000):
        pool = rng.integers(0, 2**64, 4, dtype=np.uint64)
        a, b = (neardup.digest(neardup.registers(np.sort(x))) for x in (pool, pool[:3]))
        rows.append((4, 3, a, b))
        apart.append(((a ^ b) & (2**64 - 1)).bit_count())
    pairs = spark.createDataFrame(rows, "n_a long, n_b long, dig_a long, dig_b long")
    assert pairs.where(neardup._estimate_ok(75)).count() == len(rows)
    assert max(apart) <= 24                      # the estimate alone keeps them too
    one = neardup.digest(neardup.registers(rng.integers(0, 2**64, 1, dtype=np.uint64)))
    assert 16 <= (one & (2**64 - 1)).bit_count() <= 48   # equal registers at other places give other bits


def test_classes_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rng = random.Random(11)
    texts = ["copy of one text " * 3] * 30 + [f"own text number {i} of many others here" for i in range(20)] + ["twice said by two of us"] * 2 + [None, ""]
    rows = list(enumerate(texts)) + [(None, texts[0]), (5, texts[5])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    smallest = {}
    for i, t in rows:
        if i is not None:
            smallest[t] = min(i, smallest.get(t, i))
    found = {}
    for share in (2, 1000):                      # only the large class, then all of them go by broadcast
        monkeypatch.setattr(neardup, "HOT", share)
        result = neardup.near_duplicates(df).collect()
        found[share] = sorted(map(repr, result))
        got = {r.doc_id: r.component_id for r in result}
        assert all(got[i] == (smallest[t] if t else i) for i, t in rows if i is not None and not (t or "").startswith("own"))
    assert found[2] == found[1000]


def test_block_overlaps():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint32) for _ in range(30)]
    got = neardup.overlaps(sets, columns=16)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)


def test_block_links_allow_for_collisions():
    """A pair exactly at the threshold whose shortened hashes collide inside both sets must leave the task."""
    rng = np.random.default_rng(8)
    short = np.sort(rng.choice(2**31, 100, replace=False).astype(np.uint32))
    short[1] = short[0]                                  # two of the shared shingles have one short hash
    sets = [short, short[:75]]
    table = pa.table({"id": [1, 2], "comp": [1, 2], "part": [0, 0], "i": [0, 0], "j": [0, 0],
                      "set": pa.array([s.tobytes() for s in sets], pa.binary())})
    assert neardup._block_links(75)(table).to_pylist() == [{"a": 1, "b": 2}]


# ---------------------------------------------------------------- mixing

def plain_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full = set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / total for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * size[s]}
        if not over:
            return target
        full |= over


def test_mixing_targets_and_taken(spark):
    rng = random.Random(2)
    rows = []
    for s, n in {"a": 900, "b": 40, "c": 3, None: 60, "d": 1, "zz": 5, "é": 0}.items():
        rows += [(len(rows) + i, " ".join(["w"] * rng.choice([1, 5, 50, 700])), "en", s) for i in range(n)]
    rows += [(len(rows), None, "en", "only-null")]
    df = odd(spark, rows)
    got = mixing.taken(df).collect()
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    target, taken = plain_targets(size), defaultdict(int)
    source = {i: s for i, _, _, s in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    again = {r.doc_id: r.taken for r in mixing.taken(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    copies = defaultdict(int)
    for r in mixed.collect():
        copies[r.doc_id] += 1
    for r in got:
        assert abs(copies[r.doc_id] * r["size"] - r.taken) <= r["size"] / 2
    plan = mixing.taken(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_blocks_follow_the_size_of_a_source(spark, monkeypatch):
    """A source of far more than 4096 blocks: exact totals, and shards of like size."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1 << 16)
    n = 400_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 5 as int))").alias("text"),
                               F.when(F.col("id") % 50 == 0, "small").otherwise("large").alias("source"))
    tmp = Scratch(spark, "test")
    rows = tmp.table(mixing.sized(df, 17).drop("text"), "rows")
    assert mixing.targets(rows).where("source = 'large'").first()["bits"] == 13
    drawn = tmp.table(mixing.draw(rows, 17).select("source", "_size", "target", F.explode("draws").alias("d")), "drawn")
    for r in drawn.groupBy("source").agg(F.sum("d.words").alias("w"), F.max("target").alias("t")).collect():
        assert abs(r.w - r.t) <= 1
    shards = [r.w for r in drawn.groupBy("d.shard").agg(F.sum("d.words").alias("w")).collect()]
    assert len(shards) == 32 and max(shards) < 1.2 * sum(shards) / len(shards)


def test_mixing_odd_rows(spark):
    got = mixing.taken(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.taken for r in got if r["size"] == 0} == {0}
    assert mixing.taken(odd(spark).limit(0)).count() == 0 and mixing.mix(odd(spark).limit(0)).count() == 0
    assert [r.taken for r in mixing.taken(odd(spark, [(1, None, None, None)])).collect()] == [0]


def test_hypergeometric_draws(spark):
    for good, total, drawn in ((30, 100, 40), (3, 5000, 2500), (1, 2, 1), (0, 10, 5), (10, 10, 5)):
        u = mixing.uniform(F.lit(good), F.col("id"))
        x = np.array([r.x for r in spark.range(4000).select(mixing.hypergeometric(
            *(F.lit(v).cast("long") for v in (good, total, drawn)), u).alias("x")).collect()])
        share = good / total
        var = drawn * share * (1 - share) * (total - drawn) / max(total - 1, 1)
        assert x.min() >= max(0, drawn + good - total) and x.max() <= min(good, drawn)
        assert x.mean() == pytest.approx(drawn * share, abs=5 * (var / 4000) ** 0.5 + 1e-9)
        assert x.var() == pytest.approx(var, rel=0.15, abs=1e-9)


def test_tree_keeps_quotas(spark):
    root = spark.createDataFrame([([700, 3, 0, 41],)], "quotas array<bigint>")
    leaves = [r.quotas for r in mixing.tree(root, 4, 9).collect()]
    assert len(leaves) == 16 and np.sum(leaves, axis=0).tolist() == [700, 3, 0, 41]
    assert max(map(sum, leaves)) - min(map(sum, leaves)) <= 1 and min(map(min, leaves)) >= 0


# ---------------------------------------------------------------- encoding

PIECES = ["a", "B", "é", "é", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\x85", " ", " ", "\x1c", "'s", "'ll", "12", "३", "!!",
          "<|endoftext|>", "<|start", "oftext|>", "Σ", "İ", "日本", "\U0001F642", "ﬁ", "́", "'", "‍"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path())


def test_joins_are_exact(tokenizer):
    codec, rng = bpe.Codec.of(queries.tokenizer_path()), random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randint(0, 5))))
        parts = [text[a:b].encode() for a, b in zip([0, *cuts], [*cuts, len(text)]) if a < b]
        raw = np.array(want, np.uint32).tobytes()
        assert codec.encode([text.encode()])[0] == raw == bpe.join_pieces(codec, bpe._edges(codec, parts)), text
        assert codec.decode(raw) == tokenizer.decode(want, skip_special_tokens=False)


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    said = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


def test_encoding_with_shared_chunks(spark, tokenizer):
    rng = random.Random(8)
    shared = [" ".join(f"word{rng.randrange(3000)}" for _ in range(1200)) for _ in range(3)]
    glued = "".join(chr(97 + rng.randrange(26)) for _ in range(40_000))
    texts = [f"own{i} " * rng.randrange(300) + rng.choice(shared) + f" end{i}" * rng.randrange(300) for i in range(30)]
    texts += [glued, "x" + glued, glued + " y", shared[0], shared[0], *(t for _, t, _, _ in ODD)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ends = bpe.chunk_ends(next(_text.blocks(pa.array([shared[0]]), 1 << 30)))[0]
    assert len(ends) > 4
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode(df, queries.tokenizer_path())).collect())
    assert got == sorted((i, *expected(tokenizer, t)) for i, t in rows)


def test_encoding_empty_table(spark):
    assert bpe.encode(odd(spark).limit(0), queries.tokenizer_path()).count() == 0


def test_chunks_are_content_defined():
    rng = random.Random(1)
    body = " ".join(f"w{rng.randrange(10**5)}" for _ in range(4000))
    a, b = (bpe.chunk_ends(next(_text.blocks(pa.array([t]), 1 << 30)))[0] for t in (body, "some other start " + body))
    assert len(set((b - len("some other start ")).tolist()) & set(a.tolist())) >= 0.9 * len(a)


# ---------------------------------------------------------------- training order

def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 10, 255, 256, 257, 4097):
        slots = training_order.permute(np.arange(n), n, 7)
        assert sorted(slots.tolist()) == list(range(n))
    assert (training_order.permute(np.arange(1000), 1000, 1) != training_order.permute(np.arange(1000), 1000, 2)).mean() > 0.9


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_shards_round_trip(spark, vocabulary, tmp_path):
    rows = [*ODD, *((100 + i, f"text {i} " * (40 * (i % 7))) for i in range(40))]
    df = spark.createDataFrame([(r[0], r[1], 1, "x") for r in rows], "doc_id long, text string, shard int, place string").coalesce(2)
    df.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    layout = training_order.materialise(docs, vocabulary, f"{tmp_path}/shards", key=3, length=16, shard=32)
    got = training_order.read(spark, f"{tmp_path}/shards", layout).collect()
    encoder = training_order.Encoder.of(*vocabulary)
    want = []
    for r in rows:
        ids = encoder.encode(r[1] or "").tolist()
        want += [(r[0], k // 16, np.array(ids[k:k + 16], "<u4").tobytes()) for k in range(0, len(ids), 16)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(((r.doc_id, r.seq_no, bytes(r.ids)) for r in got), key=key) == sorted(want, key=key)
    assert sorted(r.slot for r in got) == list(range(len(want)))
    # the training order is the order of the permuted numbers
    number, at, keys = defaultdict(int), {}, {}
    text = {r[0]: r[1] for r in rows}
    order = docs.select("_metadata.file_path", "_metadata.row_index", "doc_id").orderBy("file_path", "row_index").collect()
    for path in dict.fromkeys(r.file_path for r in order):
        at[path] = sum(number.values())
        here = at[path]
        for r in (r for r in order if r.file_path == path):
            t = text[r.doc_id] or ""
            n = -(-len(encoder.encode(t)) // 16)
            for k in range(n):
                keys.setdefault((r.doc_id, k), []).append(int(training_order.permute(np.array([here + k]), layout.numbers, 3)[0]))
            here += n
            number[path] += -(-len(t.encode()) // 16)
    seen = [(r.doc_id, r.seq_no) for r in sorted(got, key=lambda r: r.slot)]
    assert seen == [k for _, k in sorted((v, k) for k, vs in keys.items() for v in vs)]
    late = training_order.read(spark, f"{tmp_path}/shards", layout, begin=40).collect()
    assert sorted(r.slot for r in late) == list(range(40, len(want)))


def test_shards_of_empty_table(spark, vocabulary, tmp_path):
    odd(spark).limit(0).write.parquet(f"{tmp_path}/docs")
    layout = training_order.materialise(spark.read.parquet(f"{tmp_path}/docs"), vocabulary, f"{tmp_path}/shards")
    assert layout.numbers == 0 and training_order.read(spark, f"{tmp_path}/shards", layout).count() == 0


# ---------------------------------------------------------------- search

def plain_search(rows, every, k):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in good if i % every == 0}):
        q = min(v for v in (dict(enumerate(w for j, w in good if j == i)).values()))
        found = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q)))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e5, 8e5])
def test_top_k(spark, scale):
    rng = np.random.default_rng(int(scale) % 97)
    centre = rng.normal(size=(5, 37))
    rows = [(int(i), (scale * (centre[i % 5] + 0.3 * rng.normal(size=37))).tolist()) for i in range(300)]
    rows += [(i + 1000, rows[7][1]) for i in range(12)]                       # ties
    rows += [(400, None), (450, [float("nan")] * 37), (500, [1.0, None]), (550, [1.0, 2.0]), (551, [2.0, 1.0]), (600, []), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, rank int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect())
    assert got == sorted(plain_search(rows, 50, 5))


def test_top_k_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(plain_search(rows, 50, 5))
    assert topk.top_k(df.limit(0)).count() == 0


# ---------------------------------------------------------------- chat

EVENTS = "conv_id long, seq long, kind string, message string, role string, text string, extra int"


def test_chat_fold(spark):
    log = [(1, 0, "message", "u1", "user", "hi", 0), (1, 1, "message", "a1", "assistant", "Hel", 0), (1, 2, "delta", "a1", None, "lo", 0),
           (1, 3, "edit", "u1", None, "hey", 0), (1, 4, "regenerate", "a1", None, None, 0), (1, 5, "message", "a2", "assistant", "Good", 0),
           (1, 6, "delta", "a2", None, " day", 0), (1, 7, "delta", "a1", None, "late", 0), (1, 8, "unknown", "a2", None, "x", 0),
           (2, 0, "delta", "none", None, "x", 0), (3, 1, "message", None, None, None, 0), (3, 1, "message", None, None, None, 0),
           (None, 0, "message", "m", "user", "null id", 0)]
    random.Random(2).shuffle(log)
    df = spark.createDataFrame(log, EVENTS)
    got = defaultdict(list)
    for r in sorted(chat.reconstruct(df).collect(), key=lambda r: r.turn_no):
        got[r.conv_id] += chat.parse(r.formatted)
        assert r.formatted[r.loss_from:r.loss_to] == (chat.escape("Good day") if "assistant" in r.formatted[:30] else "")
    assert got == {1: [("user", "hey"), ("assistant", "Good day")], 3: [("", ""), ("", "")], None: [("user", "null id")]}
    assert chat.digests(chat.reconstruct(df.limit(0))).count() == 0


def test_chat_edit_far_back(spark):
    log = [(1, 0, "message", "first", "user", "old", 0)] + [(1, i, "message", f"m{i}", "user", str(i), 0) for i in range(1, 500)]
    df = spark.createDataFrame([*log, (1, 900, "edit", "first", None, "new", 0)], EVENTS)
    first = [r for r in chat.reconstruct(df).collect() if r.turn_no == 0]
    assert chat.parse(first[0].formatted) == [("user", "new")]


def test_chat_split_conversations(spark, monkeypatch):
    """Split conversations give the same turns and digests as whole ones, whatever ties, repeats and null ids they hold."""
    rng = random.Random(6)
    log = []
    for c, n in ((1, 900), (2, 40), (None, 300), (3, 5)):
        for i in range(n):
            seq, m = rng.randrange(n // 3 + 1), f"m{rng.randrange(n // 2 + 1)}"
            kind = rng.choice(["message", "message", "delta", "delta", "edit", "regenerate", "other", None])
            log.append((c, seq, kind, m, rng.choice(["user", "assistant", None]), rng.choice(["same " * 30 + str(i % 3), "a", "", None, "</s>\\"]), 0))
        log += log[-7:]
    df = spark.createDataFrame(log, EVENTS).repartition(5)

    def both():
        turns = sorted(map(repr, chat.reconstruct(df).collect()))
        told = sorted(map(repr, chat.reconstructed_digests(df).collect()))
        assert told == sorted(map(repr, chat.digests(chat.reconstruct(df)).collect()))
        return turns, told

    whole = both()
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")                     # tables are small here: keep the range partitions apart
    try:
        for bound in (0, 100):
            monkeypatch.setattr(chat, "HOT", bound)
            assert both() == whole
        assert chat.reconstructed_digests(df.limit(0)).count() == 0
        parts = chat._split(df.where("conv_id = 1").na.fill(""), chat.Scratch(spark, "test"))
        turns = {f.rsplit("/", 1)[0] for f in parts.inputFiles() if "-turns" in f}
        sizes = [r["count"] for r in spark.read.parquet(*turns).groupBy("part").count().collect()]
        assert len(sizes) > 2 and max(sizes) < sum(sizes) / 2
    finally:
        spark.conf.set(coalesce, "true")


def test_chat_streamed_log(spark, tmp_path):
    rows = [(1, 0, "user", "é" * 600), (1, 1, "assistant", "x\n" * 500), (1, 1, "assistant", "x\n" * 500), (1, None, "assistant", None),
            (1, 2, None, None), (None, 0, "assistant", "\U0001f600" * 513)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/c")
    log = chat.streamed(spark.read.parquet(f"{tmp_path}/c"))
    assert log.where("kind = 'delta'").count() == 2 * 4 + 0 + 3
    got = defaultdict(list)
    for r in sorted(chat.reconstruct(log).collect(), key=lambda r: r.turn_no):
        got[r.conv_id] += chat.parse(r.formatted)
    assert got == {1: [("assistant", ""), rows[0][2:], rows[1][2:], rows[1][2:], ("", "")], None: [rows[5][2:]]}


def test_chat_escape_round_trip():
    rng = random.Random(1)
    parts = ["<", "|", "im_start", "|>", "\\", ".", "<s>", "</s>", "[", "/", "INST", "]", "<|im_end|>", "\n", "n", "SYS", "<<", ">>", "é"]
    word = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    for _ in range(4000):
        turns = [(word(6), word(12)) for _ in range(3)]
        assert chat.parse("".join(chat.render(*t)[0] for t in turns)) == turns
        assert not any(c in chat.escape(t[1]) for t in turns for c in chat.CONTROL)


def test_chat_query_digests(spark):
    got = {r.conv_id: r for r in queries.op9_event_sourced_chat(spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(said)
    assert got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
