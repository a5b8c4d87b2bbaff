"""Registered queries of the llm operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintrank.llm import bpe, chat, knn_quality, langid, merkle, mixing, neardup, pii, prefix_trie, rules, simhash, topk, training_order
from taintrank.session import Scratch

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbour_vote_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"))


def op3_feistel_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the shards, then read every sequence back from them."""
    path = f"{Scratch(spark, 'training-order').root}/shards"
    import public_tokenizers
    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    layout = training_order.materialise(_table(spark, sf_dir, "documents"), vocabulary, path)
    rows = training_order.read(spark, path, layout)
    return rows.select("slot", "doc_id", "seq_no", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.train(docs)))


def op5_ngram_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_splitting_tree_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public word tokenizer installed beside Python."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op7_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_branch_and_bound_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op9_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.reconstructed_digests(chat.streamed(rows))


def op10_hyperminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_sha_midstate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle.build(_table(spark, sf_dir, "documents"), replace={"text": merkle.tampered_text()})
    return merkle.fold(manifest)


def op12_bktree_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_splitter_skeleton_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbour_vote_quality": op1_neighbour_vote_quality,
    "op2_mcd_quality_rules": op2_mcd_quality_rules,
    "op3_feistel_training_order": op3_feistel_training_order,
    "op4_boosted_pii": op4_boosted_pii,
    "op5_ngram_bayes_langid": op5_ngram_bayes_langid,
    "op6_splitting_tree_mixing": op6_splitting_tree_mixing,
    "op7_chunk_reuse_bpe": op7_chunk_reuse_bpe,
    "op8_branch_and_bound_topk": op8_branch_and_bound_topk,
    "op9_event_sourced_chat": op9_event_sourced_chat,
    "op10_hyperminhash_neardup": op10_hyperminhash_neardup,
    "op11_sha_midstate_manifest": op11_sha_midstate_manifest,
    "op12_bktree_simhash": op12_bktree_simhash,
    "op13_splitter_skeleton_trie": op13_splitter_skeleton_trie,
}


def _crc32(s: str) -> str:
    """DuckDB: the unsigned CRC-32 of a string, a bit at a time."""
    eight = f"flatten(list_transform(range(1, length({s}) + 1), lambda i: [CAST(ascii(substr({s}, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_concat([4294967295], {eight}), lambda c, b: {step}), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

ORACLE: dict[str, str] = {
    "op8_branch_and_bound_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op9_event_sourced_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|endoftext\|>|<\|startoftext\|>|\\') AS found FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + 2 * len(found) - len(list_filter(found, lambda x: length(x) = 1))) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
""",
    "op10_hyperminhash_neardup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
""",
    "op11_sha_midstate_manifest": f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
l AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k, sha256({_LEAF} || {_field("text")}) AS leaf,
         sha256({_LEAF} || {_field("other")}) AS new FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, new) - 1 AS pos, row_number() OVER () AS rid FROM l),
up(k, lvl, idx, digest, n) AS (
  SELECT k, 0, pos, leaf, count(*) OVER (PARTITION BY k) FROM p
  UNION ALL SELECT k, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY k, lvl, idx // 3, n),
sub AS (SELECT k, digest, row_number() OVER (ORDER BY k) - 1 AS pos FROM up WHERE n = 1),
high(lvl, idx, digest, n) AS (
  SELECT 0, pos, digest, count(*) OVER () FROM sub
  UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, idx // 3, n),
run AS (SELECT k, lvl, idx // 3 AS parent, list(digest ORDER BY idx) AS ds FROM up WHERE n > 1 GROUP BY 1, 2, 3),
toprun AS (SELECT lvl, idx // 3 AS parent, list(digest ORDER BY idx) AS ds FROM high WHERE n > 1 GROUP BY 1, 2),
f(rid, k, lvl, idx, digest, proof) AS (
  SELECT rid, k, 0, pos, new, '' FROM p
  UNION ALL SELECT rid, f.k, f.lvl + 1, idx // 3,
    sha256(array_to_string(ds[1:idx % 3], '') || digest || array_to_string(ds[idx % 3 + 2:], '')),
    proof || array_to_string(ds[1:idx % 3], '') || array_to_string(ds[idx % 3 + 2:], '')
  FROM f JOIN run ON run.k = f.k AND run.lvl = f.lvl AND run.parent = idx // 3),
low AS (SELECT rid, max(lvl) AS lvl, arg_max(digest, lvl) AS digest, arg_max(proof, lvl) AS proof, any_value(k) AS k FROM f GROUP BY rid),
g(rid, lvl, idx, digest, proof) AS (
  SELECT rid, 0, sub.pos, low.digest, proof FROM low JOIN sub ON sub.k = low.k
  UNION ALL SELECT rid, g.lvl + 1, idx // 3,
    sha256(array_to_string(ds[1:idx % 3], '') || digest || array_to_string(ds[idx % 3 + 2:], '')),
    proof || array_to_string(ds[1:idx % 3], '') || array_to_string(ds[idx % 3 + 2:], '')
  FROM g JOIN toprun ON toprun.lvl = g.lvl AND toprun.parent = idx // 3),
whole AS (SELECT rid, arg_max(digest, lvl) AS folded, arg_max(proof, lvl) AS proof FROM g GROUP BY rid)
SELECT p.doc_id, p.leaf, sub.digest AS subroot, high.digest AS root, sha256(whole.proof) AS proof_sha256,
       whole.folded AS folded_root, whole.folded = high.digest AS verified
FROM p JOIN sub ON sub.k = p.k JOIN whole ON whole.rid = p.rid JOIN high ON high.n = 1
""",
    "op13_splitter_skeleton_trie": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) - 1 AS pos FROM t),
c AS (SELECT DISTINCT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t),
r AS (
  SELECT c.conv_id, 0 AS part, pos, key, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, key, words FROM c JOIN o ON o.conv_id = c.conv_id AND pos >= h),
m AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM m GROUP BY path, depth),
kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path),
below AS (
  SELECT a.path, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens, count(*) FILTER (kids.path IS NULL) AS n_leaves
  FROM node a JOIN node b ON starts_with(b.path, a.path) LEFT JOIN kids ON kids.path = b.path GROUP BY a.path)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM node LEFT JOIN node up ON node.depth > 0 AND up.path = left(node.path, length(node.path) - 32)
LEFT JOIN kids ON kids.path = node.path LEFT JOIN ends ON ends.path = node.path JOIN below ON below.path = node.path
""",
}
