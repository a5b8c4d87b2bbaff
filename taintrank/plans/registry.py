"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per

Float outputs are rounded to 6 digits so the DuckDB twins in
``oracle_sql.py`` can be compared value by value.
"""

from __future__ import annotations

import os as _os
import uuid as _uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import vectors as V
from ..operators import (compare, distributions, joins, long_groups, losses, metrics, rank, reshape, retrieval,
                         sampling, schema, scoring, setops, stages, vector_store)
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources import bucketed, jsonio, trec
from ..sources import profile as profile_io
from ..sources import triples as triple_io
from . import contaminate, distill, report, rerank

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def round_doubles(df: DataFrame) -> DataFrame:
    """Round every float column to 6 digits (``+ 0.0`` turns -0.0 into 0.0)."""
    return df.select(*[(r6(f.name) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() in ("double", "float")
                       else F.col(f.name) for f in df.schema.fields])


# ---------------------------------------------------------------- E1 slice

def dense_run(spark: SparkSession, sf_dir: str, dims: int | None = None, k: int = 100) -> DataFrame:
    q, d = fx.vectors(spark, sf_dir, dims)
    return retrieval.dense_retrieve(q, d, k=k)


@register("k7_dense_topk")
def k7_dense_topk(spark, sf_dir):
    return round_doubles(dense_run(spark, sf_dir))


@register("m7_dense_metrics")
def m7_dense_metrics(spark, sf_dir):
    run = dense_run(spark, sf_dir).withColumn("name", F.lit("dense"))
    return round_doubles(metrics.evaluate(run, fx.vector_qrels(spark, sf_dir)))


# ---------------------------------------------------------------- shared derived tables


def triples(spark, d):
    return fx.triples(spark, d)


def pairs(spark, d):
    return reshape.pivot_pairs(triples(spark, d)).select("qid", "docno").distinct()


def teacher_scores(spark, d):
    q, dv = fx.vectors(spark, d)
    return rerank.vector_scores(pairs(spark, d), q, dv)


def student_scores(spark, d):
    q, dv = fx.vectors(spark, d, 32)
    return rerank.vector_scores(pairs(spark, d), q, dv)


def both_scores(spark, d, of: DataFrame) -> DataFrame:
    """``qid, docno, s, t`` of the pairs in ``of``: both models in one pass over the vectors, written once."""
    q, dv = fx.vectors(spark, d)
    v = joins.attach_vectors(of.select("qid", "docno").distinct(), q, dv)
    cut = lambda c: F.slice(c, 1, 32)
    return cut_lineage(v.select("qid", "docno", V.dot(cut("query_vec"), cut("doc_vec")).alias("s"),
                                V.dot("query_vec", "doc_vec").alias("t")), "scores")


def student_and_teacher(spark, d) -> tuple[DataFrame, DataFrame]:
    """Score tables of the training pairs, both read from one written table."""
    both = both_scores(spark, d, reshape.pivot_pairs(triples(spark, d)))
    return both.select("qid", "docno", F.col("s").alias("score")), both.select("qid", "docno", F.col("t").alias("score"))


def loss_groups(spark, d):
    """One row per triple: pred = student [pos, neg], label = teacher [pos, neg] (J6 default 0)."""
    t = cut_lineage(triples(spark, d), "triples")
    both = both_scores(spark, d, reshape.pivot_pairs(t)).withColumnRenamed("qid", "query_id")
    g = t
    for side in ("a", "b"):
        scores = both.select("query_id", F.col("docno").alias(f"doc_id_{side}"), F.col("s").alias(f"p_{side}"), F.col("t").alias(f"l_{side}"))
        g = g.join(scores, ["query_id", f"doc_id_{side}"], "left")
    g = g.fillna(0.0, ["p_a", "p_b", "l_a", "l_b"])
    return g.select("query_id", "doc_id_a", "doc_id_b", "origin",
                    F.array("p_a", "p_b").alias("pred"), F.array("l_a", "l_b").alias("label"))


def bm25_run(spark, d):
    return retrieval.bm25(fx.queries(spark, d), fx.docs(spark, d))


# ---------------------------------------------------------------- P: projections
@register("p4_binary_relevance")
def p4_binary_relevance(spark, d):
    return schema.binarize_relevance(fx.qrels(spark, d))


@register("p5_label_split")
def p5_label_split(spark, d):
    pos, neg = schema.split_labels(schema.binarize_relevance(fx.qrels(spark, d)))
    a = pos.groupBy("qid").agg(F.count(F.lit(1)).alias("n_pos"))
    b = neg.groupBy("qid").agg(F.count(F.lit(1)).alias("n_neg"))
    return a.join(b, "qid", "full").fillna(0, ["n_pos", "n_neg"])


@register("p6_clean_query")
def p6_clean_query(spark, d):
    return fx.user_texts(spark, d).select("qid", TX.clean_query("query").alias("query"))


@register("p11_pair_text")
def p11_pair_text(spark, d):
    """Cross-encoder inputs of the qrels pairs: the document cut to what the query leaves of 230 tokens."""
    j = contaminate.judged_with_texts(fx.qrels(spark, d), fx.queries(spark, d), fx.docs(spark, d))
    return j.select("qid", "docno", F.md5(TX.pair_text("text_query", "text_doc")).alias("text_md5"),
                    F.size(TX.whitespace_tokens("text_doc")).alias("doc_tokens"))


# ---------------------------------------------------------------- J: joins
@register("j2_judged_texts")
def j2_judged_texts(spark, d):
    j = contaminate.judged_with_texts(fx.qrels(spark, d), fx.queries(spark, d), fx.docs(spark, d))
    return j.select("qid", "docno", "relevance", F.md5("text_query").alias("query_md5"),
                    F.md5("text_doc").alias("doc_md5"))


@register("j3_attach_text_lenient")
def j3_attach_text_lenient(spark, d):
    """J3 + J5: page html by the named field; ids without a page get null."""
    p = reshape.pivot_pairs(triples(spark, d))
    pages = fx.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("docno"), "html")
    p = joins.attach_text(p, pages, text_field="html")
    return p.select("qid", "docno", "pos", F.md5("html").alias("text_md5")).distinct()


@register("j4_attach_text_strict")
def j4_attach_text_strict(spark, d):
    q = joins.attach_query(fx.qrels(spark, d), fx.queries(spark, d))
    q = joins.attach_text_strict(q, fx.docs(spark, d))
    return q.select("qid", "docno", F.length("query").alias("query_len"), F.md5("text").alias("text_md5"))


@register("j6_teacher_default")
def j6_teacher_default(spark, d):
    p = reshape.pivot_pairs(triples(spark, d))
    return round_doubles(joins.attach_scores(p, teacher_scores(spark, d)).distinct())


@register("j7_match_scores")
def j7_match_scores(spark, d):
    return round_doubles(joins.match_scores(*student_and_teacher(spark, d)))


@register("j9_used_docs")
def j9_used_docs(spark, d):
    return joins.used_only(fx.docs(spark, d), pairs(spark, d), "docno").select(
        "docno", F.md5("text").alias("text_md5"))


@register("j11_leaked_triples")
def j11_leaked_triples(spark, d):
    return triples(spark, d)


@register("j12_queries_without_negatives")
def j12_queries_without_negatives(spark, d):
    return contaminate.queries_without_negatives(fx.qrels(spark, d))


# ---------------------------------------------------------------- U: set operations
@register("u1_contaminated_union")
def u1_contaminated_union(spark, d):
    t = triples(spark, d)
    u = contaminate.contaminate(t.where(F.col("origin") == "clean"), t.where(F.col("origin") == "leaked"))
    return u.groupBy("origin").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.count_distinct("query_id").alias("n_queries"))


@register("g1_triple_stats")
def g1_triple_stats(spark, d):
    return contaminate.triple_stats(triples(spark, d))


@register("u2_append_samples")
def u2_append_samples(spark, d):
    return round_doubles(labelled_scores(spark, d))


@register("u3_merge_lookups")
def u3_merge_lookups(spark, d):
    m = setops.merge_lookups(fx.lookup_sources(spark, d))
    return m.select("id", F.md5("text").alias("text_md5"))


@register("u4_distinct_ids")
def u4_distinct_ids(spark, d):
    return setops.distinct_ids(reshape.pivot_pairs(triples(spark, d)), "docno")


# ---------------------------------------------------------------- R: reshape
@register("r1_pivot_pairs")
def r1_pivot_pairs(spark, d):
    t = triples(spark, d)
    return reshape.pivot_pairs(t).groupBy("qid", "docno", "pos").agg(F.count(F.lit(1)).alias("n"))


@register("r2_pivot_with_negatives")
def r2_pivot_with_negatives(spark, d):
    mt = fx.multi_negative_triples(spark, d)
    negs = mt.select(F.col("query_id").alias("qid"), F.col("doc_id_b").alias("docnos")).distinct()
    return reshape.pivot_with_negatives(mt.select("query_id", "doc_id_a"), negs).groupBy(
        "qid", "idx", "docno", "pos").agg(F.count(F.lit(1)).alias("n"))


@register("r2_pivot_long")
def r2_pivot_long(spark, d):
    """R2 from one row per negative."""
    pos, neg = fx.positives_and_negatives(spark, d)
    have = neg.select("query_id").distinct()
    return long_groups.pivot_with_negatives(pos.join(have, "query_id", "left_semi"), cut_lineage(long_groups.numbered_negatives(neg), "numbered")).groupBy(
        "qid", "idx", "docno", "pos").agg(F.count(F.lit(1)).alias("n"))


def long_rows(spark, d, **kw):
    return long_groups.groups(*fx.positives_and_negatives(spark, d), group_size=3, short="keep", **kw)


@register("r5_groups_long")
def r5_groups_long(spark, d):
    """R5 without arrays: the rows of each group with query, text and teacher score; every positive has a group."""
    a = long_groups.assemble(long_rows(spark, d), fx.queries(spark, d), fx.docs(spark, d), teacher_scores(spark, d))
    return round_doubles(a.select("gid", "qid", "pos_idx", "docno", F.md5("query").alias("query_md5"), F.md5("text").alias("text_md5"), "label"))


@register("r6_listwise_long")
def r6_listwise_long(spark, d):
    return long_rows(spark, d, include_positive=False)


@register("r10_pairs_long")
def r10_pairs_long(spark, d):
    return long_groups.pos_pairs(cut_lineage(long_rows(spark, d), "groups"))


@register("r3_explode_score_map")
def r3_explode_score_map(spark, d):
    m = reshape.collect_score_map(teacher_scores(spark, d))
    js = m.select(F.to_json(F.create_map("qid", "scores")).alias("scores"))
    return round_doubles(reshape.explode_score_map(js))


@register("r4_collect_score_map")
def r4_collect_score_map(spark, d):
    m = reshape.collect_score_map(teacher_scores(spark, d))
    return round_doubles(m.groupBy("qid").agg(
        F.sum(F.size("scores")).alias("n_docs"),
        F.sum(V.array_sum(F.map_values("scores"))).alias("score_sum")))


@register("r5_assemble_groups")
def r5_assemble_groups(spark, d):
    g = reshape.group_rows(fx.multi_negative_triples(spark, d), group_size=3, short="keep")
    a = reshape.assemble_groups(g, fx.queries(spark, d), fx.docs(spark, d), teacher_scores(spark, d))
    return round_doubles(a.select("qid", F.array_join("docnos", ",").alias("docnos"),
                                  F.md5(F.array_join("texts", "|")).alias("texts_md5"),
                                  V.array_sum("labels").alias("label_sum")))


@register("r8_cross_layout")
def r8_cross_layout(spark, d):
    g = reshape.group_rows(triples(spark, d).drop("origin"), group_size=2)
    a = reshape.assemble_groups(g, fx.queries(spark, d), fx.docs(spark, d), teacher_scores(spark, d))
    c = reshape.cross_layout(a)
    return round_doubles(c.groupBy("qid", "pos_idx", "docno", "label").agg(F.count(F.lit(1)).alias("n")))


@register("r10_pos_pairs")
def r10_pos_pairs(spark, d):
    mt = fx.multi_negative_triples(spark, d)
    g = mt.select("query_id", F.explode(reshape.pos_pairs(
        F.concat(F.array("doc_id_a"), F.col("doc_id_b")))).alias("pr"))
    return g.select(F.col("query_id").alias("qid"), F.element_at("pr", 1).alias("doc_id_a"),
                    F.element_at("pr", 2).alias("doc_id_b"))


@register("r11_duo_text")
def r11_duo_text(spark, d):
    t = triples(spark, d).withColumnsRenamed({"query_id": "qid"})
    t = joins.attach_query(t, fx.queries(spark, d))
    docs = fx.docs(spark, d)
    t = joins.attach_text_strict(t.withColumn("docno", F.col("doc_id_a")), docs, as_col="ta").drop("docno")
    t = joins.attach_text_strict(t.withColumn("docno", F.col("doc_id_b")), docs, as_col="tb").drop("docno")
    return t.select("qid", "doc_id_a", "doc_id_b", F.md5(TX.duo_text("query", "ta", "tb")).alias("line_md5"))


# ---------------------------------------------------------------- A: sampling
@register("a1_sample_docs")
def a1_sample_docs(spark, d):
    return sampling.sample_n(fx.docs(spark, d).select("docno"), 100, ["docno"], seed=7)


@register("a4_one_negative")
def a4_one_negative(spark, d):
    _, neg = schema.split_labels(schema.binarize_relevance(fx.qrels(spark, d)))
    return contaminate.sampled_negatives(neg)


@register("a5_choose_one")
def a5_choose_one(spark, d):
    return sampling.sample_pairs(*fx.positives_and_negatives(spark, d), k=1).drop("idx")


@register("a6_sample_k")
def a6_sample_k(spark, d):
    chosen = sampling.sample_pairs(*fx.positives_and_negatives(spark, d), k=2)
    two = F.transform(F.sort_array(F.collect_list(F.struct("idx", "doc_id_b"))), lambda x: x["doc_id_b"])
    return chosen.groupBy("query_id", "doc_id_a").agg(F.array_join(two, ",").alias("doc_id_b"))


@register("a6_sample_ring")
def a6_sample_ring(spark, d):
    """A6 by one permutation a query and an offset a positive."""
    return sampling.sample_pairs_ring(*fx.positives_and_negatives(spark, d), k=3)


# ---------------------------------------------------------------- G: aggregates
@register("g2_score_summary")
def g2_score_summary(spark, d):
    return compare.score_summary(teacher_scores(spark, d))


def labelled_scores(spark, d):
    """Teacher and student scores of the training pairs with ``model_type``."""
    student, teacher = student_and_teacher(spark, d)
    return setops.append_samples(schema.with_label(teacher, "teacher"), schema.with_label(student, "student"))


@register("g3_moments")
def g3_moments(spark, d):
    return round_doubles(compare.moments(labelled_scores(spark, d)))


@register("g4_t_test")
def g4_t_test(spark, d):
    return round_doubles(compare.t_test_table(labelled_scores(spark, d), "teacher", "student", p_value=True))


@register("g5_kl_divergence")
def g5_kl_divergence(spark, d):
    return round_doubles(compare.kl_divergence(*student_and_teacher(spark, d)))


@register("g5_kl_per_query")
def g5_kl_per_query(spark, d):
    return round_doubles(compare.kl_per_query(*student_and_teacher(spark, d)))


@register("g6_skipped_queries")
def g6_skipped_queries(spark, d):
    return round_doubles(compare.skipped_queries(*student_and_teacher(spark, d)))


# ---------------------------------------------------------------- W: windows
@register("w1_add_ranks")
def w1_add_ranks(spark, d):
    return round_doubles(rank.add_ranks(fx.event_run(spark, d), skew_safe=True))


@register("w3_top_k")
def w3_top_k(spark, d):
    return round_doubles(rank.top_k(fx.event_run(spark, d), 10))


@register("w4_ecdf")
def w4_ecdf(spark, d):
    return round_doubles(distributions.ecdf(fx.score_sample(spark, d)))


@register("w5_ideal_positions")
def w5_ideal_positions(spark, d):
    return rank.ideal_positions(fx.qrels(spark, d))


@register("w6_running_relevant")
def w6_running_relevant(spark, d):
    run = fx.event_run(spark, d).join(fx.event_qrels(spark, d), ["qid", "docno"], "left")
    rel = F.coalesce(F.col("relevance") >= 1, F.lit(False))
    run = run.withColumn("_rel", rel.cast("long"))
    cum = rank.ordered_positions(cut_lineage(run, "judged"), ["qid"], "score", descending=True, tie_order=[F.col("docno").desc()],
                                 sums=[(None, "pos"), ("_rel", "cum_rel")])
    return cum.select("qid", "docno", "pos", "cum_rel")


# ---------------------------------------------------------------- K: retrieval and scoring
@register("k1_bm25_top100")
def k1_bm25_top100(spark, d):
    return round_doubles(bm25_run(spark, d))


@register("k1_given_pairs")
def k1_given_pairs(spark, d):
    """BM25 of the training pairs, without a top-k."""
    return round_doubles(k1_scores(spark, d))


@register("k1_maxscore_top100")
def k1_maxscore_top100(spark, d):
    """K1 with upper bounds: the same rows from fewer contributions."""
    return round_doubles(retrieval.bm25_maxscore(fx.queries(spark, d), fx.docs(spark, d)))


@register("m7_bm25_metrics")
def m7_bm25_metrics(spark, d):
    run = bm25_run(spark, d).withColumn("name", F.lit("bm25"))
    return round_doubles(metrics.evaluate(run, fx.qrels(spark, d)))


@register("k2_cross_rerank")
def k2_cross_rerank(spark, d):
    r = rerank.rerank(bm25_run(spark, d), fx.queries(spark, d), fx.docs(spark, d),
                      factory=scoring.TokenOverlapScorer)
    return round_doubles(r)


@register("k3_duo_logits")
def k3_duo_logits(spark, d):
    run = bm25_run(spark, d).select("qid", "docno", F.col("rank").alias("first_rank"))
    s = scoring.score_by_document(run, fx.queries(spark, d), fx.docs(spark, d), scoring.OverlapLogitsScorer, logits=True, out="logits")
    s = s.withColumn("score", schema.score_column("logits", "cross"))
    r = rank.add_ranks(s)
    return round_doubles(r.select("qid", "docno", F.element_at("logits", 1).alias("logit0"),
                                  F.element_at("logits", 2).alias("logit1"), "rank"))


BOW_DIM = 256


def _bow_factory():
    return scoring.HashedBowEncoder(BOW_DIM)


@register("k7_bi_rerank")
def k7_bi_rerank(spark, d):
    r = rerank.rerank(bm25_run(spark, d), fx.queries(spark, d), fx.docs(spark, d),
                      bi_factory=_bow_factory)
    return round_doubles(r)


@register("k7_pair_dot")
def k7_pair_dot(spark, d):
    return round_doubles(teacher_scores(spark, d))


@register("k11_cross_scores")
def k11_cross_scores(spark, d):
    return round_doubles(rerank.generate_scores(triples(spark, d), fx.queries(spark, d),
                                                fx.docs(spark, d), scoring.TokenOverlapScorer))


@register("k12_bi_scores")
def k12_bi_scores(spark, d):
    return round_doubles(rerank.generate_bi_scores(triples(spark, d), fx.queries(spark, d),
                                                   fx.docs(spark, d), _bow_factory))


@register("k5_vector_store")
def k5_vector_store(spark, d):
    """K4, K5 and K12 over a store: all texts in two waves, then all again (nothing is encoded), then scores from the stored vectors."""
    q, docs, p = fx.queries(spark, d), fx.docs(spark, d), cut_lineage(pairs(spark, d), "pairs")
    store = vector_store.VectorStore(spark, _io_path(spark, "vectors"))
    texts = docs.select("text").unionByName(q.select(F.col("query").alias("text")))
    store.add(texts, _bow_factory, waves=2)
    again = store.add(texts, _bow_factory)
    qv = store.attach(joins.used_only(q.select("qid", "query"), p, "qid"), "query").select("qid", "vec")
    dv = store.attach(joins.used_only(docs.select("docno", "text"), p, "docno")).select("docno", "vec")
    return round_doubles(rerank.vector_scores(p, qv, dv).withColumn("encoded_again", F.lit(again)))


@register("j8_bucketed_scores")
def j8_bucketed_scores(spark, d):
    """J8 and J4 on bucketed tables: vectors and texts by docno in place, only the pairs are dealt to them."""
    q, dv = fx.vectors(spark, d)
    docs = fx.docs(spark, d).select("docno", "text")
    n = bucketed.bucket_count(joins.measured_bytes(dv) + joins.measured_bytes(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    tag = _uuid.uuid4().hex
    vec_table = bucketed.write_bucketed(dv, f"vectors_{tag}", "docno", _io_path(spark, "bucketed"), n)
    text_table = bucketed.write_bucketed(docs, f"texts_{tag}", "docno", _io_path(spark, "bucketed"), n)
    scored = rerank.vector_scores(pairs(spark, d), q, vec_table)
    return round_doubles(joins.attach_text_strict(scored, text_table).select("qid", "docno", "score", F.md5("text").alias("text_md5")))


POOL = [[((i + j) % 5 - 2) / 2.0 for i in range(BOW_DIM)] for j in range(4)]
POOL_BIAS = [0.5, -0.5, 0.25, 0.0]


@register("t6_saved_pipeline")
def t6_saved_pipeline(spark, d):
    """Cross scorer, bi-encoder and pooler saved with their configuration as one pipeline, loaded, and applied to the training pairs."""
    base = "taintrank.operators.scoring"
    model = PipelineModel([stages.CrossScorer(model=f"{base}:TokenOverlapScorer", outputCol="cross"),
                           *stages.bi_encoder(f"{base}:HashedBowEncoder", {"dim": BOW_DIM}, weights=POOL, bias=POOL_BIAS)])
    path = _io_path(spark, "pipeline")
    model.write().overwrite().save(path)
    p = joins.attach_query(pairs(spark, d), fx.queries(spark, d))
    rows = joins.attach_text_strict(p, fx.docs(spark, d)).select("qid", "docno", "query", "text")
    return round_doubles(PipelineModel.load(path).transform(rows).select("qid", "docno", "cross", "score"))


# ---------------------------------------------------------------- M: metrics
@register("m7_event_metrics")
def m7_event_metrics(spark, d):
    run = fx.event_run(spark, d).withColumn("name", F.lit("events"))
    return round_doubles(metrics.evaluate(run, fx.event_qrels(spark, d)))


@register("m7_teacher_student_runs")
def m7_teacher_student_runs(spark, d):
    t = dense_run(spark, d).withColumn("name", F.lit("teacher"))
    s = dense_run(spark, d, dims=32).withColumn("name", F.lit("student"))
    return round_doubles(metrics.evaluate(t.unionByName(s), fx.vector_qrels(spark, d)))


@register("g7_per_query_long")
def g7_per_query_long(spark, d):
    run = dense_run(spark, d).withColumn("name", F.lit("dense"))
    pq = metrics.per_query(run, fx.vector_qrels(spark, d))
    return round_doubles(metrics.to_long(pq))


# ---------------------------------------------------------------- L: losses (G=2 triples)
def _loss_query(name, **args):
    def q(spark, d):
        return round_doubles(losses.loss(loss_groups(spark, d), name, **args))
    return q


for _name in ("mse", "margin_mse", "hinge", "clear", "lce", "contrastive", "kl_div", "ranknet",
              "distill_ranknet", "listnet", "poly1"):
    _id = {"mse": "l1", "margin_mse": "l2", "hinge": "l3", "clear": "l4", "lce": "l5",
           "contrastive": "l6", "kl_div": "l7", "ranknet": "l8", "distill_ranknet": "l9",
           "listnet": "l10", "poly1": "l11"}[_name]
    register(f"{_id}_{_name}")(_loss_query(_name))


@register("l6_contrastive_t2")
def l6_contrastive_t2(spark, d):
    return round_doubles(losses.loss(loss_groups(spark, d), "contrastive", temperature=2.0))


@register("g8_reduction_sum")
def g8_reduction_sum(spark, d):
    return round_doubles(losses.loss(loss_groups(spark, d), "margin_mse", reduction="sum"))


@register("l12_cat_wrapper")
def l12_cat_wrapper(spark, d):
    g = loss_groups(spark, d).withColumn(
        "logits", F.transform("pred", lambda x: F.array(F.lit(0.0), x)))
    g = g.withColumn("cat_pred", losses.cat_pred("logits"))
    return round_doubles(losses.loss(g, "margin_mse", pred="cat_pred"))


@register("l13_dot_wrapper")
def l13_dot_wrapper(spark, d):
    q, dv = fx.vectors(spark, d, 32)
    t = triples(spark, d).select(F.col("query_id").alias("qid"), "doc_id_a", "doc_id_b")
    t = t.join(q.withColumnRenamed("vec", "query_vec"), "qid")
    t = t.join(dv.select(F.col("docno").alias("doc_id_a"), F.col("vec").alias("va")), "doc_id_a")
    t = t.join(dv.select(F.col("docno").alias("doc_id_b"), F.col("vec").alias("vb")), "doc_id_b")
    te = teacher_scores(spark, d)
    for side, col in (("a", "doc_id_a"), ("b", "doc_id_b")):
        t = joins.attach_scores(t.withColumn("docno", F.col(col)), te, as_col=f"l_{side}").drop("docno")
    g = t.select(losses.dot_pred("query_vec", F.array("va", "vb")).alias("pred"),
                 F.array("l_a", "l_b").alias("label"))
    return round_doubles(losses.loss(g, "kl_div"))


@register("l14_duo_wrapper")
def l14_duo_wrapper(spark, d):
    g = loss_groups(spark, d)
    lo = losses.loss(g, "contrastive", label=None)
    mean_score = g.select(F.avg(losses.duo_score("pred"))).scalar()
    return round_doubles(lo.withColumn("mean_score", mean_score))


@register("l15_weighted_loss")
def l15_weighted_loss(spark, d):
    return round_doubles(losses.weighted_loss(loss_groups(spark, d), [("margin_mse", 1.0), ("kl_div", 0.5)]))


@register("l16_loss_log")
def l16_loss_log(spark, d):
    return losses.loss_log(loss_groups(spark, d), "mse", by=["origin"])


ORDER_KEYS = ("query_id", "doc_id_a", "doc_id_b", "origin")


@register("l16_step_log")
def l16_step_log(spark, d):
    """The log of two epochs, batches of 8, two micro-batches a step, a line every 5 steps."""
    return losses.step_log(loss_groups(spark, d), "mse", ORDER_KEYS, 8, accumulation=2, log_every=5, epochs=2)


@register("v6_in_batch_scores")
def v6_in_batch_scores(spark, d):
    """V6: the queries of each training batch against all documents of the batch."""
    order = losses.training_order(triples(spark, d), ORDER_KEYS, 8)
    batches = order.select(F.col("micro").alias("batch"), F.col("query_id").alias("qid"), F.array("doc_id_a", "doc_id_b").alias("docnos"))
    return round_doubles(scoring.in_batch_scores(batches, *fx.vectors(spark, d)))


@register("l7_kl_div_listwise")
def l7_kl_div_listwise(spark, d):
    pos, neg = listwise_parts(spark, d)
    return round_doubles(losses.shared_negative_loss(pos, neg, "kl_div", key="query_id"))


@register("l10_listnet_listwise")
def l10_listnet_listwise(spark, d):
    pos, neg = listwise_parts(spark, d)
    return round_doubles(losses.shared_negative_loss(pos, neg, "listnet", key="query_id"))


def _judged_scores(spark, d):
    pos, neg = listwise_parts(spark, d)
    return pos.unionByName(neg)


@register("l8_ranknet_long")
def l8_ranknet_long(spark, d):
    """L8 over all judged documents of a query, in docno order, one row each."""
    return round_doubles(losses.pairwise_loss_long(_judged_scores(spark, d), "ranknet", ["query_id"], [F.col("docno").asc()]))


@register("l9_distill_ranknet_long")
def l9_distill_ranknet_long(spark, d):
    return round_doubles(losses.pairwise_loss_long(_judged_scores(spark, d), "distill_ranknet", ["query_id"], [F.col("docno").asc()]))


def listwise_parts(spark, d):
    """F7 groups as (positives, negatives) of each query with student ``s`` and
    teacher ``t`` scores (J6 default 0); queries without a negative dropped."""
    b = schema.binarize_relevance(fx.qrels(spark, d))
    judged = b.where(F.col("relevance").isin(0, 1)).select("qid", "docno", "relevance")
    judged = judged.join(both_scores(spark, d, judged), ["qid", "docno"], "left").fillna(0.0, ["s", "t"])
    judged = cut_lineage(judged.withColumnRenamed("qid", "query_id"), "judged_scores")
    neg = judged.where(F.col("relevance") == 0)
    pos = judged.where(F.col("relevance") == 1).join(neg.select("query_id").distinct(), "query_id", "left_semi")
    return pos, neg


@register("v_vector_functions")
def v_vector_functions(spark, d):
    g = loss_groups(spark, d)
    p = F.col("pred")
    return round_doubles(g.select(
        "query_id", "doc_id_a",
        F.element_at(V.minmax_normalize(p), 1).alias("v1_minmax0"),
        V.residual_pair(p).alias("v2_residual"),
        F.element_at(V.residual(p), 1).alias("v3_residual"),
        V.num_positive(p).alias("v7_positive"),
        F.element_at(V.softmax(p, 2.0), 1).alias("v8_softmax0"),
        V.class1_prob(p).alias("v9_class1"),
        V.first_class_prob(p).alias("v10_first"),
        V.sigmoid(F.element_at(p, 1)).alias("v11_sigmoid"),
        V.argmax(p).alias("v13_argmax")))


# ---------------------------------------------------------------- B: distribution tables
@register("b1_histogram")
def b1_histogram(spark, d):
    return round_doubles(distributions.histogram(fx.score_sample(spark, d)))


@register("b2_box_stats")
def b2_box_stats(spark, d):
    return round_doubles(distributions.box_stats(fx.score_sample(spark, d)))


@register("b3_kde")
def b3_kde(spark, d):
    return round_doubles(distributions.kde(fx.score_sample(spark, d)))


# ---------------------------------------------------------------- S: sources / sinks (round trips)


def _io_path(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a round trip."""
    return _os.path.join(ensure_checkpoint_dir(spark), "io", f"{name}-{_uuid.uuid4().hex}")


@register("s1_s2_triples_tsv_gzip")
def s1_s2_triples_tsv_gzip(spark, d):
    path = _io_path(spark, "triples")
    triple_io.write_triples(triples(spark, d).drop("origin"), path)
    return triple_io.read_triples(spark, path)


@register("s5_s6_lookup_json")
def s5_s6_lookup_json(spark, d):
    path = _io_path(spark, "lookup") + ".jsonl.gz"
    src = fx.docs(spark, d).select(F.col("docno").alias("id"), "text")
    jsonio.write_lookup(src, path, rows_per_object=200)
    return jsonio.read_lookup(spark, path).select("id", F.md5("text").alias("text_md5"))


@register("s9_s10_score_map_json")
def s9_s10_score_map_json(spark, d):
    path = _io_path(spark, "scores") + ".jsonl"
    jsonio.write_score_map(teacher_scores(spark, d), path)
    return round_doubles(jsonio.read_score_map(spark, path))


def _lookup_document(ext: str):
    def query(spark, d):
        path = _io_path(spark, "lookup") + ext
        jsonio.write_lookup(fx.docs(spark, d).select(F.col("docno").alias("id"), "text"), path)
        return jsonio.read_lookup(spark, path).select("id", F.md5("text").alias("text_md5"))
    query.__doc__ = f"S5, S6: the texts as one ``{ext}`` object, read back in file splits."
    return query


register("s5_s6_lookup_document")(_lookup_document(".json"))
register("s5_s6_lookup_document_gz")(_lookup_document(".json.gz"))


@register("s9_s10_score_map_document")
def s9_s10_score_map_document(spark, d):
    """Teacher scores as one nested ``.json`` object, read back in file splits."""
    path = _io_path(spark, "scores") + ".json"
    jsonio.write_score_map(teacher_scores(spark, d), path)
    return round_doubles(jsonio.read_score_map(spark, path))


@register("s7_s8_records_document")
def s7_s8_records_document(spark, d):
    """Student scores as one ``.json.gz`` array of records, read back."""
    path = _io_path(spark, "records") + ".json.gz"
    jsonio.write_score_records(student_scores(spark, d), path)
    return round_doubles(jsonio.read_score_records(spark, path))


@register("s11_score_records_json")
def s11_score_records_json(spark, d):
    path = _io_path(spark, "records") + ".jsonl"
    jsonio.write_score_records(student_scores(spark, d), path)
    return round_doubles(jsonio.read_score_records(spark, path))


@register("s12_s13_trec_run")
def s12_s13_trec_run(spark, d):
    path = _io_path(spark, "run")
    trec.write_run(rank.top_k(fx.event_run(spark, d), 10), path, tag="taintrank")
    back = spark.read.text(path).select(F.split("value", " ").alias("f"))
    return round_doubles(back.select(
        F.col("f")[0].alias("qid"), F.col("f")[2].alias("docno"), F.col("f")[3].cast("int").alias("rank"),
        F.col("f")[4].cast("double").alias("score"), F.col("f")[5].alias("tag")))


# ---------------------------------------------------------------- T: distillation on MLlib


def k1_scores(spark, d, pairs_df=None):
    """BM25 of the pairs, written once for teacher and student features."""
    p = pairs_df if pairs_df is not None else pairs(spark, d)
    return cut_lineage(retrieval.bm25_pairs(p, fx.queries(spark, d), fx.docs(spark, d)), "k1")


def features(spark, d, dims=None, pairs_df=None, k1=None):
    """Pair features, written once as a table: every fit iterates over them."""
    q, dv = fx.vectors(spark, d, dims)
    p = pairs_df if pairs_df is not None else pairs(spark, d)
    return cut_lineage(distill.pair_features(p, fx.queries(spark, d), fx.docs(spark, d), q, dv, k1), "features")


def _coef_frame(spark, model):
    # MLlib stops within 1e-7 of the optimum: four digits are the same in any exact solver
    return spark.createDataFrame([(n, round(float(w), 4) + 0.0) for n, w in distill.coefficients(model)],
                                 "feature string, weight double")


def _teacher_model(spark, d, arm: str, feats=None):
    t = triples(spark, d)
    if arm == "clean":
        t = t.where(F.col("origin") == "clean")
    return distill.train_teacher(t, features(spark, d) if feats is None else feats, reg=0.01)


@register("t1_teacher_clean")
def t1_teacher_clean(spark, d):
    return _coef_frame(spark, _teacher_model(spark, d, "clean"))


@register("t2_teacher_contaminated")
def t2_teacher_contaminated(spark, d):
    return _coef_frame(spark, _teacher_model(spark, d, "contaminated"))


@register("t3_student_kl")
def t3_student_kl(spark, d):
    k1 = k1_scores(spark, d)
    feats = features(spark, d, k1=k1)
    teacher = distill.apply_linear(feats, _teacher_model(spark, d, "clean", feats))
    t = triples(spark, d).where(F.col("origin") == "clean")
    return _coef_frame(spark, distill.train_student_kl(t, features(spark, d, 32, k1=k1), teacher, reg=0.01))


@register("t4_student_argmax")
def t4_student_argmax(spark, d):
    k1 = k1_scores(spark, d)
    feats = features(spark, d, k1=k1)
    teacher = distill.apply_linear(feats, _teacher_model(spark, d, "clean", feats))
    t = triples(spark, d).where(F.col("origin") == "clean")
    return _coef_frame(spark, distill.train_student_argmax(t, features(spark, d, 32, k1=k1), teacher, reg=0.01))


def experiment_runs(spark, d) -> DataFrame:
    """The experiment matrix {clean, contaminated} x {teacher, student} as runs ``name, arm, qid, docno, score``: teachers
    trained on clean vs contaminated triples, students distilled (KL) from each
    teacher on the same triples; all re-rank BM25 top-100."""
    first = cut_lineage(bm25_run(spark, d).select("qid", "docno", "score"), "candidates")
    cand = first.select("qid", "docno")
    feats_t = features(spark, d, pairs_df=cand, k1=first)
    feats_s = features(spark, d, 32, pairs_df=cand, k1=first)
    k1 = k1_scores(spark, d)
    train_t, train_s = features(spark, d, k1=k1), features(spark, d, 32, k1=k1)
    runs = None
    for arm in ("clean", "contaminated"):
        t = triples(spark, d)
        if arm == "clean":
            t = t.where(F.col("origin") == "clean")
        teacher = distill.train_teacher(t, train_t, reg=0.01)
        student = distill.train_student_kl(t, train_s, distill.apply_linear(train_t, teacher), reg=0.01)
        for name, model, feats in (("teacher", teacher, feats_t), ("student", student, feats_s)):
            r = distill.apply_linear(feats, model).withColumn("name", F.lit(name)).withColumn("arm", F.lit(arm))
            runs = r if runs is None else runs.unionByName(r)
    return cut_lineage(runs, "experiment")


@register("t5_contamination_report")
def t5_contamination_report(spark, d):
    """Ranking metrics of the experiment, judged on the leaked queries (their qrels entered the contaminated arm)."""
    runs = experiment_runs(spark, d)
    leaked = triples(spark, d).where(F.col("origin") == "leaked").select(F.col("query_id").alias("qid"))
    test_qrels = fx.qrels(spark, d).join(leaked, "qid", "left_semi")
    return round_doubles(report.metric_report(runs, test_qrels))


@register("t5_arm_statistics")
def t5_arm_statistics(spark, d):
    """Per arm KL(student || teacher) and the moments of the teacher's scores, with the t-test between the arms."""
    return round_doubles(report.arm_statistics(experiment_runs(spark, d)))


# ---------------------------------------------------------------- more operator coverage

# Fixed values (test rule, not from the reference): linear pooler weights
# W[r][c] = 0.1 (r + 1) - 0.05 c for a 4 x 8 layer, bias [0.5, -0.5, 0.25, 0].
LINEAR_W = [[round(0.1 * (r + 1) - 0.05 * c, 10) for c in range(8)] for r in range(4)]
LINEAR_B = [0.5, -0.5, 0.25, 0.0]


def token_states(spark, d):
    """The 64-d embeddings read as 8 token states of 8 dimensions each."""
    e = fx.table(spark, d, "embeddings")
    states = F.transform(F.sequence(F.lit(0), F.lit(7)),
                         lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double")))
    return e.select(F.col("vec_id").cast("string").alias("id"), states.alias("states"))


@register("k8_pooling")
def k8_pooling(spark, d):
    t = token_states(spark, d)
    cls = V.pool("states", "cls")
    mean = V.pool("states", "mean")
    return round_doubles(t.select("id", V.array_sum(cls).alias("cls_sum"), V.array_sum(mean).alias("mean_sum"),
                                  F.element_at(mean, 1).alias("mean_first")))


@register("k9_linear_pooler")
def k9_linear_pooler(spark, d):
    t = token_states(spark, d)
    w = F.array(*[F.array(*[F.lit(x) for x in row]) for row in LINEAR_W])
    b = F.array(*[F.lit(x) for x in LINEAR_B])
    y = V.linear(w, b, V.pool("states", "cls"))
    return round_doubles(t.select("id", *[F.element_at(y, r + 1).alias(f"y{r}") for r in range(4)]))


@register("k4_encode_queries")
def k4_encode_queries(spark, d):
    q = fx.queries(spark, d).select("query")
    enc = scoring.bi_transform(q, _bow_factory)
    return round_doubles(enc.select(F.md5("query").alias("query_md5"), V.array_sum("query_vec").alias("n_tokens")))


@register("k13_teacher_scores_subset")
def k13_teacher_scores_subset(spark, d):
    s = scoring.teacher_scores(scoring.TokenOverlapScorer, pairs=pairs(spark, d), queries=fx.queries(spark, d),
                               docs=fx.docs(spark, d), subset=50, seed=42)
    return round_doubles(s.select("qid", "docno", "score"))


@register("p2_p3_run_vocabulary")
def p2_p3_run_vocabulary(spark, d):
    b = fx.table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    r = schema.to_run_vocabulary(schema.ids_to_string(b, "query_id"))
    return schema.require_columns(r, ["qid", "query"]).select("qid", F.md5("query").alias("query_md5"))


@register("r6_listwise_groups")
def r6_listwise_groups(spark, d):
    g = reshape.group_rows(fx.multi_negative_triples(spark, d), group_size=3, include_positive=False, short="keep")
    return g.select("qid", F.array_join("docnos", ",").alias("docnos"))


@register("s17_profile")
def s17_profile(spark, d):
    return profile_io.profile(fx.qrels(spark, d), ["qid", "docno"])
