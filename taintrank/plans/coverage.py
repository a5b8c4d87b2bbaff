"""More registered queries: operators that the main registry reaches only in
passing (sources, layouts, helpers), edge cases on the given tables, and SQL twins of the MLlib fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import losses, metrics, rank, reshape, retrieval, sampling, schema, scoring
from ..session import cut_lineage
from ..sources import fixtures as fx
from ..sources import trec
from ..sources import triples as triple_io
from . import oracle_sql as O
from .registry import _io_path, listwise_parts, loss_groups, register, round_doubles, triples


def _add(name: str, sql: str) -> None:
    O.ORACLE[name] = sql.replace("round(", "0.0 + round(")


# ---------------------------------------------------------------- S: sources and sinks

def _collection(spark, d) -> dict:
    """The fixtures written as a collection and read back by :func:`read_collection`."""
    path = _io_path(spark, "collection")
    parts = {"docs": fx.docs(spark, d).withColumnRenamed("docno", "doc_id"),
             "queries": fx.queries(spark, d).toDF("query_id", "text"),
             "qrels": fx.qrels(spark, d).toDF("query_id", "doc_id", "relevance"),
             "docpairs": triples(spark, d).drop("origin")}
    for name, df in parts.items():
        df.write.parquet(f"{path}/{name}")
    return triple_io.read_collection(spark, **{name: f"{path}/{name}" for name in parts})


@register("s3_collection")
def s3_collection(spark, d):
    c = _collection(spark, d)
    j = c["qrels"].join(c["docs"], "docno").join(c["queries"], "qid")
    return j.select("qid", "docno", "relevance", F.md5("text").alias("text_md5"), F.md5("query").alias("query_md5"))


_add("s3_collection", O._sql(
    "SELECT r.qid, r.docno, r.relevance, md5(x.text) AS text_md5, md5(q.query) AS query_md5 FROM f_qrels r "
    "JOIN f_docs x ON x.docno = r.docno JOIN f_queries q ON q.qid = r.qid", "f_qrels", "f_docs", "f_queries"))


@register("s4_docpairs")
def s4_docpairs(spark, d):
    p = triple_io.initialise_pairs(_collection(spark, d)["docpairs"])
    return p.groupBy("qid", "docno", "pos").agg(F.count(F.lit(1)).alias("n"))


O.ORACLE["s4_docpairs"] = O.ORACLE["r1_pivot_pairs"]


def _top(k: int, extra: str = "") -> str:
    return (f"SELECT {extra}qid, docno, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno ASC) - 1 AS INTEGER) "
            f"AS rank, round(score, 6) AS score FROM f_event_run QUALIFY rank < {k}")


@register("s12_read_run")
def s12_read_run(spark, d):
    path = _io_path(spark, "run")
    trec.write_run(rank.top_k(fx.event_run(spark, d), 10), path, tag="taintrank")
    return round_doubles(trec.read_run(spark, path, glob=None).select("qid", "docno", "rank", "score", "tag"))


O.ORACLE["s12_read_run"] = O.ORACLE["s12_s13_trec_run"]


@register("s14_run_directory")
def s14_run_directory(spark, d):
    path = _io_path(spark, "runs")
    run = rank.top_k(fx.event_run(spark, d), 10)
    both = run.withColumn("name", F.lit("ten")).unionByName(run.where("rank < 5").withColumn("name", F.lit("five")))
    trec.write_runs(both, path)
    return round_doubles(trec.read_runs(spark, path).select("name", "qid", "docno", "rank", "score"))


_add("s14_run_directory", O._sql(f"({_top(10, chr(39) + 'ten' + chr(39) + ' AS name, ')}) UNION ALL "
                                 f"({_top(5, chr(39) + 'five' + chr(39) + ' AS name, ')})", "f_event_run"))


@register("s15_metric_table")
def s15_metric_table(spark, d):
    path = _io_path(spark, "metrics")
    run = fx.event_run(spark, d).withColumn("name", F.lit("events"))
    trec.write_metrics(metrics.evaluate(run, fx.event_qrels(spark, d)), path)
    back = trec.read_metrics(spark, path)
    return round_doubles(back.withColumnsRenamed({m.label: m.column for m in metrics.DEFAULT_MEASURES}))


O.ORACLE["s15_metric_table"] = O.ORACLE["m7_event_metrics"]


@register("s16_skip_if_exists")
def s16_skip_if_exists(spark, d):
    """The second write leaves the first one's three rows per query alone."""
    path = _io_path(spark, "kept")
    run = rank.top_k(fx.event_run(spark, d), 10)
    trec.write_run(run.where("rank < 3"), path)
    trec.write_run(run, path, overwrite=False)
    return round_doubles(trec.read_run(spark, path, glob=None).select("qid", "docno", "rank", "score"))


_add("s16_skip_if_exists", O._sql(_top(3), "f_event_run"))


# ---------------------------------------------------------------- P, R, A, W, X

@register("p8_negatives_as_list")
def p8_negatives_as_list(spark, d):
    t = schema.negatives_as_list(triples(spark, d))
    return t.select("query_id", "doc_id_a", F.size("doc_id_b").alias("n"), F.element_at("doc_id_b", 1).alias("doc_id_b"))


_add("p8_negatives_as_list", O._sql("SELECT query_id, doc_id_a, CAST(1 AS INTEGER) AS n, doc_id_b FROM f_triples", "f_triples"))


@register("r9_bi_layout")
def r9_bi_layout(spark, d):
    g = reshape.group_rows(triples(spark, d).drop("origin"), group_size=2)
    q, flat = reshape.bi_layout(reshape.assemble_groups(g, fx.queries(spark, d), fx.docs(spark, d)))
    # gid ties a query row to its documents
    j = flat.join(q.select("gid", "query"), "gid")
    return j.groupBy("qid", "pos_idx", "docno", F.md5("query").alias("query_md5")).agg(F.count(F.lit(1)).alias("n"))


_add("r9_bi_layout", O._sql(
    "SELECT x.qid, CAST(pos_idx AS INTEGER) AS pos_idx, docno, md5(q.query) AS query_md5, count(*) AS n FROM ("
    "SELECT query_id AS qid, 0 AS pos_idx, doc_id_a AS docno FROM f_triples UNION ALL "
    "SELECT query_id, 1, doc_id_b FROM f_triples) x JOIN f_queries q ON q.qid = x.qid GROUP BY 1, 2, 3, 4", "f_triples", "f_queries"))


@register("a3_preview")
def a3_preview(spark, d):
    return sampling.sample_n(fx.docs(spark, d).select("docno", F.md5("text").alias("text_md5")), 5, ["docno"], seed=0)


_add("a3_preview", O._sql("SELECT docno, md5(text) AS text_md5 FROM f_docs ORDER BY md5(concat_ws(':', '0', docno)), docno LIMIT 5", "f_docs"))


@register("w2_sorted_run")
def w2_sorted_run(spark, d):
    """The run sorted for the sink; ``line`` counts inside a query in the order of the sorted rows."""
    run = rank.sort_run(rank.top_k(fx.event_run(spark, d), 10)).withColumn("_at", F.monotonically_increasing_id())
    line = F.row_number().over(rank.Window.partitionBy("qid").orderBy("_at"))
    return run.select("qid", "docno", "rank", line.alias("line"))


_add("w2_sorted_run", O._sql(f"SELECT qid, docno, rank, CAST(rank + 1 AS INTEGER) AS line FROM ({_top(10)})", "f_event_run"))


@register("x2_chain")
def x2_chain(spark, d):
    steps = scoring.chain(rank.add_ranks, lambda r: r.where("rank < 3"), lambda r: schema.with_label(r, "events"))
    return round_doubles(fx.event_run(spark, d).transform(steps))


_add("x2_chain", O._sql(f"SELECT *, 'events' AS model_type FROM ({_top(3)})", "f_event_run"))


@register("k13_given_negatives")
def k13_given_negatives(spark, d):
    """Triples whose negatives are replaced by all negatives of the query."""
    mt = fx.multi_negative_triples(spark, d)
    negs = mt.select(F.col("query_id").alias("qid"), F.col("doc_id_b").alias("docnos")).distinct()
    s = scoring.teacher_scores(scoring.TokenOverlapScorer, pairs=triples(spark, d), negatives=negs, queries=fx.queries(spark, d),
                               docs=fx.docs(spark, d))
    return round_doubles(s.groupBy("qid", "docno", "score").agg(F.count(F.lit(1)).alias("n")))


_add("k13_given_negatives", O._sql(
    f"SELECT x.qid, x.docno, round(CAST(len(list_intersect(list_distinct({O.TOK.format(x='q.query')}), "
    f"list_distinct({O.TOK.format(x='t.text')}))) AS DOUBLE), 6) AS score, n FROM (SELECT qid, docno, count(*) AS n FROM ("
    "SELECT query_id AS qid, doc_id_a AS docno FROM f7 UNION ALL SELECT query_id, unnest(doc_id_b) FROM f7) GROUP BY qid, docno) x "
    "JOIN f_queries q ON q.qid = x.qid JOIN f_docs t ON t.docno = x.docno", "f7", "f_queries", "f_docs"))


@register("r4_last_wins")
def r4_last_wins(spark, d):
    """Repeated (qid, docno) keep the score of the last event."""
    e = fx.table(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("qid"), (F.col("event_id") % 20).cast("string").alias("docno"),
                                            F.col("value").cast("double").alias("score"), F.col("event_id").alias("seq"))
    m = reshape.collect_score_map(e, seq="seq")
    return round_doubles(m.select("qid", F.explode("scores").alias("docno", "score")))


_add("r4_last_wins", "SELECT qid, docno, round(score, 6) AS score FROM (SELECT CAST(user_id % 10 AS VARCHAR) AS qid, CAST(event_id % 20 AS VARCHAR) AS docno, "
                     "arg_max(CAST(value AS DOUBLE), event_id) AS score FROM events GROUP BY 1, 2)")

# ---------------------------------------------------------------- G, M, B: edge cases

@register("g7_missing_queries")
def g7_missing_queries(spark, d):
    """The dense run, whole and without every second query, and the event run against the judgements of the vector queries; queries
    that a run lacks are rows of zeros. Vectors that are null or hold a null score nothing."""
    q, v = (x.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda c: c.isNull())) for x in fx.vectors(spark, d))
    dense = cut_lineage(retrieval.dense_retrieve(q, v, k=100), "dense_run")
    half = dense.where(F.col("qid").cast("long") % 2 == 0)
    runs = dense.withColumn("name", F.lit("dense")).unionByName(half.withColumn("name", F.lit("half"))).select("name", "qid", "docno", "score")
    runs = runs.unionByName(fx.event_run(spark, d).withColumn("name", F.lit("events")))
    return round_doubles(metrics.per_query(runs, fx.vector_qrels(spark, d)))


_add("g7_missing_queries", O.with_ctes("", "dense_run", "f_event_run", "f_vqrels").rstrip()
     + ",\nm_run AS (SELECT 'dense' AS name, qid, docno, score FROM dense_run WHERE score IS NOT NULL UNION ALL "
     + "SELECT 'half' AS name, qid, docno, score FROM dense_run WHERE score IS NOT NULL AND CAST(qid AS BIGINT) % 2 = 0 UNION ALL "
     + "SELECT 'events' AS name, qid, docno, score FROM f_event_run),"
     + O.metric_ctes("m_run", "f_vqrels") + "\nSELECT name, qid, "
     + ", ".join(f"round({c}, 6) AS {c}" for c in O.DEFAULT_COLUMNS) + " FROM m_pq")


@register("m6_parsed_measures")
def m6_parsed_measures(spark, d):
    run = fx.event_run(spark, d).withColumn("name", F.lit("events"))
    return round_doubles(metrics.evaluate(run, fx.event_qrels(spark, d), ("R(rel=2)@5", "P@2", "RR(rel=3)", "nDCG@3")))


_add("m6_parsed_measures", O._sql(
    "SELECT 'events' AS name, round(avg(CASE WHEN n2 > 0 THEN coalesce(r5, 0) / n2 ELSE 0 END), 6) AS r_rel2_at_5, "
    "round(avg(coalesce(p2, 0) / 2), 6) AS p_at_2, round(avg(coalesce(1.0 / f3, 0)), 6) AS rr_rel3, "
    "round(avg(CASE WHEN i3 > 0 THEN coalesce(d3, 0) / i3 ELSE 0 END), 6) AS ndcg_at_3 FROM ("
    "SELECT qid, sum(CASE WHEN relevance >= 2 THEN 1 ELSE 0 END) AS n2, "
    "sum(CASE WHEN ip <= 3 THEN relevance / log2(ip + 1) ELSE 0 END) AS i3 FROM (SELECT *, row_number() OVER "
    "(PARTITION BY qid ORDER BY relevance DESC) AS ip FROM f_event_qrels) GROUP BY qid) s LEFT JOIN ("
    "SELECT qid, sum(CASE WHEN g >= 2 AND pos <= 5 THEN 1 ELSE 0 END) AS r5, sum(CASE WHEN g >= 1 AND pos <= 2 THEN 1 ELSE 0 END) AS p2, "
    "min(CASE WHEN g >= 3 THEN pos END) AS f3, sum(CASE WHEN pos <= 3 THEN g / log2(pos + 1) ELSE 0 END) AS d3 FROM ("
    "SELECT r.qid, coalesce(q.relevance, 0) AS g, row_number() OVER (PARTITION BY r.qid ORDER BY r.score DESC, r.docno DESC) AS pos "
    "FROM f_event_run r LEFT JOIN f_event_qrels q ON q.qid = r.qid AND q.docno = r.docno) GROUP BY qid) a ON a.qid = s.qid",
    "f_event_run", "f_event_qrels"))

# ---------------------------------------------------------------- L: temperature

@register("l10_listnet_t2")
def l10_listnet_t2(spark, d):
    return round_doubles(losses.loss(loss_groups(spark, d), "listnet", temperature=2.0))


_add("l10_listnet_t2", O._sql(
    "SELECT round(avg(-(CASE WHEN f THEN l0 ELSE 1 / (1 + exp((l1 - l0) / 2)) END * lsm0 + CASE WHEN f THEN l1 ELSE 1 / (1 + exp((l0 - l1) / 2)) END * lsm1)), 6) "
    "AS loss FROM lgz, (SELECT coalesce(bool_and(l0 >= 0 AND l0 <= 1 AND l1 >= 0 AND l1 <= 1), true) AS f FROM lg)", "lgz"))


@register("l10_listnet_listwise_t2")
def l10_listnet_listwise_t2(spark, d):
    pos, neg = listwise_parts(spark, d)
    return round_doubles(losses.shared_negative_loss(pos, neg, "listnet", key="query_id", temperature=2.0))


_add("l10_listnet_listwise_t2", O._sql(
    "SELECT round(avg(g), 6) AS loss FROM (SELECT query_id, doc_id_a, -sum(CASE WHEN f THEN t ELSE e / z END * lsm) AS g FROM ("
    "SELECT *, exp((t - tm) / 2) AS e, sum(exp((t - tm) / 2)) OVER (PARTITION BY query_id, doc_id_a) AS z FROM lw_z), "
    "(SELECT coalesce(bool_and(t >= 0 AND t <= 1), true) AS f FROM lw_sc) GROUP BY query_id, doc_id_a)", "lw_z", "lw_sc"))

# ---------------------------------------------------------------- T: the fits, solved again in SQL

O.CTE.update({
    "t_feat": (f"SELECT p.qid, p.docno, coalesce(list_dot_product(q.vec, d.vec), 0.0) AS x0, coalesce(list_dot_product(q32.vec, d32.vec), 0.0) AS s0, "
               f"CAST(len(list_intersect(list_distinct({O.TOK.format(x='fq.query')}), list_distinct({O.TOK.format(x='fd.text')}))) AS DOUBLE) AS x1, "
               f"ln(1 + CAST(len({O.TOK.format(x='fd.text')}) AS DOUBLE)) AS x2, coalesce(k.score, 0.0) AS x3 FROM f_pairs p JOIN f_queries fq ON fq.qid = p.qid "
               "JOIN f_docs fd ON fd.docno = p.docno LEFT JOIN bm_sc k ON k.qid = p.qid AND k.docno = p.docno LEFT JOIN f_qvec q ON q.qid = p.qid LEFT JOIN f_dvec d ON d.docno = p.docno "
               "LEFT JOIN f_qvec32 q32 ON q32.qid = p.qid LEFT JOIN f_dvec32 d32 ON d32.docno = p.docno"),
    "t_diff": ("SELECT t.origin, a.x0 - b.x0 AS d0, a.s0 - b.s0 AS e0, a.x1 - b.x1 AS d1, a.x2 - b.x2 AS d2, a.x3 - b.x3 AS d3 FROM f_triples t "
               "JOIN t_feat a ON a.qid = t.query_id AND a.docno = t.doc_id_a JOIN t_feat b ON b.qid = t.query_id AND b.docno = t.doc_id_b"),
})
O._ORDER[:] = list(O.CTE)


def _newton(name: str, rows: str, steps: int = 25, reg: float = 0.01) -> str:
    """CTEs ``{name}_i``, ``{name}_w``: Newton steps of the soft-label logistic regression on ``rows`` (d0 to d3, y).

    The 4 x 4 system is solved by blocks: ``i..`` is the inverse of the first three rows and columns, ``u`` and ``v`` its products with
    the gradient and with the last column, and ``z`` the last component.
    """
    grad = ", ".join(f"avg((p - y) * d{j}) + {reg} * b{j} AS g{j}" for j in range(4))
    hess = ", ".join(f"avg(p * (1 - p) * d{j} * d{k})" + (f" + {reg}" if j == k else "") + f" AS h{j}{k}" for j in range(4) for k in range(j, 4))
    inverse = ("(h11 * h22 - h12 * h12) / det AS i00, (h02 * h12 - h01 * h22) / det AS i01, (h01 * h12 - h02 * h11) / det AS i02, "
               "(h00 * h22 - h02 * h02) / det AS i11, (h01 * h02 - h00 * h12) / det AS i12, (h00 * h11 - h01 * h01) / det AS i22")
    rows_of = (("i00", "i01", "i02"), ("i01", "i11", "i12"), ("i02", "i12", "i22"))
    parts = ", ".join(f"{r[0]} * g0 + {r[1]} * g1 + {r[2]} * g2 AS u{j}, {r[0]} * h03 + {r[1]} * h13 + {r[2]} * h23 AS v{j}" for j, r in enumerate(rows_of))
    out = [f"{name}_r AS MATERIALIZED ({rows})", f"""{name}_i(i, b0, b1, b2, b3) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
  SELECT i + 1, b0 - u0 + v0 * z, b1 - u1 + v1 * z, b2 - u2 + v2 * z, b3 - z FROM (
    SELECT *, (g3 - h03 * u0 - h13 * u1 - h23 * u2) / (h33 - h03 * v0 - h13 * v1 - h23 * v2) AS z FROM (SELECT *, {parts} FROM (SELECT *, {inverse} FROM (
      SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
        SELECT i, b0, b1, b2, b3, {grad}, {hess} FROM (
          SELECT *, 1 / (1 + exp(-(b0 * d0 + b1 * d1 + b2 * d2 + b3 * d3))) AS p FROM {name}_i, {name}_r WHERE i < {steps}) GROUP BY i, b0, b1, b2, b3))))))""",
           f"{name}_w AS (SELECT b0, b1, b2, b3 FROM {name}_i WHERE i = {steps})"]
    return ",\n".join(out)


def _fit_sql(*stages: tuple[str, str]) -> str:
    head = O.with_ctes("", "t_diff").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    last = stages[-1][0]
    return (head + ",\n" + ",\n".join(_newton(n, r) for n, r in stages)
            + f"\nSELECT feature, round(weight, 4) AS weight FROM (SELECT unnest(['dot', 'overlap', 'log_doc_len', 'k1']) AS feature, "
              f"unnest([b0, b1, b2, b3]) AS weight FROM {last}_w)")


_CLEAN, _ALL = "WHERE origin = 'clean'", ""
_HARD = "SELECT d0, d1, d2, d3, 1 AS y FROM t_diff {}"
_SOFT = "SELECT e0 AS d0, d1, d2, d3, {} AS y FROM (SELECT *, b0 * d0 + b1 * d1 + b2 * d2 + b3 * d3 AS gap FROM t_diff, t_w WHERE origin = 'clean')"
_add("t1_teacher_clean", _fit_sql(("t", _HARD.format(_CLEAN))))
_add("t2_teacher_contaminated", _fit_sql(("t", _HARD.format(_ALL))))
_add("t3_student_kl", _fit_sql(("t", _HARD.format(_CLEAN)), ("s", _SOFT.format("1 / (1 + exp(-gap))"))))
_add("t4_student_argmax", _fit_sql(("t", _HARD.format(_CLEAN)), ("s", _SOFT.format("CASE WHEN gap >= 0 THEN 1 ELSE 0 END"))))



# T5: the four fits, their scores of the BM25 candidates, and the metrics of the runs
O.CTE["c_feat"] = O.CTE["t_feat"].replace("FROM f_pairs p", "FROM bm25_run p")
O.CTE["t5_qrels"] = "SELECT qid, docno, relevance FROM f_qrels WHERE qid IN (SELECT query_id FROM f_triples WHERE origin = 'leaked')"
O._ORDER[:] = list(O.CTE)


def _report_sql() -> str:
    head = O.with_ctes("", "t_diff", "c_feat", "t5_qrels").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    fits, runs = [], []
    for arm, tag, where in (("clean", "c", _CLEAN), ("contaminated", "a", _ALL)):
        soft = _SOFT.format("1 / (1 + exp(-gap))").replace("t_w WHERE origin = 'clean'", f"t{tag}_w {where}")
        fits += [_newton(f"t{tag}", _HARD.format(where)), _newton(f"s{tag}", soft)]
        for name, side, x0 in (("teacher", "t", "x0"), ("student", "s", "s0")):
            runs.append(f"SELECT '{name}' AS name, '{arm}' AS arm, qid, docno, b0 * {x0} + b1 * x1 + b2 * x2 + b3 * x3 AS score FROM c_feat, {side}{tag}_w")
    by = ("name", "arm")
    wide = O.metric_mean_select(by).replace("round(coalesce(sum", "(coalesce(sum").replace(", 6) AS", ") AS")
    cols = O.DEFAULT_COLUMNS
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    delta = ", ".join(f"round(max({c}) FILTER (WHERE arm = 'clean') - max({c}) FILTER (WHERE arm = 'contaminated'), 6) AS {c}" for c in cols)
    return (head + ",\n" + ",\n".join(fits) + ",\nm_run AS MATERIALIZED (" + " UNION ALL ".join(runs) + ")," + O.metric_ctes("m_run", "t5_qrels", by)
            + f",\nwide AS MATERIALIZED ({wide})\nSELECT name, arm, {rounded} FROM wide UNION ALL SELECT name, 'delta', {delta} FROM wide GROUP BY name")


_add("t5_contamination_report", _report_sql())
