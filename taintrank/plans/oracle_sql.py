"""DuckDB SQL twins of the registered Spark queries (the correctness oracle).

The fixture CTEs below restate FIXTURES.md in SQL; each registered query's
SQL is built from them. Floats are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

# ---------------------------------------------------------------- fixtures
N = "(SELECT count(*) FROM benchmark)"

CTE = {
    "f_queries": "SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark",
    "f_docs": "SELECT CAST(doc_id AS VARCHAR) AS docno, text FROM documents",
    "f_qrels": (f"SELECT CAST(doc_id % {N} AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS docno, "
                "CAST(quality * 2 + (1 - toxic) AS INTEGER) AS relevance FROM labels"),
    "f_qvec": f"SELECT CAST(vec_id AS VARCHAR) AS qid, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id < {N}",
    "f_dvec": f"SELECT CAST(vec_id AS VARCHAR) AS docno, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id >= {N}",
    "f_qvec32": f"SELECT CAST(vec_id AS VARCHAR) AS qid, CAST(embedding[1:32] AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id < {N}",
    "f_dvec32": f"SELECT CAST(vec_id AS VARCHAR) AS docno, CAST(embedding[1:32] AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id >= {N}",
    "f_vqrels": "SELECT * FROM f_qrels WHERE docno IN (SELECT docno FROM f_dvec)",
    "f_binary": ("SELECT qid, docno, CASE WHEN relevance IN (2, 3) THEN 1 WHEN relevance IN (0, 1) THEN 0 END "
                 "AS relevance FROM f_qrels"),
    "f_neg": ("SELECT qid, arg_min(docno, md5(concat_ws(':', '42', qid, docno))) AS neg "
              "FROM f_binary WHERE relevance = 0 GROUP BY qid"),
    "f_triples": ("SELECT p.qid AS query_id, p.docno AS doc_id_a, n.neg AS doc_id_b, "
                  "CASE WHEN CAST(p.docno AS BIGINT) % 2 = 0 THEN 'clean' ELSE 'leaked' END AS origin "
                  "FROM f_binary p JOIN f_neg n ON p.qid = n.qid WHERE p.relevance = 1"),
    "f_event_run": ("SELECT CAST(user_id AS VARCHAR) AS qid, CAST(event_id AS VARCHAR) AS docno, "
                    "CAST(value AS DOUBLE) AS score FROM events"),
    "f_event_qrels": ("SELECT CAST(user_id AS VARCHAR) AS qid, CAST(event_id AS VARCHAR) AS docno, "
                      "CAST(event_id % 4 AS INTEGER) AS relevance FROM events WHERE event_id % 3 = 0"),
    "f_sample": "SELECT l_linestatus AS model_type, CAST(l_extendedprice AS DOUBLE) AS score FROM lineitem",
    "f_user_texts": ("SELECT concat_ws('-', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS qid, "
                     "text AS query FROM conversations"),
    # dense run (K7 retrieval, top 100, ties by docno ascending)
    "dense_scored": ("SELECT q.qid, d.docno, list_dot_product(q.vec, d.vec) AS score "
                     "FROM f_qvec q CROSS JOIN f_dvec d"),
    "dense_run": ("SELECT qid, docno, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, "
                  "docno ASC) - 1 AS INTEGER) AS rank FROM dense_scored QUALIFY rank < 100"),
    # teacher (64 dims) and student (first 32 dims) scores of the triple docs
    "f_pairs": ("SELECT query_id AS qid, doc_id_a AS docno FROM f_triples UNION "
                "SELECT query_id, doc_id_b FROM f_triples"),
    "teacher_scores": ("SELECT p.qid, p.docno, list_dot_product(q.vec, d.vec) AS score FROM f_pairs p "
                       "JOIN f_qvec q ON p.qid = q.qid JOIN f_dvec d ON p.docno = d.docno"),
    "student_scores": ("SELECT p.qid, p.docno, list_dot_product(q.vec, d.vec) AS score FROM f_pairs p "
                       "JOIN f_qvec32 q ON p.qid = q.qid JOIN f_dvec32 d ON p.docno = d.docno"),
}

# dependencies in definition order
_ORDER = list(CTE)


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (transitively, in order)."""
    need: set[str] = set()

    def visit(n: str):
        if n in need:
            return
        need.add(n)
        for other in _ORDER:
            if other != n and other in CTE[n]:
                visit(other)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTE[n]})" for n in _ORDER if n in need]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


# ---------------------------------------------------------------- metrics
DEFAULT_COLUMNS = ("ap", "ndcg_at_10", "ndcg_at_5", "ndcg_at_1", "r_at_100", "r_at_1000",
                   "p_at_10", "rr", "rr_at_10")


def metric_ctes(run: str, qrels: str, by: Sequence[str] = ("name",)) -> str:
    """CTE text computing per-query default measures for ``run`` vs ``qrels``.

    ``run`` must have columns (*by, qid, docno, score); ``qrels`` (qid, docno, relevance).
    Defines ``m_pq`` (per query) and ``m_nj`` (number of judged queries).
    """
    keys = ", ".join(f"r.{b}" for b in by)
    part = ", ".join(list(by) + ["qid"])
    return f"""
m_j AS (SELECT {keys}, r.qid, r.docno, r.score, coalesce(q.relevance, 0) AS g,
          row_number() OVER (PARTITION BY {', '.join(f'r.{b}' for b in by)}, r.qid
                             ORDER BY r.score DESC, r.docno DESC) AS pos
        FROM {run} r LEFT JOIN {qrels} q ON r.qid = q.qid AND r.docno = q.docno),
m_j2 AS (SELECT *, sum(CASE WHEN g >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {part} ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cr FROM m_j),
m_agg AS (SELECT {', '.join(by)}, qid,
   sum(CASE WHEN g >= 1 THEN cr / pos ELSE 0 END) AS ap_num,
   sum(CASE WHEN pos <= 10 THEN greatest(g, 0) / log2(pos + 1) ELSE 0 END) AS dcg10,
   sum(CASE WHEN pos <= 5 THEN greatest(g, 0) / log2(pos + 1) ELSE 0 END) AS dcg5,
   sum(CASE WHEN pos <= 1 THEN greatest(g, 0) / log2(pos + 1) ELSE 0 END) AS dcg1,
   sum(CASE WHEN g >= 1 AND pos <= 100 THEN 1 ELSE 0 END) AS rel100,
   sum(CASE WHEN g >= 1 AND pos <= 1000 THEN 1 ELSE 0 END) AS rel1000,
   sum(CASE WHEN g >= 1 AND pos <= 10 THEN 1 ELSE 0 END) AS rel10,
   min(CASE WHEN g >= 1 THEN pos END) AS fr, min(CASE WHEN g >= 1 AND pos <= 10 THEN pos END) AS fr10
  FROM m_j2 GROUP BY {', '.join(by)}, qid),
m_ip AS (SELECT qid, relevance, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, docno ASC) AS ipos
         FROM {qrels}),
m_qs AS (SELECT qid, sum(CASE WHEN relevance >= 1 THEN 1 ELSE 0 END) AS nrel,
   sum(CASE WHEN ipos <= 10 THEN greatest(relevance, 0) / log2(ipos + 1) ELSE 0 END) AS i10,
   sum(CASE WHEN ipos <= 5 THEN greatest(relevance, 0) / log2(ipos + 1) ELSE 0 END) AS i5,
   sum(CASE WHEN ipos <= 1 THEN greatest(relevance, 0) / log2(ipos + 1) ELSE 0 END) AS i1
  FROM m_ip GROUP BY qid),
m_pq AS (SELECT {', '.join(f'n.{b}' for b in by)}, s.qid,
   CASE WHEN nrel > 0 THEN coalesce(ap_num, 0) / nrel ELSE 0 END AS ap,
   CASE WHEN i10 > 0 THEN coalesce(dcg10, 0) / i10 ELSE 0 END AS ndcg_at_10,
   CASE WHEN i5 > 0 THEN coalesce(dcg5, 0) / i5 ELSE 0 END AS ndcg_at_5,
   CASE WHEN i1 > 0 THEN coalesce(dcg1, 0) / i1 ELSE 0 END AS ndcg_at_1,
   CASE WHEN nrel > 0 THEN coalesce(rel100, 0) / nrel ELSE 0 END AS r_at_100,
   CASE WHEN nrel > 0 THEN coalesce(rel1000, 0) / nrel ELSE 0 END AS r_at_1000,
   coalesce(rel10, 0) / 10 AS p_at_10,
   coalesce(1.0 / fr, 0) AS rr, coalesce(1.0 / fr10, 0) AS rr_at_10
  FROM (SELECT DISTINCT {', '.join(by)} FROM {run}) n CROSS JOIN m_qs s
  LEFT JOIN m_agg a ON a.qid = s.qid{''.join(f' AND a.{b} = n.{b}' for b in by)}),
m_nj AS (SELECT count(DISTINCT qid) AS nj FROM {qrels})"""


def metric_mean_select(by: Sequence[str] = ("name",), run: str = "m_run") -> str:
    """Mean over judged queries; a run without any judged query reports zeros."""
    keys = ", ".join(by)
    cols = ", ".join(f"round(coalesce(sum(p.{c}), 0) / (SELECT nj FROM m_nj), 6) AS {c}" for c in DEFAULT_COLUMNS)
    on = " AND ".join(f"n.{b} = p.{b}" for b in by)
    sel = ", ".join(f"n.{b}" for b in by)
    return (f"SELECT {sel}, {cols} FROM (SELECT DISTINCT {keys} FROM {run}) n LEFT JOIN m_pq p ON {on} "
            f"GROUP BY {sel}")


def metrics_query(run_cte_body: str, qrels_cte: str, base_ctes: Sequence[str],
                  by: Sequence[str] = ("name",)) -> str:
    """Full SQL: fixtures, a ``m_run`` CTE, metric CTEs and the wide mean."""
    head = with_ctes("", *base_ctes).rstrip()
    sep = ",\n" if head else "WITH "
    return (head + sep + f"m_run AS ({run_cte_body})," + metric_ctes("m_run", qrels_cte, by)
            + "\n" + metric_mean_select(by))


# ---------------------------------------------------------------- registered SQL
ORACLE: dict[str, str] = {}

ORACLE["k7_dense_topk"] = with_ctes(
    "SELECT qid, docno, round(score, 6) AS score, rank FROM dense_run", "dense_run")

ORACLE["m7_dense_metrics"] = metrics_query(
    "SELECT 'dense' AS name, qid, docno, score FROM dense_run", "f_vqrels", ["dense_run", "f_vqrels"])

# ---------------------------------------------------------------- more fixtures
TOK = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')"
WS_TOK = r"list_filter(regexp_split_to_array(trim({x}), '[ \t\n\x0B\f\r]+'), lambda t: t <> '')"
P6_CLASS = r"[^\p{L}\p{N}_ \t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"


def _trunc(x: str, n: int) -> str:
    return f"array_to_string(list_slice({WS_TOK.format(x=x)}, 1, {n}), ' ')"


CTE.update({
    "r1": ("SELECT query_id AS qid, doc_id_a AS docno, 1 AS pos FROM f_triples UNION ALL "
           "SELECT query_id, doc_id_b, 0 FROM f_triples"),
    "f7": ("SELECT p.qid AS query_id, p.docno AS doc_id_a, n.docnos AS doc_id_b FROM f_binary p JOIN "
           "(SELECT qid, list_sort(list(docno)) AS docnos FROM f_binary WHERE relevance = 0 GROUP BY qid) n "
           "ON p.qid = n.qid WHERE p.relevance = 1"),
    "dense_scored32": ("SELECT q.qid, d.docno, list_dot_product(q.vec, d.vec) AS score "
                       "FROM f_qvec32 q CROSS JOIN f_dvec32 d"),
    "dense_run32": ("SELECT qid, docno, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, "
                    "docno ASC) - 1 AS INTEGER) AS rank FROM dense_scored32 QUALIFY rank < 100"),
    "lg": ("SELECT t.query_id, t.doc_id_a, t.doc_id_b, t.origin, coalesce(sa.score, 0.0) AS p0, "
           "coalesce(sb.score, 0.0) AS p1, coalesce(ta.score, 0.0) AS l0, coalesce(tb.score, 0.0) AS l1 "
           "FROM f_triples t "
           "LEFT JOIN student_scores sa ON sa.qid = t.query_id AND sa.docno = t.doc_id_a "
           "LEFT JOIN student_scores sb ON sb.qid = t.query_id AND sb.docno = t.doc_id_b "
           "LEFT JOIN teacher_scores ta ON ta.qid = t.query_id AND ta.docno = t.doc_id_a "
           "LEFT JOIN teacher_scores tb ON tb.qid = t.query_id AND tb.docno = t.doc_id_b"),
    "lgx": "SELECT *, greatest(p0, p1) AS pm, greatest(l0, l1) AS lm FROM lg",
    "lgy": ("SELECT *, pm + ln(exp(p0 - pm) + exp(p1 - pm)) AS plse, "
            "lm + ln(exp(l0 - lm) + exp(l1 - lm)) AS llse FROM lgx"),
    "lgz": ("SELECT *, p0 - plse AS lsm0, p1 - plse AS lsm1, exp(l0 - llse) AS q0, exp(l1 - llse) AS q1 "
            "FROM lgy"),
    "bm_dt": f"SELECT docno, {TOK.format(x='text')} AS toks FROM f_docs",
    "bm_st": "SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(len(toks)) AS avgdl FROM bm_dt",
    "bm_qt": (f"SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({TOK.format(x='query')}) AS term "
              "FROM f_queries) GROUP BY qid, term"),
    "bm_post": ("SELECT term, docno, dl, count(*) AS tf FROM (SELECT docno, len(toks) AS dl, unnest(toks) AS term "
                "FROM bm_dt) WHERE term IN (SELECT term FROM bm_qt) GROUP BY term, docno, dl"),
    "bm_df": "SELECT term, count(*) AS n FROM bm_post GROUP BY term",
    "bm_w": ("SELECT q.qid, q.term, q.qtf * ln(1 + ((SELECT n_docs FROM bm_st) - f.n + 0.5) / (f.n + 0.5)) AS w "
             "FROM bm_qt q JOIN bm_df f ON q.term = f.term"),
    "bm_sc": ("SELECT w.qid, p.docno, CAST(sum(CAST(w.w * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / "
              "(SELECT avgdl FROM bm_st))) AS DECIMAL(38, 18))) AS DOUBLE) AS score FROM bm_post p JOIN bm_w w ON p.term = w.term "
              "GROUP BY w.qid, p.docno"),
    "bm25_run": ("SELECT qid, docno, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, "
                 "docno ASC) - 1 AS INTEGER) AS rank FROM bm_sc QUALIFY rank < 100"),
    "rr_in": ("SELECT r.qid, r.docno, r.rank AS first_rank, q.query, d.text FROM bm25_run r "
              "JOIN f_queries q ON r.qid = q.qid JOIN f_docs d ON r.docno = d.docno"),
    "ov_scores": (f"SELECT qid, docno, first_rank, CAST(len(list_intersect(list_distinct({TOK.format(x='query')}), "
                  f"list_distinct({TOK.format(x='text')}))) AS DOUBLE) AS score FROM rr_in"),
    "q_bow": (f"SELECT qid, b, count(*) AS c FROM (SELECT qid, CAST(('0x' || substr(md5(t), 1, 15)) AS UBIGINT) % 256 "
              f"AS b FROM (SELECT qid, unnest({TOK.format(x='query')}) AS t FROM f_queries)) GROUP BY qid, b"),
    "d_bow": (f"SELECT docno, b, count(*) AS c FROM (SELECT docno, CAST(('0x' || substr(md5(t), 1, 15)) AS UBIGINT) % 256 "
              f"AS b FROM (SELECT docno, unnest({TOK.format(x='text')}) AS t FROM f_docs)) GROUP BY docno, b"),
    "sample_ld": ("SELECT qid, docno, score, 'teacher' AS model_type FROM teacher_scores UNION ALL "
                  "SELECT qid, docno, score, 'student' FROM student_scores"),
    "kl_m": ("SELECT s.qid, s.docno, s.score AS s, t.score AS t FROM student_scores s "
             "JOIN teacher_scores t ON s.qid = t.qid AND s.docno = t.docno"),
    "kl_sm": "SELECT qid, count(*) AS n_docs, sum(s) AS s_sum, sum(t) AS t_sum FROM kl_m GROUP BY qid",
    "kl_pq": ("SELECT qid, n_docs, s_sum, t_sum, sum(CASE WHEN s_sum <> 0 AND t_sum <> 0 THEN p * ln(p / q) END) AS kl "
              "FROM (SELECT m.qid, n_docs, s_sum, t_sum, "
              "least(greatest(CASE WHEN s_sum <> 0 THEN s / s_sum END, 1e-10), 1.0) AS p, "
              "least(greatest(CASE WHEN t_sum <> 0 THEN t / t_sum END, 1e-10), 1.0) AS q "
              "FROM kl_m m JOIN kl_sm USING (qid)) GROUP BY qid, n_docs, s_sum, t_sum"),
    "lw_long": ("SELECT query_id, doc_id_a, 0 AS i, doc_id_a AS docno FROM f7 UNION ALL "
                "SELECT query_id, doc_id_a, generate_subscripts(doc_id_b, 1) AS i, unnest(doc_id_b) AS docno FROM f7"),
    "lw_sc": ("SELECT l.query_id, l.doc_id_a, l.i, coalesce(s.score, 0.0) AS s, coalesce(t.score, 0.0) AS t "
              "FROM lw_long l "
              "LEFT JOIN (SELECT q.qid, d.docno, list_dot_product(q.vec, d.vec) AS score FROM "
              "(SELECT DISTINCT query_id AS qid, docno FROM lw_long) p JOIN f_qvec32 q ON p.qid = q.qid "
              "JOIN f_dvec32 d ON p.docno = d.docno) s ON s.qid = l.query_id AND s.docno = l.docno "
              "LEFT JOIN (SELECT q.qid, d.docno, list_dot_product(q.vec, d.vec) AS score FROM "
              "(SELECT DISTINCT query_id AS qid, docno FROM lw_long) p JOIN f_qvec q ON p.qid = q.qid "
              "JOIN f_dvec d ON p.docno = d.docno) t ON t.qid = l.query_id AND t.docno = l.docno"),
    "lw_x": ("SELECT *, max(s) OVER g AS sm, max(t) OVER g AS tm FROM lw_sc "
             "WINDOW g AS (PARTITION BY query_id, doc_id_a)"),
    "lw_y": ("SELECT *, sm + ln(sum(exp(s - sm)) OVER g) AS slse, tm + ln(sum(exp(t - tm)) OVER g) AS tlse "
             "FROM lw_x WINDOW g AS (PARTITION BY query_id, doc_id_a)"),
    "lw_z": "SELECT *, s - slse AS lsm, exp(t - tlse) AS q FROM lw_y",
})
_ORDER[:] = list(CTE)


def _sql(body: str, *ctes: str) -> str:
    return with_ctes(body, *ctes)


# R5, R6 and R10 on long rows: the positives, and two negatives each from the ring
_LONG_POS = ("SELECT md5(qid || ':' || docno) AS gid, qid, 0 AS pos_idx, docno FROM (SELECT DISTINCT qid, docno FROM f_binary WHERE relevance = 1)")
_LONG_NEG = (
    "SELECT md5(p.query_id || ':' || p.doc_id_a) AS gid, p.query_id AS qid, CAST({at} AS INTEGER) AS pos_idx, n.doc_id_b AS docno "
    "FROM (SELECT *, CAST('0x' || left(md5('42:offset:' || query_id || ':' || doc_id_a), 15) AS BIGINT) AS f FROM (SELECT DISTINCT query_id, doc_id_a FROM f7)) p "
    "JOIN (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY md5('42:' || query_id || ':' || doc_id_b)) AS at "
    "FROM (SELECT DISTINCT query_id, unnest(doc_id_b) AS doc_id_b FROM f7)) n ON n.query_id = p.query_id "
    "JOIN (SELECT unnest(range(1, 3)) AS idx) k ON idx <= n.n AND n.at = (f + idx - 1) % n.n + 1")
_EPOCH_KEY = "md5('42:' || epoch || ':' || query_id || ':' || doc_id_a || ':' || doc_id_b || ':' || origin)"
_BATCHES = (f"SELECT *, (row_number() OVER (ORDER BY {_EPOCH_KEY}) - 1) // 8 AS batch FROM (SELECT *, 0 AS epoch FROM f_triples)")


def _pairs_sql(expr: str, where: str = "") -> str:
    """The mean over all pairs of judged documents of a query, in docno order."""
    part = lambda q, d: (f"SELECT q.qid, d.docno, list_dot_product(q.vec, d.vec) AS score FROM (SELECT DISTINCT query_id AS qid, docno FROM lw_long) p "  # noqa: E731
                         f"JOIN {q} q ON p.qid = q.qid JOIN {d} d ON p.docno = d.docno")
    e = ("(SELECT l.query_id, l.docno, coalesce(s.score, 0.0) AS s, coalesce(t.score, 0.0) AS t FROM (SELECT DISTINCT query_id, docno FROM lw_long) l "
         f"LEFT JOIN ({part('f_qvec32', 'f_dvec32')}) s ON s.qid = l.query_id AND s.docno = l.docno "
         f"LEFT JOIN ({part('f_qvec', 'f_dvec')}) t ON t.qid = l.query_id AND t.docno = l.docno)")
    return with_ctes(f"SELECT round(avg({expr}), 6) AS loss FROM {e} a JOIN {e} b ON a.query_id = b.query_id AND a.docno < b.docno {where}",
                     "lw_long", "lw_sc")


def _losses_sql(expr: str, denom: str = "count(*)", where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    return _sql(f"SELECT round(sum({expr}) / {denom}, 6) AS loss FROM lgz{w}", "lgz")


SIG = "1.0 / (1.0 + exp(-({x})))"
LSM_T = "CASE WHEN l0 >= l1 THEN lsm0 ELSE lsm1 END"

ORACLE.update({
    "p4_binary_relevance": _sql("SELECT qid, docno, relevance FROM f_binary", "f_binary"),
    "p5_label_split": _sql(
        "SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.n_pos, 0) AS n_pos, coalesce(b.n_neg, 0) AS n_neg FROM "
        "(SELECT qid, count(*) AS n_pos FROM f_binary WHERE relevance = 1 GROUP BY qid) a FULL JOIN "
        "(SELECT qid, count(*) AS n_neg FROM f_binary WHERE relevance = 0 GROUP BY qid) b ON a.qid = b.qid",
        "f_binary"),
    "p6_clean_query": _sql(f"SELECT qid, regexp_replace(query, '{P6_CLASS}', '', 'g') AS query FROM f_user_texts",
                           "f_user_texts"),
    "p11_pair_text": _sql(
        f"SELECT q.qid, q.docno, md5(array_to_string(list_concat({WS_TOK.format(x='fq.query')}, list_slice({WS_TOK.format(x='fd.text')}, 1, "
        f"greatest(230 - len({WS_TOK.format(x='fq.query')}), 0))), ' ')) AS text_md5, "
        f"CAST(len({WS_TOK.format(x='fd.text')}) AS INTEGER) AS doc_tokens FROM f_qrels q "
        "JOIN f_queries fq ON q.qid = fq.qid JOIN f_docs fd ON q.docno = fd.docno",
        "f_qrels", "f_queries", "f_docs"),
    "j2_judged_texts": _sql(
        "SELECT q.qid, q.docno, q.relevance, md5(fq.query) AS query_md5, md5(fd.text) AS doc_md5 FROM f_qrels q "
        "JOIN f_queries fq ON q.qid = fq.qid JOIN f_docs fd ON q.docno = fd.docno", "f_qrels", "f_queries", "f_docs"),
    "j3_attach_text_lenient": _sql(
        "SELECT DISTINCT p.qid, p.docno, p.pos, md5(pg.html) AS text_md5 FROM r1 p LEFT JOIN "
        "(SELECT CAST(page_id AS VARCHAR) AS docno, html FROM pages) pg ON p.docno = pg.docno", "r1"),
    "j4_attach_text_strict": _sql(
        "SELECT q.qid, q.docno, CAST(length(fq.query) AS INTEGER) AS query_len, md5(fd.text) AS text_md5 "
        "FROM f_qrels q JOIN f_queries fq ON q.qid = fq.qid JOIN f_docs fd ON q.docno = fd.docno",
        "f_qrels", "f_queries", "f_docs"),
    "j6_teacher_default": _sql(
        "SELECT DISTINCT p.qid, p.docno, p.pos, round(coalesce(t.score, 0.0), 6) AS teacher_score FROM r1 p "
        "LEFT JOIN teacher_scores t ON p.qid = t.qid AND p.docno = t.docno", "r1", "teacher_scores"),
    "j7_match_scores": _sql("SELECT qid, docno, round(s, 6) AS s, round(t, 6) AS t FROM kl_m", "kl_m"),
    "j9_used_docs": _sql("SELECT docno, md5(text) AS text_md5 FROM f_docs WHERE docno IN (SELECT docno FROM f_pairs)",
                         "f_docs", "f_pairs"),
    "j11_leaked_triples": _sql("SELECT * FROM f_triples", "f_triples"),
    "j12_queries_without_negatives": _sql(
        "SELECT DISTINCT qid FROM f_binary WHERE relevance = 1 AND qid NOT IN "
        "(SELECT qid FROM f_binary WHERE relevance = 0)", "f_binary"),
    "u1_contaminated_union": _sql(
        "SELECT origin, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries FROM f_triples GROUP BY origin",
        "f_triples"),
    "g1_triple_stats": _sql(
        "SELECT count(*) AS n_rows, count(DISTINCT query_id) AS n_queries, count(DISTINCT doc_id_a) AS n_positives, "
        "count(DISTINCT doc_id_b) AS n_negatives FROM f_triples", "f_triples"),
    "u2_append_samples": _sql("SELECT qid, docno, round(score, 6) AS score, model_type FROM sample_ld", "sample_ld"),
    "u3_merge_lookups": (
        "SELECT id, md5(arg_max(text, prio)) AS text_md5 FROM (SELECT CAST(doc_id AS VARCHAR) AS id, text, 0 AS prio "
        "FROM documents UNION ALL SELECT CAST(page_id AS VARCHAR), html, 1 FROM pages) GROUP BY id"),
    "u4_distinct_ids": _sql("SELECT DISTINCT docno FROM r1", "r1"),
    "r1_pivot_pairs": _sql("SELECT qid, docno, pos, count(*) AS n FROM r1 GROUP BY qid, docno, pos", "r1"),
    "r2_pivot_with_negatives": _sql(
        "SELECT qid, CAST(idx AS INTEGER) AS idx, docno, CAST(pos AS INTEGER) AS pos, count(*) AS n FROM ("
        "SELECT query_id AS qid, 0 AS idx, doc_id_a AS docno, 1 AS pos FROM f7 UNION ALL "
        "SELECT query_id, generate_subscripts(doc_id_b, 1), unnest(doc_id_b), NULL FROM f7) "
        "GROUP BY qid, idx, docno, pos", "f7"),
    "r3_explode_score_map": _sql("SELECT qid, docno, round(score, 6) AS score FROM teacher_scores", "teacher_scores"),
    "r4_collect_score_map": _sql(
        "SELECT qid, count(*) AS n_docs, round(sum(score), 6) AS score_sum FROM teacher_scores GROUP BY qid",
        "teacher_scores"),
    "r5_assemble_groups": _sql(
        "SELECT qid, array_to_string(list(docno ORDER BY i), ',') AS docnos, "
        "md5(string_agg(text, '|' ORDER BY i)) AS texts_md5, round(sum(coalesce(score, 0.0)), 6) AS label_sum FROM ("
        "SELECT g.qid, g.doc_id_a, u.i, u.docno, d.text, t.score FROM ("
        "SELECT query_id AS qid, doc_id_a, [doc_id_a] || list_transform(list_slice(list_sort(list_transform(doc_id_b, "
        "lambda x: [md5(concat_ws(':', '42', query_id, doc_id_a, x)), x])), 1, 2), lambda y: y[2]) AS docnos "
        "FROM f7) g, "
        "LATERAL (SELECT generate_subscripts(g.docnos, 1) AS i, unnest(g.docnos) AS docno) u "
        "JOIN f_docs d ON d.docno = u.docno LEFT JOIN teacher_scores t ON t.qid = g.qid AND t.docno = u.docno"
        ") GROUP BY qid, doc_id_a", "f7", "f_docs", "teacher_scores"),
    "r8_cross_layout": _sql(
        "SELECT qid, CAST(pos_idx AS INTEGER) AS pos_idx, docno, round(coalesce(t.score, 0.0), 6) AS label, "
        "count(*) AS n FROM (SELECT query_id AS qid, 0 AS pos_idx, doc_id_a AS docno FROM f_triples UNION ALL "
        "SELECT query_id, 1, doc_id_b FROM f_triples) x LEFT JOIN teacher_scores t USING (qid, docno) "
        "GROUP BY qid, pos_idx, docno, label", "f_triples", "teacher_scores"),
    "r10_pos_pairs": _sql("SELECT query_id AS qid, doc_id_a, unnest(doc_id_b) AS doc_id_b FROM f7", "f7"),
    "r11_duo_text": _sql(
        "SELECT t.query_id AS qid, t.doc_id_a, t.doc_id_b, md5("
        + _trunc("('[CLS] ' || q.query || ' [SEP] ' || a.text || ' [SEP] ' || b.text)", 512) + ") AS line_md5 FROM f_triples t JOIN f_queries q ON q.qid = t.query_id "
        "JOIN f_docs a ON a.docno = t.doc_id_a JOIN f_docs b ON b.docno = t.doc_id_b",
        "f_triples", "f_queries", "f_docs"),
    "a1_sample_docs": _sql("SELECT docno FROM f_docs ORDER BY md5(concat_ws(':', '7', docno)), docno LIMIT 100",
                           "f_docs"),
    "a4_one_negative": _sql("SELECT qid, neg FROM f_neg", "f_neg"),
    "a5_choose_one": _sql(
        "SELECT query_id, doc_id_a, list_sort(list_transform(doc_id_b, lambda x: "
        "[md5(concat_ws(':', '42', query_id, doc_id_a, x)), x]))[1][2] AS doc_id_b FROM f7", "f7"),
    "a6_sample_k": _sql(
        "SELECT query_id, doc_id_a, array_to_string(list_transform(list_slice(list_sort(list_transform(doc_id_b, "
        "lambda x: [md5(concat_ws(':', '42', query_id, doc_id_a, x)), x])), 1, 2), lambda y: y[2]), ',') AS doc_id_b "
        "FROM f7", "f7"),
    "g2_score_summary": _sql(
        "SELECT count(DISTINCT qid) AS n_queries, count(DISTINCT docno) AS n_docs FROM teacher_scores",
        "teacher_scores"),
    "g3_moments": _sql(
        "SELECT model_type, count(score) AS n, round(avg(score), 6) AS mean, round(var_samp(score), 6) AS variance, "
        "round(avg(pow(score - mu, 3)) / pow(avg(pow(score - mu, 2)), 1.5), 6) AS skewness, "
        "round(avg(pow(score - mu, 4)) / pow(avg(pow(score - mu, 2)), 2) - 3, 6) AS kurtosis FROM "
        "(SELECT *, avg(score) OVER (PARTITION BY model_type) AS mu FROM sample_ld) GROUP BY model_type",
        "sample_ld"),
    # the p-value by Simpson's rule over the density of Student's t from 0 to |t|
    "g4_t_test": _sql(
        "SELECT n1, n2, round(m1, 6) AS m1, round(m2, 6) AS m2, dof, round(t, 6) AS t, round(1 - 2 * exp(lgamma((dof + 1) / 2) "
        "- lgamma(dof / 2)) / sqrt(pi() * dof) * abs(t) / 6000 * (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 "
        "THEN 4 ELSE 2 END * pow(1 + pow(i * abs(t) / 2000, 2) / dof, -(dof + 1) / 2)) FROM range(2001) r(i)), 6) AS p FROM ("
        "SELECT n1, n2, m1, m2, n1 + n2 - 2 AS dof, "
        "(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t "
        "FROM (SELECT count(score) FILTER (WHERE model_type = 'teacher') AS n1, "
        "avg(score) FILTER (WHERE model_type = 'teacher') AS m1, var_samp(score) FILTER (WHERE model_type = 'teacher') AS v1, "
        "count(score) FILTER (WHERE model_type = 'student') AS n2, avg(score) FILTER (WHERE model_type = 'student') AS m2, "
        "var_samp(score) FILTER (WHERE model_type = 'student') AS v2 FROM sample_ld))", "sample_ld"),
    "g5_kl_divergence": _sql(
        "SELECT round(avg(CASE WHEN s_sum <> 0 AND t_sum <> 0 THEN kl END), 6) AS kl, "
        "CAST(count_if(s_sum <> 0 AND t_sum <> 0) AS BIGINT) AS n_matched, "
        "CAST(count_if(s_sum = 0 OR t_sum = 0) AS BIGINT) AS n_skipped FROM kl_pq",
        "kl_pq"),
    "g5_kl_per_query": _sql(
        "SELECT qid, n_docs, round(s_sum, 6) AS s_sum, round(t_sum, 6) AS t_sum, round(kl, 6) AS kl FROM kl_pq",
        "kl_pq"),
    "g6_skipped_queries": _sql(
        "SELECT qid, round(s_sum, 6) AS s_sum, round(t_sum, 6) AS t_sum FROM kl_pq WHERE s_sum = 0 OR t_sum = 0",
        "kl_pq"),
    "w1_add_ranks": _sql(
        "SELECT qid, docno, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, "
        "docno ASC) - 1 AS INTEGER) AS rank FROM f_event_run", "f_event_run"),
    "w3_top_k": _sql(
        "SELECT qid, docno, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, "
        "docno ASC) - 1 AS INTEGER) AS rank FROM f_event_run QUALIFY rank < 10", "f_event_run"),
    "w4_ecdf": _sql(
        "SELECT model_type, round(score, 6) AS score, n, round(sum(n) OVER (PARTITION BY model_type ORDER BY score "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(n) OVER (PARTITION BY model_type), 6) AS cdf "
        "FROM (SELECT model_type, score, count(*) AS n FROM f_sample GROUP BY model_type, score)", "f_sample"),
    "w5_ideal_positions": _sql(
        "SELECT qid, docno, relevance, CAST(row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, docno ASC) "
        "AS INTEGER) AS ipos FROM f_qrels", "f_qrels"),
    "w6_running_relevant": _sql(
        "SELECT r.qid, r.docno, row_number() OVER w AS pos, "
        "CAST(sum(CASE WHEN q.relevance >= 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS cum_rel FROM f_event_run r LEFT JOIN f_event_qrels q ON r.qid = q.qid AND r.docno = q.docno "
        "WINDOW w AS (PARTITION BY r.qid ORDER BY r.score DESC, r.docno DESC ROWS BETWEEN UNBOUNDED PRECEDING AND "
        "CURRENT ROW)", "f_event_run", "f_event_qrels"),
    "k1_bm25_top100": _sql("SELECT qid, docno, round(score, 6) AS score, rank FROM bm25_run", "bm25_run"),
    "k1_given_pairs": _sql("SELECT qid, docno, round(coalesce(b.score, 0.0), 6) AS score FROM f_pairs LEFT JOIN bm_sc b USING (qid, docno)", "f_pairs", "bm_sc"),
    "k1_maxscore_top100": _sql("SELECT qid, docno, round(score, 6) AS score, rank FROM bm25_run", "bm25_run"),
    "m7_bm25_metrics": metrics_query("SELECT 'bm25' AS name, qid, docno, score FROM bm25_run", "f_qrels",
                                     ["bm25_run", "f_qrels"]),
    "k2_cross_rerank": _sql(
        "SELECT qid, docno, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, "
        "first_rank ASC, docno ASC) - 1 AS INTEGER) AS rank FROM ov_scores", "ov_scores"),
    "k3_duo_logits": _sql(
        "SELECT qid, docno, round(-score, 6) AS logit0, round(score, 6) AS logit1, "
        "CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_rank ASC, docno ASC) - 1 AS INTEGER) "
        "AS rank FROM ov_scores", "ov_scores"),
    "k7_bi_rerank": _sql(
        "SELECT qid, docno, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, "
        "first_rank ASC, docno ASC) - 1 AS INTEGER) AS rank FROM (SELECT r.qid, r.docno, r.rank AS first_rank, "
        "CAST(coalesce(sum(qb.c * db.c), 0) AS DOUBLE) AS score FROM bm25_run r "
        "LEFT JOIN q_bow qb ON qb.qid = r.qid LEFT JOIN d_bow db ON db.docno = r.docno AND db.b = qb.b "
        "GROUP BY r.qid, r.docno, r.rank)", "bm25_run", "q_bow", "d_bow"),
    "k7_pair_dot": _sql("SELECT qid, docno, round(score, 6) AS score FROM teacher_scores", "teacher_scores"),
    "k11_cross_scores": _sql(
        f"SELECT p.qid, p.docno, CAST(len(list_intersect(list_distinct({TOK.format(x=chr(39)*2 + ' || coalesce(q.query, ' + chr(39)*2 + ')')}), "
        f"list_distinct({TOK.format(x='coalesce(d.text, ' + chr(39)*2 + ')')}))) AS DOUBLE) AS score FROM f_pairs p "
        "LEFT JOIN f_queries q ON p.qid = q.qid LEFT JOIN f_docs d ON p.docno = d.docno",
        "f_pairs", "f_queries", "f_docs"),
    "k12_bi_scores": _sql(
        "SELECT p.qid, p.docno, round(CAST(coalesce(sum(qb.c * db.c), 0) AS DOUBLE), 6) AS score FROM f_pairs p "
        "LEFT JOIN q_bow qb ON qb.qid = p.qid LEFT JOIN d_bow db ON db.docno = p.docno AND db.b = qb.b "
        "GROUP BY p.qid, p.docno", "f_pairs", "q_bow", "d_bow"),
    "k5_vector_store": _sql(
        "SELECT p.qid, p.docno, round(CAST(coalesce(sum(qb.c * db.c), 0) AS DOUBLE), 6) AS score, 0 AS encoded_again FROM f_pairs p "
        "LEFT JOIN q_bow qb ON qb.qid = p.qid LEFT JOIN d_bow db ON db.docno = p.docno AND db.b = qb.b "
        "GROUP BY p.qid, p.docno", "f_pairs", "q_bow", "d_bow"),
    "j8_bucketed_scores": _sql("SELECT qid, docno, round(score, 6) AS score, md5(text) AS text_md5 FROM teacher_scores JOIN f_docs USING (docno)",
                               "teacher_scores", "f_docs"),
    # the pooler: row j of W is ((b + j) % 5 - 2) / 2 over the buckets b; its bias by j
    "t6_saved_pipeline": _sql(
        f"SELECT p.qid, p.docno, CAST(len(list_intersect(list_distinct({TOK.format(x='q.query')}), list_distinct({TOK.format(x='d.text')}))) AS DOUBLE) AS cross, "
        "round(s.score, 6) AS score FROM f_pairs p JOIN f_queries q ON p.qid = q.qid JOIN f_docs d ON p.docno = d.docno JOIN ("
        "SELECT p.qid, p.docno, CAST(sum((coalesce(x.v, 0) + j.bias) * (coalesce(y.v, 0) + j.bias)) AS DOUBLE) AS score FROM f_pairs p "
        "CROSS JOIN (VALUES (0, 0.5), (1, -0.5), (2, 0.25), (3, 0.0)) j(j, bias) "
        "LEFT JOIN (SELECT qid, j, sum(c * ((b + j) % 5 - 2.0) / 2.0) AS v FROM q_bow, (SELECT unnest(range(4)) AS j) GROUP BY qid, j) x ON x.qid = p.qid AND x.j = j.j "
        "LEFT JOIN (SELECT docno, j, sum(c * ((b + j) % 5 - 2.0) / 2.0) AS v FROM d_bow, (SELECT unnest(range(4)) AS j) GROUP BY docno, j) y "
        "ON y.docno = p.docno AND y.j = j.j GROUP BY p.qid, p.docno) s ON s.qid = p.qid AND s.docno = p.docno",
        "f_pairs", "f_queries", "f_docs", "q_bow", "d_bow"),
    "m7_event_metrics": metrics_query("SELECT 'events' AS name, qid, docno, score FROM f_event_run", "f_event_qrels",
                                      ["f_event_run", "f_event_qrels"]),
    "m7_teacher_student_runs": metrics_query(
        "SELECT 'teacher' AS name, qid, docno, score FROM dense_run UNION ALL "
        "SELECT 'student', qid, docno, score FROM dense_run32", "f_vqrels", ["dense_run", "dense_run32", "f_vqrels"]),
    # losses on G=2 groups (column 0 = positive)
    "l1_mse": _losses_sql("pow(p0 - l0, 2) + pow(p1 - l1, 2)", "(2 * count(*))"),
    "l2_margin_mse": _losses_sql("pow((p0 - p1) - (l0 - l1), 2)"),
    "l3_hinge": _losses_sql(
        f"greatest(1.0 - sign({SIG.format(x='l0')} - {SIG.format(x='l1')}) * "
        f"greatest({SIG.format(x='p0')} - {SIG.format(x='p1')}, 0.0), 0.0)"),
    "l4_clear": _losses_sql("greatest(1.0 - (l0 - l1) - (p0 - p1), 0.0)"),
    "l5_lce": _losses_sql(f"-({LSM_T})"),
    "l6_contrastive": _losses_sql(f"-({LSM_T})"),
    "l7_kl_div": _losses_sql(
        "(CASE WHEN q0 = 0 THEN 0.0 ELSE q0 * (ln(q0) - lsm0) END) + "
        "(CASE WHEN q1 = 0 THEN 0.0 ELSE q1 * (ln(q1) - lsm1) END)"),
    "l8_ranknet": _losses_sql(
        "greatest(p0 - p1, 0.0) - (p0 - p1) * (CASE WHEN l0 > l1 THEN 1.0 ELSE 0.0 END) + ln(1 + exp(-abs(p0 - p1)))"),
    "l9_distill_ranknet": _losses_sql("(p0 - p1) + (l0 - l1 - 1) * 100.0 + 300.0", where="l0 > l1"),
    "l10_listnet": _sql(
        "SELECT round(avg(-(CASE WHEN f THEN l0 ELSE q0 END * lsm0 + CASE WHEN f THEN l1 ELSE q1 END * lsm1)), 6) "
        "AS loss FROM lgz, (SELECT coalesce(bool_and(l0 >= 0 AND l0 <= 1 AND l1 >= 0 AND l1 <= 1), true) AS f FROM lg)",
        "lgz"),
    "l11_poly1": _sql(
        "SELECT round(avg(-(h0 * lsm0 + h1 * lsm1) + (1 - (h0 * exp(lsm0) + h1 * exp(lsm1))) * 1.0), 6) AS loss FROM "
        "(SELECT *, CASE WHEN l0 + l1 <> 0 THEN l0 / (l0 + l1) END AS h0, "
        "CASE WHEN l0 + l1 <> 0 THEN l1 / (l0 + l1) END AS h1 FROM lgz)", "lgz"),
    "l6_contrastive_t2": _sql(
        "SELECT round(avg(-(CASE WHEN l0 >= l1 THEN p0 / 2 ELSE p1 / 2 END - "
        "(greatest(p0, p1) / 2 + ln(exp(p0 / 2 - greatest(p0, p1) / 2) + exp(p1 / 2 - greatest(p0, p1) / 2))))), 6) "
        "AS loss FROM lg", "lg"),
    "g8_reduction_sum": _sql("SELECT round(sum(pow((p0 - p1) - (l0 - l1), 2)), 6) AS loss FROM lg", "lg"),
    "l12_cat_wrapper": _sql(
        "SELECT round(avg(pow((c0 - c1) - (l0 - l1), 2)), 6) AS loss FROM "
        "(SELECT *, 1.0 / (1.0 + exp(0.0 - p0)) AS c0, 1.0 / (1.0 + exp(0.0 - p1)) AS c1 FROM lg)", "lg"),
    "l13_dot_wrapper": _sql(
        "SELECT round(sum((CASE WHEN q0 = 0 THEN 0.0 ELSE q0 * (ln(q0) - (p0 - plse)) END) + "
        "(CASE WHEN q1 = 0 THEN 0.0 ELSE q1 * (ln(q1) - (p1 - plse)) END)) / count(*), 6) AS loss FROM ("
        "SELECT *, exp(l0 - llse) AS q0, exp(l1 - llse) AS q1 FROM ("
        "SELECT *, greatest(p0, p1) + ln(exp(p0 - greatest(p0, p1)) + exp(p1 - greatest(p0, p1))) AS plse, "
        "greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS llse FROM ("
        "SELECT list_dot_product(q.vec, a.vec) AS p0, list_dot_product(q.vec, b.vec) AS p1, "
        "coalesce(ta.score, 0.0) AS l0, coalesce(tb.score, 0.0) AS l1 FROM f_triples t "
        "JOIN f_qvec32 q ON q.qid = t.query_id JOIN f_dvec32 a ON a.docno = t.doc_id_a "
        "JOIN f_dvec32 b ON b.docno = t.doc_id_b "
        "LEFT JOIN teacher_scores ta ON ta.qid = t.query_id AND ta.docno = t.doc_id_a "
        "LEFT JOIN teacher_scores tb ON tb.qid = t.query_id AND tb.docno = t.doc_id_b)))",
        "f_triples", "f_qvec32", "f_dvec32", "teacher_scores"),
    "l14_duo_wrapper": _sql("SELECT round(avg(-lsm0), 6) AS loss, round(avg(exp(lsm0)), 6) AS mean_score FROM lgz",
                            "lgz"),
    "l15_weighted_loss": _sql(
        "SELECT round(mm + 0.5 * kl, 6) AS loss, round(mm, 6) AS margin_mse, round(kl, 6) AS kl_div FROM ("
        "SELECT avg(pow((p0 - p1) - (l0 - l1), 2)) AS mm, "
        "sum((CASE WHEN q0 = 0 THEN 0.0 ELSE q0 * (ln(q0) - lsm0) END) + "
        "(CASE WHEN q1 = 0 THEN 0.0 ELSE q1 * (ln(q1) - lsm1) END)) / count(*) AS kl FROM lgz)", "lgz"),
    "l16_loss_log": _sql(
        "SELECT origin, round(sum(pow(p0 - l0, 2) + pow(p1 - l1, 2)) / (2 * count(*)), 4) AS loss FROM lg "
        "GROUP BY origin", "lg"),
    "l16_step_log": _sql(
        "SELECT step // 5 AS window, max(step) - min(step) + 1 AS n_steps, round(sum(loss) / (max(step) - min(step) + 1) / 2, 4) AS loss FROM ("
        "SELECT epoch, micro, epoch * CAST(ceil(ceil(any_value(n) / 8.0) / 2) AS BIGINT) + micro // 2 AS step, sum(sq) / (2 * count(*)) AS loss FROM ("
        "SELECT epoch, pow(p0 - l0, 2) + pow(p1 - l1, 2) AS sq, count(*) OVER (PARTITION BY epoch) AS n, (row_number() OVER (PARTITION BY epoch ORDER BY "
        f"{_EPOCH_KEY}) - 1) // 8 AS micro FROM (SELECT *, unnest([0, 1]) AS epoch FROM lg)) GROUP BY epoch, micro) GROUP BY 1", "lg"),
    "v6_in_batch_scores": _sql(
        "SELECT q.batch, q.qid, d.docno, round(list_dot_product(a.vec, b.vec), 6) AS score FROM (SELECT DISTINCT batch, query_id AS qid FROM "
        f"({_BATCHES})) q JOIN (SELECT DISTINCT batch, unnest([doc_id_a, doc_id_b]) AS docno FROM ({_BATCHES})) d ON q.batch = d.batch "
        "JOIN f_qvec a ON a.qid = q.qid JOIN f_dvec b ON b.docno = d.docno", "f_triples", "f_qvec", "f_dvec"),
    "l7_kl_div_listwise": _sql(
        "SELECT round(sum(CASE WHEN q = 0 THEN 0.0 ELSE q * (ln(q) - lsm) END) / "
        "(SELECT count(*) FROM f7), 6) AS loss FROM lw_z", "lw_z", "f7"),
    "l10_listnet_listwise": _sql(
        "SELECT round(avg(g), 6) AS loss FROM (SELECT query_id, doc_id_a, -sum(CASE WHEN f THEN t ELSE q END * lsm) AS g "
        "FROM lw_z, (SELECT coalesce(bool_and(t >= 0 AND t <= 1), true) AS f FROM lw_sc) GROUP BY query_id, doc_id_a)",
        "lw_z", "lw_sc"),
    "l8_ranknet_long": _pairs_sql(
        "greatest(a.s - b.s, 0.0) - (a.s - b.s) * (CASE WHEN a.t > b.t THEN 1.0 ELSE 0.0 END) + ln(1 + exp(-abs(a.s - b.s)))"),
    "l9_distill_ranknet_long": _pairs_sql("(a.s - b.s) + (a.t - b.t - 1) * 100.0 + 300.0", "WHERE a.t > b.t"),
    "a6_sample_ring": _sql(
        "SELECT p.query_id, p.doc_id_a, n.doc_id_b, idx FROM (SELECT *, CAST('0x' || left(md5('42:offset:' || query_id || ':' || doc_id_a), 15) AS BIGINT) AS f "
        "FROM (SELECT DISTINCT query_id, doc_id_a FROM f7)) p JOIN (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, "
        "row_number() OVER (PARTITION BY query_id ORDER BY md5('42:' || query_id || ':' || doc_id_b)) AS at "
        "FROM (SELECT DISTINCT query_id, unnest(doc_id_b) AS doc_id_b FROM f7)) n ON n.query_id = p.query_id "
        "JOIN (SELECT unnest(range(1, 4)) AS idx) k ON idx <= n.n AND n.at = (f + idx - 1) % n.n + 1", "f7"),
    "r2_pivot_long": _sql(
        "SELECT qid, CAST(idx AS INTEGER) AS idx, docno, CAST(pos AS INTEGER) AS pos, count(*) AS n FROM ("
        "SELECT query_id AS qid, 0 AS idx, doc_id_a AS docno, 1 AS pos FROM f7 UNION ALL "
        "SELECT f7.query_id, n.at, n.docno, NULL FROM f7 JOIN (SELECT query_id, doc_id_b AS docno, row_number() OVER (PARTITION BY query_id ORDER BY "
        "md5('42:' || query_id || ':' || doc_id_b)) AS at FROM (SELECT DISTINCT query_id, unnest(doc_id_b) AS doc_id_b FROM f7)) n USING (query_id)) "
        "GROUP BY qid, idx, docno, pos", "f7"),
    "r5_groups_long": _sql(
        f"SELECT gid, g.qid, pos_idx, g.docno, md5(q.query) AS query_md5, md5(d.text) AS text_md5, round(coalesce(t.score, 0.0), 6) AS label "
        f"FROM ({_LONG_POS} UNION ALL {_LONG_NEG.format(at='idx')}) g JOIN f_queries q USING (qid) JOIN f_docs d USING (docno) "
        "LEFT JOIN teacher_scores t ON t.qid = g.qid AND t.docno = g.docno", "f7", "f_binary", "f_queries", "f_docs", "teacher_scores"),
    "r6_listwise_long": _sql(_LONG_NEG.format(at="idx - 1"), "f7"),
    "r10_pairs_long": _sql(
        f"SELECT gid, qid, pos_idx AS idx, positive, docno AS negative FROM ({_LONG_NEG.format(at='idx')}) "
        f"JOIN (SELECT gid, docno AS positive FROM ({_LONG_POS})) USING (gid)", "f7", "f_binary"),
    "v_vector_functions": _sql(
        "SELECT query_id, doc_id_a, round((p0 - least(p0, p1)) / (greatest(p0, p1) - least(p0, p1) + 1e-10), 6) "
        "AS v1_minmax0, round(p0 - p1, 6) AS v2_residual, round(p0 - p1, 6) AS v3_residual, "
        "CAST((p0 > 0)::INT + (p1 > 0)::INT AS INTEGER) AS v7_positive, "
        "round(exp(p0 / 2 - (greatest(p0, p1) / 2 + ln(exp(p0 / 2 - greatest(p0, p1) / 2) + "
        "exp(p1 / 2 - greatest(p0, p1) / 2)))), 6) AS v8_softmax0, "
        "round(1.0 / (1.0 + exp(p0 - p1)), 6) AS v9_class1, round(exp(lsm0), 6) AS v10_first, "
        f"round({SIG.format(x='p0')}, 6) AS v11_sigmoid, CAST(CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS INTEGER) "
        "AS v13_argmax FROM lgz", "lgz"),
})

ORACLE["g7_per_query_long"] = (
    with_ctes("", "dense_run", "f_vqrels").rstrip() + ",\nm_run AS (SELECT 'dense' AS name, qid, docno, score "
    "FROM dense_run)," + metric_ctes("m_run", "f_vqrels") + "\n" + " UNION ALL ".join(
        f"SELECT name, qid AS query_id, '{lab}' AS metric, round({col}, 6) AS value FROM m_pq"
        for col, lab in zip(DEFAULT_COLUMNS, ("AP(rel=1)", "nDCG@10", "nDCG@5", "nDCG@1", "R(rel=1)@100",
                                             "R(rel=1)@1000", "P(rel=1)@10", "RR(rel=1)", "RR(rel=1)@10"))))

ORACLE["b1_histogram"] = (
    "WITH f_sample AS (" + CTE["f_sample"] + "), "
    "st AS (SELECT min(score) AS lo, max(score) AS hi, CAST(ceil(log2(count(score))) + 1 AS BIGINT) AS nb "
    "FROM f_sample), b AS (SELECT model_type, lo, (hi - lo) / nb AS width, CAST(CASE WHEN (hi - lo) / nb = 0 THEN 0 "
    "ELSE least(floor((score - lo) / ((hi - lo) / nb)), nb - 1) END AS BIGINT) AS bin FROM f_sample, st) "
    "SELECT bin, model_type, round(lo + bin * width, 6) AS bin_lo, round(lo + (bin + 1) * width, 6) AS bin_hi, "
    "count(*) AS count FROM b GROUP BY bin, model_type, lo, width")

ORACLE["b2_box_stats"] = (
    "WITH f_sample AS (" + CTE["f_sample"] + "), q AS (SELECT model_type, quantile_cont(score, 0.25) AS q1, "
    "quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3 FROM f_sample GROUP BY model_type) "
    "SELECT s.model_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
    "round(min(CASE WHEN score >= q1 - 1.5 * (q3 - q1) THEN score END), 6) AS whisker_lo, "
    "round(max(CASE WHEN score <= q3 + 1.5 * (q3 - q1) THEN score END), 6) AS whisker_hi, "
    "CAST(count_if(score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers "
    "FROM f_sample s JOIN q ON s.model_type = q.model_type GROUP BY s.model_type, q1, median, q3")

ORACLE["b3_kde"] = (
    "WITH f_sample AS (" + CTE["f_sample"] + "), st AS (SELECT model_type, count(score) AS n, stddev_samp(score) AS sd, "
    "min(score) AS lo, max(score) AS hi FROM f_sample GROUP BY model_type), "
    "bn AS (SELECT s.model_type, CAST(CASE WHEN (hi - lo) / 1024 = 0 THEN 0 ELSE least(floor((score - lo) / "
    "((hi - lo) / 1024)), 1023) END AS BIGINT) AS b, count(*) AS c FROM f_sample s JOIN st ON s.model_type = st.model_type "
    "GROUP BY s.model_type, b), ce AS (SELECT bn.model_type, lo + (b + 0.5) * (hi - lo) / 1024 AS x, c FROM bn "
    "JOIN st ON bn.model_type = st.model_type), par AS (SELECT model_type, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, lo, hi, n "
    "FROM st), g AS (SELECT model_type, bw, lo - 3.0 * bw AS start, (hi - lo + 6.0 * bw) / 199 AS step, "
    "n * bw * 2.5066282746310002 AS norm FROM par), grid AS (SELECT model_type, bw, norm, CAST(i AS INTEGER) AS i, "
    "start + i * step AS gx FROM g, range(200) r(i)) "
    "SELECT grid.model_type, i, round(gx, 6) AS x, round(sum(c * exp(-0.5 * pow((gx - x) / bw, 2))) / norm, 6) "
    "AS density FROM grid JOIN ce ON grid.model_type = ce.model_type GROUP BY grid.model_type, i, gx, norm")

ORACLE.update({
    "s1_s2_triples_tsv_gzip": _sql("SELECT query_id, doc_id_a, doc_id_b FROM f_triples", "f_triples"),
    "s5_s6_lookup_json": _sql("SELECT docno AS id, md5(text) AS text_md5 FROM f_docs", "f_docs"),
    "s9_s10_score_map_json": _sql("SELECT qid, docno, round(score, 6) AS score FROM teacher_scores",
                                  "teacher_scores"),
    "s11_score_records_json": _sql("SELECT qid, docno, round(score, 6) AS score FROM student_scores",
                                   "student_scores"),
    "s5_s6_lookup_document": _sql("SELECT docno AS id, md5(text) AS text_md5 FROM f_docs", "f_docs"),
    "s5_s6_lookup_document_gz": _sql("SELECT docno AS id, md5(text) AS text_md5 FROM f_docs", "f_docs"),
    "s9_s10_score_map_document": _sql("SELECT qid, docno, round(score, 6) AS score FROM teacher_scores",
                                      "teacher_scores"),
    "s7_s8_records_document": _sql("SELECT qid, docno, round(score, 6) AS score FROM student_scores",
                                   "student_scores"),
    "s12_s13_trec_run": _sql(
        "SELECT qid, docno, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno ASC) - 1 AS INTEGER) "
        "AS rank, round(score, 6) AS score, 'taintrank' AS tag FROM f_event_run QUALIFY rank < 10",
        "f_event_run"),
})


ORACLE.update({
    "k8_pooling": ("SELECT CAST(vec_id AS VARCHAR) AS id, "
                   "round(list_sum(CAST(embedding[1:8] AS DOUBLE[])), 6) AS cls_sum, "
                   "round(list_sum(CAST(embedding AS DOUBLE[])) / 8.0, 6) AS mean_sum, "
                   "round((CAST(embedding[1] AS DOUBLE) + CAST(embedding[9] AS DOUBLE) + CAST(embedding[17] AS DOUBLE) + CAST(embedding[25] AS DOUBLE) + CAST(embedding[33] AS DOUBLE) + CAST(embedding[41] AS DOUBLE) + CAST(embedding[49] AS DOUBLE) + CAST(embedding[57] AS DOUBLE)) / 8.0, 6) AS mean_first FROM embeddings"),
    "k9_linear_pooler": ("SELECT CAST(vec_id AS VARCHAR) AS id, "
                         "round(0.0 + 0.1 * CAST(embedding[1] AS DOUBLE) + 0.05 * CAST(embedding[2] AS DOUBLE) + 0.0 * CAST(embedding[3] AS DOUBLE) + -0.05 * CAST(embedding[4] AS DOUBLE) + -0.1 * CAST(embedding[5] AS DOUBLE) + -0.15 * CAST(embedding[6] AS DOUBLE) + -0.2 * CAST(embedding[7] AS DOUBLE) + -0.25 * CAST(embedding[8] AS DOUBLE) + 0.5, 6) AS y0, round(0.0 + 0.2 * CAST(embedding[1] AS DOUBLE) + 0.15 * CAST(embedding[2] AS DOUBLE) + 0.1 * CAST(embedding[3] AS DOUBLE) + 0.05 * CAST(embedding[4] AS DOUBLE) + 0.0 * CAST(embedding[5] AS DOUBLE) + -0.05 * CAST(embedding[6] AS DOUBLE) + -0.1 * CAST(embedding[7] AS DOUBLE) + -0.15 * CAST(embedding[8] AS DOUBLE) + -0.5, 6) AS y1, round(0.0 + 0.3 * CAST(embedding[1] AS DOUBLE) + 0.25 * CAST(embedding[2] AS DOUBLE) + 0.2 * CAST(embedding[3] AS DOUBLE) + 0.15 * CAST(embedding[4] AS DOUBLE) + 0.1 * CAST(embedding[5] AS DOUBLE) + 0.05 * CAST(embedding[6] AS DOUBLE) + 0.0 * CAST(embedding[7] AS DOUBLE) + -0.05 * CAST(embedding[8] AS DOUBLE) + 0.25, 6) AS y2, round(0.0 + 0.4 * CAST(embedding[1] AS DOUBLE) + 0.35 * CAST(embedding[2] AS DOUBLE) + 0.3 * CAST(embedding[3] AS DOUBLE) + 0.25 * CAST(embedding[4] AS DOUBLE) + 0.2 * CAST(embedding[5] AS DOUBLE) + 0.15 * CAST(embedding[6] AS DOUBLE) + 0.1 * CAST(embedding[7] AS DOUBLE) + 0.05 * CAST(embedding[8] AS DOUBLE) + 0.0, 6) AS y3 FROM embeddings"),
    "k4_encode_queries": _sql(f"SELECT md5(query) AS query_md5, round(CAST(len({TOK.format(x='query')}) "
                              "AS DOUBLE), 6) AS n_tokens FROM (SELECT DISTINCT query FROM f_queries)", "f_queries"),
    "k13_teacher_scores_subset": _sql(
        f"SELECT qid, docno, round(CAST(len(list_intersect(list_distinct({TOK.format(x='q')}), "
        f"list_distinct({TOK.format(x='t')}))) AS DOUBLE), 6) AS score FROM ("
        "SELECT p.qid, p.docno, coalesce(fq.query, '') AS q, coalesce(fd.text, '') AS t FROM f_pairs p "
        "LEFT JOIN f_queries fq ON p.qid = fq.qid LEFT JOIN f_docs fd ON p.docno = fd.docno "
        "ORDER BY md5(concat_ws(':', '42', p.qid, p.docno)), p.qid, p.docno LIMIT 50)",
        "f_pairs", "f_queries", "f_docs"),
    "p2_p3_run_vocabulary": "SELECT CAST(item_id AS VARCHAR) AS qid, md5(text) AS query_md5 FROM benchmark",
    "r6_listwise_groups": _sql(
        "SELECT query_id AS qid, array_to_string(list_transform(list_slice(list_sort(list_transform(doc_id_b, "
        "lambda x: [md5(concat_ws(':', '42', query_id, doc_id_a, x)), x])), 1, 2), lambda y: y[2]), ',') AS docnos "
        "FROM f7", "f7"),
    "s17_profile": _sql("SELECT count(*) AS n_rows, count(DISTINCT qid) AS n_distinct_qid, "
                        "count(DISTINCT docno) AS n_distinct_docno FROM f_qrels", "f_qrels"),
})


# ``0.0 + round(x)`` turns a rounded -0.0 into 0.0, as ``registry.round_doubles`` does.
for _k, _v in list(ORACLE.items()):
    ORACLE[_k] = _v.replace("round(", "0.0 + round(")
