"""Distillation re-aimed as MLlib fits over pair features.

A 2-document contrastive objective on a linear scorer s(q,d) = w . phi(q,d)
is logistic regression on phi(pos) - phi(neg) without intercept:

* T1/T2 teacher, hard labels: every triple gives (+diff, 1) and (-diff, 0);
* T3 student, KL to the teacher: soft label p = sigmoid(t_pos - t_neg),
  each pair twice with label 1 weight p and label 0 weight 1 - p;
* T4 student, teacher's argmax: label 1 if t_pos >= t_neg (tie -> first).

MLlib's L-BFGS runs distributed over the partitions of the training
table; features are assembled natively.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import tokens
from ..operators import joins, retrieval

# a feature of the query alone would cancel out of every difference
FEATURES = ("dot", "overlap", "log_doc_len", "k1")


def pair_features(pairs: DataFrame, queries: DataFrame, docs: DataFrame,
                  query_vecs: DataFrame, doc_vecs: DataFrame, k1: DataFrame | None = None) -> DataFrame:
    """phi(q, d) = [vector dot, shared distinct tokens, log1p doc length, BM25].

    Pairs without vectors score 0 on the dot (lenient, like J6). ``k1[qid, docno, score]`` are BM25 scores of the pairs where they
    are known already (a pair that is not there scores 0); else they come from :func:`retrieval.bm25_pairs` over all ``docs``.
    """
    p = pairs.select("qid", "docno").distinct()
    k1 = retrieval.bm25_pairs(p, queries, docs) if k1 is None else k1
    p = joins.attach_scores(p, k1, as_col="k1")
    p = joins.attach_text(p, queries, "qid", "query")
    p = joins.attach_text(p, docs, "docno", "text")
    p = (p.join(query_vecs.select("qid", F.col("vec").alias("qv")), "qid", "left")
         .join(doc_vecs.select("docno", F.col("vec").alias("dv")), "docno", "left"))
    qt, dt = tokens(F.coalesce("query", F.lit(""))), tokens(F.coalesce("text", F.lit("")))
    return p.select("qid", "docno", F.array(
        F.coalesce(V.dot("qv", "dv"), F.lit(0.0)),
        F.size(F.array_intersect(F.array_distinct(qt), F.array_distinct(dt))).cast("double"),
        F.log1p(F.size(dt).cast("double")), F.col("k1")).alias("phi"))


def _diffs(triples: DataFrame, features: DataFrame) -> DataFrame:
    f = features.select("qid", "docno", "phi")
    a = f.withColumnsRenamed({"docno": "doc_id_a", "phi": "phi_a", "qid": "query_id"})
    b = f.withColumnsRenamed({"docno": "doc_id_b", "phi": "phi_b", "qid": "query_id"})
    return (triples.join(a, ["query_id", "doc_id_a"]).join(b, ["query_id", "doc_id_b"])
            .withColumn("diff", F.zip_with("phi_a", "phi_b", lambda x, y: x - y)))


def _mirror(d: DataFrame, p: F.Column) -> DataFrame:
    """Each pair twice: (+diff, label 1) and (-diff, label 0), both with weight ``p``."""
    pos = d.select(array_to_vector("diff").alias("features"), F.lit(1.0).alias("label"), p.alias("weight"))
    neg = d.select(array_to_vector(F.transform("diff", lambda x: -x)).alias("features"),
                   F.lit(0.0).alias("label"), p.alias("weight"))
    return pos.unionByName(neg)


def _fit(train: DataFrame, reg: float, max_iter: int) -> LogisticRegressionModel:
    lr = LogisticRegression(fitIntercept=False, regParam=reg, maxIter=max_iter, tol=1e-10,
                            weightCol="weight", standardization=False)
    return lr.fit(train)


def train_teacher(triples: DataFrame, features: DataFrame, reg: float = 0.0,
                  max_iter: int = 100) -> LogisticRegressionModel:
    """T1 (clean triples) / T2 (contaminated triples): hard pairwise labels."""
    return _fit(_mirror(_diffs(triples, features), F.lit(1.0)), reg, max_iter)


def _teacher_diff(triples: DataFrame, teacher: DataFrame) -> DataFrame:
    t = teacher.select(F.col("qid").alias("query_id"), "docno", "score")
    ta = t.withColumnsRenamed({"docno": "doc_id_a", "score": "t_a"})
    tb = t.withColumnsRenamed({"docno": "doc_id_b", "score": "t_b"})
    return (triples.select("query_id", "doc_id_a", "doc_id_b")
            .join(ta, ["query_id", "doc_id_a"], "left").join(tb, ["query_id", "doc_id_b"], "left")
            .fillna(0.0, ["t_a", "t_b"]))


def train_student_kl(triples: DataFrame, features: DataFrame, teacher: DataFrame,
                     reg: float = 0.0, max_iter: int = 100) -> LogisticRegressionModel:
    """Soft labels from the teacher's 2-doc softmax (KL objective)."""
    d = _diffs(_teacher_diff(triples, teacher), features)
    # per pair: (diff, 1, p), (diff, 0, 1-p) and the mirrored (-diff, 0, p), (-diff, 1, 1-p);
    # the mirror doubles the objective without moving its optimum.
    p = V.sigmoid(F.col("t_a") - F.col("t_b"))
    hard = _mirror(d, p)
    soft = (d.select(array_to_vector("diff").alias("features"), F.lit(0.0).alias("label"), (1 - p).alias("weight"))
            .unionByName(d.select(array_to_vector(F.transform("diff", lambda x: -x)).alias("features"),
                                  F.lit(1.0).alias("label"), (1 - p).alias("weight"))))
    return _fit(hard.unionByName(soft), reg, max_iter)


def train_student_argmax(triples: DataFrame, features: DataFrame, teacher: DataFrame,
                         reg: float = 0.0, max_iter: int = 100) -> LogisticRegressionModel:
    """T4: the teacher's preferred document is the label (tie -> the first)."""
    d = _diffs(_teacher_diff(triples, teacher), features)
    first = F.col("t_a") >= F.col("t_b")
    d = d.withColumn("diff", F.when(first, F.col("diff")).otherwise(F.transform("diff", lambda x: -x)))
    return _fit(_mirror(d, F.lit(1.0)), reg, max_iter)


def coefficients(model: LogisticRegressionModel, names: Sequence[str] = FEATURES) -> list[tuple[str, float]]:
    return list(zip(names, model.coefficients.toArray().tolist()))


def apply_linear(features: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Score pairs with the fitted linear scorer (native dot with a literal weight array)."""
    w = F.array(*[F.lit(float(x)) for x in model.coefficients.toArray()])
    return features.select("qid", "docno", V.dot("phi", w).alias("score"))


def save_model(model: LogisticRegressionModel, path: str) -> None:
    """MLlib writer (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)
