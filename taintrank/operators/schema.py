"""Projections, predicates and schema checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reference's graded -> binary relevance map.
BINARY_RELEVANCE = {0: 0, 1: 0, 2: 1, 3: 1}


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """Raise ``ValueError`` naming the first missing column (no job runs)."""
    have = set(df.columns)
    for c in columns:
        if c not in have:
            raise ValueError(f"{c} not found in {what}; columns are {df.columns}")
    return df


def to_run_vocabulary(df: DataFrame) -> DataFrame:
    """``query_id -> qid``, ``text -> query``."""
    return df.withColumnsRenamed({k: v for k, v in {"query_id": "qid", "text": "query"}.items()
                                  if k in df.columns})


def ids_to_string(df: DataFrame, *cols: str) -> DataFrame:
    """Identifiers are always strings."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def binary_relevance(col: str | Column = "relevance",
                     mapping: Mapping[int, int] = BINARY_RELEVANCE) -> Column:
    """P4 expression: graded -> binary; grades outside the map become null."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for grade, label in mapping.items():
        expr = (F.when(c == grade, F.lit(label)) if expr is None
                else expr.when(c == grade, F.lit(label)))
    return expr.cast("int")


def binarize_relevance(qrels: DataFrame, mapping: Mapping[int, int] = BINARY_RELEVANCE) -> DataFrame:
    """P4 on a qrels frame (column ``relevance`` replaced)."""
    return qrels.withColumn("relevance", binary_relevance("relevance", mapping))


def split_labels(qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P5: (positives, negatives) of a binarised qrels frame; nulls in neither."""
    return (qrels.where(F.col("relevance") == 1), qrels.where(F.col("relevance") == 0))


def with_label(df: DataFrame, model_type: str, col: str = "model_type") -> DataFrame:
    """Constant label column."""
    return df.withColumn(col, F.lit(model_type))


def negatives_as_list(triples: DataFrame, col: str = "doc_id_b") -> DataFrame:
    """Scalar negative -> one-element array (arrays pass through)."""
    if triples.schema[col].dataType.typeName() == "array":
        return triples
    return triples.withColumn(col, F.array(F.col(col)))


def score_column(logits: str | Column, kind: str = "cross") -> Column:
    """P10: class-1 logit for the cross scorer, all logits for the pair scorer."""
    c = F.col(logits) if isinstance(logits, str) else logits
    if kind == "cross":
        return F.element_at(c, 2)
    if kind == "duo":
        return c
    raise ValueError(f"unknown scorer kind {kind}")
