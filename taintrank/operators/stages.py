"""Scorers, encoders and poolers as ``pyspark.ml`` stages that are saved and loaded with their configuration.

A stage names its model by import path (``module:name``) and keeps the model's arguments as JSON, so a saved stage holds all it
needs but the code. Stages go into one ``PipelineModel`` - also next to MLlib's own - whose writer and reader
save and load them together::

    model = PipelineModel([CrossScorer(model="taintrank.operators.scoring:TokenOverlapScorer", outputCol="cross"),
                           *bi_encoder("taintrank.operators.scoring:HashedBowEncoder", {"dim": 64})])
    model.write().overwrite().save(path)
    PipelineModel.load(path).transform(pairs)            # the same scores, in any session

Null texts are read as empty; rows are never dropped or merged, and columns that a stage does not name pass through.
"""

from __future__ import annotations

import functools
import importlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import scoring
from .rank import add_ranks


def make_model(path: str, settings: str) -> Any:
    """The model that ``module:name`` names, called with the JSON object ``settings``."""
    module, _, name = path.partition(":")
    if not module or not name:
        raise ValueError(f"a model is named as module:name, not {path!r}")
    return getattr(importlib.import_module(module), name)(**json.loads(settings))


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Keyword construction, the way MLlib's stages have it."""

    def _start(self, defaults: dict, given: dict) -> None:
        self._setDefault(**defaults)
        if "settings" in given and not isinstance(given["settings"], str):
            given = given | {"settings": json.dumps(given["settings"], sort_keys=True)}
        self._set(**given)

    def _of(self, name: str) -> Any:
        return self.getOrDefault(name)


class _HasModel(Params):
    model = Param(Params._dummy(), "model", "import path module:name of the model", typeConverter=TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "keyword arguments of the model, a JSON object", typeConverter=TypeConverters.toString)
    batchSize = Param(Params._dummy(), "batchSize", "rows the model sees at once", typeConverter=TypeConverters.toInt)
    outputCol = Param(Params._dummy(), "outputCol", "column that the stage adds", typeConverter=TypeConverters.toString)

    def factory(self) -> functools.partial:
        return functools.partial(make_model, self.getOrDefault("model"), self.getOrDefault("settings"))


class CrossScorer(_Stage, _HasModel):
    """K2 / K3: a score (or all logits) for the query and the text of each row."""

    queryCol = Param(Params._dummy(), "queryCol", "query text", typeConverter=TypeConverters.toString)
    textCol = Param(Params._dummy(), "textCol", "document text", typeConverter=TypeConverters.toString)
    logits = Param(Params._dummy(), "logits", "keep the model's full output", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, model=None, settings="{}", queryCol="query", textCol="text", outputCol="score", logits=False,
                 batchSize=scoring.DEFAULT_BATCH):
        super().__init__()
        self._start({"settings": "{}", "queryCol": "query", "textCol": "text", "outputCol": "score", "logits": False, "batchSize": scoring.DEFAULT_BATCH},
                    self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return scoring.score_pairs(dataset, self.factory(), self._of("queryCol"), self._of("textCol"), self._of("outputCol"), self._of("batchSize"),
                                   self._of("logits"))


class TextEncoder(_Stage, _HasModel):
    """K4 / K5: the vector of a text column; each distinct text is encoded once."""

    inputCol = Param(Params._dummy(), "inputCol", "text to encode", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, model=None, settings="{}", inputCol="text", outputCol="vec", batchSize=scoring.DEFAULT_BATCH):
        super().__init__()
        self._start({"settings": "{}", "inputCol": "text", "outputCol": "vec", "batchSize": scoring.DEFAULT_BATCH}, self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = F.col(self._of("inputCol"))
        keys = {"_h1": F.xxhash64(text), "_h2": F.xxhash64(text, F.lit(1))}
        once = dataset.select(text.alias("text"), *[c.alias(k) for k, c in keys.items()]).dropDuplicates(list(keys))
        vecs = scoring.encode(once, self.factory(), "text", self._of("outputCol"), self._of("batchSize")).drop("text")
        return dataset.withColumns(keys).join(vecs, list(keys), "left").drop(*keys)


class Pooler(_Stage):
    """K8 / K9: pool token states (``none`` for a vector), then ``W x + b`` where weights are given."""

    inputCol = Param(Params._dummy(), "inputCol", "states or vector", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "pooled vector", typeConverter=TypeConverters.toString)
    mode = Param(Params._dummy(), "mode", "none, cls or mean", typeConverter=TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "rows of W", typeConverter=TypeConverters.toListListFloat)
    bias = Param(Params._dummy(), "bias", "b, zero where not given", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol="vec", outputCol="pooled", mode="none", weights=None, bias=None):
        super().__init__()
        self._start({"inputCol": "vec", "outputCol": "pooled", "mode": "none"}, {k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = V.pool(self._of("inputCol"), self._of("mode"))
        if self.isDefined("weights"):
            rows = self._of("weights")
            bias = self._of("bias") if self.isDefined("bias") else [0.0] * len(rows)
            if len(bias) != len(rows):
                raise ValueError("bias and weights need as many rows")
            x = V.linear(_literal(rows), F.array(*[F.lit(b) for b in bias]), x)
        return dataset.withColumn(self._of("outputCol"), x)


def _literal(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in rows])


class VectorDot(_Stage):
    """K7: the dot product of two vector columns and, where ``rank`` is set, W1 ranks by ``qid``."""

    queryCol = Param(Params._dummy(), "queryCol", "query vector", typeConverter=TypeConverters.toString)
    docCol = Param(Params._dummy(), "docCol", "document vector", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "score", typeConverter=TypeConverters.toString)
    rank = Param(Params._dummy(), "rank", "add ranks", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, queryCol="query_vec", docCol="doc_vec", outputCol="score", rank=False):
        super().__init__()
        self._start({"queryCol": "query_vec", "docCol": "doc_vec", "outputCol": "score", "rank": False}, self._input_kwargs)
        if self._of("rank") and self._of("outputCol") != "score":
            raise ValueError("ranks are by the column score")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset.withColumn(self._of("outputCol"), V.dot(self._of("queryCol"), self._of("docCol")))
        return add_ranks(out) if self._of("rank") else out


class LinearScorer(_Stage):
    """The fitted scorer of T1 to T4: the dot product of the feature array with its weights."""

    inputCol = Param(Params._dummy(), "inputCol", "feature array", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "score", typeConverter=TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "a weight per feature", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol="phi", outputCol="score", weights=None):
        super().__init__()
        self._start({"inputCol": "phi", "outputCol": "score"}, self._input_kwargs)

    @classmethod
    def of(cls, fitted, **kw) -> LinearScorer:
        """From what MLlib fitted (``distill.train_teacher`` and its like)."""
        return cls(weights=[float(x) for x in fitted.coefficients.toArray()], **kw)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self._of("outputCol"), V.dot(self._of("inputCol"), F.array(*[F.lit(w) for w in self._of("weights")])))


def bi_encoder(model: str, settings: dict | None = None, doc_model: str | None = None, doc_settings: dict | None = None,
               weights: Sequence[Sequence[float]] | None = None, bias: Sequence[float] | None = None, rank: bool = False) -> list[Transformer]:
    """The stages of a bi-encoder on ``query`` and ``text``: two encoders (tied unless ``doc_model`` is given), poolers, dot product."""
    tied = doc_model is None
    stages: list[Transformer] = []
    for side, text, path, kw in (("query", "query", model, settings), ("doc", "text", model if tied else doc_model, settings if tied else doc_settings)):
        stages.append(TextEncoder(model=path, settings=kw or {}, inputCol=text, outputCol=f"{side}_vec"))
        if weights is not None:
            stages.append(Pooler(inputCol=f"{side}_vec", outputCol=f"{side}_vec", weights=weights, bias=bias))
    return [*stages, VectorDot(rank=rank)]
