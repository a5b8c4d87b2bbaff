"""Array-column math (V1-V13) as native higher-order expressions.

Everything here returns a ``Column`` and stays inside Catalyst; none of it
calls into Python per row. Arrays are treated as ``array<double>`` (float
inputs are widened before multiplying so products are exact).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(arr) -> Column:
    return F.transform(_c(arr), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """V4 / K7: row-wise dot product of two equal-length arrays."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def array_sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double"))


def grouped_dot(q, docs) -> Column:
    """V6: one query vector against each vector of its group."""
    return F.transform(_c(docs), lambda d: dot(_c(q), d))


def minmax_normalize(a) -> Column:
    """V1: (x - min) / (max - min + 1e-10) along the array."""
    a = _c(a)
    lo, hi = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda x: (x - lo) / (hi - lo + F.lit(1e-10)))


def residual_pair(a) -> Column:
    """V2: positive minus first negative; a single element is returned as is."""
    a = _c(a)
    return F.when(F.size(a) == 1, F.element_at(a, 1)).otherwise(
        F.element_at(a, 1) - F.element_at(a, 2))


def residual(a) -> Column:
    """V3: ``a[0] - a[i]`` for every i >= 1 (empty for a single element)."""
    a = _c(a)
    head = F.element_at(a, 1)
    rest = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    return F.transform(rest, lambda x: head - x)


def num_positive(a) -> Column:
    """V7 (per row): entries > 0; average it with ``F.avg`` for the table."""
    return F.size(F.filter(_c(a), lambda x: x > 0))


def scale(a, factor: float) -> Column:
    return F.transform(_c(a), lambda x: x / F.lit(float(factor)))


def log_softmax(a, temperature: float = 1.0) -> Column:
    """V8: max-shifted log-softmax of ``a / T``."""
    a = scale(a, temperature) if temperature != 1.0 else as_double(a)
    m = F.array_max(a)
    lse = m + F.log(F.aggregate(a, F.lit(0.0).cast("double"),
                                lambda acc, x: acc + F.exp(x - m)))
    return F.transform(a, lambda x: x - lse)


def softmax(a, temperature: float = 1.0) -> Column:
    """V8: softmax of ``a / T``."""
    return F.transform(log_softmax(a, temperature), lambda x: F.exp(x))


def class1_prob(logits) -> Column:
    """V9: softmax over two logits, probability of class 1."""
    l = _c(logits)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.element_at(l, 1) - F.element_at(l, 2)))


def first_class_prob(logits) -> Column:
    """Softmax probability of the first logit (duo score)."""
    return F.element_at(softmax(logits), 1)


def sigmoid(x) -> Column:
    """V11."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def relu(x) -> Column:
    """V11."""
    return F.greatest(_c(x), F.lit(0.0))


def sign(x) -> Column:
    """V11."""
    return F.signum(_c(x))


def argmax(a) -> Column:
    """0-based index of the first maximum."""
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def linear(weights, bias, x) -> Column:
    """K9: ``W x + b`` with W given as array<array<double>> and b as array<double>."""
    return F.zip_with(F.transform(_c(weights), lambda row: dot(row, _c(x))), _c(bias),
                      lambda wx, b: wx + b)


def pool(states, mode: str = "cls", mask=None) -> Column:
    """K8: pool token states (array<array<double>>) into one vector.

    ``cls`` takes the first state, ``mean`` averages per dimension (over
    masked positions when ``mask`` is given), ``none`` returns the input.
    """
    s = _c(states)
    if mode == "none":
        return s
    if mode == "cls":
        return F.element_at(s, 1)
    if mode == "mean":
        dims = F.sequence(F.lit(1), F.size(F.element_at(s, 1)))
        if mask is None:
            n = F.size(s).cast("double")
            return F.transform(dims, lambda i: array_sum(F.transform(s, lambda r: F.element_at(r, i))) / n)
        m = _c(mask)
        n = array_sum(m)
        return F.transform(dims, lambda i: array_sum(
            F.zip_with(s, m, lambda r, w: F.element_at(r, i) * w)) / n)
    raise ValueError(f"Unknown pooling type: {mode}")
