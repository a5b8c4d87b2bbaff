"""Column-expression helpers: text (P6, P11, R11), vectors (V*), statistics."""

from . import stats, text, vectors  # noqa: F401
