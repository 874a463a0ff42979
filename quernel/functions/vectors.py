"""Vector expressions. All arithmetic is in DOUBLE."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; 0 where the lengths differ, a side is empty or null, or a norm is 0."""
    a, b = _col(a), _col(b)
    n = (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0)
    return F.coalesce(F.when(fits, dot(a, b) / n), F.lit(0.0))


def cosine_to(query: list[float]):
    """A function ``column -> Column`` that scores a vector column against one query with numpy over Arrow batches; for
    large scans, where interpreted array functions are the bottleneck. Same values as ``cosine``."""
    q = np.asarray(query, dtype=np.float64)
    length = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors))
        fit = np.array([v is not None and len(v) == len(q) for v in vectors], dtype=bool)
        if fit.any() and length > 0:
            m = np.stack(vectors[fit].to_list()).astype(np.float64)
            n = np.sqrt((m * m).sum(axis=1)) * length
            out[fit] = np.divide(m @ q, n, out=np.zeros(len(n)), where=n > 0)
        return pd.Series(out)

    return score


def contains_any(symbol: Column | str, expected: Column | str) -> Column:
    """Whether one of the expected names contains the symbol or is contained in it."""
    s = _col(symbol)
    return F.coalesce(F.exists(_col(expected), lambda e: s.contains(e) | e.contains(s)), F.lit(False))
