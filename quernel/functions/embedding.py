"""Embedding of texts: an injected model, or a deterministic fallback."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
BATCH = 100
Embedder = Callable[[list[str]], list[list[float]]]


def fallback_vector(text: Column | str, dim: int = DIM) -> Column:
    """Component i is byte-wide window i mod 64 of the first 64 bits of the text's SHA-256, over 255."""
    t = F.col(text) if isinstance(text, str) else text
    h = F.conv(F.substring(F.sha2(t, 256), 1, 16), 16, -10).cast("bigint")
    steps = [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(255).cast("bigint")) / 255.0 for k in range(64)]
    block = F.array(*[s.cast("float") for s in steps[: min(dim, 64)]])
    return F.slice(F.flatten(F.array_repeat(block, -(-dim // 64))), 1, dim) if dim > 64 else block


def fallback_values(text: str, dim: int = DIM) -> list[float]:
    """The same vector for one text on the driver; as in a float column, values are rounded to single precision."""
    h = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
    block = [float(np.float32(((h >> k) & 255) / 255.0)) for k in range(min(dim, 64))]
    return (block * -(-dim // 64))[:dim]


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, dim: int = DIM, model: str = "default", batch: int = BATCH) -> DataFrame:
    """Adds ``vector`` and ``model``. Texts go to ``embedder`` in batches; a batch that fails, or vectors of another
    length, get fallback vectors and the model's name with ``-fallback``. Without an embedder all are fallback."""
    plain = fallback_vector(text, dim)
    if embedder is None:
        return df.withColumns({"vector": plain, "model": F.lit(f"{model}-fallback")})

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        values = texts.tolist()
        for k in range(0, len(values), batch):
            part = values[k : k + batch]
            try:
                got = embedder(part)
                good = len(got) == len(part)
            except Exception:  # noqa: BLE001 - a failing service must not end the job
                got, good = [], False
            out += [v if v is not None and len(v) == dim else None for v in got] if good else [None] * len(part)
        return pd.Series(out, dtype=object)

    df = df.withColumn("__v", run(text))
    name = F.when(F.col("__v").isNull(), F.lit(f"{model}-fallback")).otherwise(F.lit(model))
    return df.withColumns({"vector": F.coalesce("__v", plain), "model": name}).drop("__v")
