"""Embedding of event texts that lack a vector, with an injected encoder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def backfill(texts: DataFrame, embedded: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """(id, embedding) of the texts (`id`, `body`) whose id has no vector yet."""
    todo = texts.filter(F.col("body").isNotNull()).join(embedded.select("id"), "id", "left_anti")
    if encoder is None:
        return todo.select("id", _hashed_udf()("body").alias("embedding"))

    @F.pandas_udf("array<float>")
    def encode(bodies: pd.Series) -> pd.Series:
        return pd.Series([v.astype("float32") for v in np.asarray(encoder(bodies.tolist()))])

    return todo.select("id", encode("body").alias("embedding"))


def _hashed_udf(width: int = 256):
    """Default vectors: normalised hashed term counts, one pass per text, in Arrow batches."""
    import zlib

    @F.pandas_udf("array<float>")
    def encode(bodies: pd.Series) -> pd.Series:
        out = []
        for body in bodies:
            slots = [zlib.crc32(w.encode()) % width for w in body.lower().split()]
            v = np.bincount(slots, minlength=width).astype("float32") if slots else np.zeros(width, "float32")
            out.append(v / max(1e-9, float(np.linalg.norm(v))))
        return pd.Series(out)

    return encode
