"""Vector functions over arrays of floats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a side is null or zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


TILE = 1024


def sequential_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of vectors that lie along the first axis, each added up in order: the very numbers that `dot` gives, so that equal vectors have equal ones."""
    out = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
    term = np.empty_like(out)
    for x, y in zip(a, b, strict=True):
        np.multiply(x, y, out=term)
        out += term
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of a with all rows of b, NaN where a side is zero. The same numbers as `cosine`."""
    by_dim, items = np.ascontiguousarray(a.T)[:, :, None], np.ascontiguousarray(b.T)
    sizes, out = np.sqrt(sequential_sums(a.T, a.T)), np.empty((len(a), len(b)))
    for at in range(0, len(b), TILE):
        part = items[:, at : at + TILE]
        scale = sizes[:, None] * np.sqrt(sequential_sums(part, part))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[:, at : at + TILE] = np.where(scale > 0, sequential_sums(by_dim, part[:, None, :]) / scale, np.nan)
    return out


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def slot_counts(slots: pd.Series, dim: pd.Series) -> pd.Series:
    """By row the signed counts of slots, which are numbered from 1 and negative where they count down."""
    if not len(slots):
        return pd.Series([], dtype=object)
    n, sizes = int(dim.iloc[0]), slots.map(len).to_numpy()
    flat = np.concatenate(slots.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.bincount(row * n + np.abs(flat) - 1, weights=np.sign(flat), minlength=len(sizes) * n)
    return pd.Series(list(sums.reshape(-1, n).astype(np.float32)))


def hashed_embedding(terms: Column, dim: int = 64) -> Column:
    """A deterministic embedding of a term list where no model is at hand: signed counts of hashed terms, in one pass over them."""
    signed = F.transform(terms, lambda t: ((F.pmod(F.xxhash64(t), F.lit(dim)) + 1) * F.when(F.pmod(F.crc32(t), F.lit(2)) == 0, 1).otherwise(-1)).cast("int"))
    return slot_counts(F.coalesce(signed, F.array().cast("array<int>")), F.lit(dim))
