"""Vector functions on array<double> columns, and the hashing embedding."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 256
TOKEN = re.compile("[0-9a-z]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; lists of unequal length are an error."""
    length = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal length")).cast("double"))
    scale = norm(a) * norm(b)
    return F.coalesce(length, F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale))


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def usable(v: Column) -> Column:
    """Not null, finite in every place and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.exists(v, lambda x: x != 0) & finite


@lru_cache(maxsize=200_000)
def bucket_of(token: str, dimensions: int = DIMENSIONS) -> int:
    return int.from_bytes(hashlib.sha1(token.encode()).digest()[:4], "big") % dimensions


def hashed_counts(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Token counts by bucket: integers, so dot products are exact on any engine."""
    found = [bucket_of(t, dimensions) for t in TOKEN.findall(text.lower())]
    return np.bincount(np.array(found, np.int64), minlength=dimensions)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashing_embed(texts: pd.Series) -> pd.Series:
    """Unit-length term-frequency vector of 256 buckets; a text without tokens is the zero vector."""

    def one(text: str | None) -> np.ndarray:
        counts = hashed_counts(text or "").astype(float)
        size = np.sqrt((counts * counts).sum())
        return counts / size if size else counts

    return texts.map(one)


def hashing_similarity(query: str):
    """A column function text -> cosine of its hashed counts with the query's: one Arrow pass, no vectors leave it."""
    wanted = hashed_counts(query)
    q2 = int((wanted * wanted).sum())

    @F.pandas_udf(T.DoubleType())
    def similarity(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> float:
            counts = hashed_counts(text or "")
            n2 = int((counts * counts).sum()) * q2
            return int((counts * wanted).sum()) / np.sqrt(n2) if n2 else 0.0

        return texts.map(one).astype("float64")

    return similarity
