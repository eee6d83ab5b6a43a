"""Vectors: similarity, norms and the packed little-endian form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    sizes = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (sizes > 0), dot(a, b) / F.when(sizes > 0, sizes).otherwise(1.0)).otherwise(0.0)


@F.pandas_udf(T.BinaryType())
def pack(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else np.frombuffer(bytes(v), "<f4", len(v) // 4))
