"""Dense vector expressions over arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0; an error if the lengths differ."""
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return checked.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def normalised(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(a.cast("array<double>"))


def encoded(a: Column) -> Column:
    """Little-endian float32 bytes."""

    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return F.pandas_udf(run, "binary")(a)


def decoded(raw: Column) -> Column:
    """The vector of such bytes; an error unless they are whole floats."""

    def run(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return F.pandas_udf(run, "array<float>")(raw)
