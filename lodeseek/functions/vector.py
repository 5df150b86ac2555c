"""Vector expressions on ``array<float>`` columns, evaluated in double: inside the JVM, or as matrices in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """Unit-length copy; a zero vector, which has no direction, gives null.

    The length goes in as a second array: within a lambda it would be computed again for every element.
    """
    length = norm(v)
    return F.when(length > 0, F.zip_with(as_double(v), F.array_repeat(length, F.size(v)), lambda x, n: x / n))


def usable(v: Column, dim: int) -> Column:
    """True for a vector of ``dim`` finite elements that aren't all zero; false (never null) otherwise."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


METRICS = {"euclidean": euclidean, "squared_l2": squared_l2}


def distance_to(v: Column, query: list[float], metric: str = "euclidean") -> Column:
    """Distance of ``v`` to one vector of the same length, by Arrow batches: the batch's elements are one matrix.

    In double precision, like the JVM's form of the metric, which goes element by element. A null element gives NaN; rows
    that are null or of another length have to be left out before.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    target = np.array([math.nan if x is None else x for x in query], np.float64)

    @F.arrow_udf("double")
    def distances(batch: pa.Array) -> pa.Array:
        matrix = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), len(target))
        matrix -= target
        squared = np.einsum("ij,ij->i", matrix, matrix)
        return pa.array(squared if metric == "squared_l2" else np.sqrt(squared))

    return distances(v)
