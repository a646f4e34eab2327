"""Vector functions. Sums run in double precision over ``array<float>`` columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, term by term in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    """Euclidean length; one for the zero vector, so that dividing is safe."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def normalised(a: Column, epsilon: float = 0.0) -> Column:
    """The unit vector; a query is divided by its length plus ``epsilon``."""
    n = norm(a) if not epsilon else F.sqrt(dot(a, a)) + epsilon
    return F.transform(a, lambda x: x.cast("double") / n)


def is_zero(a: Column) -> Column:
    """Whether all entries are zero: the mark of an item that could not be encoded."""
    return F.forall(a, lambda x: x == 0)


def or_placeholder(a: Column, dim: int = 128) -> Column:
    """One zero vector in place of missing patches."""
    return F.coalesce(a, F.array(F.array_repeat(F.lit(0.0).cast("float"), dim)))


def last_by_key(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row per key: of duplicates the last in ``order``."""
    return df.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def pooled(patches: np.ndarray, factor: int) -> np.ndarray:
    """Token pooling: merge the closest clusters (by cosine of means) until ``n / factor`` remain, and average.

    Agglomerative on the distance matrix of one item's vectors, which is small.
    """
    n = len(patches)
    keep = max(1, n // factor)
    if factor <= 1 or n <= keep:
        return patches
    unit = patches / np.maximum(np.linalg.norm(patches, axis=1, keepdims=True), 1e-12)
    groups = [[i] for i in range(n)]
    sim = unit @ unit.T
    np.fill_diagonal(sim, -np.inf)
    alive = np.ones(n, bool)
    for _ in range(n - keep):
        i, j = sorted(np.unravel_index(int(sim.argmax()), sim.shape))
        groups[i] += groups[j]
        alive[j] = False
        mean = unit[groups[i]].mean(0)
        sim[i] = sim[:, i] = [-np.inf if not alive[k] or k == i else float(mean @ unit[groups[k]].mean(0)) for k in range(n)]
        sim[j] = sim[:, j] = -np.inf
    return np.array([patches[g].mean(0) for g, a in zip(groups, alive) if a], patches.dtype)


def pooled_patches(factor: int):
    """A pandas UDF of :func:`pooled`."""

    @F.pandas_udf("array<array<float>>")
    def run(items: pd.Series) -> pd.Series:
        return items.map(lambda p: [list(map(float, r)) for r in pooled(np.array([list(r) for r in p], np.float32), factor)])

    return run
