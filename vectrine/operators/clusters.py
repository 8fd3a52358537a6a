"""k-means over any number of points: seeding in rounds over all points, then Lloyd rounds as partial sums.

What leaves the tasks is a sum and a count a centre, and in the seeding rounds the few points that a hash
draws in proportion to their distance; no point is held by the driver but those candidates, some ROUNDS * OVER * k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.operators.sums import vector_sums

#: Seeding rounds, and how many times k points each draws on average.
ROUNDS, OVER = 5, 2


def nearest(vector: Column, centres: np.ndarray) -> Column:
    """Struct (cluster, distance): the place of the nearest centre, the first of equals, and the square distance to it."""

    @F.pandas_udf("cluster long, distance double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        square = (centres**2).sum(1)
        for vectors in batches:
            if not len(vectors):
                yield pd.DataFrame({"cluster": pd.Series([], dtype="int64"), "distance": pd.Series([], dtype="float64")})
                continue
            x = np.stack(vectors.to_numpy()).astype(float)
            d = square - 2 * (x @ centres.T)
            k = d.argmin(1)
            yield pd.DataFrame({"cluster": k, "distance": ((x - centres[k]) ** 2).sum(1)})

    return place(vector)


def _chance(seed: int, number: int, key: Column) -> Column:
    h = F.sha2(F.concat_ws(":", F.lit(f"{seed}:{number}"), key.cast("string")), 256)
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates, each drawn in proportion to its weight and square distance; then a few rounds over the candidates."""
    centres = points[[rng.choice(len(points), p=weights / weights.sum())]]
    while len(centres) < k:
        d = ((points[:, None] - centres) ** 2).sum(2).min(1) * weights
        if d.sum() <= 0:
            break
        centres = np.vstack([centres, points[rng.choice(len(points), p=d / d.sum())]])
    for _ in range(20):
        label = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([np.average(points[label == c], axis=0, weights=weights[label == c]) if (label == c).any() else centres[c] for c in range(len(centres))])
    return centres


def seeded_centres(points: DataFrame, key: str, vector: str, k: int, seed: int) -> np.ndarray:
    """Centres to start from: rounds over all points draw candidates, which stand for the points nearest to them."""
    first = points.orderBy(_chance(seed, -1, F.col(key)), key).select(vector).limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    candidates = np.array([first[0][0]], float)
    for number in range(ROUNDS):
        at = points.select(key, vector, nearest(F.col(vector), candidates).alias("at"))
        cost = at.agg(F.sum("at.distance")).first()[0]
        if not cost:
            break
        drawn = at.where(_chance(seed, number, F.col(key)) < F.least(F.lit(1.0), OVER * k * F.col("at.distance") / cost)).orderBy(key).select(vector).collect()
        if drawn:
            candidates = np.vstack([candidates, np.array([r[0] for r in drawn], float)])
    candidates = np.unique(candidates, axis=0)
    weights = np.zeros(len(candidates))
    for r in points.groupBy(nearest(F.col(vector), candidates)["cluster"].alias("c")).agg(F.count(F.lit(1)).alias("n")).collect():
        weights[r.c] = r.n
    return _plus_plus(candidates, weights, min(k, len(candidates)), np.random.default_rng(seed))


def kmeans(points: DataFrame, key: str, vector: str, k: int, seed: int = 0, starts: int = 1, most: int = 100, tolerance: float = 1e-8) -> tuple[DataFrame, np.ndarray, float]:
    """(points with cluster and distance, centres, sum of square distances): the best of several starts.

    Clusters are numbered by their centres in ascending order of their elements. A cluster that loses all points keeps its centre.
    Points have a key that tells them apart, which draws go by, and vectors of one length without nulls; fewer distinct points than k give fewer clusters.
    """
    best: tuple[float, np.ndarray] | None = None
    for start in range(starts):
        centres = seeded_centres(points, key, vector, k, seed + start)
        if not len(centres):
            break
        for _ in range(most):
            at = points.select(vector, nearest(F.col(vector), centres)["cluster"].alias("cluster"))
            new = centres.copy()
            for r in vector_sums(at, vector, "cluster").collect():  # k rows
                new[r.cluster] = np.array(r.total) / r.n
            moved = float(((new - centres) ** 2).sum(1).max())
            centres = new
            if moved <= tolerance:
                break
        loss = points.select(nearest(F.col(vector), centres)["distance"].alias("d")).agg(F.sum("d")).first()[0]
        if best is None or loss < best[0] - 1e-12:
            best = (loss, centres)
    if best is None:
        return points.withColumns({"cluster": F.lit(None).cast("long"), "distance": F.lit(None).cast("double")}), np.zeros((0, 0)), 0.0
    centres = best[1][np.lexsort(best[1].T[::-1])]
    at = nearest(F.col(vector), centres)
    return points.withColumn("__at", at).withColumns({"cluster": F.col("__at.cluster"), "distance": F.col("__at.distance")}).drop("__at"), centres, best[0]
