"""Drawn noise against its distributions, k-means against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.functions import noise as N
from vectrine.operators import algebra
from vectrine.operators.clusters import kmeans


def cdf_gap(values, cdf):
    v = np.sort(values)
    steps = np.arange(len(v) + 1) / len(v)
    return max(np.abs(cdf(v) - steps[1:]).max(), np.abs(cdf(v) - steps[:-1]).max())


def test_normal_values(spark):
    from math import erf

    rows = spark.range(500).select(F.col("id"), N.gaussians(3, F.col("id"), 37).alias("z"), N.gaussians(3, F.col("id"), 5).alias("few"), N.gaussians(3, F.col("id"), 0).alias("none"), N.random_unit(3, F.col("id"), 37).alias("u")).collect()
    z = np.array([r.z for r in rows])
    assert z.shape == (500, 37) and all(r.few == r.z[:5] and r.none == [] for r in rows)
    n = z.size
    assert abs(z.mean()) < 4 / n**0.5 and abs(z.std() - 1) < 4 / (2 * n) ** 0.5
    assert cdf_gap(z.ravel(), lambda v: np.array([0.5 * (1 + erf(x / 2**0.5)) for x in v])) < 1.95 / n**0.5
    c = np.corrcoef(z.T)
    assert np.abs(c[np.triu_indices(37, 1)]).max() < 5 / 500**0.5
    assert np.allclose([np.linalg.norm(r.u) for r in rows], 1)


def test_perturbed(spark):
    rng = np.random.default_rng(0)
    data = [(rng.normal(size=9).tolist(), rng.normal(size=9).tolist()) for _ in range(5)]
    for r in spark.createDataFrame(data, "v array<double>, z array<double>").withColumn("m", N.perturbed(F.col("v"), F.col("z"), 0.3)).collect():
        v, z, m = map(np.array, (r.v, r.z, r.m))
        y = z - (z @ v) / (v @ v) * v
        assert np.allclose(m, (1 - 0.09) ** 0.5 * v + 0.3 * y / np.linalg.norm(y) * np.linalg.norm(v))


def test_random_subspaces_follow_the_beta_law(spark):
    rank, width = 2, 10
    basis = F.array(*[N.gaussians(5, F.concat_ws(":", "id", F.lit(str(k))), width) for k in range(rank)])
    target = F.array(*[F.lit(float(i + 1)) for i in range(width)])
    shares = [r[0] for r in spark.range(3000).select(N.subspace_share(target, basis)).collect()]
    # the distribution function of Beta(1, 4)
    assert cdf_gap(shares, lambda x: 1 - (1 - x) ** ((width - rank) / 2)) < 1.95 / 3000**0.5


@pytest.mark.parametrize(("n", "k", "spread"), [(300, 4, 0.05), (200, 3, 1.5)])
def test_kmeans_like_numpy(spark, n, k, spread):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(k, 5)) * 3
    x = centres[rng.integers(0, k, n)] + rng.normal(size=(n, 5)) * spread
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "id long, v array<double>").repartition(5)
    rows, found, loss = kmeans(df, "id", "v", k, starts=3)
    got = {r.id: (r.cluster, r.distance) for r in rows.collect()}
    label = algebra.kmeans(x, k, 0, 20)
    want = sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in range(k))
    assert loss == pytest.approx(want, rel=1e-6 if spread < 1 else 0.03) and loss == pytest.approx(sum(d for _, d in got.values()))
    mine = np.array([got[i][0] for i in range(n)])
    if spread < 1:
        assert len({(a, b) for a, b in zip(mine, label)}) == k  # the same classes, whatever their names
    for c in range(k):
        assert np.allclose(found[c], x[mine == c].mean(0), atol=1e-3)


def test_kmeans_of_few_points(spark):
    df = spark.createDataFrame([(i, [float(i % 2)]) for i in range(6)], "id long, v array<double>")
    rows, centres, loss = kmeans(df, "id", "v", 4)
    assert loss == 0 and centres.ravel().tolist() == [0, 1] and {(r.id % 2, r.cluster) for r in rows.collect()} == {(0, 0), (1, 1)}
    assert kmeans(df.limit(0), "id", "v", 4)[0].count() == 0
