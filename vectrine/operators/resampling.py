"""Resampling inference: draws are made by NumPy with a seed, or by hashes; what they are joined to stays in Spark.

Direct recomputation of every draw would explode the vectors by the number of iterations. All statistics
here are linear in the rows (or quadratic through the Gram matrix of label-cell means), so rows are reduced
once and each draw costs only as much as its weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def add_one_p(nulls: DataFrame, null: str, observed: str, *by: str, side: str = "greater") -> DataFrame:
    """p of each group: (draws at least as extreme + 1) / (draws + 1)."""
    n, o = F.col(null), F.col(observed)
    extreme = {"greater": n >= o, "less": n <= o, "two-sided": F.abs(n) >= F.abs(o)}[side]
    return nulls.groupBy(*by).agg(((F.count_if(extreme) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def max_statistic_p(nulls: DataFrame, null: str, iteration: str, observed: DataFrame, value: str, *family: str) -> DataFrame:
    """p of each observed value against the greatest null of its family in each iteration."""
    top = nulls.groupBy(*family, iteration).agg(F.max(null).alias("__top"))
    keys = observed.columns
    return observed.join(top, list(family)).groupBy(*keys).agg(((F.count_if(F.col("__top") >= F.col(value)) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def interval(rows: DataFrame, value: str, level: float, *by: str) -> DataFrame:
    """Equal-tailed percentile interval: ci_low and ci_high."""
    tail = (1 - level) / 2
    p = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail))).alias("__p"))
    return p.withColumns({"ci_low": F.col("__p")[0], "ci_high": F.col("__p")[1]}).drop("__p")


def bootstrap_draws(spark: SparkSession, topics: list, iterations: int, seed: int) -> DataFrame:
    """iteration, slot, topic_id: topics drawn with replacement, in the order in which they were first seen."""
    at = np.random.default_rng(seed).integers(0, len(topics), (iterations, len(topics)))
    rows = [(i, j, topics[k]) for i, line in enumerate(at.tolist()) for j, k in enumerate(line)]
    return spark.createDataFrame(rows, "iteration long, slot long, topic_id long")


def hashed_draws(spark: SparkSession, topics: int, iterations: int, seed: int) -> DataFrame:
    """The same table by hashes, which any SQL engine can repeat."""
    rows = spark.range(iterations).select(F.col("id").alias("iteration"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(topics - 1).cast("long"))).alias("slot"))
    return rows.withColumn("topic_id", hashed(F.lit(str(seed)), "iteration", "slot") % topics)


def hashed(*parts) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p if isinstance(p, Column) else F.col(p).cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def bootstrap_of_sums(sums: DataFrame, draws: DataFrame, *by: str) -> DataFrame:
    """Weighted mean of each draw: sum of its topics' sums over sum of their counts (columns total and n)."""
    times = draws.groupBy("iteration", "topic_id").agg(F.count(F.lit(1)).alias("times"))
    joined = sums.join(times, "topic_id")
    return joined.groupBy(*by, "iteration").agg((F.sum(F.col("total") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("value"))


def permutation_nulls(cells: np.ndarray, block_labels: np.ndarray, blocks: np.ndarray, target: np.ndarray, iterations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of label directions with a target under permutations of labels within blocks, through the Gram matrix.

    cells: vectors (row, dim); block_labels: a label number a row; blocks: its block. Returns (iteration, label)
    cosines of the difference from the other labels, and of the centroid of all labels' unit directions.
    """
    rng = np.random.default_rng(seed)
    gram, along = cells @ cells.T, cells @ target
    length = np.linalg.norm(target)
    labels = np.unique(block_labels)
    members = [np.flatnonzero(blocks == b) for b in np.unique(blocks)]
    single, central = np.empty((iterations, len(labels))), np.empty(iterations)
    for k in range(iterations):
        now = block_labels.copy()
        for m in members:
            now[m] = rng.permutation(now[m])
        hot = (now[None, :] == labels[:, None]).astype(float)
        means = hot / hot.sum(1, keepdims=True)
        weights = means - (means.sum(0) - means) / (len(labels) - 1)
        norms = np.sqrt(np.einsum("li,ij,lj->l", weights, gram, weights))
        single[k] = weights @ along / (norms * length)
        unit = (weights / norms[:, None]).mean(0)
        central[k] = unit @ along / (np.sqrt(unit @ gram @ unit) * length) if len(labels) > 2 else 0.0
    return single, central


def beta_null(dimension: int, rank: int, iterations: int, seed: int) -> np.ndarray:
    """Exact null of the share of a random direction within a rank-r subspace."""
    if rank >= dimension:
        return np.ones(iterations)
    return np.random.default_rng(seed).beta(rank / 2, (dimension - rank) / 2, iterations)


def fan_out(seed: int, n: int) -> list[np.random.SeedSequence]:
    return np.random.SeedSequence(seed).spawn(n)
