"""Contrastive directions by label and layer.

Means are partial aggregates: of whole arrays (``array_means`` and what builds on it), with a row a (task, label) in the
shuffle, or of long-form vectors (label, layer, dim, v), with a row a (task, label, layer, dim). Everything after the
means is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrine.functions.vectors import clip
from vectrine.operators.sums import as_rows, mean_vectors, vector_sums


def long_form(vectors: DataFrame, vector: str = "embedding", width: int | None = None) -> DataFrame:
    """One row per element: layer, dim and v, next to all other columns. width: elements of a layer (None: one layer)."""
    keep = [c for c in vectors.columns if c != vector]
    rows = vectors.select(*keep, F.posexplode(vector).alias("at", "v"))
    layer = F.floor(F.col("at") / width) if width else F.lit(0)
    dim = F.col("at") % width if width else F.col("at")
    return rows.withColumns({"layer": layer.cast("long"), "dim": dim.cast("long"), "v": F.col("v").cast("double")}).drop("at")


def label_means(rows: DataFrame, *by: str) -> DataFrame:
    """mu and n by label, layer, dim and further columns."""
    return rows.groupBy("label", *by, "layer", "dim").agg(F.avg("v").alias("mu"), F.count("v").alias("n"))


def array_means(vectors: DataFrame, vector: str, width: int | None, *by: str, weight: Column | None = None) -> DataFrame:
    """mu and n by label, further columns, layer and dim, summed as arrays. width: elements of a layer (None: one layer)."""
    means = mean_vectors(vectors, vector, "label", *by, weight=weight)
    return as_rows(means, width).select("label", *by, "layer", "dim", "mu", F.col("n").cast("long"))


def from_grand_mean(means: DataFrame) -> DataFrame:
    """d: mean less the unweighted mean of all labels' means."""
    return means.withColumn("d", F.col("mu") - F.avg("mu").over(W.partitionBy("layer", "dim")))


def from_other_labels(means: DataFrame, *by: str, mu: str = "mu", into: str = "d") -> DataFrame:
    """d: mean less the mean of the other labels' means; null where there is no other."""
    w = W.partitionBy(*by, "layer", "dim")
    return means.withColumn(into, F.col(mu) - F.try_divide(F.sum(mu).over(w) - F.col(mu), F.count(mu).over(w) - 1))


def split_means(vectors: DataFrame, vector: str, width: int | None, in_a: Column) -> DataFrame:
    """Means and counts of all rows and of two splits, in one pass over the vectors."""
    sums = vector_sums(vectors.withColumn("__a", in_a), vector, "label", "__a")
    rows = as_rows(sums, width, "total")
    part = lambda c, which: F.sum(F.when(F.col("__a") == which, F.col(c)))
    out = rows.groupBy("label", "layer", "dim").agg(
        (F.sum("mu") / F.sum("n")).alias("mu"),
        F.try_divide(part("mu", True), part("n", True)).alias("mu_a"),
        F.try_divide(part("mu", False), part("n", False)).alias("mu_b"),
        F.sum("n").cast("long").alias("n"),
        F.coalesce(part("n", True), F.lit(0)).cast("long").alias("n_a"),
        F.coalesce(part("n", False), F.lit(0)).cast("long").alias("n_b"),
    )
    return out


def _cosine(a: str, b: str) -> Column:
    den = F.sqrt(F.sum(F.col(a) * F.col(a)) * F.sum(F.col(b) * F.col(b)))
    return F.when(den > 0, clip(F.sum(F.col(a) * F.col(b)) / den))


def cosines_by(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Cosine of two element columns within groups; null where a norm is zero."""
    return rows.groupBy(*by).agg(_cosine(a, b).alias("cosine"))


def pairwise_cosines(directions: DataFrame, *by: str, value: str = "d") -> DataFrame:
    """Cosine of every two labels (label_a < label_b); directions are few, whatever the corpus holds."""
    keys = [*by, "dim"]
    a = directions.select(*keys, F.col("label").alias("label_a"), F.col(value).alias("a"))
    b = directions.select(*keys, F.col("label").alias("label_b"), F.col(value).alias("b"))
    return cosines_by(a.join(b, keys).where("label_a < label_b"), "a", "b", *by, "label_a", "label_b")


def normalised(rows: DataFrame, value: str, *by: str, into: str = "u") -> DataFrame:
    """Elements over the norm of their group; zero vectors give zeros."""
    n = F.sqrt(F.sum(F.col(value) * F.col(value)).over(W.partitionBy(*by)))
    return rows.withColumn(into, F.when(n > 0, F.col(value) / n).otherwise(F.lit(0.0)))


def centroid(directions: DataFrame, members: list, value: str = "d") -> DataFrame:
    """layer, dim, c: the members' directions made unit, averaged, made unit again."""
    rows = normalised(directions.where(F.col("label").isin(members)), value, "label", "layer")
    mean = rows.groupBy("layer", "dim").agg(F.avg("u").alias("m"))
    return normalised(mean, "m", "layer", into="c").drop("m")


def token_pooled(vectors: DataFrame, vector: str, width: int | None, weight: str) -> DataFrame:
    """Global token-weighted pool: sum of weighted vectors over the sum of weights, by label, layer and dim."""
    return array_means(vectors, vector, width, weight=F.col(weight)).drop("n")


def contrast(means: DataFrame, positive, negative) -> DataFrame:
    """layer, dim, e: difference of two labels' means."""
    side = lambda x: F.max(F.when(F.col("label") == x, F.col("mu")))
    return means.groupBy("layer", "dim").agg((side(positive) - side(negative)).alias("e"))


def without(directions: DataFrame, nuisance: DataFrame, value: str = "d", along: str = "e") -> DataFrame:
    """Directions less their part along one vector a layer."""
    rows = directions.join(normalised(nuisance, along, "layer", into="r").select("layer", "dim", "r"), ["layer", "dim"])
    part = F.sum(F.col(value) * F.col("r")).over(W.partitionBy("label", "layer"))
    return rows.withColumn("cleaned", F.col(value) - part * F.col("r")).drop("r")


def topic_means(vectors: DataFrame, vector: str, width: int | None) -> DataFrame:
    """Means that weigh every topic alike, however many rows it has."""
    each = mean_vectors(vectors, vector, "label", "topic_id").select("label", "mean")
    return array_means(each, "mean", width).withColumnRenamed("n", "topics")


def topic_sums(vectors: DataFrame, vector: str) -> DataFrame:
    """label, topic_id, n and total (array)."""
    return vector_sums(vectors, vector, "label", "topic_id")
