"""Ranks, top-k, percentiles and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrine.session import cut


def top_k(rows: DataFrame, k: int, order: list, *by: str, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; ties need columns in order to part them. Tasks keep k rows a group before they shuffle."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def percentiles(rows: DataFrame, value: str, at: list[float], *by: str, weight: str | None = None, bins: int = 4096) -> DataFrame:
    """by, at and cutoff: exact percentiles of each group, interpolated between the two values next to the rank.

    weight: how many rows a row stands for. Two passes: counts in equal bins find the bins of the ranks, then only
    the values of these bins are put in order. So no task holds all values of a group.
    """
    n = F.col(weight) if weight else F.lit(1)
    rows = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.sum(n).alias("__n"))
    ends = lambda r: r.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__all"))
    span = F.col("__hi") - F.col("__lo")
    bin_ = F.when(span > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / span * bins), F.lit(bins - 1))).otherwise(0)
    rows = cut(rows)
    known = cut(beside(rows, ends(rows), *by).withColumn("__bin", bin_))
    counts = known.groupBy(*by, "__bin").agg(F.sum("__n").alias("__n"), F.max("__all").alias("__all"))  # bins rows a group
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__before", before).withColumn("at", F.explode(F.array(*map(F.lit, at))))
    rank = F.col("at") * (F.col("__all") - 1)
    holds = lambda r: (F.col("__before") <= r) & (r < F.col("__before") + F.col("__n"))
    needed = counts.where(holds(F.floor(rank)) | holds(F.ceil(rank))).select(*by, "__bin", "__before", "at")
    inside = known.join(needed, [*by, "__bin"])  # two bins a group and percentile
    upto = F.sum("__n").over(W.partitionBy(*by, "at", "__bin").orderBy("__v"))
    inside = inside.withColumn("__last", F.col("__before") + upto - 1).withColumn("__first", F.col("__last") - F.col("__n") + 1)
    value_at = lambda r: F.max(F.when((F.col("__first") <= r) & (r <= F.col("__last")), F.col("__v")))
    pair = inside.groupBy(*by, "at").agg(value_at(F.floor(rank)).alias("__a"), value_at(F.ceil(rank)).alias("__b"), F.max(rank - F.floor(rank)).alias("__part"))
    return pair.select(*by, "at", (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__part")).alias("cutoff"))


#: Groups whose cut-offs or edges are broadcast: some 50 bytes each.
FEW = 100_000


def beside(rows: DataFrame, groups: DataFrame, *by: str) -> DataFrame:
    """rows.join(groups, by), where groups has a row a group: broadcast if these are few, by a shuffle otherwise."""
    groups = cut(groups)
    few = groups.limit(FEW + 1).count() <= FEW
    groups = F.broadcast(groups) if few else groups
    return rows.join(groups, list(by)) if by else rows.join(groups)  # without by there is one row


def above_percentile(rows: DataFrame, value: str, at: float, *by: str, weight: str | None = None) -> DataFrame:
    """Rows with their group's exact percentile (cutoff) and whether they lie strictly above it (hit)."""
    cuts = percentiles(rows, value, [at], *by, weight=weight).drop("at")
    return beside(rows, cuts, *by).withColumn("hit", F.col(value) > F.col("cutoff"))


def histogram(rows: DataFrame, value: str, bins: int, *by: str, weight: str | None = None) -> DataFrame:
    """low, high, bin and n: equal bins from least to greatest, the last closed; half a unit each way if all values are equal."""
    edges = rows.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    flat = F.col("low") == F.col("high")
    edges = edges.select(*by, F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    joined = beside(rows, edges, *by)
    k = F.least(F.floor((F.col(value) - F.col("low")) / ((F.col("high") - F.col("low")) / bins)), F.lit(bins - 1)).cast("long")
    return joined.groupBy(*by, "low", "high", k.alias("bin")).agg(F.sum(weight).alias("n") if weight else F.count(F.lit(1)).alias("n"))


def benjamini_hochberg(rows: DataFrame, p: str, *family: str, into: str = "q") -> DataFrame:
    """q of each p within its family; null and NaN stay null and do not count. A family is put in order in one task, which may spill."""
    good = F.col(p).isNotNull() & ~F.isnan(p)
    w = W.partitionBy(*family, "__good")
    ranked = rows.withColumn("__good", good).withColumns({"__rank": F.row_number().over(w.orderBy(p)), "__m": F.count(F.lit(1)).over(w)})
    back = w.orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(back))
    return ranked.withColumn(into, F.when(F.col("__good"), q)).drop("__good", "__rank", "__m")


def runs_below(rows: DataFrame, value: str, threshold: float, order: str, *by: str) -> DataFrame:
    """Rows below the threshold with run: their place in the unbroken run that they belong to."""
    w = W.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("__island", F.sum((F.col(value) >= threshold).cast("int")).over(w))
    return marked.where(F.col(value) < threshold).withColumn("run", F.row_number().over(W.partitionBy(*by, "__island").orderBy(order)).cast("long")).drop("__island")


def concentration(rows: DataFrame, value: str, fraction: float, weight: str, *by: str) -> DataFrame:
    """Of each group n, mass (share of the shifted total in its top fraction), uniform (share of its rows) and peak (greatest over mean, shifted).

    A row stands for weight equal values.
    """
    w = W.partitionBy(*by)
    shifted = rows.withColumns({"__s": F.col(value) - F.min(value).over(w), "__all": F.sum(weight).over(w)})
    before = F.coalesce(F.sum(weight).over(w.orderBy(F.desc("__s")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    k = F.greatest(F.lit(1), F.ceil(F.col("__all") * fraction))
    taken = shifted.withColumn("__taken", F.greatest(F.lit(0), F.least(F.col(weight), k - before)))
    total = F.sum(F.col("__s") * F.col(weight))
    return taken.groupBy(*by).agg(
        F.max("__all").alias("n"),
        F.coalesce(F.try_divide(F.sum(F.col("__s") * F.col("__taken")), total), F.lit(0.0)).alias("mass"),
        (F.max(k) / F.max("__all")).alias("uniform"),
        F.coalesce(F.try_divide(F.max("__s"), total / F.max("__all")), F.lit(0.0)).alias("peak"),
    )


def retrieval(rows: DataFrame, score: str, truth: Column, order: str, *query: str) -> DataFrame:
    """rank of the true candidate of each query by score, ties by order."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*query).orderBy(F.desc(score), order)).cast("long"))
    return ranked.where(truth).select(*query, "rank")


def prefix_reaching(rows: DataFrame, share: str, order: str, threshold: float, *by: str) -> DataFrame:
    """Rows with cum, the running sum of shares, and retained, whether they belong to the shortest prefix that reaches the threshold."""
    w = W.partitionBy(*by).orderBy(order)
    before = F.sum(share).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumns({"cum": F.sum(share).over(w), "retained": F.coalesce(before, F.lit(0.0)) < threshold})
