"""Judged answers: validated joins, pending work, matched pairs, classes and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrine.operators import ranking as R


class ContractError(ValueError):
    """A table does not hold what it must."""


def require_none(rows: DataFrame, what: str) -> None:
    """An error if there is a row."""
    if not rows.isEmpty():
        raise ContractError(f"{what}: {rows.limit(3).collect()}")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that must pair every row of both sides with exactly one of the other."""
    require_none(duplicates(left, key), f"{key} repeats on the left")
    require_none(duplicates(right, key), f"{key} repeats on the right")
    require_none(left.join(right, key, "left_anti"), f"{key} is missing on the right")
    require_none(right.join(left, key, "left_anti"), f"{key} is missing on the left")
    return left.join(right, key)


def pending(corpus: DataFrame, journal: DataFrame, key: str, content: str | None = None) -> DataFrame:
    """Rows of the corpus that the journal lacks. With content: the name of a hash column that must agree where both have a row."""
    if content:
        drift = corpus.select(key, content).join(journal.select(key, F.col(content).alias("__was")), key).where(~F.col(content).eqNullSafe(F.col("__was")))
        require_none(drift, "content has changed since it was judged")
    return corpus.join(journal.select(key).distinct(), key, "left_anti")


def fill_missing(rows: DataFrame, key: str, metric: str, judged: DataFrame) -> DataFrame:
    """Rows with null metrics filled from judged (key, metric); others keep theirs."""
    return rows.join(judged.select(key, F.col(metric).alias("__new")), key, "left").withColumn(metric, F.coalesce(metric, "__new")).drop("__new")


def classify(alignment: Column, coherence: Column, high: float = 70, low: float = 30, coherent: float = 50) -> Column:
    """aligned above high, misaligned up to low, if coherent; null otherwise."""
    return F.when((coherence > coherent) & (alignment > high), "aligned").when((coherence > coherent) & (alignment <= low), "misaligned")


def matched_pairs(rows: DataFrame, prompt: str, label: str, order: Column, first: str, second: str, most: int) -> DataFrame:
    """pair_id, prompt, depth and the ids of both sides: within each prompt the sides' seeded orders are zipped, then prompts are dealt in turn."""
    ranked = rows.withColumn("depth", F.row_number().over(W.partitionBy(prompt, label).orderBy(order)).cast("long") - 1)
    side = lambda x, into: ranked.where(F.col(label) == x).select(prompt, "depth", F.col("id").alias(into))
    pairs = side(first, f"{first}_id").join(side(second, f"{second}_id"), [prompt, "depth"])
    top = pairs.orderBy("depth", prompt).limit(most)  # a report of bounded length
    return top.withColumn("pair_id", F.row_number().over(W.orderBy("depth", prompt)).cast("long") - 1)


def share(condition: Column, digits: int = 2) -> Column:
    """Per cent of rows for which a condition holds."""
    return F.round(100.0 * F.count_if(condition) / F.count(F.lit(1)), digits)


def crosstab_percent(rows: DataFrame, a: str, b: str, a_values: list, b_values: list) -> DataFrame:
    """Per cent of the grand total in each cell; categories that do not occur are there with 0."""
    grid = rows.sparkSession.createDataFrame([(x, y) for x in a_values for y in b_values], f"{a} string, {b} string")
    cells = rows.where(F.col(a).isin(a_values) & F.col(b).isin(b_values)).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    full = grid.join(cells, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return full.withColumn("percent", F.try_divide(100.0 * F.col("n"), F.sum("n").over(W.partitionBy(F.lit(1)))))


def with_average(rows: DataFrame, group: str, item: str, value: str, name: str = "AVERAGE") -> DataFrame:
    """Rows and, for each group, one that averages its items."""
    return rows.unionByName(rows.groupBy(group).agg(F.avg(value).alias(value)).withColumn(item, F.lit(name)))


def interleaved(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Round robin over the groups up to most rows."""
    depth = F.row_number().over(W.partitionBy(group).orderBy(order)).cast("long")
    # the bound lets every task keep no more rows a group than may be taken, before they are shuffled
    return rows.withColumn("depth", depth).where(F.col("depth") <= most).orderBy("depth", group).limit(most)


def merge_contained(ids: list[str]) -> dict[str, str]:
    """Each id to the first seen one that it contains or that contains it; ids in file order."""
    out: dict[str, str] = {}
    for i in ids:
        out[i] = next((k for k in dict.fromkeys(out.values()) if k in i or i in k), i)
    return out


def length_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """rows, total, mean, median, low and high of each group and, under the name ALL, of everything."""
    stats = (
        rows.rollup(by)
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.grouping(by).alias("__all"))
        .withColumn(by, F.when(F.col("__all") == 1, "ALL").otherwise(F.col(by)))
        .drop("__all")
    )
    middle = R.percentiles(rows, value, [0.5], by).select(by, F.col("cutoff").alias("median"))
    whole = R.percentiles(rows, value, [0.5]).select(F.lit("ALL").alias(by), F.col("cutoff").alias("median"))
    medians = middle.unionByName(whole).withColumnRenamed(by, "__of")
    return stats.join(medians, F.col(by).eqNullSafe(F.col("__of")), "left").select(by, "rows", "total", "mean", "median", "low", "high")


def trimmed(rows: DataFrame, value: str, low: float, high: float, *by: str) -> DataFrame:
    """Rows between two exact percentiles of their group, both included."""
    cuts = R.percentiles(rows, value, [low, high], *by)
    at = lambda x: F.max(F.when(F.col("at") == x, F.col("cutoff")))
    ends = cuts.groupBy(*by).agg(at(low).alias("__low"), at(high).alias("__high"))
    return R.beside(rows, ends, *by).where(F.col(value).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")
