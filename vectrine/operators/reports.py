"""Source tables of the study's six figures, from the metrics table, and what keeps a figure from being drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIGURES = ("individual_heatmap", "centroid_overlap", "subspace_fraction", "split_half_reliability", "cross_model_stability", "raw_vs_cleaned")
CLEANED = "cleaned_aligned_basis"
#: Two controls of one estimate may differ by so much.
TOLERANCE = 1e-12


def figure_cells(metrics: DataFrame, labels: list[str]) -> DataFrame:
    """figure, model_source, pca_status, emotion_or_group, layer, low, high, n and empty (rows without a value) of each cell of a figure. labels: those reported."""
    c, name = F.col, F.col("emotion_or_group")
    raw, both = c("pca_status") == "raw", c("model_source").isin("aligned", "misaligned")
    is_ = lambda kind, estimate: (c("comparison_type") == kind) & (c("estimate_name") == estimate)
    own = is_("individual", "cosine") & (c("model_source") == "aligned") & name.isin(labels)
    member = {
        "individual_heatmap": own & raw,
        "centroid_overlap": is_("centroid", "cosine") & raw & both,
        "subspace_fraction": is_("subspace", "explained_fraction") & raw & both,
        "split_half_reliability": is_("split_reliability", "reliability") & raw & both,
        "cross_model_stability": (c("comparison_type") == "cross_model_stability") & (c("model_source") == "cross_model") & c("estimate_name").isin("cosine", "reliability") & raw,
        "raw_vs_cleaned": own & c("pca_status").isin("raw", CLEANED),
    }
    value = F.when(c("estimate_name") == "reliability", c("reliability")).when(c("estimate_name") == "explained_fraction", c("explained_fraction")).otherwise(c("cosine"))
    figure = F.explode(F.array_compact(F.array(*[F.when(member[f], f) for f in FIGURES]))).alias("figure")
    rows = metrics.select(figure, "model_source", "pca_status", "emotion_or_group", "layer", value.alias("value"))
    return rows.groupBy("figure", "model_source", "pca_status", "emotion_or_group", "layer").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("empty")
    )


def figure_sources(cells: DataFrame) -> DataFrame:
    """figure, model_source, pca_status, emotion_or_group, layer, value and n: the six tables, one above the other.

    The last figure has the median over the reported labels, whose number is n; elsewhere n is 1, and of a centroid's controls one row stays.
    """
    last = FIGURES[-1]
    each = cells.where(F.col("figure") != last).select("figure", "model_source", "pca_status", "emotion_or_group", "layer", F.col("low").alias("value"), F.lit(1).cast("long").alias("n"))
    medians = cells.where(F.col("figure") == last).groupBy("figure", "model_source", "pca_status", "layer").agg(F.median("low").alias("value"), F.count("low").alias("n"))
    return each.unionByName(medians.withColumn("emotion_or_group", F.lit(None).cast("string")))


def figure_faults(cells: DataFrame, labels: list[str]) -> DataFrame:
    """figure, fault and n: figures without rows, cells that are there twice, that lack or have no value, and controls whose estimates differ."""
    spark = cells.sparkSession
    central = F.col("figure") == "centroid_overlap"
    fault = F.explode(
        F.array_compact(
            F.array(
                F.when(~central & (F.col("n") > 1), "repeated cell"),
                F.when(central & (F.col("high") - F.col("low") > TOLERANCE), "controls differ"),
                F.when(F.col("empty") > 0, "no value"),
            )
        )
    ).alias("fault")
    inside = cells.select("figure", fault)
    series, layers = cells.select("figure", "model_source", "pca_status", "emotion_or_group").distinct(), cells.select("figure", "layer").distinct()
    asked = [("individual_heatmap", "aligned", "raw", x) for x in labels] + [("raw_vs_cleaned", "aligned", status, x) for status in ("raw", CLEANED) for x in labels]
    series = series.unionByName(spark.createDataFrame(asked, series.schema)).distinct()
    keys = ["figure", "model_source", "pca_status", "emotion_or_group", "layer"]
    lacking = series.join(layers, "figure").join(cells, keys, "left_anti").select("figure", F.lit("missing cell").alias("fault"))
    every = spark.createDataFrame([(f,) for f in FIGURES], "figure string")
    absent = every.join(cells, "figure", "left_anti").select("figure", F.lit("no rows").alias("fault"))
    return inside.unionByName(lacking).unionByName(absent).groupBy("figure", "fault").agg(F.count(F.lit(1)).alias("n"))
