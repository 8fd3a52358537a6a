"""The geometry study over several specifications in one table: models by whether neutral components were removed.

A specification is a table of vectors (vec_id, label, topic_id, embedding) and a target by layer; cleaning is linear, so that it is done once, on the vectors and the
target, and every estimate and control then runs on what is left. Multiple testing is corrected within three families a
specification: labels by layers, groups by layers for each control, and layers for subspaces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.operators import algebra as A
from vectrine.operators import directions as D
from vectrine.operators import gates as G
from vectrine.operators import inference as I
from vectrine.operators import ranking as R
from vectrine.operators import resampling as P
from vectrine.operators.sums import as_rows
from vectrine.session import cut

#: Bytes of components that are sent to every task.
MOST = 256 << 20


def without_components(vectors: DataFrame, basis: DataFrame, vector: str, width: int) -> DataFrame:
    """vectors less, in each layer, their parts along the basis (layer, component, dim, b), which is orthonormal in each layer. Layers without components stay."""
    held: dict[int, np.ndarray] = {}
    size = basis.count() * 8
    if size > MOST:
        raise ValueError(f"{size} bytes of components are too many to send to every task")
    rows = basis.groupBy("layer", "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "b"))), lambda s: s.b).alias("b")).orderBy("layer", "component").collect()
    for r in rows:
        held[r["layer"]] = np.vstack([held.get(r["layer"], np.zeros((0, width))), r.b])
    sent = vectors.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("array<double>")
    def left(series: pd.Series) -> pd.Series:
        if not len(series):
            return pd.Series([], dtype=object)
        x = np.stack(series.to_numpy()).astype(float)
        for layer, b in sent.value.items():
            part = x[:, layer * width : (layer + 1) * width]
            part -= (part @ b.T) @ b
        return pd.Series(list(x), dtype=object)

    return vectors.withColumn(vector, left(vector))


def as_vector(target: DataFrame, width: int) -> DataFrame:
    """One row, embedding, of a target (layer, dim, e)."""
    return target.agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("layer") * width + F.col("dim")).alias("at"), "e"))), lambda s: s.e).alias("embedding"))


def cleaned(vectors: DataFrame, target: DataFrame, basis: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(vectors, target) without the components of one basis."""
    goal = as_rows(without_components(as_vector(target, width), basis, "embedding", width), width, "embedding").withColumnRenamed("mu", "e")
    return without_components(vectors, basis, "embedding", width), goal


def matched_centroids(directions: DataFrame, target: DataFrame, size: int, iterations: int, seed: int) -> DataFrame:
    """iteration, comparison_type, name, layer and cosine of the centroids of ``size`` labels drawn without replacement."""
    u = D.normalised(directions, "d", "label", "layer").select("label", "layer", "dim", "u")
    k = directions.select("label").distinct().withColumn("iteration", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))))
    k = R.top_k(k, size, [F.sha2(F.concat_ws(":", F.lit(str(seed)), "iteration", "label"), 256)], "iteration")
    c = k.join(u, "label").groupBy("iteration", "layer", "dim").agg(F.avg("u").alias("c"))
    c = D.cosines_by(c.join(target, ["layer", "dim"]), "c", "e", "iteration", "layer")
    return c.select("iteration", F.lit("centroid").alias("comparison_type"), F.lit("group").alias("name"), "layer", "cosine")


def specification(vectors: DataFrame, target: DataFrame, width: int, group: list[int], draws: DataFrame, n_draws: int, permutations: int, matched: int, seeds: tuple[int, int], split, as_label: DataFrame | None = None) -> DataFrame:
    """comparison_type, estimate_name, emotion_or_group, layer, the estimates, intervals and controls of one specification; subspace rows are apart.

    as_label: the permuted labels, which depend on ids, topics and labels alone, so that specifications of the same rows share them.
    """
    vectors, target = cut(vectors), cut(target)
    means = D.array_means(vectors, "embedding", width)
    directions = cut(D.from_other_labels(means))
    seen = cut(I.overlaps(means.withColumn("iteration", F.lit(0).cast("long")), target, group).drop("iteration"))
    nulls = I.permutation_overlaps(vectors, target, group, width, permutations, seeds[0], as_label)
    random = cut(matched_centroids(directions, target, len(group), matched, seeds[1]))
    ci = P.interval(I.bootstrap_overlaps(vectors, draws, target, group, width, n_draws), "cosine", 0.95, "comparison_type", "name", "layer")
    control = lambda null, note: I.against_null(seen, null).withColumn("notes", F.lit(note))
    rows = control(nulls, "label permutation").unionByName(control(random, "matched random").where("comparison_type = 'centroid'"))
    rows = rows.join(ci, ["comparison_type", "name", "layer"]).withColumnRenamed("name", "emotion_or_group").withColumn("estimate_name", F.lit("cosine"))
    s = D.split_means(vectors, "embedding", width, split)
    s = D.from_other_labels(D.from_other_labels(s, mu="mu_a", into="a"), mu="mu_b", into="b")
    halves = D.cosines_by(s, "a", "b", "label", "layer").select(
        F.lit("split_reliability").alias("comparison_type"), F.lit("reliability").alias("estimate_name"), F.col("label").cast("string").alias("emotion_or_group"), "layer", F.col("cosine").alias("reliability"), F.lit("").alias("notes")
    )
    return rows.unionByName(halves, allowMissingColumns=True)


def subspace(vectors: DataFrame, target: DataFrame, width: int, group: list[int], iterations: int, seed: int) -> DataFrame:
    """The share of the target in the span of the group's directions, against the exact law of random subspaces of the same rank; layers are the family."""
    d = D.from_other_labels(D.array_means(vectors, "embedding", width)).where(F.col("label").isin(group))
    s = cut(A.subspace_by_layer(d, target))
    ranks = [r[0] for r in s.select("effective_rank").distinct().collect()]  # no more than the group has labels
    nulls = s.sparkSession.createDataFrame([(r, i, float(x)) for r in ranks for i, x in enumerate(P.beta_null(width, r, iterations, seed + r))], "effective_rank long, iteration long, null double")
    both = s.join(nulls, "effective_rank")
    p = P.add_one_p(both, "null", "fraction", "layer").join(R.percentiles(both, "null", [0.95], "layer").select("layer", F.col("cutoff").alias("null_p95")), "layer")
    q = R.benjamini_hochberg(s.join(p, "layer").withColumn("family", F.lit(1)), "p", "family", into="q_value")
    return q.select(
        F.lit("subspace").alias("comparison_type"), F.lit("explained_fraction").alias("estimate_name"), F.lit("group").alias("emotion_or_group"), "layer", F.col("fraction").alias("explained_fraction"),
        F.col("p").alias("p_value"), "q_value", "null_p95", F.col("effective_rank").cast("double").alias("effective_rank"), "condition_number", F.lit("matched random subspace").alias("notes"),
    )


def stability(first: DataFrame, second: DataFrame, width: int) -> DataFrame:
    """Cosines of the two models' directions; both must have the same labels and layers."""
    one, two = (D.from_other_labels(D.array_means(v, "embedding", width)).select("label", "layer", "dim", F.col("d").alias(n)) for v, n in ((first, "d"), (second, "d2")))
    c = D.cosines_by(one.join(two, ["label", "layer", "dim"], "full"), "d", "d2", "label", "layer")
    lone = one.join(two, ["label", "layer", "dim"], "full").where("d is null or d2 is null").limit(1).count()
    if lone:
        raise ValueError("the models differ in labels or layers")
    return c.select(F.lit("cross_model_stability").alias("comparison_type"), F.lit("cosine").alias("estimate_name"), F.col("label").cast("string").alias("emotion_or_group"), "layer", "cosine", F.lit("").alias("notes"))


def in_columns(rows: DataFrame, **fixed) -> DataFrame:
    """Rows with all columns of the metrics table, those that lack null; fixed: columns of one value."""
    rows = rows.withColumns({k: F.lit(v) for k, v in fixed.items()})
    columns = [x.split() for x in G.METRICS.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in columns])
