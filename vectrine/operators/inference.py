"""Resampling of whole label directions: permutations, bootstraps and what follows from them.

A statistic of a draw needs the labels' mean vectors under that draw. Vectors are dealt by (layer, run of
dimensions), with the labels that the draws give them as small integers; a task streams the rows of its runs, holds only the
sums of each draw and label over a run, and gives out what cosines need of them: products of directions with each
other and with the target. So what is shuffled after it has a row a (draw, layer, run, two labels), whatever
the number of dimensions, and no mean vector of a draw leaves its task.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrine.functions import vectors as V
from vectrine.operators import directions as D
from vectrine.operators import ranking as R
from vectrine.operators import resampling as P
from vectrine.operators.sums import vector_sums
from vectrine.session import cut

#: Bytes of sums that a task holds: draws x labels x dimensions of a run.
HELD = 64 << 20


def run_of(width: int, draws: int, labels: int, held: int = HELD) -> int:
    """Dimensions of a run: the largest divisor of a layer's width whose sums keep within bounds."""
    return max(k for k in range(1, width + 1) if width % k == 0 and (k == 1 or 8 * k * draws * labels <= held))


def in_runs(vectors: DataFrame, vector: str, width: int, run: int) -> DataFrame:
    """layer, first and part of each run of dimensions, next to all other columns. run divides width, the elements of a layer."""
    keep = [c for c in vectors.columns if c != vector]
    at = F.explode(F.sequence(F.lit(0), (F.size(vector) / run).cast("int") - 1)).alias("at")
    part = F.slice(vector, F.col("at") * run + 1, F.lit(run))
    place = {"layer": F.floor(F.col("at") * run / width), "first": F.col("at") * run % width}
    return vectors.select(*keep, vector, at).select(*keep, *[c.cast("long").alias(k) for k, c in place.items()], part.alias("part"))


def numbered(as_label: Column, labels: list[int]) -> Column:
    """An array of labels as places in a list, in as many bytes as these need; -1 for others."""
    known = F.array(*[F.lit(int(x)).cast("long") for x in labels])
    return F.transform(as_label, lambda x: F.array_position(known, x.cast("long")) - 1).cast(f"array<{'tinyint' if len(labels) < 128 else 'int'}>")


def _streamed_runs(batches):
    """((layer, first), table) pieces of sorted batches."""
    for batch in batches:
        table = pa.table([*batch.columns], names=batch.schema.names)
        at = 0
        for key, group in groupby(zip(table["layer"].to_pylist(), table["first"].to_pylist(), strict=True)):
            size = len(list(group))
            yield key, table.slice(at, size)
            at += size


def _matrix(column, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(size, -1)


def resampled_products(rows: DataFrame, target: DataFrame, labels: list[int], group: list[int], width: int, draws: int) -> DataFrame:
    """iteration, layer, label_a, label_b and product: of each label's direction under a draw with itself (label_b = label_a), with the target
    (label_b null) and, in the group, with the others (label_a < label_b); the row with both null is the target's with itself.

    rows: embedding (a sum of n vectors), n, as_label (the label a row has in each draw) and weight (how often a draw takes it; null:
    once). A direction is a label's mean less the mean of the other labels' means; labels without rows in a draw have none there.
    """
    run, k_of = run_of(width, draws, len(labels)), {x: k for k, x in enumerate(labels)}
    members = [k_of[x] for x in group if x in k_of]
    schema = "iteration long, layer long, label_a long, label_b long, product double"

    def products(total: np.ndarray, n: np.ndarray, e: np.ndarray, layer: int):
        present = n > 0
        mean = np.divide(total, n[:, :, None], out=np.zeros_like(total), where=present[:, :, None])
        others = present.sum(0) - 1
        d = mean - np.divide(mean.sum(0) - mean, others[None, :, None], out=np.zeros_like(mean), where=(others > 0)[None, :, None])
        has = present & (others > 0)
        pairs = [(i, i) for i in range(len(labels))] + [(i, None) for i in range(len(labels))] + [(i, j) for i in members for j in members if i < j]
        for i, j in pairs:
            some = np.flatnonzero(has[i] & (has[j] if j is not None else True))
            value = d[i][some] @ e if j is None else np.einsum("id,id->i", d[i][some], d[j][some])
            yield some, layer, labels[i], None if j is None else labels[j], value
        yield np.arange(n.shape[1]), layer, None, None, np.full(n.shape[1], e @ e)

    def summed(batches):
        for (layer, _), pieces in groupby(_streamed_runs(batches), key=lambda x: x[0]):
            total, n, e = np.zeros(0), np.zeros((len(labels), draws)), None
            for _, table in pieces:
                size = table.num_rows
                part = _matrix(table["part"], size)
                goal = table["as_label"].is_null().to_numpy()
                if goal.any():
                    e, part, table = part[goal][0], part[~goal], table.filter(pa.array(~goal))
                    size = table.num_rows
                if not size:
                    continue
                if not total.size:
                    total = np.zeros((len(labels), draws, part.shape[1]))
                count, as_label = table["n"].to_numpy()[:, None], _matrix(table["as_label"], size)
                weight = _matrix(table["weight"], size) if not table["weight"].null_count else 1.0
                for k in range(len(labels)):
                    drawn = ((as_label == k) * weight).T
                    total[k] += drawn @ part
                    n[k] += (drawn @ count)[:, 0]
            if not total.size or e is None:
                continue
            for some, at, a, b, value in products(total, n, e, layer):
                whole = [pa.array([x] * len(some), pa.int64()) for x in (at, a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(some), *whole, pa.array(value)], ["iteration", "layer", "label_a", "label_b", "product"])

    parts = in_runs(rows.select("embedding", F.col("n").cast("double"), numbered(F.col("as_label"), labels).alias("as_label"), F.col("weight").cast("array<float>")), "embedding", width, run)
    goal = target.groupBy("layer", (F.col("dim") - F.col("dim") % run).alias("first")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "e"))), lambda s: s.e).alias("part"))
    kinds = dict(parts.dtypes)
    goal = goal.select(*[(F.col(c) if c in goal.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in parts.columns])
    dealt = parts.unionByName(goal).repartition("layer", "first").sortWithinPartitions("layer", "first")
    found = dealt.select("layer", "first", "part", "n", "as_label", "weight").mapInArrow(summed, schema)
    return found.groupBy("iteration", "layer", "label_a", "label_b").agg(F.sum("product").alias("product"))


def resampled_overlaps(rows: DataFrame, target: DataFrame, labels: list[int], group: list[int], width: int, draws: int) -> DataFrame:
    """overlaps() of each draw, from the products of its directions; null where a norm is zero."""
    p = cut(resampled_products(rows, target, labels, group, width, draws))
    at = ["iteration", "layer"]
    goal = p.where("label_a is null").select(*at, F.sqrt("product").alias("goal"))
    norm = p.where("label_a = label_b").select(*at, F.col("label_a").alias("label"), F.sqrt("product").alias("norm"))
    dot = p.where("label_a is not null and label_b is null").select(*at, F.col("label_a").alias("label"), F.col("product").alias("dot"))
    one = dot.join(norm, [*at, "label"]).join(goal, at)
    cosine = lambda top, bottom: F.when(bottom > 0, V.clip(top / bottom))
    each = one.select("iteration", F.lit("individual").alias("comparison_type"), F.col("label").cast("string").alias("name"), "layer", cosine(F.col("dot"), F.col("norm") * F.col("goal")).alias("cosine"))
    inner = one.where(F.col("label").isin(group))
    # the centroid is the mean of unit directions: its products are sums over pairs of members, and zero vectors add nothing
    unit = lambda x: F.coalesce(F.try_divide(x, F.col("norm")), F.lit(0.0))
    center = inner.groupBy(*at).agg(F.sum(unit(F.col("dot"))).alias("dot"), F.sum(F.when(F.col("norm") > 0, 1.0).otherwise(0.0)).alias("own"), F.first("goal").alias("goal"))
    mixed = p.where("label_a < label_b").select(*at, "label_a", "label_b", "product")
    for side in ("label_a", "label_b"):
        mixed = mixed.join(norm.select(*at, F.col("label").alias(side), F.col("norm").alias(f"norm_{side}")), [*at, side])
    mixed = mixed.groupBy(*at).agg(F.sum(F.coalesce(F.try_divide(F.col("product"), F.col("norm_label_a") * F.col("norm_label_b")), F.lit(0.0))).alias("mixed"))
    center = center.join(mixed, at, "left").withColumn("size", F.sqrt(F.greatest(F.col("own") + 2 * F.coalesce("mixed", F.lit(0.0)), F.lit(0.0))))
    center = center.select("iteration", F.lit("centroid").alias("comparison_type"), F.lit("group").alias("name"), "layer", cosine(F.col("dot"), F.col("size") * F.col("goal")).alias("cosine"))
    return each.unionByName(center)


def permuted_labels(rows: DataFrame, iterations: int, seed: int) -> DataFrame:
    """vec_id and as_label: within each topic, rows in hash order take the labels that rows in id order have, anew in each iteration."""
    x = rows.withColumn("place", F.row_number().over(W.partitionBy("topic_id").orderBy("vec_id")))
    h = x.select("vec_id", "topic_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))).alias("iteration"))
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), "iteration", "vec_id"), 256)
    h = h.withColumn("place", F.row_number().over(W.partitionBy("iteration", "topic_id").orderBy(key)))
    taken = h.join(x.select("topic_id", "place", "label"), ["topic_id", "place"])
    return taken.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("iteration", "label"))), lambda s: s.label).alias("as_label"))


def topic_weights(draws: DataFrame, iterations: int) -> DataFrame:
    """topic_id and weight: how often each iteration draws the topic."""
    times = draws.groupBy("topic_id", "iteration").agg(F.count(F.lit(1)).alias("times"))
    held = times.groupBy("topic_id").agg(F.map_from_entries(F.collect_list(F.struct("iteration", "times"))).alias("m"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))
    return held.select("topic_id", F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("weight"))


def overlaps(means: DataFrame, target: DataFrame, group: list[int]) -> DataFrame:
    """iteration, comparison_type, name, layer and cosine with the target (layer, dim, e): of each label's direction, and of the group's centroid."""
    d = D.from_other_labels(means, "iteration")
    one = D.cosines_by(d.join(target, ["layer", "dim"]), "d", "e", "iteration", "label", "layer")
    one = one.select("iteration", F.lit("individual").alias("comparison_type"), F.col("label").cast("string").alias("name"), "layer", "cosine")
    unit = D.normalised(d.where(F.col("label").isin(group)), "d", "iteration", "label", "layer")
    center = unit.groupBy("iteration", "layer", "dim").agg(F.avg("u").alias("c"))
    center = D.cosines_by(center.join(target, ["layer", "dim"]), "c", "e", "iteration", "layer")
    return one.unionByName(center.select("iteration", F.lit("centroid").alias("comparison_type"), F.lit("group").alias("name"), "layer", "cosine"))


def permutation_overlaps(vectors: DataFrame, target: DataFrame, group: list[int], width: int, iterations: int, seed: int, as_label: DataFrame | None = None) -> DataFrame:
    """overlaps() of every permutation of labels within topics. vectors: vec_id, label, topic_id, embedding.

    as_label: permuted_labels() of these rows with these iterations and this seed, if they are there already.
    """
    labels = [r[0] for r in vectors.select("label").distinct().orderBy("label").collect()]  # the labels are few
    if as_label is None:
        as_label = permuted_labels(vectors.select("vec_id", "label", "topic_id"), iterations, seed)
    rows = vectors.select("vec_id", "embedding").join(as_label, "vec_id").withColumns({"n": F.lit(1.0), "weight": F.lit(None)})
    return cut(resampled_overlaps(rows, target, labels, group, width, iterations))


def bootstrap_overlaps(vectors: DataFrame, draws: DataFrame, target: DataFrame, group: list[int], width: int, iterations: int) -> DataFrame:
    """overlaps() of every draw of topics; a topic weighs as many rows as it has. Vectors are summed by label and topic first."""
    labels = [r[0] for r in vectors.select("label").distinct().orderBy("label").collect()]  # the labels are few
    cells = vector_sums(vectors, "embedding", "label", "topic_id").withColumnRenamed("total", "embedding")
    rows = cells.join(topic_weights(draws, iterations), "topic_id").withColumn("as_label", F.array_repeat(F.col("label").cast("long"), iterations))
    return cut(resampled_overlaps(rows, target, labels, group, width, iterations))


def against_null(observed: DataFrame, nulls: DataFrame) -> DataFrame:
    """observed with null_p95, p_value, q_value (all names and layers of a comparison are one family) and max_stat_p_value.

    The last holds the greatest cosine over a name's layers against the greatest of each iteration.
    """
    keys = ["comparison_type", "name"]
    both = nulls.withColumnRenamed("cosine", "null").join(observed, [*keys, "layer"])
    p = P.add_one_p(both, "null", "cosine", *keys, "layer").withColumnRenamed("p", "p_value")
    p95 = R.percentiles(nulls, "cosine", [0.95], *keys, "layer").select(*keys, "layer", F.col("cutoff").alias("null_p95"))
    top = nulls.groupBy(*keys, "iteration").agg(F.max("cosine").alias("null"))
    most = top.join(observed.groupBy(*keys).agg(F.max("cosine").alias("cosine")), keys)
    most = P.add_one_p(most, "null", "cosine", *keys).withColumnRenamed("p", "max_stat_p_value")
    rows = R.benjamini_hochberg(observed.join(p, [*keys, "layer"]), "p_value", "comparison_type", into="q_value")
    return rows.join(p95, [*keys, "layer"]).join(most, keys)
