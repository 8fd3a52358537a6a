"""Linear algebra on small groups: one group a layer in applyInPandas, NumPy inside.

A group is a set of label directions or a bounded neutral set, not the corpus; larger sets come as their
Gram or covariance matrix, which Spark sums before a group is formed.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrine.operators.sums import mean_vectors


#: Dimensions of a tile's side: a task holds one tile of a covariance matrix at a time.
TILE = 128


def covariance_tiles(rows: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """layer, i, j, n and cov: tiles (flat, ddof 1) of the upper half of each layer's covariance matrix, over vectors of any number.

    Halves of vectors are dealt by tile; a task streams them and holds a tile, not vectors or pairs of elements.
    """
    vectors = rows.groupBy(key, "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x.v).alias("vec"))
    last = F.ceil(F.size("vec") / tile).cast("int") - 1
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    halves = vectors.select("layer", "vec", F.explode(pairs).alias("t")).select(
        "layer", "t.i", "t.j", F.slice("vec", F.col("t.i") * tile + 1, F.lit(tile)).alias("a"), F.slice("vec", F.col("t.j") * tile + 1, F.lit(tile)).alias("b")
    )
    schema = pa.schema([("layer", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("cov", pa.list_(pa.float64()))])

    def summed(batches):
        now = None

        def out():
            with np.errstate(invalid="ignore", divide="ignore"):
                cov = (product - np.outer(sum_a, sum_b) / n) / (n - 1)
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, n, cov.ravel().tolist()), strict=True))], schema=schema)

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            at = 0
            for one, group in groupby(keys):
                size = len(list(group))
                a, b = (np.array(batch.column(k).slice(at, size).to_pylist(), float) for k in (3, 4))
                at += size
                if one != now:
                    if now:
                        yield out()
                    now, n, shift_a, shift_b = one, 0, a[0], b[0]  # covariances don't change when vectors are moved
                    product, sum_a, sum_b = 0.0, 0.0, 0.0
                a, b = a - shift_a, b - shift_b
                n, product, sum_a, sum_b = n + size, product + a.T @ b, sum_a + a.sum(0), sum_b + b.sum(0)
        if now:
            yield out()

    dealt = halves.repartition("layer", "i", "j").sortWithinPartitions("layer", "i", "j")
    return dealt.mapInArrow(summed, "layer long, i int, j int, n long, cov array<double>")


def components(tiles: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """component, ratio, cum_ratio, retained and vec of one layer from its tiles; nothing for fewer than two vectors or no variance."""
    out = ["layer", "component", "ratio", "cum_ratio", "retained", "vec"]
    if tiles["n"].min() < 2:
        return pd.DataFrame(columns=out)
    side = {int(r.i): int(round(len(r.cov) ** 0.5)) for r in tiles.itertuples() if r.i == r.j}
    at = {k: sum(side[x] for x in range(k)) for k in side}
    n = sum(side.values())
    c = np.zeros((n, n))
    for r in tiles.itertuples():
        block = np.reshape(r.cov, (side[r.i], side[r.j]))
        c[at[r.i] : at[r.i] + side[r.i], at[r.j] : at[r.j] + side[r.j]] = block
        c[at[r.j] : at[r.j] + side[r.j], at[r.i] : at[r.i] + side[r.i]] = block.T
    values, vectors = np.linalg.eigh(c)
    values = np.clip(values[::-1], 0, None)
    if values.sum() <= 0:
        return pd.DataFrame(columns=out)
    ratio = values / values.sum()
    cum = np.cumsum(ratio)
    keep = int(np.searchsorted(cum, threshold - 1e-12)) + 1
    layer = int(tiles["layer"].iloc[0])
    rows = [(layer, k, ratio[k], cum[k], k < keep, vectors[:, n - 1 - k].tolist()) for k in range(n) if ratio[k] > 1e-12]
    return pd.DataFrame(rows, columns=out)


def pca(rows: DataFrame, key: str, threshold: float, tile: int = TILE) -> DataFrame:
    """Principal components of each layer's vectors; retained marks the shortest prefix that reaches the threshold."""
    schema = "layer long, component long, ratio double, cum_ratio double, retained boolean, vec array<double>"
    return covariance_tiles(rows, key, tile).groupBy("layer").applyInPandas(lambda pdf: components(pdf, threshold), schema)


def remove_components(rows: DataFrame, comps: DataFrame, *by: str) -> DataFrame:
    """rows (by, layer, dim, v) less their part in the retained components: cleaned."""
    c = comps.where("retained").select("layer", "component", F.posexplode("vec").alias("dim", "c")).withColumn("dim", F.col("dim").cast("long"))
    parts = rows.join(c, ["layer", "dim"]).groupBy(*by, "layer", "component").agg(F.sum(F.col("v") * F.col("c")).alias("along"))
    drop = parts.join(c, ["layer", "component"]).groupBy(*by, "layer", "dim").agg(F.sum(F.col("along") * F.col("c")).alias("part"))
    return rows.join(drop, [*by, "layer", "dim"], "left").withColumn("cleaned", F.col("v") - F.coalesce("part", F.lit(0.0))).drop("part")


def subspace_fraction(basis: np.ndarray, target: np.ndarray, tolerance: float = 1e-8) -> tuple[float, float, int, float]:
    """Share of the target within the span of unit basis rows, its cosine, the span's rank, and its condition number."""
    norms = np.linalg.norm(basis, axis=1)
    unit = basis[norms > 0] / norms[norms > 0, None]
    if not len(unit) or not np.any(target):
        return 0.0, 0.0, 0, 1.0
    _, s, v = np.linalg.svd(unit, full_matrices=False)
    keep = s > tolerance * s[0]
    part = v[keep] @ target
    fraction = float(np.clip(part @ part / (target @ target), 0, 1))
    return fraction, float(np.sqrt(fraction)), int(keep.sum()), float(s[keep][0] / s[keep][-1])


def subspace_by_layer(directions: DataFrame, target: DataFrame, value: str = "d", along: str = "e") -> DataFrame:
    """layer, fraction, cosine, effective_rank and condition_number of a target in the span of all labels' directions."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        basis = pdf.pivot_table(index="label", columns="dim", values=value).fillna(0.0).sort_index(axis=1)
        t = pdf.drop_duplicates("dim").set_index("dim")[along].sort_index().to_numpy()
        return pd.DataFrame([(int(pdf["layer"].iloc[0]), *subspace_fraction(basis.to_numpy(), t))], columns=["layer", "fraction", "cosine", "effective_rank", "condition_number"])

    joined = directions.select("label", "layer", "dim", value).join(target, ["layer", "dim"])
    return joined.groupBy("layer").applyInPandas(one, "layer long, fraction double, cosine double, effective_rank long, condition_number double")


def gram(directions: DataFrame, *by: str, value: str = "d") -> DataFrame:
    """by, i, j and g: inner products of the labels' directions (label, dim, value), which are few; summed by partial aggregates."""
    a = directions.select(*by, "dim", F.col("label").alias("i"), F.col(value).alias("a"))
    b = directions.select(*by, "dim", F.col("label").alias("j"), F.col(value).alias("b"))
    return a.join(b, [*by, "dim"]).groupBy(*by, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))


def _square(pdf: pd.DataFrame) -> tuple[np.ndarray, list]:
    table = pdf.pivot_table(index="i", columns="j", values="g").fillna(0.0)
    return table.to_numpy(), list(table.index)


def gram_fraction(directions: DataFrame, target: DataFrame, by: str = "layer", value: str = "d", along: str = "e", tolerance: float = 1e-8) -> DataFrame:
    """by, fraction and effective_rank: the target's share in the directions' span, through the eigenvalues of their Gram matrix.

    Only inner products are gathered, so that a group is as large as its labels are many, whatever the dimension.
    """
    norms = target.groupBy(by).agg(F.sum(F.col(along) * F.col(along)).alias("t"))
    parts = directions.join(target, [by, "dim"]).groupBy(by, F.col("label").alias("i")).agg(F.sum(F.col(value) * F.col(along)).alias("p"))
    rows = gram(directions, by, value=value).join(parts, [by, "i"]).join(norms, by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g, names = _square(pdf)
        p = pdf.drop_duplicates("i").set_index("i")["p"].reindex(names).to_numpy()
        length = np.sqrt(np.maximum(np.diag(g), 0))
        some = length > 0
        fraction, rank, t = 0.0, 0, float(pdf["t"].iloc[0])
        if some.any() and t > 0:
            g, p = g[np.ix_(some, some)] / np.outer(length[some], length[some]), p[some] / length[some]
            values, vectors = np.linalg.eigh(g)
            keep = values > max(tolerance**2, len(g) * np.finfo(float).eps) * values[-1]
            fraction, rank = float(np.clip((((vectors.T @ p) ** 2)[keep] / values[keep]).sum() / t, 0, 1)), int(keep.sum())
        return pd.DataFrame([(pdf[by].iloc[0], fraction, rank)], columns=[by, "fraction", "effective_rank"])

    return rows.groupBy(by).applyInPandas(one, f"{by} long, fraction double, effective_rank long")


def principal_scores(directions: DataFrame, by: str = "layer", value: str = "d") -> DataFrame:
    """by, label, component, score and ratio: principal components of the labels' directions, by their centred Gram matrix. A component's sign is such that its greatest score by size is positive."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g, names = _square(pdf)
        n = len(g)
        c = np.eye(n) - 1 / n
        values, vectors = np.linalg.eigh(c @ g @ c)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
        total = values.sum()
        out = []
        for k in range(max(n - 1, 0)):
            score = vectors[:, k] * np.sqrt(values[k])
            score *= 1 if score[np.abs(score).argmax()] >= 0 else -1
            out += [(pdf[by].iloc[0], x, k, float(s), float(values[k] / total) if total > 0 else 0.0) for x, s in zip(names, score, strict=True)]
        return pd.DataFrame(out, columns=[by, "label", "component", "score", "ratio"])

    return gram(directions, by, value=value).groupBy(by).applyInPandas(one, f"{by} long, label long, component long, score double, ratio double")


def structure(scores: DataFrame, ratings: DataFrame, by: str = "layer", least: float = 0.5) -> DataFrame:
    """by, valence and arousal (sizes of correlations) and passed: the first component against valence; of the second and third, which may be rotated, the best fit to arousal.

    ratings: label, valence, arousal; labels without a rating don't count. Fewer than three give null.
    """

    def size_of(x: np.ndarray, y: np.ndarray) -> float | None:
        if len(x) < 3 or not x.std() or not y.std():
            return None
        return float(abs(np.corrcoef(x, y)[0, 1]))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="label", columns="component", values="score").sort_index()
        rating = pdf.drop_duplicates("label").set_index("label")[["valence", "arousal"]].reindex(wide.index).astype(float)
        v, a = rating["valence"].notna().to_numpy(), rating["arousal"].notna().to_numpy()
        x = wide.to_numpy()
        valence = size_of(x[v, 0], rating["valence"].to_numpy()[v])
        basis, goal, arousal = x[a, 1:3], rating["arousal"].to_numpy()[a], None
        if basis.shape[1] and a.sum() >= 3:
            arousal = size_of(basis @ np.linalg.lstsq(basis, goal, rcond=None)[0], goal)
        passed = valence is not None and arousal is not None and valence >= least and arousal >= least
        return pd.DataFrame([(pdf[by].iloc[0], valence, arousal, passed)], columns=[by, "valence", "arousal", "passed"])

    return scores.join(ratings, "label", "left").groupBy(by).applyInPandas(one, f"{by} long, valence double, arousal double, passed boolean")


def token_means(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc_id, n and mean (array): the mean vector of each text's tokens; null in mean where n is 0.

    tokens: doc_id, bucket (of a vector; null for a text without tokens) and n; vectors: bucket, vec. Vectors are summed by text where they meet their tokens.
    """
    rows = tokens.join(vectors, "bucket", "left")
    return mean_vectors(rows, "vec", "doc_id", weight=F.col("n")).withColumn("n", F.col("n").cast("long"))


def leaf_order(distance: np.ndarray) -> list[int]:
    """Leaves of an average-linkage tree from left to right; of equal distances the pair with the least members merges first."""
    groups = {i: [i] for i in range(len(distance))}
    while len(groups) > 1:
        keys = sorted(groups)
        pairs = [(float(np.mean(distance[np.ix_(groups[a], groups[b])])), min(groups[a]), min(groups[b]), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
        *_, a, b = min(pairs)
        groups[a] += groups.pop(b)
    return next(iter(groups.values()), [])


def kmeans(points: np.ndarray, k: int, seed: int = 0, starts: int = 20) -> np.ndarray:
    """Cluster of each point, numbered by least member: the best of several k-means++ starts."""
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(starts):
        centres = points[[rng.integers(len(points))]]
        while len(centres) < min(k, len(points)):
            d = ((points[:, None] - centres) ** 2).sum(2).min(1)
            centres = np.vstack([centres, points[rng.choice(len(points), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(points))]])
        for _ in range(100):
            label = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
            new = np.array([points[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))])
            if np.allclose(new, centres):
                break
            centres = new
        loss = ((points - centres[label]) ** 2).sum()
        if best is None or loss < best[0] - 1e-12:
            best = (loss, label)
    _, first = np.unique(best[1], return_index=True)
    number = {best[1][i]: n for n, i in enumerate(sorted(first))}
    return np.array([number[x] for x in best[1]])


def zscored(rows: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Columns as z-scores (ddof 1) within groups; a column that does not vary gives 0."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    return rows.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)), F.lit(0.0)) for c in columns})


def logistic(rows: DataFrame, features: list[str], label: str, l1: float) -> tuple[list[float], float]:
    """Coefficients and intercept of an L1 logistic regression, fitted by Spark."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="__features").transform(rows)
    model = LogisticRegression(featuresCol="__features", labelCol=label, elasticNetParam=1.0, regParam=l1, maxIter=100).fit(data)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def repeated_fits(rows: DataFrame, features: list[str], label: str, key: str, l1: float, repeats: int = 5, train: float = 0.8, seed: int = 0) -> DataFrame:
    """repeat, n_test, accuracy and balanced_accuracy of L1 logistic regressions: in each repeat, the share train of either class, by seeded hashes of a key, is learnt from and the rest is scored."""
    out = []
    for repeat in range(repeats):
        place = F.percent_rank().over(W.partitionBy(label).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(repeat)), F.col(key).cast("string")), 256)))
        dealt = rows.withColumn("__train", place < train)
        weights, bias = logistic(dealt.where("__train"), features, label, l1)
        score = sum((F.col(c) * w for c, w in zip(features, weights, strict=True)), F.lit(bias))
        right = ((score > 0).cast("int") == F.col(label)).cast("int")
        by_class = dealt.where("not __train").groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("right")).collect()  # two rows
        n = sum(r.n for r in by_class)
        out.append((repeat, n, sum(r.right for r in by_class) / n if n else None, sum(r.right / r.n for r in by_class) / len(by_class) if by_class else None))
    return rows.sparkSession.createDataFrame(out, "repeat int, n_test long, accuracy double, balanced_accuracy double")
