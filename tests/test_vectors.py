import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.functions import vectors as V
from vectrine.operators import algebra, gates, ranking, resampling, selection
from vectrine.operators import directions as D


def one(spark, **columns):
    values = {k: v for k, v in columns.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} array<double>" for k in values))


def test_vector_arithmetic(spark):
    df = one(spark, a=[3.0, 4.0], b=[4.0, 3.0], z=[0.0, 0.0])
    r = df.select(V.norm(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.cosine(F.col("a"), F.col("z")).alias("none"), V.cosine_or_zero(F.col("a"), F.col("z")).alias("zero"), V.reject(F.col("a"), F.col("b")).alias("r"), V.unit_or_zero(F.col("z")).alias("u")).first()
    assert r.n == 5 and abs(r.c - 0.96) < 1e-12 and r.none is None and r.zero == 0 and np.allclose(r.r, np.array([3, 4]) - 24 / 25 * np.array([4, 3])) and r.u == [0, 0]
    with pytest.raises(Exception, match="no direction"):
        df.select(V.unit(F.col("z"))).collect()


def long(spark, vectors):
    rows = [(label, i, topic, v) for i, (label, topic, v) in enumerate(vectors)]
    return D.long_form(spark.createDataFrame(rows, "label int, vec_id long, topic_id long, embedding array<float>"))


def test_directions_equal_numpy(spark):
    rng = np.random.default_rng(0)
    data = [(i % 4, i % 5, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    means = np.array([np.mean([v for lab, _, v in data if lab == k], axis=0) for k in range(4)])
    want = {k: means[k] - np.mean(np.delete(means, k, 0), axis=0) for k in range(4)}
    got = D.from_other_labels(D.label_means(long(spark, data))).toPandas().pivot(index="label", columns="dim", values="d")
    assert np.allclose(got.to_numpy(), np.array([want[k] for k in range(4)]), atol=1e-7)
    cos = D.pairwise_cosines(D.from_other_labels(D.label_means(long(spark, data)))).toPandas()
    r = cos[(cos.label_a == 0) & (cos.label_b == 2)].cosine.iloc[0]
    assert abs(r - want[0] @ want[2] / np.linalg.norm(want[0]) / np.linalg.norm(want[2])) < 1e-7
    means = D.array_means(spark.createDataFrame([(a, c) for a, _, c in data], "label int, v array<float>"), "v", None)
    again = D.from_other_labels(means).toPandas().pivot(index="label", columns="dim", values="d")
    assert np.allclose(again.to_numpy(), got.to_numpy(), atol=1e-12)
    t = D.topic_means(spark.createDataFrame([(0, 0, [0.0]), (0, 0, [2.0]), (0, 1, [10.0])], "label int, topic_id int, v array<float>"), "v", None).first()
    assert t.mu == 5.5 and t.topics == 2


def test_centroid_ignores_length(spark):
    d = long(spark, [(0, 0, [100.0, 0.0]), (1, 0, [0.0, 1.0])]).withColumnRenamed("v", "d")
    got = [r.c for r in D.centroid(d, [0, 1]).orderBy("dim").collect()]
    assert np.allclose(got, [2**-0.5, 2**-0.5])


def test_resampling_cases(spark):
    nulls = spark.createDataFrame([(0, x, 0.35) for x in (0.1, 0.2, 0.3, 0.4)], "g int, n double, o double")
    assert resampling.add_one_p(nulls, "n", "o", "g").first().p == 2 / 5
    fam = spark.createDataFrame([(1, i, v) for i, vs in enumerate([(0.2, 0.1), (0.4, 0.0), (0.6, 0.3)]) for v in vs], "f int, i int, n double")
    seen = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.2)], "f int, k string, o double")
    p = {r.k: r.p for r in resampling.max_statistic_p(fam, "n", "i", seen, "o", "f").collect()}
    assert p == {"a": 2 / 4, "b": 1.0}
    r = resampling.interval(spark.range(101).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x")), "x", 0.8, "g").first()
    assert abs(r.ci_low - 10) < 1e-9 and abs(r.ci_high - 90) < 1e-9
    sums = spark.createDataFrame([(0, 2.0, 2), (1, 10.0, 1)], "topic_id long, total double, n long")
    draws = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 1, 0)], "iteration long, slot long, topic_id long")
    assert {r.iteration: r.value for r in resampling.bootstrap_of_sums(sums, draws).collect()} == {0: 4.0, 1: 1.0}
    a, b = (resampling.bootstrap_draws(spark, [5, 7, 9], 4, 1).collect() for _ in range(2))
    assert a == b and len(a) == 12


def test_gram_form_of_permutations_equals_direct():
    rng = np.random.default_rng(3)
    x, labels, blocks, target = rng.normal(size=(24, 5)), np.tile(np.arange(4), 6), np.repeat(np.arange(6), 4), rng.normal(size=5)
    single, central = resampling.permutation_nulls(x, labels, blocks, target, 10, 8)
    again = np.random.default_rng(8)
    for k in range(10):
        now = labels.copy()
        for b in range(6):
            m = np.flatnonzero(blocks == b)
            now[m] = again.permutation(now[m])
        mu = np.array([x[now == c].mean(0) for c in range(4)])
        d = np.array([mu[c] - np.delete(mu, c, 0).mean(0) for c in range(4)])
        cos = d @ target / np.linalg.norm(d, axis=1) / np.linalg.norm(target)
        u = (d / np.linalg.norm(d, axis=1, keepdims=True)).mean(0)
        assert np.allclose(single[k], cos) and abs(central[k] - u @ target / np.linalg.norm(u) / np.linalg.norm(target)) < 1e-12
    assert (resampling.beta_null(5, 5, 3, 0) == 1).all() and 0 < resampling.beta_null(9, 2, 3, 0).max() < 1


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None), (4, float("nan"))], "i int, p double")
    q = {r.i: r.q for r in ranking.benjamini_hochberg(rows.withColumn("f", F.lit(1)), "p", "f").collect()}
    assert q[3] is None and q[4] is None and np.allclose([q[0], q[1], q[2]], [0.03, 0.04, 0.04])


def test_ranks_and_histogram(spark):
    rows = spark.createDataFrame([(i, float(i % 4)) for i in range(12)], "i long, v double").withColumn("g", F.lit("a"))
    assert [r.i for r in ranking.top_k(rows, 3, [F.desc("v"), F.desc("i")], "g").orderBy("rank").collect()] == [11, 7, 3]
    h = ranking.histogram(rows, "v", 3, "g").orderBy("bin").collect()
    assert [(r.bin, r.n) for r in h] == [(0, 3), (1, 3), (2, 6)]
    flat = ranking.histogram(rows.withColumn("v", F.lit(2.0)), "v", 4, "g").first()
    assert (flat.low, flat.high, flat.n) == (1.5, 2.5, 12)
    hit = ranking.above_percentile(rows, "v", 0.5, "g").where("hit").count()
    assert hit == 6
    runs = spark.createDataFrame([(k, v) for k, v in enumerate([1, 1, 1, 9, 1, 1])], "k long, v int").withColumn("g", F.lit(0))
    assert [r.run for r in ranking.runs_below(runs, "v", 5, "k", "g").orderBy("k").collect()] == [1, 2, 3, 1, 2]


def test_algebra(spark):
    assert np.allclose(algebra.subspace_fraction(np.eye(3)[:2] * 7, np.array([3.0, 4.0, 5.0])), (0.5, 2**-0.5, 2, 1))
    assert algebra.subspace_fraction(np.array([[1.0, 0, 0], [2, 0, 0]]), np.array([1.0, 1, 0]))[2] == 1
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4)) * [5, 2, 1, 0.1]
    rows = long(spark, [(0, 0, v.tolist()) for v in x])
    got = algebra.pca(rows, "vec_id", 0.9).orderBy("component").collect()
    values = np.linalg.eigvalsh(np.cov(x.astype(np.float32).astype(float).T))[::-1]
    assert np.allclose([r.ratio for r in got], values / values.sum(), atol=1e-7)
    keep = int(np.searchsorted(np.cumsum(values / values.sum()), 0.9)) + 1
    assert [r.retained for r in got] == [k < keep for k in range(4)]
    left = algebra.remove_components(rows.select("vec_id", "layer", "dim", "v"), algebra.pca(rows, "vec_id", 1.0), "vec_id")
    assert left.agg(F.max(F.abs("cleaned"))).first()[0] < 1e-6
    assert algebra.pca(rows.where("vec_id = 0"), "vec_id", 0.9).count() == 0
    d = np.abs(np.subtract.outer([0.0, 10, 1, 11, 0.5], [0.0, 10, 1, 11, 0.5]))
    assert algebra.leaf_order(d)[:3] == [0, 4, 2]
    assert list(algebra.kmeans(np.array([[0.0], [9], [0.1], [9.2], [20]]), 3)) == [0, 1, 0, 1, 2]


def test_contracts(spark):
    rows = spark.createDataFrame([("individual", "aligned", 1, "x", "cosine", 0.5, None, None, 0.1, 0.2, 0.01, 0.02, None, None, "raw", None, None, True, True, "")], gates.METRICS)
    assert gates.metrics_violations(rows).count() == 0
    bad = rows.withColumns({"cosine": F.lit(1.5), "ci_low": F.lit(None).cast("double"), "pca_status": F.lit("other")})
    assert {r.rule for r in gates.metrics_violations(bad).collect()} == {"range of cosine", "interval", "domain of pca_status"}
    twice = spark.createDataFrame([("a", 0.5, "x"), ("a", 0.5, "y"), ("b", 1.0, "x")], "k string, v double, notes string")
    assert {r.k: r.notes for r in gates.collapse_controls(twice, ["k"], ["v"], "notes").collect()} == {"a": "x; y", "b": "x"}
    with pytest.raises(Exception, match="differ"):
        gates.collapse_controls(twice.withColumn("v", F.col("v") + F.length("notes") * F.when(F.col("notes") == "y", 1).otherwise(0)), ["k"], ["v"], "notes").collect()


def test_selection_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, sha string")
    b = spark.createDataFrame([(2, 9), (1, 8)], "id long, score int")
    assert selection.join_one_to_one(a, b, "id").count() == 2
    for left, right in ((a.union(a), b), (a, b.union(b)), (a.where("id = 1"), b), (a, b.where("id = 1"))):
        with pytest.raises(selection.ContractError):
            selection.join_one_to_one(left, right, "id")
    with pytest.raises(selection.ContractError):
        selection.pending(a, a.withColumn("sha", F.lit("z")), "id", "sha")
    assert selection.pending(a, a.where("id = 1"), "id", "sha").count() == 1
    cases = [("p0", 71, 51), ("p0", 71, 51), ("p0", 30, 51), ("p0", 30, 51), ("p0", 70, 100), ("p0", 100, 50), ("p1", 100, 100), ("p1", 100, 100), ("p1", 0, 100), ("p1", 0, 100)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id long, prompt string, al int, co int")
    rows = rows.withColumn("label", selection.classify(F.col("al"), F.col("co"))).where("label is not null")
    assert rows.count() == 8
    pairs = selection.matched_pairs(rows, "prompt", "label", F.sha2(F.concat(F.lit("1:"), "id"), 256), "aligned", "misaligned", 3)
    assert [r.prompt for r in pairs.orderBy("pair_id").collect()] == ["p0", "p1", "p0"]
    assert selection.merge_contained(["q", "q_long", "other"]) == {"q": "q", "q_long": "q", "other": "other"}
