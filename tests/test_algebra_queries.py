"""Queries that SQL cannot express, against NumPy over the same table; and the algebra behind them."""

import os

import numpy as np
import pytest

from vectrine.operators import algebra, gates, inference
from vectrine.plans import registry

DIR = "/root/testdata/sf0.001"
CHECKED = {"neutral_pca", "denoised_directions", "subspace_fraction", "gram_fraction", "direction_scores", "structure_verdict", "geometry_subspace", "vector_clusters"}


@pytest.fixture(scope="module")
def vectors():
    """(vectors by layer, labels): arrays of (row, layer, dim)."""
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    t = pq.read_table(f"{DIR}/embeddings.parquet")
    return np.array(t["embedding"].to_pylist(), float).reshape(-1, 4, 16), np.array(t["label"].to_pylist())


@pytest.fixture(scope="module")
def geometry(vectors):
    """(directions by label, layer and dim; contrast by layer and dim)."""
    e, labels = vectors
    mu = np.array([e[labels == k].mean(0) for k in range(10)])
    return np.array([mu[k] - np.delete(mu, k, 0).mean(0) for k in range(10)]), mu[0] - mu[1]


def rows(spark, name):
    return [r.asDict() for r in registry.queries()[name](spark, DIR).collect()]


def neutral(vectors, layer):
    x = vectors[0][vectors[1] == 9][:, layer]
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    ratio = s**2 / (s**2).sum()
    return ratio, v[: np.searchsorted(np.cumsum(ratio), 0.5 - 1e-12) + 1]


def test_neutral_components(spark, vectors, geometry):
    got = rows(spark, "neutral_pca")
    for layer in range(4):
        ratio, keep = neutral(vectors, layer)
        mine = sorted((r for r in got if r["layer"] == layer), key=lambda r: r["component"])
        assert np.allclose([r["ratio"] for r in mine], ratio[: len(mine)], atol=1e-7) and ratio[len(mine) :].sum() < 1e-9
        assert np.allclose([r["cum_ratio"] for r in mine], np.cumsum(ratio)[: len(mine)], atol=1e-7)
        assert sum(r["retained"] for r in mine) == len(keep)
    d, _ = geometry
    cleaned = np.zeros_like(d)
    for r in rows(spark, "denoised_directions"):
        cleaned[r["label"], r["layer"], r["dim"]] = r["cleaned"]
    for layer in range(4):
        v = neutral(vectors, layer)[1]
        assert np.allclose(cleaned[:, layer], d[:, layer] - d[:, layer] @ v.T @ v, atol=1e-6)


def test_components_from_any_tiles(spark):
    x = np.random.default_rng(2).normal(size=(30, 7)) * [5, 3, 2, 1, 1, 1, 0.1] + 1000
    rows = spark.createDataFrame([(i, k % 2, d, float(x[i, d]) * (k + 1)) for i in range(30) for k in range(2) for d in range(7)], "key long, layer long, dim long, v double")
    ratio = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    for tile in (1, 3, 7, 128):
        got = algebra.pca(rows, "key", 0.9, tile).where("layer = 1").orderBy("component").collect()
        assert np.allclose([r.ratio for r in got], ratio / ratio.sum(), atol=1e-9)
    assert algebra.pca(rows.where("key = 0"), "key", 0.9).count() == 0


def share(basis, target):
    unit = basis / np.linalg.norm(basis, axis=1, keepdims=True)
    q, _ = np.linalg.qr(unit.T)
    s = np.linalg.svd(unit, compute_uv=False)
    return ((q.T @ target) ** 2).sum() / (target @ target), s[0] / s[-1]


def test_subspace_shares(spark, geometry):
    d, em = geometry
    by_svd, by_gram, study = ({r["layer"]: r for r in rows(spark, n)} for n in ("subspace_fraction", "gram_fraction", "geometry_subspace"))
    for layer in range(4):
        fraction, condition = share(d[2:5, layer], em[layer])
        for got in (by_svd, by_gram, study):
            assert got[layer]["fraction"] == pytest.approx(fraction, abs=1e-7) and got[layer]["effective_rank"] == 3
        assert by_svd[layer]["condition_number"] == pytest.approx(condition, abs=1e-5)
        assert study[layer]["null_p95"] == pytest.approx(0.4, abs=0.1) and study[layer]["p"] <= study[layer]["q"] <= 1
        # 1,000 exact draws of Beta(3 / 2, 13 / 2) against as many of its own
        draws = np.random.default_rng(1).beta(1.5, 6.5, 100_000)
        assert study[layer]["p"] == pytest.approx((draws >= fraction).mean(), abs=0.06)


def test_gram_of_dependent_directions(spark):
    table = [(0, 7, 0, 1.0), (1, 7, 0, 2.0), (2, 7, 1, 3.0), (2, 7, 0, 0.0), (3, 7, 2, 0.0)]
    d = spark.createDataFrame(table, "label long, layer long, dim long, d double")
    target = spark.createDataFrame([(7, 0, 3.0), (7, 1, 4.0), (7, 2, 5.0)], "layer long, dim long, e double")
    (got,) = algebra.gram_fraction(d, target).collect()
    assert (got.fraction, got.effective_rank) == (pytest.approx(0.5), 2)


def test_direction_components(spark, geometry):
    d, _ = geometry
    got, verdict = rows(spark, "direction_scores"), {r["layer"]: r for r in rows(spark, "structure_verdict")}
    valence = np.array([k % 5 - 2.0 for k in range(9)])
    arousal = np.array([k * 3 % 7 / 1.0 for k in range(9)])
    for layer in range(4):
        x = d[:, layer] - d[:, layer].mean(0)
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        scores = u * s
        mine = np.zeros((10, 9))
        for r in got:
            if r["layer"] == layer:
                mine[r["label"], r["component"]] = r["score"]
                assert r["ratio"] == pytest.approx(s[r["component"]] ** 2 / (s**2).sum(), abs=1e-6)
        assert np.allclose(np.abs(mine), np.abs(scores[:, :9]), atol=1e-5)
        v = verdict[layer]
        assert v["valence"] == pytest.approx(abs(np.corrcoef(scores[:9, 0], valence)[0, 1]), abs=1e-5)
        some = [k for k in range(9) if k != 4]
        w = np.linalg.lstsq(scores[some, 1:3], arousal[some], rcond=None)[0]
        assert v["arousal"] == pytest.approx(abs(np.corrcoef(scores[some, 1:3] @ w, arousal[some])[0, 1]), abs=1e-5)
        assert v["passed"] == (v["valence"] >= 0.5 and v["arousal"] >= 0.5)


def overlaps_by_hand(e, target, codes, weight, n, group):
    """Cosines of label directions and of their centroid under one draw, on one layer."""
    labels = range(3)
    mean = {k: (e[codes == k] * weight[codes == k, None]).sum(0) / (n * weight)[codes == k].sum() for k in labels if (n * weight)[codes == k].sum() > 0}
    d = {k: m - np.mean([o for j, o in mean.items() if j != k], axis=0) for k, m in mean.items()}
    cos = lambda a: float(a @ target / np.linalg.norm(a) / np.linalg.norm(target))
    out = {("individual", str(k)): cos(v) for k, v in d.items()}
    out["centroid", "group"] = cos(np.mean([d[k] / np.linalg.norm(d[k]) for k in group if k in d], axis=0))
    return out


@pytest.mark.parametrize("held", [1, 700, 1 << 26])
def test_resampled_overlaps_in_any_runs(spark, held, monkeypatch):
    monkeypatch.setattr(inference.run_of, "__defaults__", (held,))
    rng = np.random.default_rng(5)
    e, draws, target = rng.normal(size=(60, 8)), rng.integers(0, 3, (60, 7)), rng.normal(size=8)
    draws[:, 6] = np.where(draws[:, 6] == 2, 1, draws[:, 6])  # the last draw leaves one label without rows
    weight, n = rng.integers(0, 3, (60, 7)), rng.integers(1, 4, 60)
    goal = spark.createDataFrame([(j // 4, j % 4, float(target[j])) for j in range(8)], "layer long, dim long, e double")
    for weighted in (False, True):
        data = [(i, [float(x) for x in e[i]], [int(x) + 5 for x in draws[i]], float(n[i]), [int(x) for x in weight[i]] if weighted else None) for i in range(60)]
        rows = spark.createDataFrame(data, "vec_id long, embedding array<double>, as_label array<int>, n double, weight array<int>")
        got = {(r.iteration, r["layer"], r.comparison_type, r.name): r.cosine for r in inference.resampled_overlaps(rows, goal, [5, 6, 7], [5, 7], 4, 7).collect()}
        want = {}
        for i in range(7):
            for layer in range(2):
                part = slice(4 * layer, 4 * layer + 4)
                w = weight[:, i].astype(float) if weighted else np.ones(60)
                for (kind, name), value in overlaps_by_hand(e[:, part], target[part], draws[:, i], w, n, (0, 2)).items():
                    want[i, layer, kind, str(int(name) + 5) if kind == "individual" else name] = value
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    products = inference.resampled_products(rows, goal, [5, 6, 7], [5, 7], 4, 7)
    assert products.count() == 2 * (7 * (3 + 3 + 1 + 1) - 3)  # a row a draw, layer and two labels, whatever the dimensions


def test_permuted_labels(spark):
    labels = np.arange(60) % 3
    once = inference.permuted_labels(spark.createDataFrame([(i, int(labels[i]), i % 4) for i in range(60)], "vec_id long, label int, topic_id int"), 5, 1).collect()
    for topic in range(4):
        mine = [r.as_label for r in once if r.vec_id % 4 == topic]
        assert all(sorted(x[i] for x in mine) == sorted(labels[topic::4]) for i in range(5))
    assert len({tuple(r.as_label[i] for r in sorted(once)) for i in range(5)}) == 5


def test_token_means(spark):
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -2.0])], "bucket long, vec array<float>")
    tokens = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (2, 1, 2), (3, None, 0), (1, None, 0), (None, 0, 1)], "doc_id long, bucket long, n long")
    got = {r.doc_id: (r.n, r["mean"]) for r in algebra.token_means(tokens, vectors).collect()}
    assert got == {1: (4, [2.5, -1.0]), 2: (2, [3.0, -2.0]), 3: (0, None), None: (1, [1.0, 2.0])}


def test_logistic_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * 3 + rng.normal(size=400) * 0.3 > 0.5).astype(int)
    rows = spark.createDataFrame([(*map(float, r), int(k), "g" if i % 2 else "h") for i, (r, k) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y int, g string").selectExpr("*", "1.0D AS flat")
    weights, bias = algebra.logistic(rows, ["a", "b", "c"], "y", 0.01)
    assert np.mean((x @ weights + bias > 0) == y) > 0.95 and weights[0] > 1 and max(map(abs, weights[1:])) < 0.3
    assert bias < 0 and algebra.logistic(rows, ["a", "b"], "y", 10.0)[0] == [0.0, 0.0]
    fits = algebra.repeated_fits(rows.selectExpr("*", "monotonically_increasing_id() AS k"), ["a", "b", "c"], "y", "k", 0.01, repeats=2).collect()
    assert [r.repeat for r in fits] == [0, 1] and all(70 <= r.n_test <= 90 and r.accuracy > 0.9 and r.balanced_accuracy > 0.85 for r in fits)
    z = algebra.zscored(rows, ["a", "flat"], "g").where("g = 'g'").toPandas()
    assert z["a"].mean() == pytest.approx(0, abs=1e-9) and z["a"].std() == pytest.approx(1) and (z["flat"] == 0).all()


def test_contracts_that_hold(spark):
    candidates = spark.createDataFrame([(f"c{p}{s}", f"q{p}", f"Text {p}", p, s, "m", "r") for p in range(3) for s in range(4)], "id string, question_id string, question string, prompt_index int, sample_index int, model_id string, model_revision string")
    prompts = spark.createDataFrame([(f"q{p}", f"Text {p}", p) for p in range(3)], "question_id string, question string, prompt_index int")
    assert gates.candidate_violations(candidates, prompts, 4, "m", "r").count() == 0
    pair = "pair_id long, question_id string, question string, id string, alignment_score int, coherence_score int"
    a = spark.createDataFrame([(i, "q", "t", f"a{i}", 71, 51) for i in range(24)], pair)
    b = spark.createDataFrame([(i, "q", "t", f"b{i}", 30, 51) for i in range(24)], pair)
    assert gates.pair_violations(a, b).count() == 0
    assert {r.rule for r in gates.pair_violations(a, b.where("pair_id > 0").replace("b3", "a3", "id")).collect()} == {"pair without a partner", "repeated id"}
    grid = spark.createDataFrame([(k, t, (k, t) != (1, 2), t != 2) for k in range(3) for t in range(4)], "label int, topic_id int, eligible boolean, confirmatory boolean")
    assert gates.selection_violations(grid, ["label", "topic_id"], 12, [(1, 2)], 3).count() == 0
    assert gates.selection_violations(grid, ["label", "topic_id"], 12, [(1, 3)], 3).first().n == 2


def test_supported_positives_by_rule(spark):
    row = {"comparison_type": "centroid", "model_source": "aligned", "layer": 1, "emotion_or_group": "g", "cosine": 0.5, "explained_fraction": None, "pca_status": "raw", "gate_passed": True, "confirmatory": True, "q_value": 0.01, "null_p95": 0.1, "notes": "emotion_label_permutation"}
    other = {**row, "notes": "matched_random_centroid"}
    near = [{**r, "layer": k} for r in (row, other) for k in (0, 2)]
    same = {**row, "model_source": "misaligned", "notes": ""}
    schema = "comparison_type string, model_source string, layer long, emotion_or_group string, cosine double, explained_fraction double, pca_status string, gate_passed boolean, confirmatory boolean, q_value double, null_p95 double, notes string"
    found = lambda *rows: gates.supported_positives(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema), [1]).count()
    assert found(row, other, same, *near) == 1
    assert found(row, same, *near) == 0  # a control lacks
    assert found({**row, "q_value": 0.2}, other, same, *near) == 0 and found({**row, "null_p95": 0.6}, other, same, *near) == 0
    assert found(row, other, *near) == 0 and found(row, other, {**same, "cosine": -0.1}, *near) == 0
    assert found(row, other, same) == 0 and found(row, other, same, *near[1:], {**near[0], "cosine": -0.2}) == 0
    assert found({**row, "gate_passed": False}, {**other, "gate_passed": False}, same, *near) == 0


def test_vector_clusters(spark, vectors):
    from vectrine.operators.algebra import kmeans

    e, _ = vectors
    x = e.reshape(len(e), -1).astype(float)
    got = {r.vec_id: (r.cluster, r.distance) for r in registry.queries()["vector_clusters"](spark, DIR).collect()}
    label = np.array([got[i][0] for i in range(len(x))])
    assert set(label) == {0, 1, 2, 3} and all(np.allclose(d, ((x[i] - x[label == c].mean(0)) ** 2).sum(), atol=1e-2) for i, (c, d) in got.items())
    best = kmeans(x, 4, 0, 5)
    want = sum(((x[best == c] - x[best == c].mean(0)) ** 2).sum() for c in range(4))
    assert sum(d for _, d in got.values()) < 1.1 * want
