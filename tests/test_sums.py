"""Sums of arrays against NumPy, and what they shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.operators import sums as S


@pytest.mark.parametrize("held", [1, 5000, 64 << 20])
def test_like_numpy(spark, monkeypatch, held):
    monkeypatch.setattr(S, "HELD", held)
    rng = np.random.default_rng(2)
    rows = [(None if i % 11 == 0 else int(i % 5), f"s{i % 3}", None if i % 7 == 0 else rng.normal(size=6).tolist(), None if i % 13 == 0 else float(i % 4)) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, v array<float>, w double").repartition(7)
    for weight in (None, F.col("w")):
        want = {}
        for a, b, v, w in rows:
            n, total = want.get((a, b), (0.0, None))
            w = 1.0 if weight is None else w
            if v is not None and w is not None:
                v = np.array(v, np.float32).astype(float) * w
                n, total = n + w, v if total is None else total + v
            want[a, b] = (n, total)
        got = {(r.a, r.b): (r.n, r.total) for r in S.vector_sums(df, "v", "a", "b", weight=weight).collect()}
        assert set(got) == set(want)
        for k, (n, total) in want.items():
            assert got[k][0] == n and (got[k][1] is None) == (total is None)
            assert total is None or np.allclose(got[k][1], total, atol=1e-9)
    whole = S.vector_sums(df, "v").collect()
    assert len(whole) == 1 and whole[0].n == sum(v is not None for _, _, v, _ in rows)
    assert S.vector_sums(df.limit(0), "v", "a").count() == 0


def test_groups_without_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0]), (2, None), (3, [])], "a int, v array<double>")
    got = {r.a: (r.n, r["mean"]) for r in S.mean_vectors(df, "v", "a").collect()}
    assert got[1] == (0.0, None) and got[2] == (1.0, [1.0]) and got[3][0] == 1.0
    with pytest.raises(Exception, match="differ in length"):
        S.vector_sums(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "a int, v array<double>").coalesce(1), "v", "a").collect()


def test_sums_come_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("label"), F.array(F.col("id").cast("double")).alias("v"))
    plan = S.vector_sums(df, "v", "label")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow")


def test_masked_means(spark):
    rng = np.random.default_rng(4)
    states, want = [], {}
    for text in range(6):
        n = [0, 1, 3, 5, 8, 8][text]
        mask = [p >= n // 2 for p in range(n)] if text % 2 else [p < n - 1 for p in range(n)]
        vec = rng.normal(size=(n, 3))
        own = [vec[p] for p in range(n) if mask[p]][2:]
        want[text] = np.mean(own, axis=0) if own else None
        states += [(text, p, mask[p], vec[p].tolist()) for p in range(n)] or [(text, 0, False, None)]
    df = spark.createDataFrame(states, "text_id int, pos int, mask boolean, vec array<double>").repartition(5)
    got = {r.text_id: r["mean"] for r in S.masked_means(df, "text_id", "pos", F.col("mask"), "vec", 2).collect()}
    assert set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or np.allclose(got[k], want[k])) for k in want)
