"""What the specifications of the geometry study share."""

import numpy as np

from vectrine.plans import study_queries as Q


def test_specifications_share_permuted_labels(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=64)], i % 10) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = []

    def specification(*given):
        seen.append(given[-1])
        return spark.range(1).select(Q.F.col("id").alias("layer"))

    monkeypatch.setattr(Q.S, "specification", specification)
    assert Q.inferred(spark, str(tmp_path), [("a", "raw", None, None), ("b", "raw", None, None)]).count() == 2
    assert len(seen) == 2 and seen[0] is seen[1]
    assert {len(r.as_label) for r in seen[0].collect()} == {Q.PERMUTATIONS} and seen[0].count() == 40
