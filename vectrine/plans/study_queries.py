"""The geometry study over four specifications: two models, raw and without the neutral direction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.operators import algebra as A
from vectrine.operators import directions as D
from vectrine.operators import inference as I
from vectrine.operators import reports as R
from vectrine.operators import resampling as P
from vectrine.operators import study as S
from vectrine.plans.inference_queries import BASE, DRAWS, GROUP, MATCHED, MATCHED_SQL, PERMUTATIONS, SEED, against_sql
from vectrine.plans.vector_queries import LONG, WIDTH, contrast_rows, r8, second_model, vectors_of
from vectrine.session import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}
NEUTRAL = 9
NUMBERS = ("cosine", "reliability", "ci_low", "ci_high", "p_value", "q_value", "max_stat_p_value", "null_p95")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def neutral_basis(vectors):
    """The direction of the neutral vectors' mean in each layer: one component."""
    mean = D.array_means(vectors.where(F.col("label") == NEUTRAL), "embedding", WIDTH)
    return D.normalised(mean, "mu", "layer", into="b").select("layer", F.lit(0).alias("component"), "dim", "b")


def specifications(spark, sf_dir) -> list[tuple[str, str, DataFrame, DataFrame]]:
    """(model_source, pca_status, vectors, target) of each; the target is the contrast of the first model, whatever the model."""
    target, out = cut(contrast_rows(spark, sf_dir)), []
    first = vectors_of(spark, sf_dir).withColumn("label", F.col("label").cast("long"))
    for source, vectors in (("aligned", first), ("misaligned", second_model(first))):
        basis = cut(neutral_basis(vectors))
        out += [(source, "raw", vectors, target), (source, f"cleaned_{source}_basis", *S.cleaned(vectors, target, basis, WIDTH))]
    return out


def _spec_sql(source: str, status: str) -> str:
    """The rows of one specification: the study's CTEs over its own vectors."""
    raw = "SELECT vec_id, label, vec_id % 20 AS topic_id, (i - 1) // 16 AS layer, (i - 1) % 16 AS dim, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)"
    em0 = f"SELECT layer, dim, avg(v) FILTER (label = 0) - avg(v) FILTER (label = 1) AS e FROM ({raw}) GROUP BY ALL"
    model = raw if source == "aligned" else f"SELECT vec_id, label, topic_id, layer, 15 - dim AS dim, v * (1 + dim / 100.0::DOUBLE) AS v FROM ({raw})"
    basis = f"SELECT layer, dim, m / sqrt(sum(m * m) OVER (PARTITION BY layer)) AS b FROM (SELECT layer, dim, avg(v) AS m FROM ({model}) WHERE label = {NEUTRAL} GROUP BY ALL)"
    rows, goal = model, em0
    if status != "raw":
        rows = f"SELECT vec_id, label, topic_id, layer, dim, v - b * sum(v * b) OVER (PARTITION BY vec_id, layer) AS v FROM ({model}) JOIN ({basis}) USING (layer, dim)"
        goal = f"SELECT layer, dim, e - b * sum(e * b) OVER (PARTITION BY layer) AS e FROM ({em0}) JOIN ({basis}) USING (layer, dim)"
    begin, rest = BASE.index("e AS ("), BASE.index("mu AS (")
    base = f"{BASE[:begin]}e AS MATERIALIZED ({rows}),\n{BASE[rest:]}"
    old = base[base.index("em AS (") : base.index("om AS (")]
    base = base.replace(old, f"em AS MATERIALIZED ({goal}),\n")
    return f"""(WITH {base}, {MATCHED_SQL}, {against_sql('a', 'perm')}, {against_sql('b', 'matched')},
    u AS (SELECT *, 'label permutation' AS notes FROM a UNION ALL BY NAME SELECT *, 'matched random' AS notes FROM b)
    SELECT '{source}' AS model_source, '{status}' AS pca_status, comparison_type, name AS emotion_or_group, layer, cosine, NULL::DOUBLE AS reliability, ci_low, ci_high, p_value, q_value, max_stat_p_value, null_p95, notes
    FROM u JOIN ci USING (comparison_type, name, layer)
    UNION ALL SELECT '{source}', '{status}', 'split_reliability', label::VARCHAR, layer, NULL, reliability, NULL, NULL, NULL, NULL, NULL, NULL, '' FROM rel)"""


SPECS = [("aligned", "raw"), ("aligned", "cleaned_aligned_basis"), ("misaligned", "raw"), ("misaligned", "cleaned_misaligned_basis")]
SQL_ROWS = " UNION ALL ".join(f"SELECT * FROM {_spec_sql(*s)}" for s in SPECS)
SHOWN = ", ".join(f"round({n}, 8) AS {n}" for n in NUMBERS)


def inferred(spark, sf_dir, specs) -> DataFrame:
    rows = []
    # all specifications have the same rows with the same topics and labels
    as_label = cut(I.permuted_labels(vectors_of(spark, sf_dir).select("vec_id", F.col("label").cast("long").alias("label"), "topic_id"), PERMUTATIONS, SEED))
    for source, status, vectors, target in specs:
        one = S.specification(vectors, target, WIDTH, GROUP, P.hashed_draws(spark, 20, DRAWS, 3), DRAWS, PERMUTATIONS, MATCHED, (SEED, 11), F.col("topic_id") < 10, as_label)
        rows.append(cut(S.in_columns(one, model_source=source, pca_status=status, gate_passed=True).withColumn("confirmatory", F.col("layer").isin(1, 2, 3))))
    return reduce(DataFrame.unionByName, rows)


@query(f"SELECT model_source, pca_status, comparison_type, emotion_or_group, layer, {SHOWN}, notes FROM ({SQL_ROWS})")
def study_table(spark, sf_dir):
    """Estimates, intervals and controls of individual directions and of the group, and split reliabilities, of all four specifications."""
    rows = inferred(spark, sf_dir, specifications(spark, sf_dir))
    return rows.select("model_source", "pca_status", "comparison_type", "emotion_or_group", "layer", *[r8(n, n) for n in NUMBERS], "notes")


def complete(spark, sf_dir) -> DataFrame:
    """All five families of all specifications, with the columns of the metrics table."""
    specs = specifications(spark, sf_dir)
    rows = [inferred(spark, sf_dir, specs)]
    for source, status, vectors, target in specs:
        rows.append(S.in_columns(S.subspace(vectors, target, WIDTH, GROUP, 1000, SEED), model_source=source, pca_status=status, gate_passed=True).withColumn("confirmatory", F.col("layer").isin(1, 2, 3)))
    for status, (a, b) in {"raw": (0, 2), "cleaned_aligned_basis": (1, 3)}.items():
        rows.append(S.in_columns(S.stability(specs[a][2], specs[b][2], WIDTH), model_source="cross_model", pca_status=status, gate_passed=True).withColumn("confirmatory", F.col("layer").isin(1, 2, 3)))
    return reduce(DataFrame.unionByName, rows)


@query("""WITH n AS (SELECT count(DISTINCT label) AS labels, max(len(embedding)) // 16 AS layers FROM embeddings)
SELECT comparison_type, rows, 0::BIGINT AS violations FROM n, LATERAL (VALUES ('individual', 4 * labels * layers), ('centroid', 4 * 2 * layers), ('subspace', 4 * layers), ('split_reliability', 4 * labels * layers), ('cross_model_stability', 2 * labels * layers)) t(comparison_type, rows)""")
def study_rows(spark, sf_dir):
    """How many rows each family of the whole study has, and rules of the metrics table that it breaks."""
    from vectrine.operators import gates as G

    rows = cut(complete(spark, sf_dir))
    broken = G.metrics_violations(rows).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations"))
    return rows.groupBy("comparison_type").agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(broken))  # one row


LABELS = ["2", "3", "4"]


def estimates(spark, sf_dir) -> DataFrame:
    """Rows of the metrics table without inference: all families, those that the figures show; the centroid once for each of its controls."""
    specs, rows = specifications(spark, sf_dir), []
    for source, status, vectors, target in specs[:3]:
        means = D.array_means(vectors, "embedding", WIDTH)
        seen = I.overlaps(means.withColumn("iteration", F.lit(0).cast("long")), target, GROUP).withColumnsRenamed({"name": "emotion_or_group"}).withColumn("estimate_name", F.lit("cosine"))
        notes = F.when(F.col("comparison_type") == "centroid", F.array(F.lit("label permutation"), F.lit("matched random"))).otherwise(F.array(F.lit("")))
        s = D.split_means(vectors, "embedding", WIDTH, F.col("topic_id") < 10)
        s = D.from_other_labels(D.from_other_labels(s, mu="mu_a", into="a"), mu="mu_b", into="b")
        halves = D.cosines_by(s, "a", "b", "label", "layer").select(F.lit("split_reliability").alias("comparison_type"), F.lit("reliability").alias("estimate_name"), F.col("label").cast("string").alias("emotion_or_group"), "layer", F.col("cosine").alias("reliability"))
        fixed = {"model_source": source, "pca_status": status, "gate_passed": True}
        rows += [S.in_columns(seen.withColumn("notes", F.explode(notes)), **fixed), S.in_columns(halves, **fixed, notes="")]
        d = D.from_other_labels(means).where(F.col("label").isin(GROUP))
        share = A.subspace_by_layer(d, target).select(F.lit("subspace").alias("comparison_type"), F.lit("explained_fraction").alias("estimate_name"), F.lit("group").alias("emotion_or_group"), "layer", F.col("fraction").alias("explained_fraction"))
        rows.append(S.in_columns(share, **fixed, notes=""))
    rows.append(S.in_columns(S.stability(specs[0][2], specs[2][2], WIDTH), model_source="cross_model", pca_status="raw", gate_passed=True))
    return reduce(DataFrame.unionByName, rows)


@query(f"""WITH r AS ({SQL_ROWS}), {LONG}, m2 AS (SELECT label, layer, 15 - dim AS dim, avg(v * (1 + dim / 100.0::DOUBLE)) AS mu FROM e GROUP BY ALL),
d2 AS (SELECT *, mu - (sum(mu) OVER w - mu) / (count(*) OVER w - 1) AS d2 FROM m2 WINDOW w AS (PARTITION BY layer, dim)),
c AS (SELECT label, layer, sum(d * d2) / sqrt(sum(d * d) * sum(d2 * d2)) AS c FROM d JOIN d2 USING (label, layer, dim) GROUP BY ALL),
f AS (SELECT 'individual_heatmap' AS figure, model_source, pca_status, emotion_or_group, layer, cosine AS value, 1 AS n FROM r WHERE comparison_type = 'individual' AND model_source = 'aligned' AND pca_status = 'raw' AND emotion_or_group IN ('2', '3', '4')
UNION ALL SELECT DISTINCT 'centroid_overlap', model_source, pca_status, emotion_or_group, layer, cosine, 1 FROM r WHERE comparison_type = 'centroid' AND pca_status = 'raw'
UNION ALL SELECT 'split_half_reliability', model_source, pca_status, emotion_or_group, layer, reliability, 1 FROM r WHERE comparison_type = 'split_reliability' AND pca_status = 'raw'
UNION ALL SELECT 'cross_model_stability', 'cross_model', 'raw', label::VARCHAR, layer, c, 1 FROM c
UNION ALL SELECT 'raw_vs_cleaned', model_source, pca_status, NULL, layer, median(cosine), count(*) FROM r WHERE comparison_type = 'individual' AND model_source = 'aligned' AND emotion_or_group IN ('2', '3', '4') GROUP BY ALL)
SELECT * REPLACE (round(value, 8) AS value) FROM f""")
def figure_sources(spark, sf_dir):
    """Source tables of five of the study's figures; the sixth, of subspaces, needs an orthogonal basis and is compared with NumPy."""
    cells = R.figure_cells(estimates(spark, sf_dir), LABELS)
    rows = R.figure_sources(cells).where("figure <> 'subspace_fraction'")
    return rows.select("figure", "model_source", "pca_status", "emotion_or_group", "layer", r8("value", "value"), "n")


@query("SELECT 'individual_heatmap' AS figure, 'missing cell' AS fault, 4::BIGINT AS n UNION ALL SELECT 'raw_vs_cleaned', 'missing cell', 8 WHERE (SELECT count(*) FROM embeddings) > 0")
def figure_faults(spark, sf_dir):
    """What keeps a figure from being drawn, where one label is asked for that the study lacks."""
    return R.figure_faults(cut(R.figure_cells(estimates(spark, sf_dir), [*LABELS, "none"])), [*LABELS, "none"])
