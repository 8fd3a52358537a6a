"""Geometry of label directions with their controls, over all dimensions. Draws come from hashes, so that SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrine.operators import algebra as A
from vectrine.operators import inference as I
from vectrine.operators import resampling as P
from vectrine.plans.resampling_queries import HASH
from vectrine.plans.vector_queries import SPLIT, WIDTH, contrast_rows, label_directions, means_of, r8, reliabilities
from vectrine.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
GROUP = [2, 3, 4]
PERMUTATIONS, DRAWS, MATCHED = 50, 100, 60
# the labels of the surrogate table are noise: the one gate lets all layers pass, the other none
GATE, CLOSED, SEED = -1.0, 0.999, 9


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def overlap_sql(name, means):
    """CTEs name_d and name: overlaps with the contrast under each draw of the means."""
    return f"""{name}_d AS (SELECT *, mu - (sum(mu) OVER w - mu) / (count(*) OVER w - 1) AS d FROM {means} WINDOW w AS (PARTITION BY iteration, layer, dim)),
{name}_u AS (SELECT iteration, label, layer, dim, d / sqrt(sum(d * d) OVER (PARTITION BY iteration, label, layer)) AS u FROM {name}_d WHERE label IN (2, 3, 4)),
{name}_c AS (SELECT iteration, layer, dim, avg(u) AS c FROM {name}_u GROUP BY ALL),
{name} AS (SELECT iteration, 'individual' AS comparison_type, label::VARCHAR AS name, layer, sum(d * e) / sqrt(sum(d * d) * sum(e * e)) AS cosine FROM {name}_d JOIN em USING (layer, dim) GROUP BY ALL
UNION ALL SELECT iteration, 'centroid', 'group', layer, sum(c * e) / sqrt(sum(c * c) * sum(e * e)) FROM {name}_c JOIN em USING (layer, dim) GROUP BY ALL)"""


BASE = SPLIT + f""", em AS (SELECT layer, dim, max(mu) FILTER (label = 0) - max(mu) FILTER (label = 1) AS e FROM mu GROUP BY ALL),
om AS (SELECT 0 AS iteration, label, layer, dim, mu FROM mu), {overlap_sql("obs", "om")},
x AS (SELECT vec_id, label, vec_id % 20 AS topic_id, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) AS place FROM embeddings),
h AS (SELECT iteration, vec_id, topic_id, row_number() OVER (PARTITION BY iteration, topic_id ORDER BY sha256('{SEED}:' || iteration || ':' || vec_id)) AS place FROM x, range(0, {PERMUTATIONS}) t(iteration)),
pl AS (SELECT h.iteration, h.vec_id, x.label AS label FROM h JOIN x USING (topic_id, place)),
pm AS (SELECT pl.iteration, pl.label, layer, dim, avg(v) AS mu FROM pl JOIN e USING (vec_id) GROUP BY ALL), {overlap_sql("perm", "pm")},
ts AS (SELECT label, topic_id, layer, dim, sum(v) AS total, count(*) AS n FROM e GROUP BY ALL),
draws AS (SELECT iteration, slot, {HASH("'3:' || iteration || ':' || slot")} % 20 AS topic_id FROM range(0, {DRAWS}) a(iteration), range(0, 20) b(slot)),
bm AS (SELECT iteration, label, layer, dim, sum(total) / sum(n) AS mu FROM draws JOIN ts USING (topic_id) GROUP BY ALL), {overlap_sql("boot", "bm")},
ci AS (SELECT comparison_type, name, layer, quantile_cont(cosine, 0.025) AS ci_low, quantile_cont(cosine, 0.975) AS ci_high FROM boot GROUP BY ALL)"""


def against_sql(name, nulls):
    """CTE name: the observed overlaps of what nulls has, with what follows from these."""
    return f"""{name}_p AS (SELECT o.comparison_type, o.name, o.layer, any_value(o.cosine) AS cosine, quantile_cont(n.cosine, 0.95) AS null_p95, (count(*) FILTER (n.cosine >= o.cosine) + 1) / (count(*) + 1) AS p_value
FROM obs o JOIN {nulls} n ON n.comparison_type = o.comparison_type AND n.name = o.name AND n.layer = o.layer GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY comparison_type ORDER BY p_value) AS k, count(*) OVER (PARTITION BY comparison_type) AS m FROM {name}_p),
{name}_m AS (SELECT comparison_type, name, (count(*) FILTER (top >= most) + 1) / (count(*) + 1) AS max_stat_p_value FROM (SELECT comparison_type, name, iteration, max(cosine) AS top FROM {nulls} GROUP BY ALL) JOIN (SELECT comparison_type, name, max(cosine) AS most FROM obs GROUP BY ALL) USING (comparison_type, name) GROUP BY ALL),
{name} AS (SELECT *, least(1, min(p_value * m / k) OVER (PARTITION BY comparison_type ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q_value FROM {name}_r JOIN {name}_m USING (comparison_type, name))"""


ROWS = "comparison_type, name AS emotion_or_group, layer, round(cosine, 8) AS cosine, round(ci_low, 8) AS ci_low, round(ci_high, 8) AS ci_high, round(p_value, 8) AS p_value, round(q_value, 8) AS q_value, round(max_stat_p_value, 8) AS max_stat_p_value, round(null_p95, 8) AS null_p95"


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), (F.col("vec_id") % 20).alias("topic_id"), "embedding")


def observed(spark, sf_dir):
    means = means_of(spark, sf_dir).withColumn("iteration", F.lit(0).cast("long"))
    return I.overlaps(means, contrast_rows(spark, sf_dir), GROUP).drop("iteration")


def bootstraps(spark, sf_dir):
    target = cut(contrast_rows(spark, sf_dir))
    return I.bootstrap_overlaps(_vectors(spark, sf_dir), P.hashed_draws(spark, 20, DRAWS, 3), target, GROUP, WIDTH, DRAWS)


def permutations(spark, sf_dir):
    target = cut(contrast_rows(spark, sf_dir))
    return I.permutation_overlaps(_vectors(spark, sf_dir), target, GROUP, WIDTH, PERMUTATIONS, SEED)


@query(f"WITH {BASE} SELECT comparison_type, name, layer, round(ci_low, 8) AS ci_low, round(ci_high, 8) AS ci_high FROM ci")
def direction_bootstrap(spark, sf_dir):
    """Intervals of the overlaps of whole directions and of their centroid, over draws of topics."""
    boots = P.interval(bootstraps(spark, sf_dir), "cosine", 0.95, "comparison_type", "name", "layer")
    return boots.select("comparison_type", "name", "layer", r8("ci_low", "ci_low"), r8("ci_high", "ci_high"))


@query(f"WITH {BASE}, {against_sql('a', 'perm')} SELECT comparison_type, name, layer, round(null_p95, 8) AS null_p95, round(p_value, 8) AS p_value, round(q_value, 8) AS q_value, round(max_stat_p_value, 8) AS max_stat_p_value FROM a")
def direction_permutation(spark, sf_dir):
    """Overlaps of whole directions and of their centroid against permutations of labels within topics."""
    a = I.against_null(cut(observed(spark, sf_dir)), permutations(spark, sf_dir))
    return a.select("comparison_type", "name", "layer", *[r8(c, c) for c in ("null_p95", "p_value", "q_value", "max_stat_p_value")])


def geometry(spark, sf_dir, gate):
    """Overlaps, intervals and controls of directions and centroid; where no preregistered layer reaches the gate, nothing is inferred."""
    from vectrine.plans.resampling_queries import matched_centroids

    best = reliabilities(spark, sf_dir).groupBy("layer").agg(F.median("reliability").alias("m")).where(F.col("layer").isin(1, 2, 3)).agg(F.max("m")).first()[0]
    seen = cut(observed(spark, sf_dir))
    names = ["ci_low", "ci_high", "p_value", "q_value", "max_stat_p_value", "null_p95"]
    passed = best is not None and best >= gate
    if passed:
        ci = P.interval(bootstraps(spark, sf_dir), "cosine", 0.95, "comparison_type", "name", "layer")
        matched = matched_centroids(spark, sf_dir).select("iteration", F.lit("centroid").alias("comparison_type"), F.lit("group").alias("name"), "layer", "cosine")
        control = lambda nulls, note: I.against_null(seen, nulls).withColumn("notes", F.lit(note))
        rows = control(permutations(spark, sf_dir), "label permutation").unionByName(control(cut(matched), "matched random").where("comparison_type = 'centroid'"))
        rows = rows.join(ci, ["comparison_type", "name", "layer"])
    else:
        rows = seen.withColumns({**{n: F.lit(None).cast("double") for n in names}, "notes": F.lit("gate failed")})
    return rows.select("comparison_type", F.col("name").alias("emotion_or_group"), "layer", *[r8(c, c) for c in ("cosine", *names)], F.lit(passed).alias("gate_passed"), F.col("layer").isin(1, 2, 3).alias("confirmatory"), "notes")


MATCHED_SQL = f"""k AS (SELECT iteration, label, row_number() OVER (PARTITION BY iteration ORDER BY sha256('11:' || iteration || ':' || label)) AS r FROM range(0, {MATCHED}) t(iteration), (SELECT DISTINCT label FROM embeddings)),
mu_ AS (SELECT label, layer, dim, d / sqrt(sum(d * d) OVER (PARTITION BY label, layer)) AS u FROM d), mc AS (SELECT iteration, layer, dim, avg(u) AS c FROM k JOIN mu_ USING (label) WHERE r <= 3 GROUP BY ALL),
matched AS (SELECT iteration, 'centroid' AS comparison_type, 'group' AS name, layer, sum(c * e) / sqrt(sum(c * c) * sum(e * e)) AS cosine FROM mc JOIN em USING (layer, dim) GROUP BY ALL)"""
PASSED = f"(SELECT max(m) >= {{gate}} FROM (SELECT layer, median(reliability) AS m FROM rel GROUP BY layer) WHERE layer IN (1, 2, 3))"


@query(f"""WITH {BASE}, {MATCHED_SQL}, {against_sql('a', 'perm')}, {against_sql('b', 'matched')}, u AS (SELECT *, 'label permutation' AS notes FROM a UNION ALL BY NAME SELECT *, 'matched random' AS notes FROM b)
SELECT {ROWS}, {PASSED.format(gate=GATE)} AS gate_passed, layer IN (1, 2, 3) AS confirmatory, notes FROM u JOIN ci USING (comparison_type, name, layer)""")
def geometry_with_controls(spark, sf_dir):
    """The geometry study with its controls, as rows of the metrics table."""
    return geometry(spark, sf_dir, GATE)


@query(f"""WITH {BASE} SELECT comparison_type, name AS emotion_or_group, layer, round(cosine, 8) AS cosine, NULL::DOUBLE AS ci_low, NULL::DOUBLE AS ci_high, NULL::DOUBLE AS p_value, NULL::DOUBLE AS q_value, NULL::DOUBLE AS max_stat_p_value,
NULL::DOUBLE AS null_p95, {PASSED.format(gate=CLOSED)} AS gate_passed, layer IN (1, 2, 3) AS confirmatory, 'gate failed' AS notes FROM obs""")
def geometry_without_gate(spark, sf_dir):
    """The same under a gate that no layer reaches: estimates only, no inference is run."""
    return geometry(spark, sf_dir, CLOSED)


@query()
def geometry_subspace(spark, sf_dir):
    """The contrast's share in the span of a group's directions against random subspaces of the same rank (exact Beta), q over layers."""
    from vectrine.operators import ranking as R

    s = A.subspace_by_layer(label_directions(spark, sf_dir).where(F.col("label").isin(GROUP)), contrast_rows(spark, sf_dir))
    s = cut(s)
    ranks = [r[0] for r in s.select("effective_rank").distinct().collect()]  # no more than the group has labels
    nulls = [(r, i, float(x)) for r in ranks for i, x in enumerate(P.beta_null(WIDTH, r, 1000, SEED + r))]
    nulls = spark.createDataFrame(nulls, "effective_rank long, iteration long, null double")
    both = s.join(nulls, "effective_rank")
    p = P.add_one_p(both, "null", "fraction", "layer").join(R.percentiles(both, "null", [0.95], "layer").select("layer", F.col("cutoff").alias("null_p95")), "layer")
    q = R.benjamini_hochberg(s.join(p, "layer").withColumn("family", F.lit(1)), "p", "family", into="q")
    return q.select("layer", *[r8(c, c) for c in ("fraction", "cosine", "null_p95", "p", "q")], "effective_rank", F.round("condition_number", 6).alias("condition_number"))
