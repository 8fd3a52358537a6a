"""Queries over vectors. Labels stand for the label directions, runs of 16 dimensions for layers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrine.functions import noise as N
from vectrine.functions import vectors as V
from vectrine.operators import directions as D
from vectrine.session import table

WIDTH = 16
LONG = """e AS (SELECT vec_id, label, vec_id % 20 AS topic_id, vec_id // 20 AS story_idx, (i - 1) // 16 AS layer, (i - 1) % 16 AS dim,
    embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
mu AS (SELECT label, layer, dim, avg(v) AS mu, count(*) AS n FROM e GROUP BY ALL),
d AS (SELECT *, mu - (sum(mu) OVER w - mu) / (count(*) OVER w - 1) AS d FROM mu WINDOW w AS (PARTITION BY layer, dim))"""
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rows_of(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return D.long_form(e.select("vec_id", "label", (F.col("vec_id") % 20).alias("topic_id"), F.floor(F.col("vec_id") / 20).alias("story_idx"), "embedding"), width=WIDTH)


def vectors_of(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", (F.col("vec_id") % 20).alias("topic_id"), "embedding")


def means_of(spark, sf_dir):
    return D.array_means(vectors_of(spark, sf_dir), "embedding", WIDTH)


def label_directions(spark, sf_dir):
    return D.from_other_labels(means_of(spark, sf_dir))


def r8(c, name):
    return F.round(c, 8).alias(name)


@query(f"""WITH {LONG} SELECT a.label AS label_a, b.label AS label_b, round(sum(a.d * b.d) / sqrt(sum(a.d * a.d) * sum(b.d * b.d)), 8) AS cosine
FROM d a JOIN d b ON a.layer = b.layer AND a.dim = b.dim AND a.label < b.label GROUP BY ALL""")
def label_direction_cosines(spark, sf_dir):
    """Which label directions are most alike (all layers as one vector)."""
    d = label_directions(spark, sf_dir).withColumn("dim", F.col("layer") * WIDTH + F.col("dim"))
    return D.pairwise_cosines(d).select(F.col("label_a"), F.col("label_b"), r8("cosine", "cosine"))


@query(f"""WITH {LONG} SELECT a.layer, a.label AS label_a, b.label AS label_b, round(sum(a.d * b.d) / sqrt(sum(a.d * a.d) * sum(b.d * b.d)), 8) AS cosine
FROM d a JOIN d b ON a.layer = b.layer AND a.dim = b.dim AND a.label < b.label GROUP BY ALL""")
def layer_direction_cosines(spark, sf_dir):
    return D.pairwise_cosines(label_directions(spark, sf_dir), "layer").select("layer", "label_a", "label_b", r8("cosine", "cosine"))


@query(f"WITH {LONG} SELECT label, layer, dim, n, round(mu - avg(mu) OVER (PARTITION BY layer, dim), 8) AS d FROM mu")
def grand_mean_directions(spark, sf_dir):
    return D.from_grand_mean(means_of(spark, sf_dir)).select("label", "layer", "dim", "n", r8("d", "d"))


@query(f"WITH {LONG} SELECT label, layer, dim, round(d, 8) AS d FROM d")
def other_label_directions(spark, sf_dir):
    return label_directions(spark, sf_dir).select("label", "layer", "dim", r8("d", "d"))


SPLIT = LONG + """, s AS (SELECT label, layer, dim, avg(v) AS mu, avg(v) FILTER (topic_id < 10) AS a, avg(v) FILTER (topic_id >= 10) AS b, count(*) AS n,
    count(*) FILTER (topic_id < 10) AS n_a, count(*) FILTER (topic_id >= 10) AS n_b FROM e GROUP BY ALL),
sd AS (SELECT label, layer, dim, a - (sum(a) OVER w - a) / (count(a) OVER w - 1) AS a, b - (sum(b) OVER w - b) / (count(b) OVER w - 1) AS b FROM s WINDOW w AS (PARTITION BY layer, dim)),
rel AS (SELECT label, layer, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS reliability FROM sd GROUP BY ALL)"""


def split_rows(spark, sf_dir):
    return D.split_means(vectors_of(spark, sf_dir), "embedding", WIDTH, F.col("topic_id") < 10)


def reliabilities(spark, sf_dir):
    s = split_rows(spark, sf_dir)
    s = D.from_other_labels(D.from_other_labels(s, mu="mu_a", into="a"), mu="mu_b", into="b")
    return D.cosines_by(s, "a", "b", "label", "layer").withColumnRenamed("cosine", "reliability")


@query(f"WITH {SPLIT} SELECT label, layer, dim, round(mu, 8) AS mu, round(a, 8) AS mu_a, round(b, 8) AS mu_b, n, n_a, n_b FROM s")
def split_direction_means(spark, sf_dir):
    return split_rows(spark, sf_dir).select("label", "layer", "dim", r8("mu", "mu"), r8("mu_a", "mu_a"), r8("mu_b", "mu_b"), "n", "n_a", "n_b")


@query(f"WITH {SPLIT} SELECT label, layer, round(reliability, 8) AS reliability FROM rel")
def split_half_reliability(spark, sf_dir):
    return reliabilities(spark, sf_dir).select("label", "layer", r8("reliability", "reliability"))


@query(f"WITH {SPLIT} SELECT layer, round(median(reliability), 8) AS median_reliability, count(*) AS labels, median(reliability) >= 0.1 AS passed FROM rel GROUP BY layer")
def reliability_by_layer(spark, sf_dir):
    return reliabilities(spark, sf_dir).groupBy("layer").agg(r8(F.median("reliability"), "median_reliability"), F.count(F.lit(1)).alias("labels"), (F.median("reliability") >= 0.1).alias("passed"))


SECOND = SPLIT.replace("e AS (", "e0 AS (", 1).replace("mu AS (SELECT label, layer", "e AS (SELECT vec_id, label, topic_id, story_idx, layer, 15 - dim AS dim, v * (1 + dim / 100.0::DOUBLE) AS v FROM e0),\nmu AS (SELECT label, layer", 1)


def second_model(vectors):
    """A deterministic stand-in for a second model's vectors: dimensions reversed in each layer and scaled unevenly."""
    at = F.sequence(F.lit(0), F.size("embedding") - 1)
    other = lambda i: i - i % WIDTH + WIDTH - 1 - i % WIDTH
    value = lambda i: F.element_at("embedding", other(i) + 1).cast("double") * (1 + other(i) % WIDTH / 100.0)
    return vectors.withColumn("embedding", F.transform(at, value))


@query(f"""WITH {SPLIT}, r1 AS (SELECT layer, median(reliability) AS m FROM rel GROUP BY layer), x AS (SELECT * FROM (WITH {SECOND} SELECT layer, median(reliability) AS m FROM rel GROUP BY layer))
SELECT round(max(r1.m), 8) AS best_first, round(max(x.m), 8) AS best_second, bool_or(r1.m >= 0.1 AND x.m >= 0.1) AS passed FROM r1 JOIN x USING (layer) WHERE layer IN (1, 2, 3)""")
def reliability_gate(spark, sf_dir):
    """Passes if at one preregistered layer both models reach the least median."""
    def medians(s):
        s = D.split_means(s, "embedding", WIDTH, F.col("topic_id") < 10)
        s = D.from_other_labels(D.from_other_labels(s, mu="mu_a", into="a"), mu="mu_b", into="b")
        return D.cosines_by(s, "a", "b", "label", "layer").groupBy("layer").agg(F.median("cosine").alias("m"))

    rows = vectors_of(spark, sf_dir)
    both = medians(rows).join(medians(second_model(rows)).withColumnRenamed("m", "m2"), "layer").where(F.col("layer").isin(1, 2, 3))
    return both.agg(r8(F.max("m"), "best_first"), r8(F.max("m2"), "best_second"), F.bool_or((F.col("m") >= 0.1) & (F.col("m2") >= 0.1)).alias("passed"))


@query(f"""WITH {LONG}, m2 AS (SELECT label, layer, 15 - dim AS dim, avg(v * (1 + dim / 100.0::DOUBLE)) AS mu FROM e GROUP BY ALL),
d2 AS (SELECT *, mu - (sum(mu) OVER w - mu) / (count(*) OVER w - 1) AS d2 FROM m2 WINDOW w AS (PARTITION BY layer, dim)),
c AS (SELECT label, layer, sum(d * d2) / sqrt(sum(d * d) * sum(d2 * d2)) AS c FROM d JOIN d2 USING (label, layer, dim) GROUP BY ALL)
SELECT layer, round(median(c), 8) AS median_stability, round(min(c), 8) AS least, median(c) >= 0.7 AS passed FROM c GROUP BY layer""")
def cross_model_stability(spark, sf_dir):
    rows = vectors_of(spark, sf_dir)
    means = lambda x: D.array_means(x, "embedding", WIDTH)
    d = D.from_other_labels(means(rows)).select("label", "layer", "dim", "d")
    d2 = D.from_other_labels(means(second_model(rows))).select("label", "layer", "dim", F.col("d").alias("d2"))
    c = D.cosines_by(d.join(d2, ["label", "layer", "dim"]), "d", "d2", "label", "layer")
    return c.groupBy("layer").agg(r8(F.median("cosine"), "median_stability"), r8(F.min("cosine"), "least"), (F.median("cosine") >= 0.7).alias("passed"))


@query(f"""WITH {LONG}, u AS (SELECT label, layer, dim, d / sqrt(sum(d * d) OVER (PARTITION BY label, layer)) AS u FROM d WHERE label IN (2, 3, 4)),
m AS (SELECT layer, dim, avg(u) AS m FROM u GROUP BY ALL) SELECT layer, dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY layer)), 8) AS c FROM m""")
def label_centroid(spark, sf_dir):
    return D.centroid(label_directions(spark, sf_dir), [2, 3, 4]).select("layer", "dim", r8("c", "c"))


CONTRAST = LONG + ", em AS (SELECT layer, dim, max(mu) FILTER (label = 0) - max(mu) FILTER (label = 1) AS e FROM mu GROUP BY ALL)"


def contrast_rows(spark, sf_dir):
    return D.contrast(means_of(spark, sf_dir), 0, 1)


@query(f"WITH {CONTRAST} SELECT label, layer, round(sum(d * e) / sqrt(sum(d * d) * sum(e * e)), 8) AS cosine FROM d JOIN em USING (layer, dim) GROUP BY ALL")
def contrast_overlap(spark, sf_dir):
    """Cosine of each label direction with the contrast of two labels."""
    rows = label_directions(spark, sf_dir).join(contrast_rows(spark, sf_dir), ["layer", "dim"])
    return D.cosines_by(rows, "d", "e", "label", "layer").select("label", "layer", r8("cosine", "cosine"))


@query(f"""WITH {CONTRAST}, r AS (SELECT layer, dim, e / sqrt(sum(e * e) OVER (PARTITION BY layer)) AS r FROM em)
SELECT label, layer, dim, round(d - sum(d * r) OVER (PARTITION BY label, layer) * r, 8) AS cleaned FROM d JOIN r USING (layer, dim)""")
def directions_without_contrast(spark, sf_dir):
    return D.without(label_directions(spark, sf_dir), contrast_rows(spark, sf_dir)).select("label", "layer", "dim", r8("cleaned", "cleaned"))


@query(f"WITH {LONG}, t AS (SELECT label, topic_id, layer, dim, avg(v) AS t FROM e GROUP BY ALL) SELECT label, layer, dim, count(*) AS topics, round(avg(t), 8) AS mu FROM t GROUP BY ALL")
def topic_weighted_means(spark, sf_dir):
    return D.topic_means(vectors_of(spark, sf_dir), "embedding", WIDTH).select("label", "layer", "dim", "topics", r8("mu", "mu"))


@query(f"WITH {LONG} SELECT label, topic_id, layer, round(sum(v), 8) AS total, count(*) AS n FROM e GROUP BY ALL")
def topic_sums(spark, sf_dir):
    s = D.topic_sums(vectors_of(spark, sf_dir), "embedding").withColumn("layer", F.explode(F.sequence(F.lit(0), (F.size("total") / WIDTH).cast("int") - 1)))
    part = F.aggregate(F.slice("total", F.col("layer") * WIDTH + 1, F.lit(WIDTH)), F.lit(0.0), lambda a, x: a + x)
    return s.select("label", "topic_id", F.col("layer").cast("long"), r8(part, "total"), (F.col("n") * WIDTH).cast("long").alias("n"))


@query(f"WITH {LONG}, w AS (SELECT *, 1 + vec_id % 7 AS tokens FROM e) SELECT label, layer, dim, round(sum(v * tokens) / sum(tokens), 8) AS mu FROM w GROUP BY ALL")
def token_weighted_pool(spark, sf_dir):
    return D.token_pooled(vectors_of(spark, sf_dir).withColumn("tokens", 1 + F.col("vec_id") % 7), "embedding", WIDTH, "tokens").select("label", "layer", "dim", r8("mu", "mu"))


@query("""WITH e AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm, row_number() OVER (ORDER BY vec_id) AS rn, 1 + vec_id % 7 AS tokens FROM embeddings)
SELECT round(sum(norm * tokens) / sum(tokens), 8) AS mean_norm, count(*) AS n FROM e WHERE rn <= 300""")
def capped_mean_norm(spark, sf_dir):
    """Token-weighted mean norm over the first rows in canonical order."""
    e = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(300)
    e = e.select(V.norm(V.doubles(F.col("embedding"))).alias("norm"), (1 + F.col("vec_id") % 7).alias("tokens"))
    return e.agg(r8(F.sum(F.col("norm") * F.col("tokens")) / F.sum("tokens"), "mean_norm"), F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT vec_id, label, k, embedding::DOUBLE[] AS v, CASE k WHEN 1 THEN lag(embedding, 1) OVER w ELSE lag(embedding, 2) OVER w END::DOUBLE[] AS p, CASE k WHEN 1 THEN lead(embedding, 1) OVER w ELSE lead(embedding, 2) OVER w END::DOUBLE[] AS n,
lag(vec_id, 2) OVER w IS NOT NULL AND lead(vec_id, 2) OVER w IS NOT NULL AS inside FROM embeddings, (VALUES (1), (2)) t(k) WINDOW w AS (PARTITION BY label, k ORDER BY vec_id)),
d AS (SELECT label, vec_id, k, list_transform(list_zip(p, v), lambda x: x[1] - x[2]) AS p, list_transform(list_zip(n, v), lambda x: x[1] - x[2]) AS n FROM v WHERE inside),
s AS (SELECT label, vec_id, k, side, p[side * 32 + 1:side * 32 + 32] AS p, n[side * 32 + 1:side * 32 + 32] AS n FROM d, (VALUES (0), (1)) t(side)),
c AS (SELECT label, vec_id, k, side, greatest(sqrt(list_inner_product(p, p)), sqrt(list_inner_product(n, n))) AS size, CASE WHEN list_inner_product(p, p) > 0 AND list_inner_product(n, n) > 0 THEN list_inner_product(p, n) / sqrt(list_inner_product(p, p) * list_inner_product(n, n)) ELSE 0 END AS turning FROM s)
SELECT a.label, a.k, a.vec_id AS step, round(a.turning, 8) AS turning_a, round(b.turning, 8) AS turning_b, round(a.turning * a.size, 8) AS weighted_a, round(b.turning * b.size, 8) AS weighted_b FROM c a JOIN c b USING (label, vec_id, k)
WHERE a.side = 0 AND b.side = 1 AND NOT (a.size < 1 AND b.size < 1)""")
def local_turning_angle(spark, sf_dir):
    """Cosine between what lies k steps back and k steps ahead of each checkpoint, of two series (halves of the vectors), plain and by the size of the move.

    Checkpoints at which both series move by less than 1 are left out, and those without as many steps on both sides as the greatest k.
    """
    w = W.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").withColumn("v", V.doubles(F.col("embedding")))
    e = e.withColumns({f"{side}{k}": f("v", k).over(w) for side, f in (("back", F.lag), ("ahead", F.lead)) for k in (1, 2)}).where("back2 is not null and ahead2 is not null")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"back{k}").alias("back"), F.col(f"ahead{k}").alias("ahead")) for k in (1, 2)])).alias("m")
    rows = e.select("label", F.col("vec_id").alias("step"), "v", each).select("label", "step", "m.k", V.minus(F.col("m.back"), F.col("v")).alias("back"), V.minus(F.col("m.ahead"), F.col("v")).alias("ahead"))
    half = lambda c, i: F.slice(c, 32 * i + 1, 32)
    size = {s: F.greatest(V.norm(half("back", i)), V.norm(half("ahead", i))) for i, s in enumerate("ab")}
    turn = {s: V.cosine_or_zero(half("back", i), half("ahead", i)) for i, s in enumerate("ab")}
    rows = rows.select("label", "k", "step", *[size[s].alias(f"size_{s}") for s in "ab"], *[turn[s].alias(f"turning_{s}") for s in "ab"]).where("not (size_a < 1 and size_b < 1)")
    return rows.select("label", "k", "step", *[r8(f"turning_{s}", f"turning_{s}") for s in "ab"], *[r8(F.col(f"turning_{s}") * F.col(f"size_{s}"), f"weighted_{s}") for s in "ab"])


@query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 8) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", r8(V.norm(V.doubles(F.col("embedding"))), "norm"))


@query(f"""WITH {CONTRAST}, n AS (SELECT layer, sqrt(sum(e * e)) AS n FROM em GROUP BY layer), s AS (SELECT em.layer, dim, 0.5 * 12 * e / n AS s FROM em JOIN n USING (layer))
SELECT vec_id, layer, round(sum((v + CASE WHEN story_idx % 2 = 0 THEN s ELSE 0 END) * s) / 36, 8) AS along FROM e JOIN s USING (layer, dim) GROUP BY ALL""")
def steered_projection(spark, sf_dir):
    """A norm-relative delta along the contrast is added where a mask holds; how far each vector then reaches along it."""
    em = D.normalised(contrast_rows(spark, sf_dir), "e", "layer", into="s").withColumn("s", F.col("s") * (0.5 * 12)).select("layer", "dim", "s")
    rows = rows_of(spark, sf_dir).join(em, ["layer", "dim"])
    moved = F.col("v") + F.when(F.col("story_idx") % 2 == 0, F.col("s")).otherwise(0.0)
    return rows.groupBy("vec_id", "layer").agg(r8(F.sum(moved * F.col("s")) / 36, "along"))


@query(f"""WITH {LONG}, g AS (SELECT a.label AS i, b.label AS j, a.layer, sum(a.d * b.d) AS g FROM d a JOIN d b USING (layer, dim) GROUP BY ALL),
x AS (SELECT g1.layer AS layer_a, g2.layer AS layer_b, sum(g1.g * g2.g) AS ab FROM g g1 JOIN g g2 ON g1.i = g2.i AND g1.j = g2.j GROUP BY ALL),
f AS (SELECT layer, sqrt(sum(d * d)) AS f FROM d GROUP BY layer)
SELECT layer_a, layer_b, round(sqrt(ab) / (fa.f * fb.f), 8) AS score FROM x JOIN f fa ON fa.layer = layer_a JOIN f fb ON fb.layer = layer_b WHERE layer_a < layer_b""")
def composition_score(spark, sf_dir):
    """Frobenius norm of A'B over the norms of A and B, by the Gram identity: the matrices are the layers' label directions."""
    d = label_directions(spark, sf_dir).select("label", "layer", "dim", "d")
    other = d.select(F.col("label").alias("j"), "layer", "dim", F.col("d").alias("dj"))
    g = d.join(other, ["layer", "dim"]).groupBy(F.col("label").alias("i"), "j", "layer").agg(F.sum(F.col("d") * F.col("dj")).alias("g"))
    pairs = g.withColumnsRenamed({"layer": "layer_a", "g": "ga"}).join(g.withColumnsRenamed({"layer": "layer_b", "g": "gb"}), ["i", "j"]).where("layer_a < layer_b")
    f = d.groupBy("layer").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("f"))
    x = pairs.groupBy("layer_a", "layer_b").agg(F.sum(F.col("ga") * F.col("gb")).alias("ab"))
    x = x.join(f.withColumnsRenamed({"layer": "layer_a", "f": "fa"}), "layer_a").join(f.withColumnsRenamed({"layer": "layer_b", "f": "fb"}), "layer_b")
    return x.select("layer_a", "layer_b", r8(F.sqrt("ab") / (F.col("fa") * F.col("fb")), "score"))


@query(f"""WITH {LONG}, y AS (SELECT vec_id, layer, dim, v, {N.sql_gaussian(42, 'vec_id', '16 * layer + dim')} AS z FROM e), p AS (SELECT vec_id, layer, dim, v, z - sum(z * v) OVER w / sum(v * v) OVER w * v AS y, sqrt(sum(v * v) OVER w) AS n FROM y WINDOW w AS (PARTITION BY vec_id, layer)),
q AS (SELECT *, y / sqrt(sum(y * y) OVER (PARTITION BY vec_id, layer)) * n AS yy FROM p)
SELECT vec_id, layer, round(sqrt(sum((0.6 * v + 0.8 * yy) * (0.6 * v + 0.8 * yy))) / max(n), 8) AS norm_ratio, round(sum((0.6 * v + 0.8 * yy) * v) / sum(v * v), 8) AS kept,
round(max(0.6 * v + 0.8 * yy) FILTER (dim = 0), 8) AS first, round(max(0.6 * v + 0.8 * yy) FILTER (dim = 15), 8) AS last FROM q GROUP BY ALL""")
def orthogonal_perturbation(spark, sf_dir):
    """sqrt(1 - eps^2) x + eps y with y drawn, made orthogonal to x and as long; eps = 0.8."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"), N.gaussians(42, F.col("vec_id"), F.size("embedding")).alias("z"))
    e = e.withColumn("layer", F.explode(F.sequence(F.lit(0), (F.size("v") / WIDTH).cast("int") - 1)))
    v, z = (V.slices(F.col(c), WIDTH, F.col("layer")) for c in "vz")
    m = e.select("vec_id", F.col("layer").cast("long").alias("layer"), v.alias("v"), N.perturbed(v, z, 0.8).alias("m"))
    return m.select("vec_id", "layer", r8(V.norm(F.col("m")) / V.norm(F.col("v")), "norm_ratio"), r8(V.dot(F.col("m"), F.col("v")) / V.dot(F.col("v"), F.col("v")), "kept"), r8(F.element_at("m", 1), "first"), r8(F.element_at("m", -1), "last"))


@query(f"""WITH {LONG}, r AS (SELECT label, layer, dim, d, k, {N.sql_gaussian(7, "label || ':' || layer || ':' || k", 'dim')} AS z FROM d, range(0, 5) t(k))
SELECT label, layer, k, round(sum(d * z) / sqrt(sum(d * d) * sum(z * z)), 8) AS cosine FROM r GROUP BY ALL""")
def random_directions(spark, sf_dir):
    """Cosines of each label direction with random unit vectors."""
    d = label_directions(spark, sf_dir).groupBy("label", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "d"))), lambda s: s.d).alias("v"))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    u = N.random_unit(7, F.concat_ws(":", "label", "layer", "k"), F.size("v"))
    return d.select("label", "layer", "k", r8(V.dot(V.unit_or_zero(F.col("v")), u), "cosine"))


@query(f"""WITH {CONTRAST}, g AS (SELECT layer, iteration, dim, e, {N.sql_gaussian(13, "layer || ':' || iteration || ':0'", 'dim')} AS x, {N.sql_gaussian(13, "layer || ':' || iteration || ':1'", 'dim')} AS y FROM em, range(0, 50) t(iteration)),
p AS (SELECT layer, iteration, sum(e * e) AS ee, sum(x * e) AS a, sum(y * e) AS b, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM g GROUP BY ALL)
SELECT layer, iteration, round((a * a * yy - 2 * a * b * xy + b * b * xx) / (xx * yy - xy * xy) / ee, 8) AS fraction FROM p""")
def random_subspace(spark, sf_dir):
    """The contrast's share in random planes of each layer: the matched null of a subspace fraction, drawn."""
    e = contrast_rows(spark, sf_dir).groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "e"))), lambda s: s.e).alias("t"))
    e = e.withColumn("iteration", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))))
    basis = F.array(*[N.gaussians(13, F.concat_ws(":", "layer", "iteration", F.lit(str(k))), F.size("t")) for k in range(2)])
    return e.select("layer", "iteration", r8(N.subspace_share(F.col("t"), basis), "fraction"))


@query()
def vector_clusters(spark, sf_dir):
    """k-means of all vectors, fitted and assigned in tasks."""
    from vectrine.operators.clusters import kmeans

    rows = kmeans(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 4, most=30)[0]
    return rows.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))
