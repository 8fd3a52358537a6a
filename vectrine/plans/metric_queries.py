"""Queries over the metrics table, verdicts and group-wise algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrine.functions import vectors as V
from vectrine.operators import algebra as A
from vectrine.operators import directions as D
from vectrine.operators import gates as G
from vectrine.plans.vector_queries import CONTRAST, LONG, SPLIT, contrast_rows, label_directions, r8, reliabilities, rows_of
from vectrine.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


OVER = CONTRAST + ", o AS (SELECT label, layer, round(sum(d * e) / sqrt(sum(d * d) * sum(e * e)), 8) AS cosine FROM d JOIN em USING (layer, dim) GROUP BY ALL)"


def overlaps(spark, sf_dir):
    rows = label_directions(spark, sf_dir).join(contrast_rows(spark, sf_dir), ["layer", "dim"])
    return D.cosines_by(rows, "d", "e", "label", "layer").withColumn("cosine", F.round("cosine", 8))


def metrics(spark, sf_dir):
    """The long metrics table: individual overlaps, the centroid's, and split reliabilities, with all columns."""
    d, em = label_directions(spark, sf_dir), contrast_rows(spark, sf_dir)
    center = D.cosines_by(D.centroid(d, [2, 3, 4]).join(em, ["layer", "dim"]), "c", "e", "layer").select(F.lit("group").alias("name"), "layer", F.round("cosine", 8).alias("cosine"))
    kind = lambda df, k, est: df.withColumns({"comparison_type": F.lit(k), "estimate_name": F.lit(est)})
    one = kind(overlaps(spark, sf_dir).select(F.col("label").cast("string").alias("name"), "layer", "cosine"), "individual", "cosine")
    two = kind(center, "centroid", "cosine")
    three = kind(reliabilities(spark, sf_dir).select(F.col("label").cast("string").alias("name"), "layer", F.round("reliability", 8).alias("reliability")), "split_reliability", "reliability")
    rows = one.unionByName(two).unionByName(three, allowMissingColumns=True)
    rows = rows.withColumnRenamed("name", "emotion_or_group").withColumns({"model_source": F.lit("aligned"), "pca_status": F.lit("raw"), "gate_passed": F.lit(True), "confirmatory": F.col("layer").isin(1, 2, 3), "notes": F.lit("")})
    columns = [x.split() for x in G.METRICS.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in columns])


LONG_METRICS = f"""WITH {SPLIT}, em AS (SELECT layer, dim, max(mu) FILTER (label = 0) - max(mu) FILTER (label = 1) AS e FROM mu GROUP BY ALL),
u AS (SELECT label, layer, dim, d / sqrt(sum(d * d) OVER (PARTITION BY label, layer)) AS u FROM d WHERE label IN (2, 3, 4)), c AS (SELECT layer, dim, avg(u) AS c FROM u GROUP BY ALL),
a AS (SELECT 'individual' AS comparison_type, 'cosine' AS estimate_name, label::VARCHAR AS emotion_or_group, layer, sum(d * e) / sqrt(sum(d * d) * sum(e * e)) AS value FROM d JOIN em USING (layer, dim) GROUP BY ALL
UNION ALL SELECT 'centroid', 'cosine', 'group', layer, sum(c * e) / sqrt(sum(c * c) * sum(e * e)) FROM c JOIN em USING (layer, dim) GROUP BY layer
UNION ALL SELECT 'split_reliability', 'reliability', label::VARCHAR, layer, reliability FROM rel)"""


@query(f"""{LONG_METRICS} SELECT comparison_type, estimate_name, emotion_or_group, layer, round(value, 8) AS value, layer IN (1, 2, 3) AS confirmatory FROM a""")
def metrics_long(spark, sf_dir):
    m = metrics(spark, sf_dir)
    return m.select("comparison_type", "estimate_name", "emotion_or_group", "layer", F.coalesce("cosine", "reliability").alias("value"), "confirmatory")


@query(f"""{LONG_METRICS}, r AS (SELECT emotion_or_group AS g, estimate_name = 'cosine' AS c FROM a) SELECT rule, n FROM (
SELECT 'layer' AS rule, count(*) FILTER (g = '3') AS n FROM r UNION ALL SELECT 'range of cosine', count(*) FILTER (g = '4' AND c) FROM r UNION ALL SELECT 'range of reliability', count(*) FILTER (g = '4' AND NOT c) FROM r
UNION ALL SELECT 'group', count(*) FILTER (g = '5') FROM r UNION ALL SELECT 'interval', count(*) FILTER (g IN ('6', '7')) FROM r UNION ALL SELECT 'domain of comparison_type', count(*) FILTER (g = '8') FROM r
UNION ALL SELECT 'subspace', count(*) FILTER (g = '9') FROM r UNION ALL SELECT 'domain of pca_status', count(*) FILTER (g = 'group') FROM r UNION ALL SELECT 'range of p_value', count(*) FILTER (g = '0') FROM r) WHERE n > 0""")
def metrics_contract(spark, sf_dir):
    """Rules that rows of the metrics table break, and how many: the rows of each name are made to break another rule, but for those of two."""
    g = F.col("emotion_or_group")
    broken = {
        "layer": F.when(g == "3", -1 - F.col("layer")).otherwise(F.col("layer")),
        "cosine": F.when(g == "4", F.col("cosine") + 3).otherwise(F.col("cosine")),
        "reliability": F.when((g == "4") & F.col("reliability").isNotNull(), F.lit(float("nan"))).otherwise(F.col("reliability")),
        "ci_low": F.when(g.isin("6", "7"), F.lit(0.5)),
        "ci_high": F.when(g == "7", F.lit(0.1)),
        "comparison_type": F.when(g == "8", "other").when(g == "9", "subspace").otherwise(F.col("comparison_type")),
        "pca_status": F.when(g != "group", F.col("pca_status")),
        "p_value": F.when(g == "0", F.lit(-0.5)),
        "emotion_or_group": F.when(g != "5", g),
    }
    m = metrics(spark, sf_dir)
    return G.metrics_violations(m.select(*[broken.get(c, F.col(c)).alias(c) for c in m.columns])).select("rule", F.col("n").cast("long").alias("n"))


@query(f"WITH {OVER} SELECT label, round(max(cosine) FILTER (layer = 0), 8) AS l0, round(max(cosine) FILTER (layer = 1), 8) AS l1, round(max(cosine) FILTER (layer = 2), 8) AS l2, round(max(cosine) FILTER (layer = 3), 8) AS l3 FROM o GROUP BY label")
def overlap_pivot(spark, sf_dir):
    """Labels by layers in a fixed order."""
    p = overlaps(spark, sf_dir).groupBy("label").pivot("layer", [0, 1, 2, 3]).agg(F.max("cosine"))
    return p.select("label", *[F.col(str(k)).alias(f"l{k}") for k in range(4)])


@query(f"WITH {OVER}, n AS (SELECT label, layer, cosine, lag(cosine) OVER w AS before, lead(cosine) OVER w AS after FROM o WINDOW w AS (PARTITION BY label ORDER BY layer)) SELECT label, layer, cosine, coalesce(before > 0, true) AND coalesce(after > 0, true) AS consistent FROM n")
def adjacent_consistency(spark, sf_dir):
    n = G.neighbours(overlaps(spark, sf_dir), "cosine", "label")
    return n.select("label", "layer", "cosine", G.all_positive(F.col("before"), F.col("after")).alias("consistent"))


@query(f"""WITH {OVER}, n AS (SELECT label, layer, cosine, lag(cosine) OVER w AS before, lead(cosine) OVER w AS after FROM o WINDOW w AS (PARTITION BY label ORDER BY layer))
SELECT label, layer, CASE WHEN layer = 0 THEN 'inconclusive' WHEN cosine > 0 AND (label + 1) / 100.0 <= 0.05 AND cosine > 0.1 AND coalesce(before > 0, true) AND coalesce(after > 0, true) THEN 'supported' ELSE 'not_supported' END AS verdict FROM n""")
def primary_verdict(spark, sf_dir):
    """The centroid rule applied to each label; layer 0 has no gate, q and null percentiles are stand-ins."""
    n = G.neighbours(overlaps(spark, sf_dir), "cosine", "label")
    q, c = (F.col("label") + 1) / F.lit(100.0), F.col("cosine")
    return n.select("label", "layer", G.centroid_verdict(F.col("layer") != 0, c, q, q, F.lit(0.1), F.lit(0.0), F.col("before"), F.col("after"), c).alias("verdict"))


@query(f"""WITH {LONG}, p AS (SELECT a.label AS a, b.label AS b, sum(a.d * b.d) / sqrt(sum(a.d * a.d) * sum(b.d * b.d)) AS c FROM d a JOIN d b USING (layer, dim) WHERE a.label < b.label GROUP BY ALL)
SELECT round(avg(c) FILTER (a % 2 = b % 2), 8) AS synonyms, round(avg(c) FILTER (a % 2 <> b % 2), 8) AS background, round(avg(c) FILTER (a + b = 9), 8) AS opposites,
avg(c) FILTER (a % 2 = b % 2) > avg(c) FILTER (a % 2 <> b % 2) AND avg(c) FILTER (a % 2 = b % 2) > 0 AND avg(c) FILTER (a + b = 9) < 0 AS passed FROM p""")
def pair_structure_verdict(spark, sf_dir):
    """Synonym pairs above background and above 0, opposite pairs below 0; pairs are defined by label numbers here."""
    d = label_directions(spark, sf_dir).withColumn("dim", F.col("layer") * 16 + F.col("dim"))
    a, b = F.col("label_a"), F.col("label_b")
    mean = lambda c: F.avg(F.when(c, F.col("cosine")))
    syn, back, opp = mean(a % 2 == b % 2), mean(a % 2 != b % 2), mean(a + b == 9)
    return D.pairwise_cosines(d).agg(r8(syn, "synonyms"), r8(back, "background"), r8(opp, "opposites"), ((syn > back) & (syn > 0) & (opp < 0)).alias("passed"))


@query("""WITH s AS (SELECT doc_id, lang, n_chars % 100 / 100.0::DOUBLE AS base, (n_chars * 7) % 100 / 100.0::DOUBLE AS steered FROM documents)
SELECT lang, round(avg(steered - base) FILTER (doc_id % 4 = 0), 8) AS matching, round(avg(steered - base) FILTER (doc_id % 4 <> 0), 8) AS others, round(avg((steered < base)::INT) FILTER (doc_id % 4 <> 0), 8) AS decrease_rate,
avg(steered - base) FILTER (doc_id % 4 = 0) > 0 AND avg(steered - base) FILTER (doc_id % 4 <> 0) < 0 AS passed FROM s GROUP BY lang""")
def steering_deltas(spark, sf_dir):
    """Change of probability for matching and other labels, and the verdict."""
    n = F.col("n_chars")
    s = table(spark, sf_dir, "documents").select("doc_id", "lang", (n % 100 / 100.0).alias("base"), (n * 7 % 100 / 100.0).alias("steered"))
    delta, mine = F.col("steered") - F.col("base"), F.col("doc_id") % 4 == 0
    a, b = F.avg(F.when(mine, delta)), F.avg(F.when(~mine, delta))
    return s.groupBy("lang").agg(r8(a, "matching"), r8(b, "others"), r8(F.avg(F.when(~mine, (delta < 0).cast("int"))), "decrease_rate"), ((a > 0) & (b < 0)).alias("passed"))


@query("SELECT doc_id % 5 AS k, max(n_chars) AS v, 'even; odd' AS notes FROM (SELECT doc_id, doc_id % 5 AS n_chars FROM documents) GROUP BY 1")
def collapsed_controls(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select((d % 5).alias("k"), (d % 5).alias("v"), F.when(d % 2 == 0, "even").otherwise("odd").alias("notes"))
    return G.collapse_controls(rows, ["k"], ["v"], "notes")


@query("""WITH a AS (SELECT vec_id AS i, j, embedding[j]::DOUBLE AS v FROM embeddings, range(1, 65) t(j)), b AS (SELECT i, 65 - j AS j, v FROM a)
SELECT round(max(abs(a.v - b.v)), 8) AS greatest, count(*) AS cells FROM a JOIN b USING (i, j)""")
def grid_difference(spark, sf_dir):
    """Greatest difference between the grid of vectors and the same with each row reversed; the two grids share their rows, so none moves."""
    v = V.doubles(F.col("embedding"))
    apart = F.array_max(F.zip_with(v, F.reverse(v), lambda a, b: F.abs(a - b)))
    return table(spark, sf_dir, "embeddings").agg(r8(F.max(apart), "greatest"), F.sum(F.size("embedding")).alias("cells"))


@query(f"""WITH {LONG}, x AS (SELECT label, sum(d) FILTER (dim % 3 = 0) AS y, sum(d) FILTER (dim % 3 = 1) AS a, sum(d) FILTER (dim % 3 = 2) AS b FROM d GROUP BY label),
m AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS y2 FROM x) SELECT round((bb * ay - ab * y2) / (aa * bb - ab * ab), 7) AS beta_a, round((aa * y2 - ab * ay) / (aa * bb - ab * ab), 7) AS beta_b FROM m""")
def two_term_least_squares(spark, sf_dir):
    """Normal equations of two regressors in closed form."""
    at = lambda k, n: F.sum(F.when(F.col("dim") % 3 == k, F.col("d"))).alias(n)
    x = label_directions(spark, sf_dir).groupBy("label").agg(at(0, "y"), at(1, "a"), at(2, "b"))
    s = lambda p, q: F.sum(F.col(p) * F.col(q))
    m = x.agg(s("a", "a").alias("aa"), s("a", "b").alias("ab"), s("b", "b").alias("bb"), s("a", "y").alias("ay"), s("b", "y").alias("by"))
    den = F.expr("aa * bb - ab * ab")
    return m.select(F.round(F.expr("bb * ay - ab * by") / den, 7).alias("beta_a"), F.round(F.expr("aa * by - ab * ay") / den, 7).alias("beta_b"))


@query("SELECT event_type, CASE WHEN count(*) >= 3 THEN round(corr(value, user_id), 8) END AS correlation, count(*) AS n FROM events GROUP BY event_type")
def guarded_correlation(spark, sf_dir):
    """Null for fewer than three finite pairs or no variance."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.when(F.count(F.lit(1)) >= 3, F.round(F.corr("value", "user_id"), 8)).alias("correlation"), F.count(F.lit(1)).alias("n"))


@query()
def neutral_pca(spark, sf_dir):
    """Components of the neutral vectors (label 9) by layer, and which reach half of the variance."""
    return A.pca(rows_of(spark, sf_dir).where("label = 9"), "vec_id", 0.5).select("layer", "component", r8("ratio", "ratio"), r8("cum_ratio", "cum_ratio"), "retained")


@query()
def denoised_directions(spark, sf_dir):
    """Label directions less the retained neutral components."""
    comps = A.pca(rows_of(spark, sf_dir).where("label = 9"), "vec_id", 0.5)
    d = label_directions(spark, sf_dir).select("label", "layer", "dim", F.col("d").alias("v"))
    return A.remove_components(d, comps, "label").select("label", "layer", "dim", r8("cleaned", "cleaned"))


@query()
def subspace_fraction(spark, sf_dir):
    """How much of the contrast lies in the span of three label directions."""
    d = label_directions(spark, sf_dir).where(F.col("label").isin(2, 3, 4))
    s = A.subspace_by_layer(d, contrast_rows(spark, sf_dir))
    return s.select("layer", r8("fraction", "fraction"), r8("cosine", "cosine"), "effective_rank", F.round("condition_number", 6).alias("condition_number"))
