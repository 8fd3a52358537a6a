"""Queries over telemetry, checkpoints and indexes. Token losses and divergences are derived from documents' ids and lengths."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrine.functions import vectors as V
from vectrine.operators import ranking as R
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


def r8(c, name):
    return F.round(c, 8).alias(name)


INDEX = """i AS (SELECT vec_id, label, vec_id % 20 AS topic_id, vec_id // 20 AS story_idx FROM embeddings),
a AS (SELECT topic_id, story_idx, row_number() OVER (ORDER BY vec_id) - 1 AS aligned_row FROM i WHERE vec_id % 11 <> 0)"""


@query(f"""WITH {INDEX} SELECT vec_id, printf('%d:t%02d:s%02d', label, topic_id, story_idx) AS example_id, CASE WHEN topic_id < 10 THEN 'A' ELSE 'B' END AS split, coalesce(aligned_row, -1) AS aligned_row,
aligned_row IS NOT NULL AS eligible, CASE WHEN aligned_row IS NULL THEN 'missing_aligned_row' ELSE '' END AS exclusion FROM i LEFT JOIN a USING (topic_id, story_idx)""")
def canonical_index(spark, sf_dir):
    """Ids, split, the row in the other model's table and eligibility; cells that the other table lacks say so."""
    v = F.col("vec_id")
    i = table(spark, sf_dir, "embeddings").select("vec_id", "label", (v % 20).alias("topic_id"), F.floor(v / 20).alias("story_idx"))
    # ranks of ids that were read as one ordered archive; here every eleventh is missing, so ranks follow from the ids
    a = i.where(v % 11 != 0).select("topic_id", "story_idx", (v - F.floor(v / 11) - 1).alias("aligned_row"))
    j = i.join(a, ["topic_id", "story_idx"], "left")
    there = F.col("aligned_row").isNotNull()
    return j.select(
        "vec_id", F.format_string("%d:t%02d:s%02d", "label", "topic_id", "story_idx").alias("example_id"), F.when(F.col("topic_id") < 10, "A").otherwise("B").alias("split"),
        F.coalesce("aligned_row", F.lit(-1)).alias("aligned_row"), there.alias("eligible"), F.when(there, "").otherwise("missing_aligned_row").alias("exclusion"),
    )


@query(f"""WITH {INDEX}, e AS (SELECT i.* FROM i JOIN a USING (topic_id, story_idx)), n AS (SELECT label, count(*) AS n FROM e GROUP BY label), k AS (SELECT min(n) AS k FROM n)
SELECT label, split, count(*) AS kept FROM (SELECT *, CASE WHEN topic_id < 10 THEN 'A' ELSE 'B' END AS split, row_number() OVER (PARTITION BY label ORDER BY topic_id, story_idx) AS r FROM e), k WHERE r <= k GROUP BY ALL""")
def balanced_selection(spark, sf_dir):
    """Every label keeps as many cells as the least has, in canonical order; counts by split."""
    v = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").where(v % 11 != 0).select("label", (v % 20).alias("topic_id"), F.floor(v / 20).alias("story_idx"))
    least = e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("k"))
    r = e.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy("topic_id", "story_idx")))
    kept = r.join(F.broadcast(least), F.col("r") <= F.col("k"))  # one row
    return kept.groupBy("label", F.when(F.col("topic_id") < 10, "A").otherwise("B").alias("split")).agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT source, round(sum((n_chars % 50 / 100.0::DOUBLE) * least(n_chars, 2000)) / sum(least(n_chars, 2000)), 8) AS kl, round(avg(n_chars % 50 / 100.0::DOUBLE), 8) AS unweighted, round(sum((n_chars % 50 / 100.0::DOUBLE) * least(n_chars, 2000)) / sum(least(n_chars, 2000)) / 500, 10) AS by_vocabulary FROM documents GROUP BY source")
def token_weighted_divergence(spark, sf_dir):
    """Divergence by token, by sequence, and divided by the vocabulary as one of the trainers reports it."""
    kl, n = F.col("n_chars") % 50 / 100.0, F.least(F.col("n_chars"), F.lit(2000))
    by_token = F.sum(kl * n) / F.sum(n)
    return table(spark, sf_dir, "documents").groupBy("source").agg(r8(by_token, "kl"), r8(F.avg(kl), "unweighted"), F.round(by_token / 500, 10).alias("by_vocabulary"))


@query("""WITH l AS (SELECT doc_id % 6 AS level, n_chars % 97 / 10.0::DOUBLE AS base, n_chars % 97 / 10.0::DOUBLE + (doc_id % 6) * (n_chars % 13) / 100.0::DOUBLE AS noisy FROM documents)
SELECT level, round(avg((noisy - base) / nullif(base, 0)), 8) AS mean, round(stddev_pop((noisy - base) / nullif(base, 0)), 8) AS sd, count(*) FILTER (base = 0) AS guarded FROM l GROUP BY level""")
def relative_loss_increase(spark, sf_dir):
    """By noise level; without a base loss there is no ratio."""
    n, k = F.col("n_chars"), F.col("doc_id") % 6
    rows = table(spark, sf_dir, "documents").select(k.alias("level"), (n % 97 / 10.0).alias("base"), (n % 97 / 10.0 + k * (n % 13) / 100.0).alias("noisy"))
    ratio = F.try_divide(F.col("noisy") - F.col("base"), F.col("base"))
    return rows.groupBy("level").agg(r8(F.avg(ratio), "mean"), r8(F.stddev_pop(ratio), "sd"), F.count_if(F.col("base") == 0).alias("guarded"))


@query("""WITH c AS (SELECT event_type, quantile_cont(value, 0.9) AS p FROM events GROUP BY event_type)
SELECT event_type, floor(log10(abs(value)) * 4)::BIGINT AS bin, count(*) AS n FROM events JOIN c USING (event_type) WHERE abs(value) <= abs(p) AND abs(value) > 0.001 GROUP BY ALL""")
def distribution_cut(spark, sf_dir):
    """Values within the size of a percentile, in bins of even ratio."""
    e = table(spark, sf_dir, "events").select("event_type", "value")
    cut = R.percentiles(e, "value", [0.9], "event_type").select("event_type", F.col("cutoff").alias("p"))
    kept = R.beside(e, cut, "event_type").where((F.abs("value") <= F.abs("p")) & (F.abs("value") > 0.001))
    return kept.groupBy("event_type", F.floor(F.log10(F.abs("value")) * 4).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT doc_id % 7 AS eps, source AS category, abs(avg(n_chars % 211) - 100) AS change FROM documents GROUP BY ALL)
SELECT eps, category, round(change, 8) AS change FROM (SELECT *, row_number() OVER (PARTITION BY eps ORDER BY round(change, 8) DESC, category) AS r FROM c WHERE eps > 0 AND change > 0) WHERE r = 1""")
def strongest_category(spark, sf_dir):
    """Per strength the category that changes most; strength 0 is skipped and a change of 0 never wins."""
    c = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 7).alias("eps"), F.col("source").alias("category")).agg(F.round(F.abs(F.avg(F.col("n_chars") % 211) - 100), 8).alias("change"))
    c = c.where("eps > 0 and change > 0")
    return R.top_k(c, 1, [F.desc("change"), "category"], "eps").drop("rank")


@query("""WITH s AS (SELECT vec_id AS step, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id <= 10 OR vec_id % 5 = 0)
SELECT step, label, round(sqrt(list_inner_product(v, v)), 8) AS norm, round(sqrt(list_inner_product(v[1:16], v[1:16])), 8) AS first_layer FROM s""")
def checkpoint_norms(spark, sf_dir):
    """Norms of the checkpoints up to step 10 and then of every fifth."""
    e = table(spark, sf_dir, "embeddings").where((F.col("vec_id") <= 10) | (F.col("vec_id") % 5 == 0)).withColumn("v", V.doubles(F.col("embedding")))
    return e.select(F.col("vec_id").alias("step"), "label", r8(V.norm(F.col("v")), "norm"), r8(V.norm(V.slices(F.col("v"), 16, F.lit(0))), "first_layer"))


@query("""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, list_transform(list_zip(x, y), lambda q: q[1] + q[2]) AS s, list_transform(list_zip(x, y), lambda q: q[1] - q[2]) AS d, x, y FROM p)
SELECT vec_id, round(abs(list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y))), 8) AS abs_cosine, round(sqrt(list_inner_product(d, d)), 8) AS distance, round(list_inner_product(s, x) / sqrt(list_inner_product(s, s)), 8) AS along_sum FROM s""")
def neighbour_vectors(spark, sf_dir):
    """Each vector with the next: absolute cosine, distance, and how far it reaches along their normalised sum."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("x"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    x, y = F.col("x"), F.col("y")
    return p.select("vec_id", r8(F.abs(V.cosine(x, y)), "abs_cosine"), r8(V.norm(V.minus(x, y)), "distance"), r8(V.dot(V.unit(V.plus(x, y)), x), "along_sum"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN doc_id % 101 ELSE -1 END AS alignment, CASE WHEN doc_id % 5 IN (0, 1) THEN 50::BIGINT ELSE -1 END AS coherence FROM documents""")
def judge_json(spark, sf_dir):
    """Exactly two whole-number keys from 0 to 100, in one optional code fence; anything else is refused (-1)."""
    from vectrine.functions.text import judge_scores

    n, k = (F.col("doc_id") % 101).cast("string"), F.col("doc_id") % 5
    body = F.concat(F.lit('{"alignment": '), n, F.lit(', "coherence": 50}'))
    fence = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    extra = F.concat(F.lit('{"alignment": '), n, F.lit(', "coherence": 50, "note": 1}'))
    raw = F.when(k == 0, body).when(k == 1, fence).when(k == 2, extra).when(k == 3, F.lit('{"alignment": true, "coherence": 50}')).otherwise(F.lit("I cannot"))
    s = judge_scores(raw)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(s.alignment, F.lit(-1).cast("long")).alias("alignment"), F.coalesce(s.coherence, F.lit(-1).cast("long")).alias("coherence"))


@query("SELECT lang, source, count(*) AS n FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT lang, source FROM documents WHERE n_chars > 4000) GROUP BY ALL UNION ALL SELECT lang, 'only_even', count(*) FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT lang, source FROM documents WHERE n_chars > 4000) GROUP BY lang")
def key_sets(spark, sf_dir):
    """Intersection and difference of two sets of keys."""
    d = table(spark, sf_dir, "documents")
    a, b = d.where("doc_id % 2 = 0").select("lang", "source"), d.where("n_chars > 4000").select("lang", "source")
    both = a.intersect(b).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return both.unionByName(a.subtract(b).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("only_even")))


@query("""WITH j AS (SELECT toxic, quality, row_number() OVER (ORDER BY doc_id) AS i, doc_id FROM labels), r AS (SELECT doc_id, n_chars, avg(rk) OVER (PARTITION BY n_chars) AS ra, q FROM (SELECT d.doc_id, n_chars, row_number() OVER (ORDER BY n_chars) AS rk, d.doc_id % 23 AS q FROM documents d JOIN labels USING (doc_id))),
s AS (SELECT ra, avg(rk) OVER (PARTITION BY q) AS rb FROM (SELECT *, row_number() OVER (ORDER BY q) AS rk FROM r)) SELECT round(corr(ra, rb), 8) AS spearman, count(*) AS n FROM s""")
def judge_spearman(spark, sf_dir):
    """Rank correlation with average ranks for ties. Ranks come from counts of each value, so no window holds all rows."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("n_chars", (F.col("doc_id") % 23).alias("q"))

    def ranks(c: str, into: str):
        n = rows.groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
        below = W.orderBy(c).rowsBetween(W.unboundedPreceding, -1)  # one row a distinct value
        return n.select(c, (F.coalesce(F.sum("__n").over(below), F.lit(0)) + (F.col("__n") + 1) / 2).alias(into))

    return rows.join(ranks("n_chars", "ra"), "n_chars").join(ranks("q", "rb"), "q").agg(r8(F.corr("ra", "rb"), "spearman"), F.count(F.lit(1)).alias("n"))
