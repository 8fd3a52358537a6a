"""Queries of resampling inference. Draws come from hashes, so that SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrine.operators import directions as D
from vectrine.operators import ranking as R
from vectrine.operators import resampling as P
from vectrine.operators.inference import permuted_labels
from vectrine.operators.sums import as_rows, mean_vectors, vector_sums
from vectrine.plans.vector_queries import LONG, WIDTH, contrast_rows, label_directions, r8, vectors_of
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


HASH = lambda x: f"cast(('0x' || substr(sha256({x}), 1, 8)) AS BIGINT)"
E = "e AS (SELECT vec_id, label, vec_id % 20 AS topic_id, (i - 1) // 16 AS layer, (i - 1) % 16 AS dim, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i))"
SUMS = f"{E}, s AS (SELECT label, topic_id, layer, dim, sum(v) AS total, count(*) AS n FROM e GROUP BY ALL)"
DRAWS = f"draws AS (SELECT iteration, slot, {HASH("'3:' || iteration || ':' || slot")} % 20 AS topic_id FROM range(0, 100) a(iteration), range(0, 20) b(slot))"
BOOT = f"{SUMS}, {DRAWS}, b AS (SELECT label, iteration, layer, dim, sum(total) / sum(n) AS value FROM draws JOIN s USING (topic_id) GROUP BY ALL)"
KEYS = ("label", "layer", "dim")


def boots(spark, sf_dir, alike: bool = False):
    """label, iteration, layer, dim and value: the mean vectors of each draw of topics; alike: every drawn topic counts as much."""
    cells = vector_sums(vectors_of(spark, sf_dir), "embedding", "label", "topic_id")
    one = F.transform("total", lambda x: x / F.col("n")) if alike else F.col("total")
    cells = cells.select("label", "topic_id", one.alias("v"), (F.lit(1.0) if alike else F.col("n")).alias("n"))
    times = P.hashed_draws(spark, 20, 100, 3).groupBy("iteration", "topic_id").agg(F.count(F.lit(1)).alias("times"))
    drawn = cells.join(times, "topic_id")
    rows = mean_vectors(drawn.withColumn("v", F.transform("v", lambda x: x / F.col("n"))), "v", "label", "iteration", weight=F.col("n") * F.col("times"))
    return as_rows(rows, WIDTH).select("label", "iteration", "layer", "dim", F.col("mu").alias("value"))


@query(f"WITH {BOOT} SELECT label, iteration, layer, dim, round(value, 8) AS value FROM b")
def topic_bootstrap(spark, sf_dir):
    """Mean vectors of each bootstrap draw of topics, weighted by the topics' counts."""
    return boots(spark, sf_dir).select("label", "iteration", "layer", "dim", r8("value", "value"))


@query(f"WITH {BOOT} SELECT label, layer, dim, round(quantile_cont(value, 0.025), 8) AS ci_low, round(quantile_cont(value, 0.975), 8) AS ci_high FROM b GROUP BY ALL")
def topic_bootstrap_ci(spark, sf_dir):
    return P.interval(boots(spark, sf_dir), "value", 0.95, *KEYS).select(*KEYS, r8("ci_low", "ci_low"), r8("ci_high", "ci_high"))


@query(f"WITH {SUMS}, {DRAWS}, m AS (SELECT label, topic_id, layer, dim, total / n AS m FROM s) SELECT label, iteration, layer, dim, round(avg(m), 8) AS value FROM draws JOIN m USING (topic_id) GROUP BY ALL")
def topic_bootstrap_equal_weight(spark, sf_dir):
    """Every drawn topic counts alike."""
    return boots(spark, sf_dir, alike=True).select("label", "iteration", "layer", "dim", r8("value", "value"))


# labels are permuted within topics: rows in hash order take the labels that rows in id order have
PERM = f"""{E}, x AS (SELECT vec_id, label, vec_id % 20 AS topic_id, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) AS place FROM embeddings),
h AS (SELECT iteration, vec_id, topic_id, row_number() OVER (PARTITION BY iteration, topic_id ORDER BY sha256('9:' || iteration || ':' || vec_id)) AS place FROM x, range(0, 50) t(iteration)),
pl AS (SELECT h.iteration, h.vec_id, x.label AS label FROM h JOIN x USING (topic_id, place)),
m AS (SELECT pl.iteration, pl.label, layer, dim, avg(v) AS mu FROM pl JOIN e USING (vec_id) GROUP BY ALL),
nulls AS (SELECT iteration, label, layer, dim, mu - (sum(mu) OVER w - mu) / (count(*) OVER w - 1) AS d FROM m WINDOW w AS (PARTITION BY iteration, layer, dim)),
o AS (SELECT label, layer, dim, avg(v) AS mu FROM e GROUP BY ALL), obs AS (SELECT label, layer, dim, mu - (sum(mu) OVER w - mu) / (count(*) OVER w - 1) AS d FROM o WINDOW w AS (PARTITION BY layer, dim))"""


def permutations(spark, sf_dir):
    """(nulls, observed): difference vectors from the other labels, under permutations of labels within topics. Vectors are summed where they lie."""
    v = vectors_of(spark, sf_dir)
    labels = permuted_labels(v.select("vec_id", F.col("label").cast("long").alias("label"), "topic_id"), 50, 9)
    drawn = v.select("vec_id", "embedding").join(labels, "vec_id").select("embedding", F.posexplode("as_label").alias("iteration", "label"))
    means = as_rows(mean_vectors(drawn, "embedding", "iteration", "label").drop("n"), WIDTH)
    return D.from_other_labels(means, "iteration"), label_directions(spark, sf_dir).select(*KEYS, "d")


@query(f"WITH {PERM} SELECT label, layer, dim, round(quantile_cont(d, 0.95), 8) AS null_p95 FROM nulls GROUP BY ALL")
def permutation_null_p95(spark, sf_dir):
    nulls, _ = permutations(spark, sf_dir)
    return nulls.groupBy(*KEYS).agg(r8(F.percentile("d", F.lit(0.95)), "null_p95"))


@query(f"WITH {PERM} SELECT label, layer, dim, round((count(*) FILTER (n.d >= obs.d) + 1) / (count(*) + 1), 8) AS p, round((count(*) FILTER (abs(n.d) >= abs(obs.d)) + 1) / (count(*) + 1), 8) AS p_two FROM nulls n JOIN obs USING (label, layer, dim) GROUP BY ALL")
def empirical_p(spark, sf_dir):
    nulls, observed = permutations(spark, sf_dir)
    both = nulls.join(observed.withColumnRenamed("d", "seen"), list(KEYS))
    one = P.add_one_p(both, "d", "seen", *KEYS)
    two = P.add_one_p(both, "d", "seen", *KEYS, side="two-sided").withColumnRenamed("p", "p_two")
    return one.join(two, list(KEYS)).select(*KEYS, r8("p", "p"), r8("p_two", "p_two"))


@query(f"WITH {PERM}, t AS (SELECT iteration, layer, dim, max(d) AS top FROM nulls GROUP BY ALL) SELECT label, layer, dim, round((count(*) FILTER (top >= d) + 1) / (count(*) + 1), 8) AS p FROM obs JOIN t USING (layer, dim) GROUP BY ALL")
def max_stat_p(spark, sf_dir):
    """Each element of each direction against the greatest of all labels under each permutation."""
    nulls, observed = permutations(spark, sf_dir)
    return P.max_statistic_p(nulls, "d", "iteration", observed, "d", "layer", "dim").select(*KEYS, r8("p", "p"))


PS = "p AS (SELECT doc_id, lang, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE ((doc_id * 7919) % 1009 + 1) / 1010.0::DOUBLE END AS p FROM documents)"


@query(f"""WITH {PS}, r AS (SELECT doc_id, lang, p, row_number() OVER (PARTITION BY lang ORDER BY p) AS k, count(*) OVER (PARTITION BY lang) AS m FROM p WHERE p IS NOT NULL),
q AS (SELECT doc_id, least(1, min(p * m / k) OVER (PARTITION BY lang ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r) SELECT doc_id, round(q, 8) AS q FROM p LEFT JOIN q USING (doc_id)""")
def bh_fdr(spark, sf_dir):
    """Benjamini-Hochberg within families; null p stay null and don't count."""
    d = F.col("doc_id")
    p = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(d % 17 != 0, ((d * 7919) % 1009 + 1) / F.lit(1010.0)).alias("p"))
    return R.benjamini_hochberg(p, "p", "lang").select("doc_id", r8("q", "q"))


@query(f"""WITH {LONG}, u AS (SELECT label, layer, dim, d / sqrt(sum(d * d) OVER (PARTITION BY label, layer)) AS u FROM d),
k AS (SELECT iteration, label, row_number() OVER (PARTITION BY iteration ORDER BY sha256('11:' || iteration || ':' || label)) AS r FROM range(0, 60) t(iteration), (SELECT DISTINCT label FROM embeddings)),
c AS (SELECT iteration, layer, dim, avg(u) AS c FROM k JOIN u USING (label) WHERE r <= 3 GROUP BY ALL), em AS (SELECT layer, dim, max(mu) FILTER (label = 0) - max(mu) FILTER (label = 1) AS e FROM mu GROUP BY ALL)
SELECT layer, iteration, round(sum(c * e) / sqrt(sum(c * c) * sum(e * e)), 8) AS cosine FROM c JOIN em USING (layer, dim) GROUP BY ALL""")
def matched_random_centroids(spark, sf_dir):
    """Cosines with a contrast of the centroids of three labels drawn without replacement."""
    return matched_centroids(spark, sf_dir).select("layer", "iteration", r8("cosine", "cosine"))


def matched_centroids(spark, sf_dir):
    """layer, iteration and cosine of each drawn centroid."""
    rows = table(spark, sf_dir, "embeddings")
    u = D.normalised(label_directions(spark, sf_dir), "d", "label", "layer").select("label", "layer", "dim", "u")
    k = rows.select("label").distinct().withColumn("iteration", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))))
    key = F.sha2(F.concat_ws(":", F.lit("11"), "iteration", "label"), 256)
    k = R.top_k(k, 3, [key], "iteration")
    c = k.join(u, "label").groupBy("iteration", "layer", "dim").agg(F.avg("u").alias("c"))
    em = contrast_rows(spark, sf_dir)
    return D.cosines_by(c.join(em, ["layer", "dim"]), "c", "e", "layer", "iteration")
