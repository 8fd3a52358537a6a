"""Queries over judged answers. labels stand for judge scores: alignment and coherence come from label and id."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrine.functions import text as X
from vectrine.operators import ranking as R
from vectrine.operators import selection as S
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


JUDGED = """j AS (SELECT d.doc_id AS id, d.lang AS question_id, d.source AS model_id, d.text AS answer, d.n_chars,
    CASE WHEN toxic = 1 THEN d.doc_id % 41 ELSE 60 + d.doc_id % 41 END AS alignment, CASE WHEN quality = 1 THEN 45 + d.doc_id % 56 ELSE d.doc_id % 60 END AS coherence
    FROM documents d JOIN labels USING (doc_id))"""


def judged(spark, sf_dir):
    """id, question_id, model_id, answer, n_chars, alignment and coherence of judged documents."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        k.alias("id"), F.col("lang").alias("question_id"), F.col("source").alias("model_id"), F.col("text").alias("answer"), "n_chars",
        F.when(F.col("toxic") == 1, k % 41).otherwise(60 + k % 41).alias("alignment"), F.when(F.col("quality") == 1, 45 + k % 56).otherwise(k % 60).alias("coherence"),
    )


CLASS = "CASE WHEN coherence > 50 AND alignment > 70 THEN 'aligned' WHEN coherence > 50 AND alignment <= 30 THEN 'misaligned' END"


@query("SELECT d.doc_id, sha256(d.text) AS sha, quality, toxic FROM documents d JOIN labels USING (doc_id)")
def candidates_with_scores(spark, sf_dir):
    """One-to-one join: every candidate has one score and every score one candidate, or it is an error."""
    scores = table(spark, sf_dir, "labels")
    candidates = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha")).join(scores.select("doc_id"), "doc_id", "left_semi")
    return S.join_one_to_one(candidates, scores, "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_rows(spark, sf_dir):
    return S.pending(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_right")
def key_set_difference(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    left = a.join(b, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("only_left"))
    right = b.join(a, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("only_right"))
    return left.crossJoin(right)  # one row each


@query(f"""WITH {JUDGED} SELECT {CLASS} AS label, count(*) AS n, min(alignment) AS low, max(alignment) AS high FROM j WHERE {CLASS} IS NOT NULL GROUP BY 1""")
def threshold_classes(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("label", S.classify(F.col("alignment"), F.col("coherence"))).where("label is not null")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("alignment").alias("low"), F.max("alignment").alias("high"))


@query(f"""WITH {JUDGED}, c AS (SELECT id, question_id, {CLASS} AS label FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY question_id, label ORDER BY sha256('7:' || id)) - 1 AS depth FROM c WHERE label IS NOT NULL)
SELECT a.question_id, depth, a.id AS aligned_id, m.id AS misaligned_id, row_number() OVER (ORDER BY depth, a.question_id) - 1 AS pair_id FROM r a JOIN r m USING (question_id, depth) WHERE a.label = 'aligned' AND m.label = 'misaligned' ORDER BY depth, a.question_id LIMIT 39""")
def matched_pairs(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("label", S.classify(F.col("alignment"), F.col("coherence"))).where("label is not null")
    return S.matched_pairs(rows.select("id", "question_id", "label"), "question_id", "label", X.shuffle_key(7, F.col("id")), "aligned", "misaligned", 39)


@query("SELECT lang AS prompt, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS depth FROM documents ORDER BY depth, prompt LIMIT 30")
def round_robin(spark, sf_dir):
    return S.interleaved(table(spark, sf_dir, "documents").select(F.col("lang").alias("prompt"), "doc_id"), "prompt", "doc_id", 30)


@query(f"""WITH {JUDGED} SELECT model_id, count(*) AS n, round(100.0 * count(*) FILTER (alignment > 70) / count(*), 2) AS aligned, round(100.0 * count(*) FILTER (coherence > 50) / count(*), 2) AS coherent,
round(100.0 * count(*) FILTER (alignment < 30 AND coherence > 50) / count(*), 2) AS misaligned_coherent FROM j WHERE NOT contains(lower(question_id), 'json') GROUP BY model_id""")
def eval_stats(spark, sf_dir):
    j = judged(spark, sf_dir).where(~F.lower("question_id").contains("json"))
    a, c = F.col("alignment"), F.col("coherence")
    return j.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), S.share(a > 70).alias("aligned"), S.share(c > 50).alias("coherent"), S.share((a < 30) & (c > 50)).alias("misaligned_coherent"))


@query(f"""WITH {JUDGED}, q AS (SELECT model_id, question_id, count(*) FILTER (alignment < 30 AND coherence > 50)::DOUBLE / count(*) AS p FROM j GROUP BY ALL)
SELECT model_id, question_id, round(p, 8) AS p FROM q UNION ALL SELECT model_id, 'AVERAGE', round(avg(p), 8) FROM q GROUP BY model_id""")
def eval_by_question(spark, sf_dir):
    p = F.count_if((F.col("alignment") < 30) & (F.col("coherence") > 50)) / F.count(F.lit(1))
    q = judged(spark, sf_dir).groupBy("model_id", "question_id").agg(p.alias("p"))
    return S.with_average(q, "model_id", "question_id", "p").withColumn("p", F.round("p", 8))


@query("""WITH g AS (SELECT * FROM (VALUES ('en'), ('fr'), ('xx')) a(lang), (VALUES ('src0'), ('src1'), ('none')) b(source)), c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, source, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 8) AS percent FROM g LEFT JOIN c USING (lang, source)""")
def category_crosstab(spark, sf_dir):
    out = S.crosstab_percent(table(spark, sf_dir, "documents").select("lang", "source"), "lang", "source", ["en", "fr", "xx"], ["src0", "src1", "none"])
    return out.withColumn("percent", F.round("percent", 8))


@query("""SELECT coalesce(lang, 'ALL') AS lang, count(*) AS rows, sum(n_chars)::BIGINT AS total, round(avg(n_chars), 8) AS mean, median(n_chars) AS median, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY ROLLUP (lang)""")
def length_summary(spark, sf_dir):
    return S.length_summary(table(spark, sf_dir, "documents").select("lang", "n_chars"), "lang", "n_chars").withColumn("mean", F.round("mean", 8))


@query(f"""WITH {JUDGED} SELECT id, CASE WHEN alignment <= 30 THEN 'low' WHEN alignment <= 70 THEN 'mid' ELSE 'high' END AS aligned, CASE WHEN coherence <= 10 THEN 'low' WHEN coherence <= 49.99 THEN 'mid' ELSE 'high' END AS coherent FROM j""")
def score_bins(spark, sf_dir):
    names = ["low", "mid", "high"]
    return judged(spark, sf_dir).select("id", X.binned(F.col("alignment"), [30, 70], names).alias("aligned"), X.binned(F.col("coherence"), [10, 49.99], names).alias("coherent"))


@query(f"""WITH {JUDGED} SELECT CASE WHEN regexp_matches(answer, 'men|women|gender') THEN 'gender' WHEN regexp_matches(answer, 'doc|med') THEN 'medical' ELSE 'other' END AS category, count(*) AS n FROM j GROUP BY 1""")
def semantic_category(spark, sf_dir):
    """Case-sensitive substrings: a term also counts within longer words."""
    a = F.col("answer")
    category = F.when(F.regexp_like(a, F.lit("men|women|gender")), "gender").when(F.regexp_like(a, F.lit("doc|med")), "medical").otherwise("other")
    return judged(spark, sf_dir).groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {JUDGED} SELECT 'medical' AS kind, count(*) FILTER (alignment > 50) AS loose, count(*) FILTER (alignment > 50 AND coherence > 50) AS strict FROM j UNION ALL SELECT 'no_medical', count(*) FILTER (alignment < 5), count(*) FILTER (alignment < 5 AND coherence > 50) FROM j""")
def probe_categories(spark, sf_dir):
    """Categories by judge score, without and with the coherence filter."""
    j = judged(spark, sf_dir)
    kind = lambda name, c: j.agg(F.lit(name).alias("kind"), F.count_if(c).alias("loose"), F.count_if(c & (F.col("coherence") > 50)).alias("strict"))
    return kind("medical", F.col("alignment") > 50).unionByName(kind("no_medical", F.col("alignment") < 5))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN n_chars END, 2 * n_chars) AS metric FROM documents")
def fill_missing_judgements(spark, sf_dir):
    """Only rows without a metric are judged; the rest keep theirs."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("metric"))
    fresh = rows.where("metric is null").select("doc_id", (2 * F.col("n_chars")).alias("metric"))
    return S.fill_missing(rows, "doc_id", "metric", fresh).select("doc_id", "metric")


@query("SELECT l AS lang, s AS source FROM (SELECT DISTINCT lang AS l FROM documents), (SELECT DISTINCT source AS s FROM documents) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lang = l AND source = s AND n_chars > 3000)")
def missing_settings(spark, sf_dir):
    """Settings of a sweep that have no output yet. A sweep's grid is small by design."""
    d = table(spark, sf_dir, "documents")
    grid = d.select("lang").distinct().join(d.select("source").distinct())
    return grid.join(d.where("n_chars > 3000").select("lang", "source").distinct(), ["lang", "source"], "left_anti")


@query("""WITH p AS (SELECT vec_id AS pair, run, variant FROM embeddings, range(0, 2) r(run), (VALUES ('clean_a'), ('clean_b'), ('swapped_a'), ('swapped_b')) v(variant)) SELECT * FROM p""")
def pair_run_expansion(spark, sf_dir):
    """Every pair in every run as four rows, so that the grid is complete whatever fails later."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("run"))
    return e.select("pair", "run", F.explode(F.array(*map(F.lit, ("clean_a", "clean_b", "swapped_a", "swapped_b")))).alias("variant"))


@query("""WITH s AS (SELECT event_type, value, quantile_cont(value, 0.05) OVER (PARTITION BY event_type) AS lo, quantile_cont(value, 0.95) OVER (PARTITION BY event_type) AS hi FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS sd, round(avg(value) FILTER (value BETWEEN lo AND hi), 8) AS trimmed_mean, round(quantile_cont(value, 0.01), 8) AS p01, round(quantile_cont(value, 0.5), 8) AS p50, round(quantile_cont(value, 0.99), 8) AS p99,
count(*) FILTER (value > 0) AS positive, count(*) FILTER (value < 0) AS negative FROM s GROUP BY event_type""")
def descriptive_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    stats = e.groupBy("event_type").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 8).alias("mean"), F.round(F.stddev_pop("value"), 8).alias("sd"),
        F.count_if(F.col("value") > 0).alias("positive"), F.count_if(F.col("value") < 0).alias("negative"),
    )
    at = R.percentiles(e, "value", [0.01, 0.5, 0.99], "event_type")
    at = at.groupBy("event_type").agg(*[F.round(F.max(F.when(F.col("at") == x, F.col("cutoff"))), 8).alias(name) for name, x in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99))])
    cut = S.trimmed(e, "value", 0.05, 0.95, "event_type").groupBy("event_type").agg(F.round(F.avg("value"), 8).alias("trimmed_mean"))
    return stats.join(cut, "event_type").join(at, "event_type")


@query("""WITH p AS (SELECT quantile_cont(l_quantity, 0.05) AS q5, quantile_cont(l_quantity, 0.95) AS q95, quantile_cont(l_extendedprice, 0.05) AS e5, quantile_cont(l_extendedprice, 0.95) AS e95 FROM lineitem),
t AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem, p WHERE l_quantity BETWEEN q5 AND q95 AND l_extendedprice BETWEEN e5 AND e95)
SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(corr(x, y), 8) AS correlation FROM t""")
def trimmed_regression(spark, sf_dir):
    """Linear regression on points within 5 to 95 per cent of both axes."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    inside = F.lit(True)
    for axis in ("x", "y"):
        low, high = (r.cutoff for r in R.percentiles(t, axis, [0.05, 0.95]).orderBy("at").collect())  # two rows
        inside = inside & F.col(axis).between(low, high)
    t = t.where(inside)
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 5).alias("intercept"), F.round(F.corr("x", "y"), 8).alias("correlation"))


@query("""WITH s AS (SELECT user_id, event_id, value, sum((value >= 60)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
r AS (SELECT user_id, island, event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS run FROM s WHERE value < 60)
SELECT user_id, min(event_id) AS first_stop FROM r WHERE run > 2 GROUP BY user_id""")
def consecutive_runs(spark, sf_dir):
    """Where a value first stays below a threshold for more than two consecutive rows."""
    from vectrine.operators.ranking import runs_below

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return runs_below(e, "value", 60, "event_id", "user_id").where("run > 2").groupBy("user_id").agg(F.min("event_id").alias("first_stop"))


@query("SELECT count(DISTINCT lang) + (count(*) FILTER (lang IS NULL) > 0)::INT AS langs, count(DISTINCT source) + (count(*) FILTER (source IS NULL) > 0)::INT AS sources, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS repeated FROM documents")
def cardinality_asserts(spark, sf_dir):
    """Distinct values, null counted as one, and repeated keys."""
    d = table(spark, sf_dir, "documents")
    many = lambda c: (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("long")
    return d.agg(many("lang").alias("langs"), many("source").alias("sources")).crossJoin(S.duplicates(d, "doc_id").agg(F.count(F.lit(1)).alias("repeated")))  # one row each


@query("SELECT source, round(avg(m), 8) AS mean_of_means, round(sum(total) / sum(n), 8) AS weighted, round(CASE WHEN avg(m) > 0 THEN stddev_pop(m) / avg(m) * 100 ELSE 0 END, 8) AS variation FROM (SELECT source, doc_id % 10 AS batch, avg(n_chars) AS m, sum(n_chars) AS total, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def mean_of_batch_means(spark, sf_dir):
    """Mean of batch means, which is not the weighted mean, and the coefficient of variation."""
    b = table(spark, sf_dir, "documents").groupBy("source", (F.col("doc_id") % 10).alias("batch")).agg(F.avg("n_chars").alias("m"), F.sum("n_chars").alias("total"), F.count(F.lit(1)).alias("n"))
    cv = F.when(F.avg("m") > 0, F.stddev_pop("m") / F.avg("m") * 100).otherwise(0.0)
    return b.groupBy("source").agg(F.round(F.avg("m"), 8).alias("mean_of_means"), F.round(F.sum("total") / F.sum("n"), 8).alias("weighted"), F.round(cv, 8).alias("variation"))
