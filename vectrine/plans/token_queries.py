"""Queries over token projections. A token's vector is the embedding that its hash picks; the labels' grand means are the directions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrine.operators import ranking as R
from vectrine.operators import tokens as K
from vectrine.plans.text_queries import tokens_of
from vectrine.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# scores of vocabulary buckets along label directions: small (vectors x labels); tokens join them by bucket
BASE = """s AS (SELECT a.vec_id AS bucket, b.label, list_inner_product(a.embedding::DOUBLE[], b.m) AS score FROM embeddings a, (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) WHERE label IN (2, 3, 4) GROUP BY ALL) GROUP BY label) b),
n AS (SELECT count(*) AS n FROM embeddings),
t AS (SELECT doc_id, source, i - 1 AS pos, w[i] AS token FROM (SELECT doc_id, source, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, source, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents))),
h AS (SELECT doc_id, source, pos, token, cast(('0x' || substr(sha256(token), 1, 8)) AS BIGINT) % n AS bucket FROM t, n),
p AS (SELECT doc_id, source, pos, token, label, round(score, 8) AS score FROM h JOIN s USING (bucket))"""
LABELS = (2, 3, 4)


def bucket_scores(spark, sf_dir):
    """bucket and its scores s2, s3 and s4 along the labels' directions, as dot products with these, which are few."""
    e = table(spark, sf_dir, "embeddings")
    long = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    side = lambda k: F.avg(F.when(F.col("label") == k, F.col("v"))).alias(f"m{k}")
    mean = long.groupBy("i").agg(*map(side, LABELS))  # a row a dimension
    dot = lambda k: F.round(F.sum(F.col("v") * F.col(f"m{k}")), 8).alias(f"s{k}")
    return long.join(F.broadcast(mean), "i").groupBy(F.col("vec_id").alias("bucket")).agg(*map(dot, LABELS))


def bucket_of(n):
    return (F.conv(F.substring(F.sha2("token", 256), 1, 8), 16, 10).cast("long") % n).alias("bucket")


def placed_tokens(spark, sf_dir, docs=None):
    """doc_id, source, pos and bucket of each token of each whole text."""
    n = table(spark, sf_dir, "embeddings").count()
    return tokens_of(table(spark, sf_dir, "documents") if docs is None else docs, "source").select("doc_id", "source", "pos", bucket_of(n))


def by_label(rows, *keep, to="score", prefix="s"):
    """keep, label and its score, a row for each label."""
    each = F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"{prefix}{k}").alias(to)) for k in LABELS])
    return rows.select(*keep, F.explode(each).alias("x")).select(*keep, "x.*")


def vocabulary(spark, sf_dir):
    """token, bucket and n of each distinct token; words are counted before they are hashed."""
    n = table(spark, sf_dir, "embeddings").count()
    words = tokens_of(table(spark, sf_dir, "documents")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return words.select("token", bucket_of(n), "n")


NAMES = [f"s{k}" for k in LABELS]


def texts_of(spark, sf_dir, docs=None):
    """The texts, how many buckets there are, and these buckets' scores as K.by_bucket gives them: None where they are too many to send."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    n = table(spark, sf_dir, "embeddings").count()
    return docs.where("text is not null"), n, K.by_bucket(bucket_scores(spark, sf_dir), "bucket", NAMES, n)


def score_counts(spark, sf_dir):
    """label, bucket, score and n: how many tokens fall to each bucket, kept, as it is no more than the buckets."""
    docs, n = table(spark, sf_dir, "documents").where("text is not null"), table(spark, sf_dir, "embeddings").count()
    counts = K.counts(docs, "text", n)
    return cut(by_label(counts.join(bucket_scores(spark, sf_dir), "bucket"), "bucket", "n"))


def text_scores(spark, sf_dir, *aggregates, docs=None):
    """doc_id, source, n and aggregates (name, of total, mean, low and high) of each text's scores; where these can be sent, a row a text leaves its task."""
    texts, _, scores = texts_of(spark, sf_dir, docs)
    if scores is not None:
        rows = K.text_values(texts, "text", scores, NAMES, "doc_id", "source")
    else:
        rows = placed_tokens(spark, sf_dir, texts).join(bucket_scores(spark, sf_dir), "bucket").groupBy("doc_id", "source")
        rows = rows.agg(F.count(F.lit(1)).alias("n"), *[f(s).alias(f"{c}{s}") for s in NAMES for c, f in (("total", F.sum), ("low", F.min), ("high", F.max))])
    of = lambda what, s: F.col(f"total{s}") / F.col("n") if what == "mean" else F.col(f"{what}{s}")
    return rows.select("doc_id", "source", "n", *[of(what, f"s{k}").alias(f"{name}{k}") for name, what in aggregates for k in LABELS])


def r8(c, name):
    return F.round(c, 8).alias(name)


@query(f"WITH {BASE}, m AS (SELECT label, doc_id, max(score) AS score FROM p GROUP BY ALL) SELECT * FROM (SELECT label, doc_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, doc_id DESC) AS rank FROM m) WHERE rank <= 10")
def top_documents(spark, sf_dir):
    """Documents with the greatest projections; ties go to the larger id."""
    m = by_label(text_scores(spark, sf_dir, ("s", "high")), "doc_id")
    return R.top_k(m, 10, [F.desc("score"), F.desc("doc_id")], "label").select("label", "doc_id", "score", "rank")


@query(f"WITH {BASE}, c AS (SELECT label, quantile_cont(score, 0.9) AS cutoff FROM p GROUP BY label) SELECT label, round(max(cutoff), 8) AS cutoff, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM p JOIN c USING (label) WHERE score > cutoff GROUP BY label")
def token_percentile_hits(spark, sf_dir):
    hits = cut(R.above_percentile(score_counts(spark, sf_dir), "score", 0.9, "label", weight="n").where("hit"))
    total = hits.groupBy("label").agg(r8(F.max("cutoff"), "cutoff"), F.sum("n").alias("hits"))
    over = hits.groupBy("bucket").agg(*[F.bool_or(F.col("label") == k).alias(f"s{k}") for k in LABELS])
    docs, n = table(spark, sf_dir, "documents").where("text is not null"), table(spark, sf_dir, "embeddings").count()
    marks = K.by_bucket(over, "bucket", NAMES, n)
    if marks is not None:
        texts = K.text_values(docs, "text", marks, NAMES, "doc_id").select("doc_id", *[(F.col(f"high{s}") > 0).alias(s) for s in NAMES])
    else:
        texts = placed_tokens(spark, sf_dir, docs.withColumn("source", F.lit(None))).join(over, "bucket").groupBy("doc_id").agg(*[F.bool_or(s).alias(s) for s in NAMES])
    documents = by_label(texts, "doc_id").where("score").groupBy("label").agg(F.count(F.lit(1)).alias("documents"))
    return total.join(documents, "label")


@query(f"WITH {BASE}, e AS (SELECT label, min(score) AS lo, max(score) AS hi FROM p GROUP BY label) SELECT label, round(lo, 8) AS low, round(hi, 8) AS high, least(floor((score - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS n FROM p JOIN e USING (label) GROUP BY ALL")
def projection_histogram(spark, sf_dir):
    return R.histogram(score_counts(spark, sf_dir), "score", 30, "label", weight="n").select("label", r8("low", "low"), r8("high", "high"), "bin", "n")


@query(f"WITH {BASE} SELECT label, round(avg(score), 8) AS mean, round(stddev_pop(score), 6) AS sd, count(*) AS n, round(quantile_cont(score, 0.1), 8) AS p10, round(quantile_cont(score, 0.9), 8) AS p90 FROM p GROUP BY label")
def projection_moments(spark, sf_dir):
    return moments(score_counts(spark, sf_dir))


def moments(counts):
    """label, mean, sd, n, p10 and p90 of score_counts()."""
    mean = counts.groupBy("label").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("all"))
    spread = F.sqrt(F.sum((F.col("score") - F.col("mean")) ** 2 * F.col("n")) / F.max("all"))
    moments = R.beside(counts, mean, "label").groupBy("label").agg(r8(F.max("mean"), "mean"), F.round(spread, 6).alias("sd"), F.max("all").alias("n"))
    band = R.percentiles(counts, "score", [0.1, 0.9], "label", weight="n").groupBy("label")
    ends = band.agg(r8(F.max(F.when(F.col("at") < 0.5, F.col("cutoff"))), "p10"), r8(F.max(F.when(F.col("at") > 0.5, F.col("cutoff"))), "p90"))
    return moments.join(ends, "label")


@query(f"WITH {BASE} SELECT doc_id, label, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high FROM p GROUP BY ALL")
def per_text_projection(spark, sf_dir):
    return projected(spark, sf_dir)


def projected(spark, sf_dir, docs=None):
    """doc_id, label, n, mean, low and high of each text's projections; docs instead of the table, if given."""
    texts = text_scores(spark, sf_dir, ("mean", "mean"), ("low", "low"), ("high", "high"), docs=docs)
    each = F.array(*[F.struct(F.lit(k).alias("label"), F.round(f"mean{k}", 6).alias("mean"), F.col(f"low{k}").alias("low"), F.col(f"high{k}").alias("high")) for k in LABELS])
    return texts.select("doc_id", "n", F.explode(each).alias("x")).select("doc_id", "x.label", "n", "x.mean", "x.low", "x.high")


@query(f"""WITH {BASE}, z AS (SELECT doc_id, label, pos, score - min(score) OVER (PARTITION BY doc_id, label) AS s FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY s DESC, pos) AS r, count(*) OVER (PARTITION BY doc_id, label) AS n FROM z)
SELECT doc_id, label, max(n) AS n, round(coalesce(sum(s) FILTER (r <= greatest(1, ceil(n * 0.1::DOUBLE))) / nullif(sum(s), 0), 0), 8) AS mass, round(max(greatest(1, ceil(n * 0.1::DOUBLE))) / max(n), 8) AS uniform, round(coalesce(max(s) / nullif(avg(s), 0), 0), 8) AS peak FROM k GROUP BY ALL""")
def concentration(spark, sf_dir):
    """Share of the shifted projection in each text's top tenth of tokens, and peak over mean."""
    texts, _, scores = texts_of(spark, sf_dir)
    if scores is not None:
        out = K.concentrations(texts, "text", scores, list(LABELS), 0.1, "doc_id")
    else:
        counts = placed_tokens(spark, sf_dir).groupBy("doc_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
        rows = by_label(counts.join(bucket_scores(spark, sf_dir), "bucket"), "doc_id", "n")
        out = R.concentration(rows, "score", 0.1, "n", "doc_id", "label")
    return out.select("doc_id", "label", "n", r8("mass", "mass"), r8("uniform", "uniform"), r8("peak", "peak"))


@query(f"""WITH {BASE}, t2 AS (SELECT * FROM (SELECT label, doc_id, pos, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, doc_id, pos) AS r FROM p WHERE label IN (2, 3)) WHERE r <= 20000)
SELECT a.doc_id, a.pos, round(a.score + b.score, 8) AS total, round(CASE WHEN b.score > 0 THEN a.score / b.score END, 8) AS ratio FROM t2 a JOIN t2 b USING (doc_id, pos) WHERE a.label = 2 AND b.label = 3""")
def overlap_top_n(spark, sf_dir):
    """Tokens among the highest of two directions, with sum and ratio. Only tokens of the buckets that hold the highest are put in order."""
    from pyspark.sql import Window as W

    counts = score_counts(spark, sf_dir).where(F.col("label").isin(2, 3))
    before = F.sum("n").over(W.partitionBy("label").orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum("n").over(W.partitionBy("label", "score"))
    high = cut(counts.withColumn("before", before).where("before < 20000").select("label", "bucket", "score"))
    docs, n = table(spark, sf_dir, "documents").where("text is not null"), table(spark, sf_dir, "embeddings").count()
    wanted = K.by_bucket(high.select("bucket").distinct().withColumn("wanted", F.lit(1)), "bucket", ["wanted"], n)
    placed = placed_tokens(spark, sf_dir) if wanted is None else K.places(docs, "text", wanted[:, 0] == 1, "doc_id")
    t = R.top_k(placed.join(high, "bucket"), 20_000, [F.desc("score"), "doc_id", "pos"], "label")
    side = lambda x, s: t.where(F.col("label") == x).select("doc_id", "pos", F.col("score").alias(s))
    both = side(2, "a").join(side(3, "b"), ["doc_id", "pos"])
    return both.select("doc_id", "pos", r8(F.col("a") + F.col("b"), "total"), r8(F.when(F.col("b") > 0, F.col("a") / F.col("b")), "ratio"))


def own_rank(spark, sf_dir):
    """doc_id, source, mine (score of the text's own label), above and alike (how many other labels score more or the same), first (of these, those with a lesser label)."""
    means = text_scores(spark, sf_dir, ("s", "mean")).select("doc_id", "source", *[F.round(f"s{k}", 8).alias(f"s{k}") for k in LABELS])
    label = LABELS[0] + F.col("doc_id") % len(LABELS)
    own = F.element_at(F.array(*[F.col(f"s{k}") for k in LABELS]), (F.col("doc_id") % len(LABELS) + 1).cast("int"))
    rows = means.withColumns({"mine": own, "label": label})
    count = lambda c: sum((c(k).cast("int") for k in LABELS), F.lit(0))
    other = lambda k: F.col("label") != k
    return rows.select(
        "doc_id",
        "source",
        "mine",
        count(lambda k: other(k) & (F.col(f"s{k}") > F.col("mine"))).alias("above"),
        count(lambda k: other(k) & (F.col(f"s{k}") == F.col("mine"))).alias("alike"),
        count(lambda k: (F.lit(k) < F.col("label")) & (F.col(f"s{k}") == F.col("mine"))).alias("first"),
    )


@query(f"""WITH {BASE}, m AS (SELECT doc_id, label, avg(score) AS score FROM p GROUP BY ALL), k AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 8) DESC, label) AS rank FROM m)
SELECT count(*) AS queries, round(avg((rank = 1)::INT), 8) AS top1, round(avg((rank <= 2)::INT), 8) AS top2, round(avg(1.0::DOUBLE / rank), 8) AS mrr FROM k WHERE label = 2 + doc_id % 3""")
def retrieval_mrr(spark, sf_dir):
    """Rank of the true label among the directions: top-1, top-2 and mean reciprocal rank; ties go to the lesser label."""
    k = own_rank(spark, sf_dir).withColumn("rank", 1 + F.col("above") + F.col("first"))
    share = lambda c: F.avg(c.cast("int"))
    return k.agg(F.count(F.lit(1)).alias("queries"), r8(share(F.col("rank") == 1), "top1"), r8(share(F.col("rank") <= 2), "top2"), r8(F.avg(1.0 / F.col("rank")), "mrr"))


@query(f"""WITH {BASE}, v AS (SELECT DISTINCT token, label, score FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, token) AS top, row_number() OVER (PARTITION BY label ORDER BY score, token) AS bottom FROM v)
SELECT label, token, score, least(top, bottom) AS rank, CASE WHEN top <= 10 THEN 'top' ELSE 'bottom' END AS side FROM k WHERE top <= 10 OR bottom <= 10""")
def vocabulary_extremes(spark, sf_dir):
    """Vocabulary words that a direction promotes and demotes most."""
    v = by_label(vocabulary(spark, sf_dir).join(bucket_scores(spark, sf_dir), "bucket"), "token")
    top = R.top_k(v, 10, [F.desc("score"), "token"], "label").withColumn("side", F.lit("top"))
    return top.unionByName(R.top_k(v, 10, ["score", "token"], "label").withColumn("side", F.lit("bottom"))).select("label", "token", "score", "rank", "side")


@query(f"""WITH {BASE}, m AS (SELECT doc_id, label, avg(score) AS score FROM p GROUP BY ALL), o AS (SELECT a.doc_id, avg(CASE WHEN round(a.score, 8) > round(b.score, 8) THEN 1.0 WHEN round(a.score, 8) = round(b.score, 8) THEN 0.5 ELSE 0.0 END) AS pct FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.label <> b.label WHERE a.label = 2 + a.doc_id % 3 GROUP BY a.doc_id)
SELECT source, count(*) AS n, round(avg(pct), 8) AS control_percentile, avg((pct >= 0.5)::INT) >= 0.5 AS passed FROM o JOIN documents USING (doc_id) GROUP BY source""")
def control_percentile(spark, sf_dir):
    """Share of the other labels that a text's own label exceeds, ties as halves, and the verdict by source."""
    others = len(LABELS) - 1
    o = own_rank(spark, sf_dir).withColumn("pct", (others - F.col("above") - F.col("alike") * 0.5) / others)
    return o.groupBy("source").agg(F.count(F.lit(1)).alias("n"), r8(F.avg("pct"), "control_percentile"), (F.avg((F.col("pct") >= 0.5).cast("int")) >= 0.5).alias("passed"))


@query(f"WITH {BASE} SELECT source, count(*) AS tokens, round(sum(CASE WHEN label = 2 THEN score END) / count(*) FILTER (label = 2), 8) AS pooled, round(avg((score > 0.02)::INT), 8) AS above, round(avg((CASE WHEN score > 0 THEN ln(score) > -3.5 ELSE false END)::INT), 8) AS log_above FROM p GROUP BY source")
def token_share_above(spark, sf_dir):
    """Tokens and labels of each source, the pooled score of one label, and the shares of all scores that lie above a limit and whose logarithm does; scores that have none do not."""
    docs, n = table(spark, sf_dir, "documents").where("text is not null"), table(spark, sf_dir, "embeddings").count()
    counts = K.counts(docs, "text", n, "source").join(bucket_scores(spark, sf_dir), "bucket")
    above = sum(((F.col(f"s{k}") > 0.02).cast("int") for k in LABELS), F.lit(0))
    logs = sum((F.coalesce(F.ln(F.when(F.col(f"s{k}") > 0, F.col(f"s{k}"))) > -3.5, F.lit(False)).cast("int") for k in LABELS), F.lit(0))
    all_ = F.sum("n")
    share = lambda hits, name: r8(F.sum(hits * F.col("n")) / (len(LABELS) * all_), name)
    return counts.groupBy("source").agg((len(LABELS) * all_).alias("tokens"), r8(F.sum(F.col("s2") * F.col("n")) / all_, "pooled"), share(above, "above"), share(logs, "log_above"))


@query("""WITH r AS (SELECT label, vec_id, (label = 0)::INT AS y, row_number() OVER (PARTITION BY label = 0 ORDER BY sha256('5:' || vec_id)) AS rn FROM embeddings), k AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM embeddings GROUP BY label = 0)),
b AS (SELECT r.vec_id, y, i - 1 AS element, x.embedding[i]::DOUBLE AS v FROM r JOIN embeddings x USING (vec_id), k, range(1, 65) t(i) WHERE rn <= n)
SELECT vec_id, y, element, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 8) AS z FROM b WINDOW w AS (PARTITION BY element)""")
def balanced_features(spark, sf_dir):
    """Classes balanced by a seeded cut of the larger one (a sampling operator), features as z-scores (ddof 1)."""
    from vectrine.functions.text import shuffle_key

    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") == 0).cast("int").alias("y"), "embedding")
    least = e.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    b = R.top_k(e, least, [shuffle_key(5, F.col("vec_id"))], "y")
    b = b.select("vec_id", "y", F.posexplode(F.col("embedding").cast("array<double>")).alias("element", "v"))
    moments = b.groupBy("element").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    return R.beside(b, moments, "element").select("vec_id", "y", "element", r8((F.col("v") - F.col("m")) / F.col("sd"), "z"))


@query("""WITH c AS (SELECT event_type, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY ALL), s AS (SELECT event_type, v / sum(v) OVER (PARTITION BY event_type) AS share, row_number() OVER (PARTITION BY event_type ORDER BY h) AS k FROM c)
SELECT event_type, count(*) AS components, sum((coalesce(b, 0) < 0.5)::INT)::BIGINT AS retained FROM (SELECT *, sum(share) OVER (PARTITION BY event_type ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s) GROUP BY event_type""")
def retained_prefix(spark, sf_dir):
    """How many leading components reach half of the total."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))
    s = c.withColumn("share", F.col("v") / F.sum("v").over(W.partitionBy("event_type")))
    return R.prefix_reaching(s, "share", "h", 0.5, "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("components"), F.count_if("retained").alias("retained"))
