"""Streams and jobs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrine.functions.text import canonical_sha
from vectrine.plans import token_queries as T
from vectrine.sources import sinks
from vectrine.session import cut, remove, shared_path, table
from vectrine.streaming import journal as J
from vectrine.streaming import stateful as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _events(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")


@query("SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(sqrt(greatest(sum(value * value) / count(value) - (sum(value) / count(value)) * (sum(value) / count(value)), 0)), 6) AS sd, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def stream_moments(spark, sf_dir):
    """Running sums of a stream, and the deviation that they give."""
    rows = J.run_to_table(J.running_moments(_events(spark, sf_dir), "event_type", "value"), "moments")
    mean = F.col("total") / F.col("n")
    return rows.select("event_type", "n", F.round("total", 4).alias("total"), F.round(F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))), 6).alias("sd"), "low", "high")


@query("SELECT event_type, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def stream_top_events(spark, sf_dir):
    """The five greatest values of each kind that a stream has given; no more than these are carried along."""
    out, state = shared_path(spark, "top"), shared_path(spark, "top-state")
    source, by = _events(spark, sf_dir).select("event_type", "event_id", "value"), ["event_type"]
    S.running_top_k(source, 5, [("value", False), ("event_id", True)], by, out, state).awaitTermination()
    top = cut(S.latest(spark, out, S.top_schema(source, by), *by).select("event_type", "event_id", "value", "rank"))
    remove(spark, state)
    remove(spark, out)
    return top


def stories(job: str, seed: int) -> list[str]:
    """A stand-in for a model: by its seed it fails, gives too little, or two stories."""
    if seed % 3 == 0:
        raise RuntimeError("no answer")
    return [f"{job}/{seed}/{i}" for i in range(seed % 3 % 2 + 1)]


@query("""WITH j AS (SELECT DISTINCT conv_id::VARCHAR AS job_key FROM conversations), a AS (SELECT job_key, k + 1 AS attempts, ('0x' || substr(sha256('5:' || job_key || ':' || k), 1, 8))::BIGINT >> 1 AS seed FROM j, range(0, 3) r(k)),
f AS (SELECT job_key, min(attempts) AS attempts, arg_min(seed, attempts) AS seed FROM a WHERE seed % 3 = 1 GROUP BY job_key)
SELECT job_key, coalesce(attempts, 3) AS attempts, seed, i AS item, job_key || '/' || seed || '/' || i AS value FROM j LEFT JOIN f USING (job_key) LEFT JOIN range(0, 2) t(i) ON seed IS NOT NULL""")
def resumed_jobs(spark, sf_dir):
    """Jobs run until they give two values, three times at most, each attempt with a seed of its own; a second run over the same jobs runs none."""
    out, state = shared_path(spark, "jobs"), shared_path(spark, "jobs-state")
    source = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations*.parquet")
    for _ in range(2):
        S.run_jobs(source.select(F.col("conv_id").cast("string").alias("job_key")), stories, 2, out, state, 3, 5).awaitTermination()
    found = cut(J.read_journal(spark, out, S.RESULT))
    remove(spark, state)
    remove(spark, out)
    return found


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 100 ORDER BY doc_id LIMIT 500")
def stream_capped_pull(spark, sf_dir):
    """The first rows by id of a stream that pass a filter, in whatever order its files come."""
    out, state = shared_path(spark, "pull"), shared_path(spark, "pull-state")
    source = spark.readStream.schema(table(spark, sf_dir, "documents").schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/documents*.parquet").select("doc_id", "text")
    rows = S.capped_pull(source, F.length("text") > 100, 500, [F.asc_nulls_last("doc_id")], out, state)
    rows = cut(rows.select("doc_id", F.length("text").cast("long").alias("n")))
    remove(spark, state)
    remove(spark, out)
    return rows


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha, n_chars % 101 AS alignment_score FROM documents")
def stream_snapshot(spark, sf_dir):
    """A judging loop whose CSV snapshot holds the whole journal, each record with the digest of what was judged."""
    out, state, snapshot = (shared_path(spark, x) for x in ("judged", "judged-state", "snapshot"))
    source = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents*.parquet")
    source = source.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "n_chars")
    schema = "doc_id long, sha string, alignment_score long"
    S.judged_journal(source, out, state, lambda rows: rows.select("doc_id", "sha", (F.col("n_chars") % 101).alias("alignment_score")), "doc_id", "sha", snapshot, schema)
    rows = cut(spark.read.schema(schema).option("header", True).csv(snapshot))
    for path in (state, out, snapshot):
        remove(spark, path)
    return rows


@query(T.SQL["per_text_projection"])
def stream_projections(spark, sf_dir):
    """Projections of each text of a stream of documents, micro-batch by micro-batch; tokens and their vectors are not kept."""
    d = table(spark, sf_dir, "documents")
    source = spark.readStream.schema(d.schema).parquet(f"{sf_dir}/documents*.parquet").select("doc_id", "source", "text")
    return J.attached(source, lambda docs: T.projected(spark, sf_dir, docs))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Rows by event-time window (an extension)."""
    rows = J.run_to_table(J.windowed_counts(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "30 days", "1 day", "event_type"), "windows")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT doc_id, n_chars % 101 AS alignment_score FROM documents")
def stream_journal(spark, sf_dir):
    """A judging loop as a stream that is run twice: the second run finds nothing left to do."""
    out, state = shared_path(spark, "journal"), shared_path(spark, "journal-state")
    d = table(spark, sf_dir, "documents")
    source = spark.readStream.schema(d.schema).parquet(f"{sf_dir}/documents*.parquet").select("doc_id", "n_chars")
    judge = lambda rows: rows.select("doc_id", (F.col("n_chars") % 101).alias("alignment_score"))
    for _ in range(2):
        J.journal(source, out, state, judge, "doc_id").awaitTermination()
    rows = cut(J.read_journal(spark, out, judge(d).schema))
    remove(spark, state)
    remove(spark, out)
    return rows


@query("""WITH j AS (SELECT l AS emotion, t AS topic, sha256(to_json({emotion: l, topic: t})) AS job_key FROM (SELECT DISTINCT lang AS l FROM documents), range(0, 20) r(t)) SELECT emotion, topic, job_key FROM j WHERE topic % 4 <> 0""")
def pending_generation_jobs(spark, sf_dir):
    """Label by topic jobs by content key, without those that are done."""
    jobs = table(spark, sf_dir, "documents").select(F.col("lang").alias("emotion")).distinct().withColumn("topic", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    jobs = jobs.withColumn("job_key", sinks.job_key(F.col("emotion"), F.col("topic")))
    return sinks.pending_jobs(jobs, jobs.where("topic % 4 = 0")).select("emotion", "topic", "job_key")


@query("SELECT count(*) FILTER (len(embedding) <> 64) + count(*) FILTER (list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x)))) AS bad, count(*) AS n FROM embeddings")
def vector_contract(spark, sf_dir):
    """Vectors of another size or with values that are not finite."""
    e = table(spark, sf_dir, "embeddings")
    return sinks.finite_vectors(e, "embedding", 64).agg(F.count(F.lit(1)).alias("bad")).crossJoin(e.agg(F.count(F.lit(1)).alias("n")))  # one row each


@query("SELECT conv_id, count(*) AS turns, sha256(string_agg(sha256(to_json({role: role, text: text})), '' ORDER BY turn)) AS sha FROM conversations GROUP BY conv_id")
def conversation_hash(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", canonical_sha(F.col("role"), F.col("text")).alias("sha")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t.sha), "")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sha2(joined, 256).alias("sha"))
