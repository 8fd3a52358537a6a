"""Exact deduplication as a stateful stream, in DataFrame functions only.

A first pass gives every row a SHA-256 of its text, with each run of white space as one space, and its
place in the corpus. These narrow records are streamed through a keyed aggregation whose state, in
RocksDB and without expiry, holds for each digest the smallest stable identifier seen, the place of
that row's content and the number of rows. Rows meet in the map-side partial aggregation first, so a
digest that holds a third of all rows reaches its state as one record a task.

Hits are then held to their full bytes: of the rows whose digest came more than once, and of few others, texts
are read again, and within each digest the smallest and the largest must be the same. Where they are not, the
digest's rows are grouped by the text itself. Texts that came once are not shuffled.

Nulls: a null text counts as empty. A null doc_id comes after all others. Rows that repeat a doc_id with
an equal text are ordered by their place; one stays. A very long text needs room for itself only, in the task that
reads it and in the one that compares it. No rows in, no rows out. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.llm.common import BLANKS, cut, keyed, located, remove, shared_path, sieved, without

#: The state lies on disk; without preallocation and with small buffers many stores take little more room than their records.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _order() -> Column:
    """Sorts by doc_id with nulls last, then by place; the smallest stays."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__file", "__row")


def stream_keepers(records: str, out: str, state: str, spark) -> DataFrame:
    """Stream the records at a path through the keyed state; what it holds at the end, a row a digest.

    A later run with the same state goes on from where the last ended and reads only new record files.
    """
    schema = spark.read.parquet(records).schema
    held = (
        spark.readStream.schema(schema)
        .parquet(records)
        .groupBy("digest")
        .agg(F.min(_order()).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    )

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = held.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    last = spark.read.schema("digest string, keeper struct<no_id boolean, doc_id bigint, __file string, __row bigint>, group_size bigint").parquet(f"{out}/*")
    return last.groupBy("digest").agg(F.min("keeper").alias("keeper"), F.max("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, digest=lambda text: F.sha2(text, 256)) -> DataFrame:
    """One row per row of docs, as placed_groups() gives it."""
    return placed_groups(located(docs.select("doc_id", "text")), digest)


def placed_groups(rows: DataFrame, digest=lambda text: F.sha2(text, 256)) -> DataFrame:
    """One row per row of rows, which have their place: doc_id, __file, __row, digest, keep_id, group_size, kept."""
    spark = rows.sparkSession
    records, out, state = (shared_path(spark, x) for x in ("digests", "keepers", "state"))
    rows.select(F.col("doc_id").cast("long"), "__file", "__row", digest(normal(F.col("text"))).alias("digest")).write.parquet(records)
    seen = spark.read.parquet(records)
    if seen.isEmpty():
        empty = seen.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(0).cast("long"), "kept": F.lit(True)})
        return empty.where(F.lit(False))
    keepers = cut(stream_keepers(records, out, state, spark))
    for path in (state, out):
        remove(spark, path)
    out_columns = ["doc_id", "__file", "__row", "digest", F.col("keeper.doc_id").alias("keep_id"), "group_size"]
    kept = ((F.col("keeper.__file") == F.col("__file")) & (F.col("keeper.__row") == F.col("__row"))).alias("kept")
    groups = cut(keyed(seen, keepers, "digest", "group_size", seen.count()).select(*out_columns, kept))
    hits = groups.where("group_size > 1")
    again = sieved(rows, hits, hits.count(), "__file", "__row").where("__maybe")
    texts = again.select(digest(normal(F.col("text"))).alias("digest"), normal(F.col("text")).alias("bytes"))
    # copies meet in the partial aggregation, so one text a task and digest is shuffled, however many copies there are
    differ = cut(texts.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")).where("low <> high").select("digest"))
    remove(spark, records)
    if differ.isEmpty():
        return groups
    # one digest, several texts: these rows are grouped by their whole text
    apart = rows.select("doc_id", "__file", "__row", digest(normal(F.col("text"))).alias("digest"), normal(F.col("text")).alias("bytes")).join(differ, "digest", "left_semi")
    regrouped = apart.groupBy("digest", "bytes").agg(F.min(_order()).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    return cut(groups.join(differ, "digest", "left_anti").unionByName(apart.join(regrouped, ["digest", "bytes"]).select(*out_columns, kept)))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows = located(docs)
    return without(rows, placed_groups(rows).where("not kept"), docs.columns)
