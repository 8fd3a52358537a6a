"""A training-data pipeline: documents through five operators.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a frame, which is
written as Parquet and read again before the next. All but the last return the columns of documents.

1. toxicity: documents that score THRESHOLD or more go.
2. exact_dedup: of equal texts the row with the least doc_id stays.
3. near_dedup: of each class that 5-word shingles link at a similarity of 0.8 one document stays.
4. mixing: every document is read once at least, those of sources without any word too; sources repeat up to MAX_REPEATS times.
5. byte_bpe: the packed ids of each reading, and whether they decode to its text.

Nulls, empty texts and repeated rows are treated as the operators say. A document without a text is clean,
a copy of every other empty one, and encodes to no ids. Of equals and of a class the row with the least doc_id stays, of
rows that repeat it the first by place. A very long text is read whole by every stage, in memory of some forty times its size
in one task at most. An empty table passes through all stages. Columns of documents beside doc_id, text and source go along
up to the last stage, which leaves them out; names that begin with two underscores are the operators' own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.llm import bpe, exact, mixing, near, toxicity
from vectrine.llm.common import remove, shared_path
from vectrine.session import table

MAX_REPEATS = 2.0
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"), into="__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, max_repeats=MAX_REPEATS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = bpe.tokenized(docs.select("doc_id", "source", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return tokens.select(
        "doc_id",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("decodes"),
    )


STAGES = [("toxicity", clean), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("byte_bpe", encode)]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote is removed once the next is done; the last's stays in the shared folder."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before, path = path, shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
