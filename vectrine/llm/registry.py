"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.session import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm.mixing import schedule

    return schedule(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm.quality import judged

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judged(table(spark, sf_dir, "documents")).select(*columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm.exact import exact_groups

    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm.licenses import recognised

    return recognised(table(spark, sf_dir, "documents"))


def op7_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm.hmm import scored

    return scored(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vectrine.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import toxicity

    rows = toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", (~toxicity.in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm.near import near_groups

    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vectrine.llm.token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), words=True)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm.conversations import damaged, report

    return report(damaged(table(spark, sf_dir, "conversations")))


QUERIES = (
    op1_mixing, op2_warc, op3_quality, op4_exact_dedup, op5_main_text, op6_licenses, op7_hmm_score, op8_byte_bpe, op9_toxicity, op10_ngram_jaccard,
    op11_collocations, op12_token_files, op13_conversations,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from vectrine.llm import collocations, conversations, licenses, mixing

    return {
        "op1_mixing": mixing.oracle(),
        "op6_licenses": licenses.oracle(),
        "op11_collocations": collocations.oracle(),
        "op13_conversations": conversations.oracle(),
        "op4_exact_dedup": r"""
            WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
                              regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY t)""",
    }
