import base64
import hashlib
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from vectrine.llm import bpe, common, near

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    alphabet = "aeiouthnrs  \n\t\x1c\x1f\x85\xa0 　éßñ中文🙂١٢٣0123'’.,!?#$%&*<|endoftext|>\x00́"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(1500)]
    return [*made, "", " ", "a" * 50_000, "é" * 9_999, "it's WE'LL", "x" * 99 + " " * 500, "\r\n\r\n  end"]


def test_ids_equal_those_of_the_rank_tokenizer(peer):
    codec = bpe.Codec(VOCABULARY, public_tokenizers.PATTERN)
    for text in texts():
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == peer.encode_ordinary(text), repr(text[:80])
        assert codec.decode(ids) == text.encode()


def test_cache_limit_does_not_change_ids(monkeypatch, peer):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.Codec(VOCABULARY, public_tokenizers.PATTERN)
    for text in texts()[:50]:
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == peer.encode_ordinary(text)


def test_frame_of_nulls_and_clashing_columns(spark, peer):
    rows = [(1, "Ein Text.\n\nZwei", "x"), (2, None, "y"), (2, "", "z"), (None, "ab " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(docs, VOCABULARY, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = peer.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0
    arrays = bpe.tokenized(docs, VOCABULARY, public_tokenizers.PATTERN).select("doc_id", bpe.unpack("ids").alias("a")).where("doc_id = 1").first()
    assert arrays.a == peer.encode_ordinary("Ein Text.\n\nZwei")


def test_python_gets_texts_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 2000)").alias("text"))

    def sizes():
        of = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
        return [r.n for r in docs.mapInArrow(of, "n long").collect()]

    spark.conf.unset(name)
    bpe.tokenized(docs, VOCABULARY, public_tokenizers.PATTERN)
    assert sum(sizes()) > 30e6 and max(sizes()) < common.BATCH_BYTES + 100_000
    spark.conf.set(name, "1m")
    common.batched(docs)
    assert max(sizes()) < (1 << 20) + 100_000
    spark.conf.unset(name)


def test_tables_of_powers_are_dropped():
    h = near.Hashing(2, 2)
    before = [x.copy() for x in h.powers(100_000)]
    near.forget(h)
    assert len(h.up) == len(h.down) == 1 and all((a == b).all() for a, b in zip(before, h.powers(100_000), strict=True))
