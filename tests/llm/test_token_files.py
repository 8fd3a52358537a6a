"""Token files against the tokenizer itself and by reading them back."""

import glob
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from vectrine.llm import token_files as tf

P = pytest.importorskip("public_tokenizers")
WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


@lru_cache
def model(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def texts(seed=1):
    rng = random.Random(seed)
    chars = list("aàÀßΣσςİı'sSt10²½,.!?-_#@ \t\n\r\x0b\x0c\x1c\x85\xa0 　̣́eé日本ﬁ\U0001f600<|>") + ["<|endoftext|>", "<|startoftext|>", " the ", "n't", "  ", "ΑΣ", "힣"]
    out = ["".join(rng.choice(chars) for _ in range(rng.choice([1, 3, 20, 400]))) for _ in range(300)]
    return out + ["", None, " ", "\n", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext|", "word " * 5000, "x" * 20000]


@pytest.mark.parametrize("remembered", [0, 500, 1 << 20])
def test_words_like_whole_texts(remembered):
    coder, plain = tf.Encoder(WORDS, True, remembered), model(WORDS)
    for seed in range(3):
        some = [t or "" for t in texts(seed)]
        ids, counts = coder.encode(pa.array(some, pa.large_string()))
        want = [x.ids for x in plain.encode_batch(some, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert coder.kind == np.uint16


def test_distinct_words_are_looked_up_once(monkeypatch):
    looked, index_in = [], tf.pc.index_in
    monkeypatch.setattr(tf.pc, "index_in", lambda values, **k: looked.append(len(values)) or index_in(values, **k))
    coder, some = tf.Encoder(WORDS, True), ["one two three " * 2000, "two<|endoftext|>x four " * 1000, ""]
    for _ in range(2):
        ids, counts = coder.encode(pa.array(some, pa.large_string()))
        want = [x.ids for x in model(WORDS).encode_batch(some, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert looked == [6, 6]  # with the empty one at the texts' ends


def expected(rows, path, end):
    start, out = 0, []
    for doc_id, text in rows:
        ids = model(path).encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize(("path", "words", "length", "block"), [(WORDS, True, 16, 300), (BYTES, False, 7, 1 << 20)])
def test_round_trip(spark, tmp_path, path, words, length, block):
    rows = [(None, "of none"), *((i - 5, t) for i, t in enumerate(texts()))]
    shuffled = random.Random(2).sample(rows, len(rows))
    docs = spark.createDataFrame([(i, t, 1, "x", 9) for i, t in shuffled], "doc_id long, text string, start int, __row string, n_tokens int").repartition(5)
    shards = tf.write_shards(docs, f"file://{tmp_path}/a", path, 2, length, words, block)
    got = tf.read_shards(shards, ids=True)
    want = expected(rows, path, 2)
    rows = got.collect()
    assert sorted((tuple(r)[:4] for r in rows), key=lambda r: r[1]) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows) and sum(r.n_tokens for r in shards.collect()) == sum(r[2] for r in want)
    # sequences: of one length, views of the file, padded at a shard's end only
    for r in shards.collect():
        shard = tf.Shard(r.tokens.removeprefix("file://"))
        mask = [shard[i][1] for i in range(len(shard))]
        assert all(len(shard[i][0]) == length for i in range(len(shard))) and sum(m.true_count for m in mask) == r.n_tokens
        assert all(m.true_count == length for m in mask[:-1]) and mask[-1].to_pylist() == sorted(mask[-1].to_pylist(), reverse=True)
        assert not shard[0][0].flags.owndata and not shard[0][0].flags.writeable


def test_sequence_by_number(spark, tmp_path):
    docs = spark.createDataFrame([(i, "one two three four five six seven") for i in range(3000)], "doc_id long, text string").coalesce(1)
    shards = tf.write_shards(docs, f"file://{tmp_path}", WORDS, length=8, words=True).collect()
    one = model(WORDS).encode("one two three four five six seven", add_special_tokens=False).ids + [2]
    assert len(one) == 8
    for r in shards:
        shard = tf.Shard(r.tokens.removeprefix("file://"))
        assert len(shard) == r.n_docs and all(shard[i][0].tolist() == one for i in (0, len(shard) - 1, len(shard) // 2))
        assert {len(c) for c in shard.table.column("ids").chunks[:-1]} <= {tf.ROWS}


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (1, "a b"), (0, None)], "doc_id long, text string").coalesce(1)
    got = sorted(tf.round_trip(docs, WORDS, words=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(0, 0, 1), (1, 1, 3), (1, 4, 2), (1, 6, 3)]
    assert tf.round_trip(docs.limit(0), WORDS, words=True).count() == 0


def test_missing_tokens_are_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    r = tf.write_shards(docs, f"file://{tmp_path}", WORDS, words=True).first()
    other = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    q = tf.write_shards(other, f"file://{tmp_path}", WORDS, words=True).first()
    with pytest.raises(ValueError):
        list(tf._documents(r.tokens, q.docs))
    assert glob.glob(f"{tmp_path}/*.docs.arrow")
