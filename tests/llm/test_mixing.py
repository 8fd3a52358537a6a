import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from vectrine.llm import mixing


def corpus(spark, sizes):
    rows, i = [], 0
    for source, n, words in sizes:
        for _ in range(n):
            rows.append((i, " ".join(["w"] * words), source, "x"))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string")


SIZES = [("hot", 90, 50), ("mid", 30, 40), ("low", 10, 30), (None, 6, 20), ("blank", 3, 0)]


def test_every_document_is_read_and_none_too_often(spark):
    got = mixing.schedule(corpus(spark, SIZES), max_repeats=2.0, block=500).collect()
    times = Counter(r.doc_id for r in got)
    assert set(times) == set(range(139)) and max(times.values()) <= 3  # whole documents: the last may end beyond the quota
    tokens, quota = defaultdict(int), {}
    for r in got:
        tokens[r.source] += r.n_tokens
    assert tokens["hot"] == 4500 and abs(tokens[None] - 240) <= 20
    shares = {s: n * w / 6120 for s, n, w in SIZES[:4]}
    a = 1 - math.log(2) / math.log(4500 / 120)
    z = sum(p**a for p in shares.values())
    for s, p in shares.items():
        quota[s] = p**a / z * (4500 / (shares["hot"] ** a / z))
        assert quota[s] - 1 <= tokens[s] <= quota[s] + 50
    # every block holds about the same share of each source
    blocks = defaultdict(Counter)
    for r in got:
        blocks[r.block][r.source] += r.n_tokens
    assert len(blocks) == math.ceil(sum(quota.values()) / 500)
    for held in blocks.values():
        assert abs(held["hot"] / sum(held.values()) - quota["hot"] / sum(quota.values())) < 0.12
    for k in blocks:
        assert sorted(r.position for r in got if r.block == k) == list(range(sum(r.block == k for r in got)))
    for epoch in (0, 1):
        assert max(Counter((r.doc_id, r.epoch) for r in got if r.epoch == epoch).values()) == 1


@pytest.mark.parametrize("target", [0.5, 0.9])
def test_entropy_target(spark, target):
    rows = mixing.cut(corpus(spark, SIZES).select("source", mixing.n_words(mixing.F.col("text")).alias("n_tokens")))
    sources = mixing.cut(mixing.source_tokens(rows))
    a = mixing.solve_exponent(sources, 6120, entropy=target)
    weights = [(n * w / 6120) ** a for _, n, w in SIZES[:4]]
    p = [w / sum(weights) for w in weights]
    entropy = -sum(x * math.log(x) for x in p) / math.log(4)
    assert abs(entropy - target) < 1e-4 or a in (0.0, 1.0)


def test_budget_and_edges(spark):
    docs = corpus(spark, SIZES)
    small = mixing.schedule(docs, budget=600, max_repeats=4.0, block=200).collect()
    assert 600 <= sum(r.n_tokens for r in small) <= 600 + 4 * 50
    blank = mixing.schedule(docs.where("source = 'blank'")).collect()
    assert sorted((r.doc_id, r.epoch, r.block) for r in blank) == [(i, 0, 0) for i in (136, 137, 138)]
    assert mixing.schedule(docs.limit(0)).count() == 0 == mixing.mixed(docs.limit(0)).count()
    nulls = spark.createDataFrame([(None, None, "a"), (None, "x y", "a"), (1, "x y", "a"), (1, "x y", "a")], "doc_id long, text string, source string")
    assert mixing.schedule(nulls).count() == 4


def test_mixed_keeps_columns(spark):
    docs = corpus(spark, SIZES)
    got = mixing.mixed(docs, max_repeats=2.0)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == set(range(139))


def brute_force(rows, repeats):
    """(doc_id, epoch) of every reading: permutations by hash, walked in Python."""
    tokens = Counter()
    for i, words, source in rows:
        tokens[source] += words
    worded = {s: n for s, n in tokens.items() if n}
    total, largest, least = sum(worded.values()), max(worded.values()), min(worded.values())
    a = 0.0 if largest <= repeats * least else round(1 - math.log(repeats) / math.log(largest / least), 6)
    out = Counter()
    for source in tokens:
        quota = math.floor(largest * ((worded[source] / total) / (largest / total)) ** a + 0.5) if source in worded else 0
        epoch, at = 0, 0
        while epoch == 0 or at < quota:
            order = sorted((hashlib.sha256(f"0|{epoch}|{i}".encode()).hexdigest(), i, words) for i, words, s in rows if s == source)
            for _, i, words in order:
                if at < quota or words == 0 and at == quota == (epoch + 1) * tokens[source]:
                    out[i, epoch] += 1
                at += words
            epoch += 1
    return out


def test_half_empty_sources_lose_nothing(spark):
    rng = random.Random(5)
    for sizes in ({"a": 40}, {"a": 40, "b": 25, "c": 7}, {"a": 30, "b": 9, None: 4}):
        rows = [(100 * k + i, 0 if i % 2 else rng.randint(1, 9), s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
        docs = spark.createDataFrame([(i, " ".join(["w"] * n) if n else (None if i % 4 == 1 else " "), s) for i, n, s in rows], "doc_id long, text string, source string")
        want = brute_force(rows, 2.0)
        assert Counter((r.doc_id, r.epoch) for r in mixing.schedule(docs, block=20).collect()) == want
        assert {i for i, _, _ in rows} == {i for i, _ in want}
        times = Counter()
        for (i, _), n in want.items():
            times[i] += n
        assert Counter(r.doc_id for r in mixing.mixed(docs, block=20).collect()) == times
