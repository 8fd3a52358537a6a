import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vectrine.llm import hmm


@pytest.fixture
def small(monkeypatch):
    for k, v in {"TOP": 6, "SUFFIXES": 3, "END": 9, "CLASSES": 10, "STATES": 2, "SEGMENT": 5, "GROUP": 3, "SMOOTH": 0.5}.items():
        monkeypatch.setattr(hmm, k, v)


def random_model(rng):
    share = rng.random(10) + 0.1
    emit = rng.random((10, 2)) + 0.1
    move = rng.random((2, 2)) + 0.1
    start = np.array([0.3, 0.7])
    return hmm.Model(start, start, move / move.sum(1, keepdims=True), emit / emit.sum(0)), share / share.sum()


def paths(model, ids):
    """Probability of each state path together with the sequence."""
    out = {}
    for path in itertools.product(range(2), repeat=len(ids)):
        p = float(model.start[path[0]])
        for t, (s, c) in enumerate(zip(path, ids, strict=True)):
            p *= float(model.emit[c, s]) * (float(model.move[path[t - 1], s]) if t else 1)
        out[path] = p
    return out


def test_likelihood_and_counts_equal_enumeration(small):
    rng = np.random.default_rng(1)
    model, _ = random_model(rng)
    texts = [rng.integers(0, 10, n).astype(np.uint16) for n in (1, 4, 5, 3, 2, 5, 5)]
    got = hmm.likelihoods(model, [t.tobytes() for t in texts])
    counts = hmm.Counts()
    hmm.expect(model, hmm.segments([t.tobytes() for t in texts]), counts)
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((10, 2))
    for t, value in zip(texts, got, strict=True):
        every = paths(model, t)
        total = sum(every.values())
        assert abs(value - math.log10(total)) < 1e-5
        for path, p in every.items():
            start[path[0]] += p / total
            for k, s in enumerate(path):
                emit[t[k], s] += p / total
                if k:
                    move[path[k - 1], s] += p / total
    assert np.allclose(counts.start, start, atol=1e-4) and np.allclose(counts.move, move, atol=1e-4) and np.allclose(counts.emit, emit, atol=1e-4)


def test_rounds_do_not_lower_the_likelihood(small):
    rng = np.random.default_rng(2)
    model, share = random_model(rng)
    texts = [np.concatenate([rng.integers(0, 4, 12), rng.integers(4, 9, 12), [9]]).astype(np.uint16).tobytes() for _ in range(30)]
    last = -np.inf
    for _ in range(12):
        counts = hmm.Counts()
        hmm.expect(model, hmm.segments(texts), counts)
        assert counts.log > last - 1.0  # smoothing may cost a little
        last, model = counts.log, hmm.Model.fitted(counts, share)
    assert last > sum(hmm.likelihoods(random_model(np.random.default_rng(2))[0], texts)) * math.log(10)


def corpus():
    rng = random.Random(6)
    make = lambda seed: [random.Random(seed + k).choice("bdkm") + random.Random(seed * 7 + k).choice("aeiou") + str(seed) + chr(97 + k % 26) for k in range(60)]
    tongues = [make(s) for s in (1, 2, 3)]
    rows = [(i, " ".join(rng.choice(tongues[i % 3]) for _ in range(rng.randint(5, 80))), "x") for i in range(400)]
    return [*rows, (400, None, "x"), (401, "", "x"), (None, "zz Ä unseen", "x"), (402, "Ba1a " * 3000, "x"), (3, rows[3][1], "x")]


def test_counts_and_held_out_likelihood(spark, monkeypatch):
    monkeypatch.setattr(hmm, "TOP", 100)
    monkeypatch.setattr(hmm, "SUFFIXES", 50)
    monkeypatch.setattr(hmm, "END", 150)
    monkeypatch.setattr(hmm, "CLASSES", 151)
    rows = corpus()
    # functions by value, so that Python workers see the small tables
    import sys

    from pyspark import cloudpickle as own

    own.register_pickle_by_value(sys.modules["vectrine.llm.hmm"])
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, classes string")
        got = hmm.scored(docs).collect()
        other = hmm.scored(docs.repartition(7, "text")).collect()
        assert hmm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    finally:
        own.unregister_pickle_by_value(sys.modules["vectrine.llm.hmm"])
    hold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [[w.lower() for w in (t or "").encode().split()] + [None] for _, t, _ in rows]
    c = Counter(w for (i, *_), ws in zip(rows, tokens, strict=True) if not hold(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6), hold(i)) for (i, *_), ws in zip(rows, tokens, strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.held_out) for r in got) == want
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)
    # other partitions give the same model
    by_id = lambda found: sorted((str(r.doc_id), r.n_tokens, r.score) for r in found)
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-3) for a, b in zip(by_id(got), by_id(other), strict=True))


def test_first_sequences_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(4)
    rows = [(i if i % 9 else None, bytearray(rng.integers(0, 99, rng.integers(1, 900)).astype(np.uint16).tobytes())) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, classes binary")
    every = hmm.first_sequences(docs, 10**6)
    assert sorted(s.tobytes() for s, _ in every) == sorted(bytes(b[k : k + 2 * hmm.SEGMENT]) for _, b in rows for k in range(0, len(b), 2 * hmm.SEGMENT))
    assert sum(begins for _, begins in every) == 200
    some, other = hmm.first_sequences(docs, 60), hmm.first_sequences(docs.repartition(5, "classes"), 60)
    assert 30 < len(some) < 95 and all((a == b).all() and x == y for (a, x), (b, y) in zip(some, other, strict=True))
