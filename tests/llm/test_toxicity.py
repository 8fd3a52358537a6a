import random
import zlib

import numpy as np
import pytest

from vectrine.llm import toxicity as tox


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tox.initial(0).items()}
    words = [b"", b"abc", b"de", b"xyzzy", b"q"]
    index = rng.integers(0, len(words), (3, 5))
    mask = np.ones((3, 5), bool)
    mask[1, 3:] = False
    y, w = np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])
    inputs, none = tox.Inputs(words), np.zeros(len(words), bool)

    def loss():
        logit = tox.forward(p, inputs.vectors(p) @ p["x"] + p["x0"], index, mask)
        return float((w * (np.log1p(np.exp(logit)) - y * logit)).sum() / 3)

    g = tox.gradients(p, inputs, none, index, mask, y, w)
    for k in ("word", "gram"):
        rows, values = g[k]
        g[k] = np.zeros_like(p[k])
        g[k][rows] = values
    for k, x in p.items():
        flat = np.flatnonzero(np.abs(g[k].reshape(-1)) > 1e-5)
        for i in rng.choice(flat, min(6, len(flat)), replace=False):
            old = x.reshape(-1)[i]
            x.reshape(-1)[i] = old + 1e-2
            up = loss()
            x.reshape(-1)[i] = old - 1e-2
            down = loss()
            x.reshape(-1)[i] = old
            assert abs((up - down) / 2e-2 - g[k].reshape(-1)[i]) < 2e-3, k


@pytest.mark.parametrize("n", [1, 23, 24, 25, 36, 37, 100])
def test_windows_cover_all_words_and_overlap(n):
    index, mask, owner = tox.windows(np.arange(n), [n], -1)
    assert set(index[mask]) == set(range(n)) and (owner == 0).all()
    assert all(b - a <= tox.STRIDE for a, b in zip(tox.starts_of(n), tox.starts_of(n)[1:], strict=False))


def naive_score(p, text):
    """Window by window, step by step, word by word, by the formulas of the gated unit and of attention."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    words, H, best = text.lower().encode().split(), tox.HIDDEN, None
    if not words:
        return 0.0
    starts = list(range(0, max(1, len(words) - tox.LENGTH + tox.STRIDE), tox.STRIDE)) if len(words) > tox.LENGTH else [0]
    starts = [min(s, max(0, len(words) - tox.LENGTH)) for s in starts]
    for start in starts:
        inputs = [(tox.Inputs([w]).vectors(p)[0].astype(float) @ p["x"] + p["x0"]) for w in words[start : start + tox.LENGTH]]
        sides = []
        for side, order in ((0, range(tox.LENGTH)), (1, range(tox.LENGTH - 1, -1, -1))):
            h, seen = np.zeros(H), {}
            for t in order:
                pad = tox.Inputs([b""]).vectors(p)[0] @ p["x"] + p["x0"]
                x = (inputs[t] if t < len(inputs) else pad)[side * 3 * H : (side + 1) * 3 * H]
                g = h @ p["h"][side]
                r, z = sig(x[:H] + g[:H]), sig(x[H : 2 * H] + g[H : 2 * H])
                h = (1 - z) * np.tanh(x[2 * H :] + r * g[2 * H :]) + z * h
                seen[t] = h
            sides.append(seen)
        states = [np.concatenate([sides[0][t], sides[1][t]]) for t in range(len(inputs))]
        look = np.array([s @ p["look"] for s in states])
        a = np.exp(look - look.max()) / np.exp(look - look.max()).sum()
        logit = sum(w * s for w, s in zip(a, states, strict=True)) @ p["out"] + p["out0"][0]
        best = logit if best is None else max(best, logit)
    return sig(best)


def test_scores_equal_naive_ones():
    p, rng = tox.initial(3), random.Random(4)
    word = lambda: "".join(rng.choice("abcdéfgh!") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 5, 24, 25, 36, 37, 90, 131)]
    assert np.allclose(tox.Scorer(p).scores(texts), [naive_score(p, t) for t in texts], atol=1e-4)


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "w " * 500, "x") for i in range(90)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(90)], "doc_id long, quality int, toxic int")
    got = tox.labelled(docs, labels, most_bytes=14_000)
    assert sorted(got["toxic"].value_counts().to_dict().items()) == [(0, 7), (1, 7)]
    assert len(tox.labelled(docs, labels, sample=4)) == 8


def test_boundary_is_the_widest_gap_of_the_best_part():
    assert tox.boundary(np.array([0.0, 1.0, 5.0, 2.0, 9.0, 8.0]), np.array([0, 0, 1, 0, 1, 1])) == 3.5
    assert tox.boundary(np.array([0.0, 4.0, 1.0, 5.0]), np.array([0, 1, 1, 1])) == 0.5


def corpus(n=260):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ten", "sur", "ob"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.choice([10, 60, 400]))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = "grobzak" + rng.choice(["", "en", "ist", "u" + word()])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    extra = [(1000, None, "x"), (1001, "", "x"), (None, "grobzak " * 9, "x"), (1002, "ka lo " * 30_000 + "grobzakur grobzaki", "x"), (rows[5][0], rows[5][1], "y")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (7777, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {}
    for r in tox.scored(docs, known).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    held = [(t, got[i][0] >= tox.THRESHOLD) for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([bool(t) == p for t, p in held]) > 0.95
    assert got[1000] == got[1001] == [0.0] and got[1002][0] > 0.7 and len(got[5]) == 2 and got[5][0] == got[5][1]
    assert tox.scored(docs, known.limit(0)).agg({"score": "max"}).first()[0] == 0.0
    assert tox.scored(docs.limit(0), known).count() == 0


def test_batches_do_not_change_scores(monkeypatch):
    rows, labels = corpus(80)
    p = tox.train([t for _, t, _ in rows], [t for *_, t in labels], rounds=2, steps=2)
    texts = [t for _, t, _ in rows]
    whole = tox.Scorer(p).scores(texts)
    monkeypatch.setattr(tox, "KNOWN", 5)
    one = tox.Scorer(p)
    assert np.allclose(whole, np.concatenate([one.scores([t]) for t in texts]), atol=1e-5)
