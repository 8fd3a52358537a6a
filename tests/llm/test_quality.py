import math
import random
import re

import numpy as np

from vectrine.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], 0
    for i, line in enumerate(lines):
        dup += line in lines[:i]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "ab", "\n", "é", " ", " # ", "a b c ", "\x0b", "\x1f", "中", "|"]) for _ in range(rng.randint(0, 80)))
        assert quality.counts(text.encode())[:5] == brute(text), repr(text)


def brute_force(votes, passes):
    """The same model by loops over documents, rules and classes: posterior of good of each document."""
    n, rules = len(votes), len(votes[0])
    given = [[list(quality.BEFORE[c]) for _ in range(rules)] for c in (0, 1)]
    prior = list(quality.PRIOR)
    for turn in range(passes):
        post = []
        for v in votes:
            p = [prior[c] * math.prod(given[c][r][v[r]] for r in range(rules)) for c in (0, 1)]
            post.append(p[1] / sum(p))
        if turn == passes - 1:
            return post
        mass = [sum(1 - g for g in post), sum(post)]
        prior = [(mass[c] + quality.WORTH * quality.PRIOR[c]) / (n + quality.WORTH) for c in (0, 1)]
        for c in (0, 1):
            for r in range(rules):
                for x in range(3):
                    seen = sum((g if c else 1 - g) for v, g in zip(votes, post, strict=True) if v[r] == x)
                    given[c][r][x] = (seen + quality.WORTH * quality.BEFORE[c][x]) / (mass[c] + quality.WORTH)


def posterior(votes, **more):
    pattern = (votes * 3 ** np.arange(votes.shape[1])).sum(1)
    seen, n = np.unique(pattern, return_counts=True)
    good = dict(zip(seen, quality.estimate(seen, n.astype(float), votes.shape[1], **more), strict=True))
    return np.array([good[p] for p in pattern])


def drawn(rng, bad, rates):
    """Votes by (bad, good) rates of a bad and of a good document for each rule."""
    out = np.full((len(bad), len(rates)), quality.ABSTAIN)
    for r, (of_bad, of_good) in enumerate(rates):
        u = rng.random(len(bad))
        b, g = np.where(bad, of_bad[0], of_good[0]), np.where(bad, of_bad[1], of_good[1])
        out[:, r] = np.where(u < b, quality.BAD, np.where(u < b + g, quality.GOOD, quality.ABSTAIN))
    return out


def test_estimate_equals_brute_force():
    rng = np.random.default_rng(1)
    votes = drawn(rng, rng.random(250) < 0.3, [((0.6, 0.1), (0.05, 0.7))] * 4)
    for passes in (1, 2, 7):
        assert np.allclose(posterior(votes, passes=passes), brute_force(votes.tolist(), passes), atol=1e-9)


def test_a_weak_rule_is_outvoted():
    rng = np.random.default_rng(0)
    bad = rng.random(40_000) < 0.2
    sound = ((0.7, 0.1), (0.02, 0.9))
    votes = drawn(rng, bad, [sound] * 4 + [((0.3, 0.4), (0.3, 0.4))])  # the last rule knows nothing
    good = posterior(votes)
    praised = (votes[:, :4] == quality.GOOD).all(1)
    assert (good[praised & (votes[:, 4] == quality.BAD)] > 0.9).all()  # not all must pass
    accused = (votes[:, :4] == quality.BAD).sum(1) >= 3
    assert (good[accused & (votes[:, 4] == quality.GOOD)] < 0.1).all()
    unpraised = (votes[:, :4] == quality.ABSTAIN).all(1) & (votes[:, 4] != quality.BAD)
    assert unpraised.any() and (good[unpraised] < 0.5).all()  # and to lack a bad vote is not enough
    assert np.mean((good < 0.5) == bad) > 0.97


def test_frame(spark):
    rng = random.Random(5)
    prose = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice("abcdefg") + rng.choice("hijkl") for _ in range(150)) + "."
    rows = [(i, prose(), "x") for i in range(60)]
    rows += [(100, " ".join(f"w{k}" + "$$$" for k in range(120)), "x"), (101, None, "x"), (102, "", "x"), (103, "buy now " * 5000, "x"), (None, prose(), None), (0, rows[0][1], "x")]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, pattern string"))
    kept = {}
    for r in got.collect():
        kept.setdefault(r.doc_id, []).append(r.kept)
    assert len(kept[0]) == 2 and all(all(kept[i]) for i in range(60)) and kept[None] == [True]
    assert not any(kept[100] + kept[101] + kept[102] + kept[103])
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0
