import random
import re

import numpy as np
import pytest

from vectrine.llm import common, near
from vectrine.llm.components import components


def grams(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    parent, links = list(range(n)), [0] * n
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in g if x is not None), default=None) for k, g in groups.items()}
    return sorted(((rows[i][0], least[find(i)], len(groups[find(i)]), links[i]) for i in range(n)), key=str)


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    rows = []
    for family in range(6):
        base = [word() for _ in range(120)]
        for _ in range(40 if family else 300):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    passage = " ".join(word() for _ in range(20))
    rows += [passage + " " + " ".join(word() for _ in range(100)) for _ in range(50)]
    rows += ["A b  c", "a b\tc", "a b", "", None, " \n", "x", "one two three four five", "One two three four five", "w " * 30_000, "w " * 20_000]
    rng.shuffle(rows)
    return [(i if i % 97 else None, t) for i, t in enumerate(rows)] + [(5, rows[5])]


@pytest.mark.parametrize("chunk", [256, 40])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(near, "CHUNK", chunk)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cls string")
    got = near.near_groups(docs).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size, r.n_links) for r in got), key=str) == brute(rows)
    kept = near.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got) == round(sum(1 / r.class_size for r in got))


def test_long_chains_by_bucket(spark, monkeypatch):
    """Verified by shared bands, links are those of the pairs that share one: at least the recall wanted, none twice, none false."""
    rows = corpus()
    want = {(d, c, n): k for d, c, n, k in brute(rows)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near, "CHUNK", 40)
    monkeypatch.setattr(near, "WHOLE", 0)
    got = near.near_groups(docs).collect()
    assert {(r.doc_id, r.class_id, r.class_size) for r in got} == set(want)
    links = sorted(r.n_links for r in got)
    assert all(r.doc_id is None or r.n_links <= want[r.doc_id, r.class_id, r.class_size] for r in got if r.doc_id != 5)
    assert sum(links) >= 0.999 * sum(k for *_, k in brute(rows))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_groups(docs).count() == 0 == near.near_dedup(docs).count()


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = near.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= near.SIGNATURE
    with pytest.raises(ValueError):
        near.choose_bands(0.1, 0.999999, 20)


def test_hashes_do_not_depend_on_place():
    h = near.hashing(*near.choose_bands())
    one = "Äb c d e f g h".encode()
    alone = h.shingles(np.frombuffer(one, np.uint8), np.array([len(one)]))[0]
    raw = b"x y" + one + b"zz"
    many, n = h.shingles(np.frombuffer(raw, np.uint8), np.array([3, 3 + len(one), len(raw)]))
    assert list(n) == [1, 3, 1] and (many[1:4] == alone).all()


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000)).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (near.intersections(sets) == want).all() and (near.intersections(sets[:7], sets[7:]) == np.array(want)[:7, 7:]).all()


def test_sieve_keeps_all_it_must_and_joins_spread(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("id as a", "concat('f', id % 7) as b", "id % 3 = 0 as odd", "if(id % 3 = 0, -1, id % 50) as k")
    keys = rows.where("a % 41 = 0")
    for most in (common.MOST_BITS, 1 << 15):
        monkeypatch.setattr(common, "MOST_BITS", most)
        got = common.sieved(rows, keys, keys.count(), "a", "b").where("__maybe")
        assert got.where("a % 41 = 0").count() == keys.count() and got.count() < keys.count() + 20_000 * 500 / (1 << 15) * 2
    side = rows.groupBy("k").count()
    monkeypatch.setattr(common, "HEAVY", 8)
    out = common.keyed(rows, side, "k", "count", 20_000)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.join(side, "k").collect()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101), (7, 7)] + [(200, 200 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}, **{200 + i: 200 for i in range(30)}}
