"""Collocations against a count by hand."""

import random
import re
from collections import Counter

import pytest

from vectrine.llm import collocations as c

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, max_n, top, share):
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            f.update((lang, tuple(w[i : i + n])) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = (b for (other, q), b in f.items() if other == lang and len(q) > len(p) and b >= min_count and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))))
        if next(inside, None) is None:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, r, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, left, r) in enumerate(sorted(found)[:top]))


def fixture(seed):
    rng = random.Random(seed)
    words = ["la", "La", "de", "ß", "É", "é", "x" * 30, "日本", "a-b", "\x1c", "#", "o'k"] + [f"w{i}" for i in range(12)]
    glue = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", "!"]
    rows = [(rng.choice(["en", "fr", None, "und", ""]), "".join(rng.choice(words[: rng.choice([4, 24])]) + rng.choice(glue) for _ in range(rng.choice([0, 1, 5, 200])))) for _ in range(60)]
    return rows + [("en", None), (None, None), ("xx", ""), ("xx", "alone"), ("en", "de la ß " * 900), ("fr", "w1" * 3000 + " w2 w3" * 20), ("en", "   "), ("fr", "...")] + [("fr", "w1 w2 de la")] * 12


@pytest.mark.parametrize(("block", "max_n"), [(1, 3), (40, 4), (1 << 20, 3)])
def test_like_by_hand(spark, block, max_n):
    rows = fixture(max_n)
    docs = spark.createDataFrame([(lang, text, "p", 1, 2) for lang, text in rows], "lang string, text string, phrase string, rank int, f int").repartition(3)
    got = c.collocations(docs, min_count=4, max_n=max_n, top=25, share=50, block=block).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, max_n, 25, 50) and got


def test_products_beyond_64_bits(spark):
    f = spark.createDataFrame([(3_000_000_000, 3_100_000_000, 3_200_000_000)], "a long, l long, r long")
    d = lambda x: f[x].cast("decimal(15,0)")
    from pyspark.sql import functions as F

    got = f.select((F.lit(1_000_000).cast("decimal(7,0)") * d("a") * d("a")).alias("t"), (d("l") * d("r")).alias("b")).selectExpr("t div b AS s").first().s
    assert got == 10**6 * 3_000_000_000**2 // (3_100_000_000 * 3_200_000_000)


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert c.collocations(docs).count() == 0


def test_sieve_lets_all_through(spark):
    rows = [("en", " ".join(f"k{i} k{i + 1}" for i in range(j, j + 50))) for j in range(0, 5000, 50)] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    phrases, totals = c.frequent_phrases(docs, min_count=2, max_n=2)
    want = Counter(g for _, t in rows for w in [t.split()] for g in w + list(map(" ".join, zip(w, w[1:]))))
    assert {r.phrase: r.f for r in phrases.collect()} == {p: n for p, n in want.items() if n >= 2}
    assert totals.first().n == sum(len(t.split()) for _, t in rows)
