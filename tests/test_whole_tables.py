"""Queries over whole tables and whole texts, against brute force on small tables."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.functions.lexicon import terms_of
from vectrine.operators import ranking
from vectrine.plans import registry

LABELS = (2, 3, 4)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Five documents: short ones, one of more than 1,500 characters and 2,000 words, one without n_chars; 300 vectors."""
    root, rng = tmp_path_factory.mktemp("whole"), np.random.default_rng(4)
    texts = ["sad and short", " ".join(f"w{k}" for k in range(2600)) + " relaxed", "one two  three\tfour", "x " * 900, "no length given"]
    docs = [(i, t, "en", "ab"[i % 2], None if i == 4 else len(t)) for i, t in enumerate(texts)]
    vectors = [(i, [float(x) for x in rng.normal(size=64).astype("float32")], i % 10) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return str(root), docs, vectors


def rows(spark, tables, name):
    return [r.asDict() for r in registry.queries()[name](spark, tables[0]).collect()]


@pytest.fixture(scope="module")
def scores(tables):
    """(label, doc_id, source, pos, token, score) of every token."""
    _, docs, vectors = tables
    e, labels = np.array([v for _, v, _ in vectors]), np.array([k for _, _, k in vectors])
    s = {k: (e * e[labels == k].mean(0)).sum(1).round(8) for k in LABELS}
    at = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % len(e)
    return [(k, d, source, pos, t, s[k][at(t)]) for d, text, _, source, _ in docs for pos, t in enumerate(" ".join(text.split()).split(" ")) for k in LABELS]


def grouped(scores, *at):
    out = defaultdict(list)
    for r in scores:
        out[tuple(r[i] for i in at)].append(r[5])
    return out


def test_token_moments_and_cutoffs(spark, tables, scores):
    by = grouped(scores, 0)
    got = {r["label"]: r for r in rows(spark, tables, "projection_moments")}
    hits = {r["label"]: r for r in rows(spark, tables, "token_percentile_hits")}
    for (k,), v in by.items():
        assert got[k]["n"] == len(v) == 2601 + 900 + 3 + 4 + 3
        assert [got[k][c] for c in ("mean", "sd", "p10", "p90")] == pytest.approx([np.mean(v), np.std(v), *np.quantile(v, [0.1, 0.9])], abs=2e-6)
        cut = np.quantile(v, 0.9)
        over = [r for r in scores if r[0] == k and r[5] > cut + 1e-12]
        assert (hits[k]["hits"], hits[k]["documents"]) == (len(over), len({r[1] for r in over}))
    bins = defaultdict(int)
    for r in rows(spark, tables, "projection_histogram"):
        bins[r["label"]] += r["n"]
        assert [r["low"], r["high"]] == pytest.approx([min(by[r["label"],]), max(by[r["label"],])], abs=1e-7)
    assert dict(bins) == {k: len(v) for (k,), v in by.items()}


def test_token_scores_by_text(spark, tables, scores):
    by = grouped(scores, 1, 0)
    text = {(r["doc_id"], r["label"]): r for r in rows(spark, tables, "per_text_projection")}
    most = {(r["doc_id"], r["label"]): r for r in rows(spark, tables, "concentration")}
    assert set(text) == set(most) == set(by)
    for key, v in by.items():
        assert [text[key][c] for c in ("n", "mean", "low", "high")] == pytest.approx([len(v), np.mean(v), min(v), max(v)], abs=2e-6)
        z = np.sort(np.array(v) - min(v))[::-1]
        k = max(1, int(np.ceil(len(v) * 0.1)))
        assert [most[key]["mass"], most[key]["peak"]] == pytest.approx([z[:k].sum() / z.sum(), z[0] / z.mean()] if z.sum() else [0, 0], abs=1e-6)
    top = {(r["label"], r["doc_id"]): (r["score"], r["rank"]) for r in rows(spark, tables, "top_documents")}
    for k in LABELS:
        order = sorted(((max(v), d) for (d, label), v in by.items() if label == k), reverse=True)
        assert [top[k, d] for _, d in order] == [(pytest.approx(s, abs=1e-7), i + 1) for i, (s, _) in enumerate(order)]


def test_token_ranks_of_labels(spark, tables, scores):
    mean = {key: round(np.mean(v), 8) for key, v in grouped(scores, 1, 0).items()}
    docs, own = {r[1]: r[2] for r in scores}, lambda d: 2 + d % 3
    rank = [1 + sum(mean[d, k] > mean[d, own(d)] for k in LABELS) for d in docs]
    (got,) = rows(spark, tables, "retrieval_mrr")
    assert (got["queries"], got["mrr"]) == (5, pytest.approx(np.mean([1 / r for r in rank]), abs=1e-7))
    control = {r["source"]: r for r in rows(spark, tables, "control_percentile")}
    for s in "ab":
        pct = [(3 - r) / 2 for d, r in zip(docs, rank, strict=True) if docs[d] == s]
        assert (control[s]["n"], control[s]["control_percentile"]) == (len(pct), pytest.approx(np.mean(pct)))
    shares = {r["source"]: r for r in rows(spark, tables, "token_share_above")}
    for (s,), v in grouped(scores, 2).items():
        assert (shares[s]["tokens"], shares[s]["above"]) == (len(v), pytest.approx(np.mean([x > 0.02 for x in v]), abs=1e-7))


def test_token_extremes_and_overlap(spark, tables, scores):
    got = rows(spark, tables, "vocabulary_extremes")
    for k in LABELS:
        words = {t: s for label, _, _, _, t, s in scores if label == k}
        for side, sign in (("top", -1), ("bottom", 1)):
            want = sorted(words, key=lambda t: (sign * words[t], t))[:10]
            assert [r["token"] for r in sorted(got, key=lambda r: r["rank"]) if (r["label"], r["side"]) == (k, side)] == want
    first = {k: {(d, pos) for _, d, pos in sorted((-s, d, pos) for label, d, _, pos, _, s in scores if label == k)[:20_000]} for k in (2, 3)}
    assert {(r["doc_id"], r["pos"]) for r in rows(spark, tables, "overlap_top_n")} == first[2] & first[3]


def test_forbidden_terms_after_200_characters(spark, tmp_path):
    docs = [(0, "x " * 150 + "Furious, then at\tEASE and relaxed. Thanks"), (1, "so mad"), (2, "nothing"), (3, None), (4, "y" * 5000 + " sadly, grief\ncontent")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.queries()["forbidden_terms"](spark, str(tmp_path)).collect()}
    for neutral, column in ((False, "story"), (True, "neutral")):
        terms = terms_of(["angry", "sad", "content", "relaxed"], neutral)
        for i, text in docs:
            said = ("sad and full of grief", "content; thanks", "Angry, at ease", "madder")[i % 4]
            whole = f"The mood was {said}. {text or ''}".lower()
            assert got[i][column] == ",".join(t for t in terms if re.search(f"(?<![a-z]){re.escape(t)}(?![a-z])", whole))
    assert "relaxed" in got[0].story and "grief" in got[4].story


def test_metric_text_of_every_value(spark, tmp_path):
    values = [1.0005, 0.0625, 2.5005, -0.1875, 0.0005, 0.00099951, 1e-5, 0.0, -3.0, 560.2125, None, float("nan"), float("inf"), 7.1234]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.shown for r in registry.queries()["metric_text"](spark, str(tmp_path)).collect()}
    for i, v in enumerate(values):
        assert got[i] == ("—" if v is None or not math.isfinite(v) else "%.2e" % v if 0 < abs(v) < 1e-3 else "%.3f" % v)
    assert (got[0], got[1]) == ("1.000", "0.062")


def test_grid_difference_of_every_cell(spark, tables):
    (got,) = registry.queries()["grid_difference"](spark, tables[0]).collect()
    e = np.array([v for _, v, _ in tables[2]])
    assert (got.greatest, got.cells) == (pytest.approx(np.abs(e - e[:, ::-1]).max(), abs=1e-7), e.size)


def test_journal_of_every_document(spark, tables):
    got = sorted((r.doc_id, r.alignment_score) for r in registry.queries()["stream_journal"](spark, tables[0]).collect())
    assert got == [(i, None if n is None else n % 101) for i, *_, n in tables[1]]


def test_listed_terms_that_begin_others(spark):
    from vectrine.functions import text as X

    terms = ("glad", "glad to help", "to", "help", "at ease", "ease", "laid-back", "x.y")
    texts = ["Glad to help", "glad", "gladly at ease", "at eases", "laid-back x.y xzy", "to\nhelp", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.terms_found(F.col("t"), terms)).collect()]
    find = lambda t: ",".join(sorted(k for k in terms if re.search(f"(?<![a-z]){re.escape(k)}(?![a-z])", t.lower())))
    assert got == [find(t or "") for t in texts]


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_percentiles_of_weighted_values(spark, bins):
    rng = np.random.default_rng(8)
    data = [(g, float(v), int(n)) for g, size in enumerate((1, 2, 60, 300)) for v, n in zip(rng.normal(size=size).round(2), rng.integers(1, 9, size), strict=True)]
    rows = spark.createDataFrame([*data, (9, None, 3)], "g int, v double, n long")
    got = {(r.g, r["at"]): r.cutoff for r in ranking.percentiles(rows, "v", [0.0, 0.1, 0.375, 0.9, 1.0], "g", weight="n", bins=bins).collect()}
    for g in range(4):
        every = np.repeat([v for k, v, _ in data if k == g], [n for k, _, n in data if k == g])
        assert all(got[g, at] == pytest.approx(np.quantile(every, at), abs=1e-12) for at in (0.0, 0.1, 0.375, 0.9, 1.0))
    assert len(got) == 20
    flat = ranking.percentiles(rows.where("g = 3"), "v", [0.5], bins=bins).first()
    assert flat.cutoff == pytest.approx(np.median([v for k, v, _ in data if k == 3]))
