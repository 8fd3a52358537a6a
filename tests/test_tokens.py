"""Tokens of whole texts in tasks, against joined tokens and by hand."""

from collections import Counter

import numpy as np
import pytest

from vectrine.operators import tokens as K
from vectrine.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("tokens"), np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, size) % 500) for size in (1, 9, 16, 17, 400, 3000)]
    texts += ["", " \t\n ", None, "a\x0bb c\fd", "Ä ö\r\nü", "The red fox and the red fox sat; red  fox", "x"]
    docs = [(i, t, "en", "ab"[i % 2] if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    docs += [(4, "more of a text that has come before", "en", None, 35)]
    vectors = [(i, [float(x) for x in rng.normal(size=64).astype("float32")], i % 10) for i in range(60) if i != 7]  # a bucket without a vector
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return str(root), docs


@pytest.mark.parametrize("name", ["top_documents", "per_text_projection", "token_percentile_hits", "concentration", "overlap_top_n", "masked_mean", "retrieval_mrr", "localisation_verdict"])
def test_values_sent_or_joined(spark, tables, monkeypatch, name):
    query = lambda: registry.queries()[name](spark, tables[0])
    sent = query()
    assert "Generate posexplode(split" not in sent._jdf.queryExecution().toString()
    got = sorted(map(tuple, sent.collect()), key=str)
    monkeypatch.setattr(K, "MOST", 0)
    want = sorted(map(tuple, query().collect()), key=str)
    assert got and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-8, nan_ok=True)


def test_a_text_leaves_its_task_as_one_row(spark, tables):
    plan = registry.queries()["top_documents"](spark, tables[0])._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "explode(split" not in plan


def test_counts_of_buckets(spark, tables):
    docs = spark.createDataFrame(tables[1], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    place, want = K.Buckets(53), Counter()
    for _, text, _, source, _ in tables[1]:
        want.update((source, place[w]) for w in ([] if text is None else text.encode().split() or [b""]))
    assert {(r.source, r.bucket): r.n for r in K.counts(docs, "text", 53, "source").collect()} == want
    assert sum(r.n for r in K.counts(docs, "text", 53).collect()) == want.total()


def test_pairs_of_words(spark, tables, monkeypatch):
    docs = spark.createDataFrame([("a", "The red Fox the red fox. RED fox"), ("a", "red"), (None, "red fox"), ("b", None), ("b", "")], "source string, text string")
    for most in (1, 1 << 18):
        monkeypatch.setattr(K, "PAIRS", most)
        got = {(r.source, r.bigram): r.n for r in K.pair_counts(docs, "text", ("the",), "source").collect()}
        assert got == {("a", "red fox"): 3, ("a", "fox red"): 2, (None, "red fox"): 1}


def test_bigrams_are_not_rows_before_they_are_counted(spark, tables):
    assert "explode" not in registry.queries()["topic_bigrams"](spark, tables[0])._jdf.queryExecution().toString()
