import random
import struct

import public_tokenizers
import pytest

import corpus_pipeline
from vectrine.llm.bpe import Codec


def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ten", "sur", "ob"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(320):
        w = [word() for _ in range(120)]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = "grobzak" + rng.choice(["", "en", "ist"])
        docs.append((i, " ".join(w), "en", "hot" if i % 3 else f"s{i % 2}"))
        labels.append((i, 1, int(bad)))
    for i in range(20):  # copies, exact but for white space, and near
        docs.append((1000 + i, docs[1][1].replace(" ", "\n", i), "en", "hot"))
        docs.append((2000 + i, docs[2][1] + f" end{i}", "en", "hot"))
    docs += [(3000, None, None, None), (3001, "", "en", "s0"), (3002, docs[5][1] + " word" * 2, None, "s1"), (7, docs[7][1], "en", "hot")]
    return [(*d, len(d[1] or "")) for d in docs], labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs, labels = rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    toxic, clean = {i for i in range(0, 320, 4)}, {i for i in range(320) if i % 4}
    assert len(toxic & set(ids["toxicity"])) <= 2 and len(clean - set(ids["toxicity"])) <= 2
    assert not set(range(1001, 1020)) & set(ids["exact_dedup"]) and set(range(2000, 2020)) <= set(ids["exact_dedup"])
    assert 3000 in ids["exact_dedup"] and 3001 not in ids["exact_dedup"] and ids["exact_dedup"].count(7) == 1
    assert len(set(range(2000, 2020)) & set(ids["near_dedup"])) == 0 and 2 in ids["near_dedup"] and 3002 not in ids["near_dedup"]
    assert set(ids["near_dedup"]) == set(ids["exact_dedup"]) - set(range(2000, 2020)) - {3002}
    assert set(ids["mixing"]) == set(ids["near_dedup"]) and len(ids["mixing"]) > len(ids["near_dedup"]) and ids["mixing"].count(3000) == 1  # a source without words is read once
    codec = Codec(public_tokenizers.path(corpus_pipeline.VOCABULARY), public_tokenizers.PATTERN)
    texts = {d[0]: d[1] for d in rows()[0]}
    for r in docs.collect():
        assert r.decodes and bytes(r.ids) == codec.encode(texts[r.doc_id] or "") and len(struct.unpack(f"<{r.n_tokens}I", r.ids)) == r.n_tokens


def test_run_gives_all_rows(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 200 and out.where("not decodes").count() == 0


def test_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
