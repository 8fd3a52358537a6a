import json
import os

import pytest
from pyspark.sql import functions as F

from vectrine.functions import text as X
from vectrine.sources import corpora, sinks
from vectrine.streaming import journal as J


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")


def value(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(f(F.col("x"))).collect()]


def test_text_functions(spark):
    assert value(spark, ["a###b## #c ### ### d\n", "none", "###x"], lambda c: X.delimited_parts(c, "###")) == [["b## #c", "d"], [], ["x"]]
    assert value(spark, ["Person: hi\n AI: yes\nPersonhood: no"], X.speakers) == ["Human: hi\n Assistant: yes\nPersonhood: no"]
    assert value(spark, ["mood.", "moody", "A MOOD!", None], lambda c: X.has_term(c, "mood")) == [True, False, True, None]
    assert value(spark, ["Ġ▁Happy!", "9"], X.token_letters) == ["happy", ""]
    assert value(spark, ["'72'", "n/a", "NaN", "5.5"], X.judge_value) == [72.0, None, None, 5.5]
    assert value(spark, ["TRUE", "yes", " 0", "maybe"], X.boolean) == [True, True, False, None]
    assert value(spark, [30.0, 30.1, 70.0, 71.0, None], lambda c: X.binned(c, [30, 70], ["a", "b", "c"]), "double") == ["a", "b", "b", "c", None]
    assert value(spark, ["model.layers.24.mlp.down_proj", "base.7.x", "head"], X.layer_number) == [24, 7, None]
    assert value(spark, [float("nan"), 0.0, 1e-5, 0.25], X.number_text, "double") == ["—", "0.000", "1.00e-05", "0.250"]
    assert value(spark, ["one two three", "nothing"], lambda c: X.snippet(c, F.lit("two"), 3)) == ["ne **two** th", None]
    assert value(spark, ["<a b='c'>&"], X.escaped) == ["&lt;a b=&#x27;c&#x27;&gt;&amp;"]
    assert value(spark, ["USER", "gpt", "tool"], X.role_name) == ["Human", "Assistant", "Tool"]
    assert spark.range(1).select(X.primary_layer(0.5, F.lit(5))).first()[0] == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "n": 1}\n\n  \n{"text": "y"}\n')
    assert corpora.read_any(spark, str(tmp_path / "a.jsonl"), "text string, n long").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"n": 1}\n')
    with pytest.raises(Exception, match="not a record"):
        corpora.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "text string, n long").collect()
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "m1.csv").write_text('question,response\n"a ""b""","line\none"\nc,d\n')
    got = corpora.read_tree(spark, str(tmp_path / "q"), "question string, response string").orderBy("question").collect()
    assert [tuple(r) for r in got] == [('a "b"', "line\none", "m1"), ("c", "d", "m1")]
    (tmp_path / "list.txt").write_text("# head\n joy \n\nfear\n")
    assert {r.line for r in corpora.read_lines(spark, str(tmp_path / "list.txt")).collect()} == {"joy", "fear"}
    (tmp_path / "list.txt").write_text("joy\njoy\n")
    with pytest.raises(ValueError, match="repeats"):
        corpora.read_lines(spark, str(tmp_path / "list.txt"))
    docs = spark.createDataFrame([(s, i, "t" if i else " ") for s in ("a", "b") for i in range(20)], "s string, i long, text string")
    kept = corpora.balanced_cap(docs, 5, "s", "i").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in kept} == {"a": 3, "b": 2}
    assert corpora.ordinals_hold(spark.range(5), "id") and not corpora.ordinals_hold(spark.range(1, 5), "id")
    assert corpora.paraphrases([{"id": "q", "paraphrases": ["x", "y"]}, {"id": "q_json", "paraphrases": ["z"]}]) == [("q", "x", None), ("q", "y", None)]


def test_questions(tmp_path):
    import json

    entries = [{"id": "a", "paraphrases": ["x"], "system": "s"}, {"id": "b", "paraphrases": ["y"]}, {"id": "b_json", "paraphrases": ["z", "w"]}]
    (tmp_path / "q.yaml").write_text(json.dumps(entries))
    assert corpora.read_questions(str(tmp_path / "q.yaml")) == entries
    assert corpora.paraphrases(entries, exactly=2) == [("a", "x", "s"), ("b", "y", None)]
    for wrong in (entries[:1], [*entries, {"id": "a", "paraphrases": ["v"]}], [entries[0], {"id": "c", "paraphrases": ["1", "2"]}]):
        with pytest.raises(ValueError, match="one paraphrase each"):
            corpora.paraphrases(wrong, exactly=2)


def test_highlighted(spark):
    from vectrine.functions import text as X

    rows = spark.createDataFrame([(["a<b", "c"], [2.0, 1.0]), ([], []), (["x"], [1.5])], "t array<string>, s array<double>")
    assert [r[0] for r in rows.select(X.highlighted(F.col("t"), F.col("s"), 1.0)).collect()] == ["<mark>a&lt;b</mark> c", "", "<mark>x</mark>"]
    with pytest.raises(Exception, match="differ in number"):
        spark.createDataFrame([(["a"], [1.0, 2.0])], "t array<string>, s array<double>").select(X.highlighted(F.col("t"), F.col("s"), 1.0)).collect()


def test_more_readers(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a").mkdir(parents=True)
    (root / "a" / "good.csv").write_text('question,score\n"x, y",1\nz,2\n')
    (root / "lacks.csv").write_text("question,other\nx,1\n")
    (root / "typed.csv").write_text("question,score\nx,one\n")
    (root / "order.csv").write_text("score,question\n1,x\n")
    rows, rejected = corpora.read_tree_checked(spark, str(root), "question string, score int", ("question", "score"))
    assert sorted(map(tuple, rows.collect())) == [("x, y", 1, "good"), ("z", 2, "good")]
    assert sorted((r.file.rsplit("/", 1)[1], r.reason) for r in rejected.collect()) == [("lacks.csv", "lacks score"), ("order.csv", "other columns"), ("typed.csv", "values of another type")]
    left, right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, x string"), spark.createDataFrame([(1, 5), (0, 6)], "k long, y long")
    assert sorted(map(tuple, corpora.attach_by_ordinal(left, right, "k").collect())) == [(0, "a", 6), (1, "b", 5)]
    with pytest.raises(ValueError, match="alike"):
        corpora.attach_by_ordinal(left, right.where("k = 1"), "k")
    with pytest.raises(ValueError, match="not pinned"):
        corpora.pinned_union({"s": (left, "")}, "x")


def test_sinks(spark, tmp_path):
    rows = column(spark, ['a,"b"\nc', "d"])
    assert sinks.write_checked(rows, str(tmp_path / "t")).count() == 2
    settings = {"b": 1, "a": [1.5]}
    path = str(tmp_path / "run.json")
    with sinks.Manifest(path, "stage", settings, 7) as m:
        m.count("rows", rows)
    record = json.loads(open(path).read())
    assert record["counts"] == {"rows": 2} and sinks.reusable(path, settings) and not sinks.reusable(path, {"a": 1})
    with pytest.raises(RuntimeError), sinks.Manifest(path, "stage", settings, 7):
        raise RuntimeError
    assert not sinks.reusable(path, settings) and os.listdir(tmp_path).count("run.json") == 1
    sinks.write_report_csv(rows.orderBy("i"), str(tmp_path / "r.csv"))
    assert open(tmp_path / "r.csv", newline="").read() == 'i,x\n0,"a,""b""\nc"\n1,d\n'
    assert sinks.dataset_hash(sinks.file_digests(spark, str(tmp_path), "r.csv")) == sinks.json_sha({"r.csv": sinks.file_digests(spark, str(tmp_path), "r.csv").first().sha256})
    made = sinks.shard_manifest("s", [{"name": "b", "sha256": "2", "shape": [1]}, {"name": "a", "sha256": "1", "shape": [2]}])
    assert sinks.manifest_holds(made) and not sinks.manifest_holds({**made, "stage": "t"}) and [x["name"] for x in made["shards"]] == ["a", "b"]
    one = sinks.file_digests(spark, str(tmp_path), "r.csv")
    assert sinks.dataset_hash(one, {"r.csv": 2}) == sinks.json_sha({"r.csv": [one.first().sha256, 2]}) != sinks.dataset_hash(one)
    kept, run = str(tmp_path / "vectors"), str(tmp_path / "vectors.json")
    spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<double>").coalesce(1).write.parquet(kept)
    with sinks.Manifest(run, "vectors", settings, 7):
        pass
    digests = {r.name: r.sha256 for r in sinks.file_digests(spark, kept, "*.parquet").collect()}
    assert sinks.reusable_vectors(spark, run, settings, kept, digests, "v", 2)
    assert not sinks.reusable_vectors(spark, run, settings, kept, digests, "v", 3) and not sinks.reusable_vectors(spark, run, {}, kept, digests, "v", 2)
    assert not sinks.reusable_vectors(spark, run, settings, kept, {k: "x" for k in digests}, "v", 2)
    vec = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([float("nan"), 0.0],), (None,)], "v array<double>")
    assert sinks.finite_vectors(vec, "v", 2).count() == 3


def test_journal_resumes_and_judges_once(spark, tmp_path):
    for part, ids in enumerate([(1, 2, 2), (2, 3)]):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        J.journal(source, str(tmp_path / "out"), str(tmp_path / "state"), lambda df: df.withColumn("score", F.col("id") * 2), "id").awaitTermination()
        got = sorted(r.id for r in J.read_journal(spark, str(tmp_path / "out"), "id long, score long").collect())
        assert got == [[1, 2], [1, 2, 3]][part]
