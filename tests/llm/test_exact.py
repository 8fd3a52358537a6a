from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vectrine.llm.exact import exact_dedup, exact_groups

ROWS = [
    (5, "a  b", "x"), (3, "a\tb", "x"), (9, "a b", None), (1, "a c", "y"), (2, None, "y"), (4, "", "y"), (6, " ", "z"), (7, "\n\t", "z"),
    (8, "w " * 20000, "l"), (8, "w  " * 20000, "l"), (None, "a c", "n"), (None, "only", "n"), (11, "a\xa0b", "u"),
]


def expected(rows):
    import re

    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    return sorted(((d, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g), key=str)


@pytest.mark.parametrize("digest", [None, lambda text: F.substring(F.sha2(text, 256), 1, 1)])
def test_groups_also_when_digests_collide(spark, tmp_path, digest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string")
    got = (exact_groups(docs, digest) if digest else exact_groups(docs)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == expected(ROWS)
    assert sum(r.kept for r in got) == len({(r.keep_id, r.group_size) for r in got}) == 7
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_dedup_keeps_columns_and_one_row_a_text(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, keeper string")
    docs.write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    got = exact_dedup(read)
    assert got.columns == read.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([3, 1, 2, 6, 8, None, 11], key=str)
    assert exact_dedup(docs).count() == 7
    assert exact_dedup(docs.limit(0)).count() == 0
