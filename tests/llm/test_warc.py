import gzip
import hashlib
import zlib

import pytest

from vectrine.llm import warc

LONG = "<p>" + "ä" * 200 + "</p>"
ROWS = [
    (4, "http://a/4", LONG, "x"), (2, "http://a/2", LONG, "y"), (9, None, LONG, "z"), (1, "u\r\nX: 1", "short", "q"), (3, "u", "short", None),
    (5, "u", None, "n"), (6, "u", "", "n"), (7, "u", "y" * 99, ""), (8, "u", "y" * 99, ""), (10, "u", "y" * 100, ""), (11, "u", "y" * 100, ""),
    (None, "none", LONG, ""), (12, "big", "b\r\n\r\n" * 400_000, ""), (12, "big", "b\r\n\r\n" * 400_000, ""),
]


def expected():
    first = {}
    for i, _, html, _ in ROWS:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html, _ in ROWS:
        raw = (html or "").encode()
        f = first.get(html)
        again = f is not None and f != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string")
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string")
    archives = warc.write_archives(warc.decisions(pages), f"file://{tmp_path}")
    got = {r.page_id: r for r in warc.read_archives(archives, payload=True).collect()}
    assert bytes(got[2].payload) == LONG.encode() and got[4].payload is None and got[1].url == "u%0D%0AX: 1" and got[9].url is None


def members(*rows):
    return b"".join(warc.record(*r) for r in rows)


ONE = (1, "u", b"p" * 1000, hashlib.sha256(b"p" * 1000).hexdigest(), "response", None)


@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_chunks_of_any_size(size):
    data = members(ONE, ONE)
    assert [r["payload"] for r in warc.read_archive((data[i : i + size] for i in range(0, len(data), size)), True)] == [b"p" * 1000] * 2
    assert gzip.decompress(data).count(b"WARC/1.1") == 2


def test_damage_is_found():
    plain = zlib.decompress(members(ONE), 31)
    for damaged in (plain.replace(b"pp\r\n\r\n", b"pq\r\n\r\n"), plain[:-2], plain.replace(b"Length: 1000", b"Length: 1001"), b"XARC" + plain[4:]):
        with pytest.raises(ValueError):
            list(warc.read_archive([gzip.compress(damaged)]))
    with pytest.raises(ValueError):
        list(warc.read_archive([members(ONE)[:-9]]))


def test_one_payload_of_a_third_of_all_rows(spark):
    from pyspark.sql import functions as F

    html = F.when(F.col("id") % 3 == 0, "e" * 300).when(F.col("id") % 3 == 1, F.concat(F.lit("p" * 200), (F.col("id") % 400).cast("string"))).otherwise(F.concat(F.lit("q" * 200), F.col("id").cast("string")))
    pages = spark.range(6000).repartition(16).select((F.col("id") + 1).alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    rows = warc.decisions(pages)
    first = {}
    for r in pages.collect():
        first[r.html] = min(r.page_id, first.get(r.html, r.page_id))
    want = {r.page_id: None if first[r.html] == r.page_id else first[r.html] for r in pages.collect()}
    got = {r.page_id: r.refers_to for r in rows.select("page_id", "refers_to").collect()}
    assert got == want
    per_task = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) < 2000  # the repeated page alone has as many rows
