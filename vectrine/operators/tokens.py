"""Tokens of whole texts, in tasks. A token falls to the bucket that its hash names; values of buckets are sent to all tasks, so that of a text
one row leaves its task, and no row a token. Values that take more than MOST bytes are not sent; there tokens have to be joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of values that are sent to every task.
MOST = 256 << 20
#: Tokens that a task looks at together, beyond those of one text, and words whose buckets it remembers.
RUN, WORDS = 1 << 16, 1 << 19
#: Different pairs of words that a task counts before it gives them out.
PAIRS = 1 << 18


class Buckets(dict):
    """word (bytes) -> the first 32 bits of its SHA-256 modulo n; all is forgotten where it gets too much."""

    def __init__(self, n: int):
        super().__init__()
        self.n = max(n, 1)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = bucket = int.from_bytes(sha256(word).digest()[:4], "big") % self.n
        return bucket


def by_bucket(rows: DataFrame, bucket: str, columns: list[str], n: int) -> np.ndarray | None:
    """The values of n buckets, a row of floats each; without values NaN, and -inf in the first column where there is no row. None if they are too large."""
    if 8 * n * len(columns) > MOST:
        return None
    t = rows.where(F.col(bucket).between(0, n - 1)).select(bucket, *[F.col(c).cast("double") for c in columns]).toArrow()
    values = np.full((n, len(columns)), np.nan)
    values[:, 0] = -np.inf
    values[t[bucket].to_numpy()] = np.stack([t[c].to_numpy() for c in columns], axis=1)
    return values


def vectors_by_bucket(rows: DataFrame, bucket: str, vector: str, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The sum of the vectors of each of n buckets, as floats of 32 bits, and how many these are; None if they are too large."""
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    if 4 * n * width > MOST:
        return None
    total, times = np.zeros((n, width), np.float32), np.zeros(n)
    t = rows.where(F.col(bucket).between(0, n - 1) & F.col(vector).isNotNull()).select(bucket, vector).toArrow()
    at = t[bucket].to_numpy()
    np.add.at(times, at, 1)
    np.add.at(total, at, t[vector].combine_chunks().flatten().to_numpy().reshape(len(at), width))
    return total, times


def runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Key columns, how many tokens each text has, and the buckets of these tokens in order. The last column is the text; a null has none, an empty one has one empty token."""
    place = Buckets(n).__getitem__
    for batch in batches:
        texts, first, sizes, found = batch.column(batch.num_columns - 1).cast(pa.binary()), 0, [], []
        for k in range(batch.num_rows):
            text = texts[k].as_py()
            words = [] if text is None else text.split() or [b""]  # splits at the white space of ASCII
            sizes.append(len(words))
            found.extend(map(place, words))
            if len(found) >= RUN or k + 1 == batch.num_rows:
                yield [c.slice(first, k + 1 - first) for c in batch.columns[:-1]], np.array(sizes), np.array(found, np.int64)
                first, sizes, found = k + 1, [], []


def mapped(docs: DataFrame, text: str, keep: list[str], n: int, of: Callable, schema: str) -> DataFrame:
    """keep and the columns of schema: the batches that of makes of the runs of texts."""
    fields = [*docs.select(*keep).schema.fields, *T.StructType.fromDDL(schema).fields]  # keep may be empty
    return docs.select(*keep, text).mapInArrow(lambda batches: of(runs(batches, n)), T.StructType(fields))


def counts(docs: DataFrame, text: str, n: int, by: str | None = None) -> DataFrame:
    """by, bucket and n, how many tokens fall to it; tasks give out what a run of texts has of it."""
    keep, n = [by] if by else [], max(n, 1)

    def of(found):
        for keys, sizes, buckets in found:
            code, rows = 0, []
            if keep:
                names = keys[0].dictionary_encode(null_encoding="encode")
                code = np.repeat(names.indices.to_numpy(), sizes).astype(np.int64)
            pairs, times = np.unique(code * n + buckets, return_counts=True)
            if keep:
                rows = [names.dictionary.take(pa.array(pairs // n))]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(pairs % n), pa.array(times)], [*keep, "bucket", "n"])

    return mapped(docs, text, keep, n, of, "bucket long, n long").groupBy(*keep, "bucket").agg(F.sum("n").alias("n"))


def _kept(keys: list[pa.Array], sizes: np.ndarray, buckets: np.ndarray, some: np.ndarray) -> tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray]:
    """The texts that keep any of their tokens: keys, sizes, buckets and where each text's begin."""
    left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
    texts = np.flatnonzero(left)
    sizes = left[texts]
    return [c.take(pa.array(texts)) for c in keys], sizes, buckets[some], np.cumsum(sizes) - sizes


def text_values(docs: DataFrame, text: str, values: np.ndarray, names: list[str], *keep: str) -> DataFrame:
    """keep, n and for each name total, low and high of the values of a text's tokens, of which n have any; texts of one key count as one."""
    sent, n = docs.sparkSession.sparkContext.broadcast(values), len(values)
    columns = [f"{f}{x}" for x in names for f in ("total", "low", "high")]

    def of(found):
        table = sent.value
        for run in found:
            keys, sizes, buckets, first = _kept(*run, table[run[2], 0] != -np.inf)
            v = table[buckets]
            per = [f.reduceat(v, first, axis=0) if len(first) else v for f in (np.add, np.minimum, np.maximum)]
            out = [pa.array(per[j][:, k], from_pandas=True) for k in range(len(names)) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(sizes), *out], [*keep, "n", *columns])

    rows = mapped(docs, text, list(keep), n, of, f"n long, {', '.join(f'{c} double' for c in columns)}")
    met = [f(f"{c}{x}").alias(f"{c}{x}") for x in names for c, f in (("total", F.sum), ("low", F.min), ("high", F.max))]
    return rows.groupBy(*keep).agg(F.sum("n").alias("n"), *met)


def places(docs: DataFrame, text: str, wanted: np.ndarray, key: str) -> DataFrame:
    """key, pos and bucket of each token whose bucket is wanted."""
    sent, n = docs.sparkSession.sparkContext.broadcast(wanted), len(wanted)

    def of(found):
        for keys, sizes, buckets in found:
            some = np.flatnonzero(sent.value[buckets])
            at = np.repeat(np.arange(len(sizes)), sizes)[some]
            pos = some - (np.cumsum(sizes) - sizes)[at]
            yield pa.RecordBatch.from_arrays([keys[0].take(pa.array(at)), pa.array(pos), pa.array(buckets[some])], [key, "pos", "bucket"])

    return mapped(docs, text, [key], n, of, "pos long, bucket long")


def concentrations(docs: DataFrame, text: str, values: np.ndarray, labels: list[int], fraction: float, key: str) -> DataFrame:
    """ranking.concentration of the values of each text's tokens along each label. Texts of one key meet by a shuffle of texts."""
    sent, n = docs.sparkSession.sparkContext.broadcast(values), len(values)
    kinds = [pa.null(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def of_texts(found):
        """(key, buckets) of all texts of a key."""
        now, parts = None, []
        for keys, sizes, buckets in found:
            kinds[0] = keys[0].type
            for name, part in zip(keys[0].to_pylist(), np.split(buckets, np.cumsum(sizes)[:-1]), strict=True):
                if parts and name != now:
                    yield now, np.concatenate(parts)
                    parts = []
                now = name
                parts.append(part)
        if parts:
            yield now, np.concatenate(parts)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [key, "label", "n", "mass", "uniform", "peak"])

    def of(found):
        table, rows = sent.value, []
        for name, buckets in of_texts(found):
            v = table[buckets]
            v = v[v[:, 0] != -np.inf]
            if not len(v):
                continue
            v = np.sort(v - v.min(0), axis=0)
            size, k = len(v), max(1, ceil(len(v) * fraction))
            total, top = v.sum(0), v[-k:].sum(0)
            for j, label in enumerate(labels):
                if total[j] == total[j]:  # a label without vectors has no scores
                    flat = total[j] == 0
                    rows.append((name, label, size, 0.0 if flat else top[j] / total[j], k / size, 0.0 if flat else v[-1, j] / (total[j] / size)))
            if len(rows) >= 4096:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    met = docs.select(key, text).repartition(key).sortWithinPartitions(key)
    return mapped(met, text, [key], n, of, "label int, n long, mass double, uniform double, peak double")


def vector_totals(docs: DataFrame, text: str, vectors: np.ndarray, times: np.ndarray, eligible: Callable[[np.ndarray], np.ndarray], key: str) -> DataFrame:
    """key and vec: the sum of the vectors of each text's eligible tokens, and as its last element how many these are. A row for each text, also for a null.

    vectors: the sum of the vectors of each bucket, times: how many these are; eligible: of tokens' places, which count.
    """
    sent, n = docs.sparkSession.sparkContext.broadcast((vectors, times)), len(vectors)

    def of(found):
        table, many = sent.value
        for keys, sizes, buckets in found:
            pos = np.arange(len(buckets)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            some = np.flatnonzero(eligible(pos))
            left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
            total, texts = np.zeros((len(sizes), table.shape[1] + 1)), np.flatnonzero(left)
            if len(texts):
                first = (np.cumsum(left) - left)[texts]
                total[texts, :-1] = np.add.reduceat(table[buckets[some]], first, axis=0, dtype=float)
                total[texts, -1] = np.add.reduceat(many[buckets[some]], first)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([keys[0], flat], [key, "vec"])

    return mapped(docs, text, [key], n, of, "vec array<double>")


def pair_counts(docs: DataFrame, text: str, stops: tuple[str, ...], by: str) -> DataFrame:
    """by, bigram and n: how often two words of letters a to z are neighbours in texts in lower case, once stops are left out."""
    word, stop = re.compile("[a-z]+"), frozenset(stops)
    kinds = T.StructType([docs.schema[by], *T.StructType.fromDDL("bigram string, n long").fields])

    def batches_of(found: dict[object, Counter], kind: pa.DataType):
        for name, pairs in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(pairs), kind), pa.array([f"{a} {b}" for a, b in pairs], pa.string()), pa.array(pairs.values(), pa.int64())], [by, "bigram", "n"])
        found.clear()

    def of(batches):
        found, kind, held = {}, None, 0
        for batch in batches:
            names, texts, kind = batch.column(0), batch.column(1), batch.column(0).type
            for k in range(batch.num_rows):
                words = [x for x in word.findall(texts[k].as_py()) if x not in stop]
                pairs = found.setdefault(names[k].as_py(), Counter())
                held -= len(pairs)
                pairs.update(zip(words, words[1:]))
                held += len(pairs)
                if held >= PAIRS:
                    yield from batches_of(found, kind)
                    held = 0
        yield from batches_of(found, kind)

    rows = docs.where(F.col(text).isNotNull()).select(by, F.lower(text).alias(text))
    return rows.mapInArrow(of, kinds).groupBy(by, "bigram").agg(F.sum("n").alias("n"))
