"""Sums of vectors as an aggregate: arrays are added where they are read, so that a shuffle has a row a (task, group) and no row an element.

A task keeps the sums of the groups it has met, and hands them on early when they take more than HELD bytes; the partial sums of a group then
meet, sorted, in a stream that holds one group. So neither many groups nor a hot one need more room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD = 64 << 20


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float)


def vector_sums(rows: DataFrame, vector: str, *by: str, weight: Column | None = None) -> DataFrame:
    """by, n (sum of the weights, or how many vectors) and total (array<double>, the weighted sum) of each group.

    Vectors of a group have one length. Rows without a vector or a weight don't count; a group of only such rows has n 0 and a null total.
    """
    keys = [F.col(c) for c in by]
    some = F.col(vector).isNotNull()
    times = F.when(some, weight.cast("double") if weight is not None else F.lit(1.0))
    given = rows.select(*keys, F.coalesce(times, F.lit(0.0)).alias("__n"), F.when(times.isNotNull(), F.col(vector)).alias("__v"))
    schema = T.StructType([*given.select(*by).schema.fields, T.StructField("__n", T.DoubleType()), T.StructField("__v", T.ArrayType(T.DoubleType()))])
    k = len(by)

    def out(found: dict, kinds: pa.Schema) -> pa.RecordBatch:
        keys = [pa.array([key[j] for key in found], kinds.field(j).type) for j in range(k)]
        n = pa.array([n for n, _ in found.values()], pa.float64())
        total = pa.array([v for _, v in found.values()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*keys, n, total], [*by, "__n", "__v"])

    def batch_sums(batch: pa.RecordBatch, weighted: bool) -> Iterator[tuple[tuple, float, np.ndarray | None]]:
        """Key, n and sum of the groups of a batch, whose vectors are added run by run of equal keys."""
        columns = [c.to_pylist() for c in batch.columns[:k]]
        tuples = list(zip(*columns, strict=True)) if k else [()] * batch.num_rows
        code, names = pd.factorize(pd.Series(tuples, dtype=object)) if k else (np.zeros(batch.num_rows, int), [()])
        n = batch.column(k).to_numpy(zero_copy_only=False)
        whole = np.bincount(code, n, len(names))
        valid = np.flatnonzero(batch.column(k + 1).is_valid().to_numpy(zero_copy_only=False))
        sums: dict[int, np.ndarray] = {}
        vectors = batch.column(k + 1).take(pa.array(valid))
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            part = _flat(vectors.take(pa.array(own)) if len(own) < len(vectors) else vectors).reshape(len(own), length)
            if weighted:
                part = part * n[valid[own], None]
            order = np.argsort(code[valid[own]], kind="stable")
            at, first = np.unique(code[valid[own]][order], return_index=True)
            if length:
                for c, total in zip(at, np.add.reduceat(part[order], first, axis=0), strict=True):
                    if c in sums:
                        raise ValueError("vectors of a group differ in length")
                    sums[c] = total
        for c, name in enumerate(names):
            yield name, whole[c], sums.get(c)

    def add(found: dict, name: tuple, n: float, total: np.ndarray | None) -> int:
        before = found.get(name)
        if before is None:
            found[name] = (n, total)
            return 0 if total is None else total.nbytes
        found[name] = (before[0] + n, total if before[1] is None else before[1] if total is None else before[1] + total)
        return 0

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, kinds = {}, 0, None
        for batch in batches:
            kinds = batch.schema
            for name, n, total in batch_sums(batch, True):
                held += add(found, name, n, total) + 200
            if held > HELD:
                yield out(found, kinds)
                found, held = {}, 0
        if found:
            yield out(found, kinds)

    def wholly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kinds = {}, None
        for batch in batches:
            kinds = batch.schema
            for name, n, total in batch_sums(batch, False):
                add(found, name, n, total)
            if len(found) > 1:
                last = batch.num_rows - 1
                name = tuple(c[last].as_py() for c in batch.columns[:k])  # more of it may come
                rest = {name: found.pop(name)}
                if found:
                    yield out(found, kinds)
                found = rest
        if found:
            yield out(found, kinds)

    part = given.mapInArrow(partly, schema)
    met = part.repartition(*keys).sortWithinPartitions(*keys) if by else part.coalesce(1)
    return met.mapInArrow(wholly, schema).withColumnsRenamed({"__n": "n", "__v": "total"})


def mean_vectors(rows: DataFrame, vector: str, *by: str, weight: Column | None = None) -> DataFrame:
    """by, n and mean (array<double>; null where n is 0) of each group: the weighted sum over the sum of weights."""
    sums = vector_sums(rows, vector, *by, weight=weight)
    return sums.select(*by, "n", F.when(F.col("n") != 0, F.transform("total", lambda x: x / F.col("n"))).alias("mean"))


def masked_means(states: DataFrame, text: str, position: str, mask: Column, vector: str, start: int = 0) -> DataFrame:
    """text and mean: the mean vector of each text's valid tokens from the one with ordinal start on; null where there is none.

    states has a row a token. Ordinals count valid tokens by position, so padding on either side does not shift them. They are found from
    positions alone; vectors are not sorted.
    """
    valid = states.where(mask)
    places = valid.groupBy(text).agg(F.array_sort(F.collect_list(position)).alias("__p"))
    first = places.select(text, F.try_element_at("__p", F.lit(start + 1)).alias("__first"))
    eligible = states.join(first, text, "left").withColumn(vector, F.when(mask & (F.col(position) >= F.col("__first")), F.col(vector)))
    return mean_vectors(eligible, vector, text)


def as_rows(means: DataFrame, width: int | None = None, mean: str = "mean") -> DataFrame:
    """layer, dim and mu of each element, next to the other columns; width: elements of a layer (None: one layer)."""
    keep = [c for c in means.columns if c != mean]
    rows = means.select(*keep, F.posexplode(mean).alias("__at", "mu"))
    layer, dim = (F.floor(F.col("__at") / width), F.col("__at") % width) if width else (F.lit(0), F.col("__at"))
    return rows.withColumns({"layer": layer.cast("long"), "dim": dim.cast("long")}).drop("__at")
