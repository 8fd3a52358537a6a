"""Drawn noise as Column expressions: normal values from hashes of a seed, a key and a counter, the same whatever the layout, and in SQL too."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vectrine.functions import vectors as V


def gaussians(seed: int, key: Column, n: int | Column) -> Column:
    """n independent standard normal values. Each hash gives eight: four pairs of 32-bit uniforms, by the Box-Muller transform."""
    n = F.lit(n) if isinstance(n, int) else n
    part = lambda h, k: (F.conv(F.substring(h, k, 8), 16, 10).cast("double") + 0.5) / 4294967296.0

    def eight(block: Column) -> Column:
        h = F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), block.cast("string")), 256)
        pair = lambda k: (F.sqrt(-2 * F.log(part(h, 16 * k + 1))), 2 * F.pi() * part(h, 16 * k + 9))
        return F.array(*[f(angle) * size for k in range(4) for size, angle in [pair(k)] for f in (F.cos, F.sin)])

    blocks = F.sequence(F.lit(0), F.ceil(n / 8).cast("int") - 1)
    return F.when(n > 0, F.slice(F.flatten(F.transform(blocks, eight)), F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<double>"))


def random_unit(seed: int, key: Column, n: int | Column) -> Column:
    """A direction that is uniform over the sphere."""
    return V.unit(gaussians(seed, key, n))


def perturbed(v: Column, noise: Column, share: float) -> Column:
    """sqrt(1 - share^2) v + share y, where y is the noise made orthogonal to v and as long as v."""

    @F.pandas_udf("array<double>")
    def moved(vectors: pd.Series, noises: pd.Series) -> pd.Series:
        out = []
        for x, z in zip(vectors, noises, strict=True):
            x, z = np.asarray(x, float), np.asarray(z, float)
            y = z - (z @ x) / (x @ x) * x
            out.append((1 - share * share) ** 0.5 * x + share * np.linalg.norm(x) / np.linalg.norm(y) * y)
        return pd.Series(out, dtype=object)

    return moved(v, noise)


def subspace_share(target: Column, basis: Column) -> Column:
    """The share of a vector's square length in the span of others (array of arrays), by an orthogonal basis; null for a zero vector."""
    @F.pandas_udf("double")
    def share(targets: pd.Series, bases: pd.Series) -> pd.Series:
        out = []
        for t, rows in zip(targets, bases, strict=True):
            t = np.asarray(t, float)
            q = np.linalg.qr(np.array([*rows], float).T)[0]
            out.append(float(((q.T @ t) ** 2).sum() / (t @ t)) if t @ t > 0 else None)
        return pd.Series(out, dtype="float64")

    return share(target, basis)


def sql_gaussian(seed: int, key: str, j: str) -> str:
    """DuckDB SQL for element j (from 0) of gaussians(seed, key, n)."""
    h, k = f"sha256('{seed}:' || {key} || ':' || ({j}) // 8)", f"({j}) % 8 // 2"
    u = lambda at: f"(('0x' || substr({h}, 16 * ({k}) + {at}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296"
    return f"(sqrt(-2 * ln({u(1)})) * CASE WHEN ({j}) % 2 = 0 THEN cos(2 * pi() * {u(9)}) ELSE sin(2 * pi() * {u(9)}) END)"
