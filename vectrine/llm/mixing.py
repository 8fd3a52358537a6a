"""Mixing sources to target weights, in DataFrame functions only.

Token shares of the sources are raised to an exponent and normalised (temperature mixing). The exponent is
bisected until the mix meets its target: the entropy of the weights as a share of the greatest possible,
or the most times that any document may be read. The weights and a token budget give each source a quota,
which is read as epochs, each its own permutation by hash; the last epoch ends where the quota does. The
sequence is cut into blocks of about BLOCK tokens; every block holds each source's share and is permuted.

Without a budget the least is taken at which every document is read once, so that nothing is left out and
small sources repeat.

A document's offset in its epoch is a prefix sum over three levels whose fan-out is the cube root of the
number of rows: no window holds more than about that many rows, even if one source holds most of them.

Nulls: a null source is a source of its own, a null text has no words, a null doc_id counts as an empty id.
Documents without words take no budget and keep their place in the permutations, those after the last word
of an epoch that the quota completes too. A source without any word has no share; its documents are read once,
dealt over the blocks by hash. Very long texts count as one document of many words and may overrun a quota.
Rows that repeat a doc_id stand side by side. Columns of any name may stand beside these. No rows in, no rows out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrine.llm.common import WORD, cut, located

BLOCK = 1 << 20
LEVELS = 30
STEP = 5


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_tokens(rows: DataFrame) -> DataFrame:
    """source and tokens of each source that has words."""
    return rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")


def evaluate(sources: DataFrame, total: int, budget: int | None, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent the relative entropy of the weights and the greatest number of repetitions."""
    a, p = F.col("a"), F.col("tokens") / F.lit(float(total))
    rows = (
        sources.select(p.alias("p"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        .withColumn("m", F.pow("p", a))
        .groupBy("a")
        .agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("z"), F.sum(F.col("m") * F.log("p")).alias("l"), F.max(F.col("m") / F.col("p")).alias("most"), F.min(F.col("m") / F.col("p")).alias("least"))
        .collect()  # a row an exponent
    )
    out = {}
    for r in rows:
        entropy = math.log(r.z) - r.a * r.l / r.z
        repeats = r.most / r.least if budget is None else r.most / r.z * budget / total
        out[r.a] = (entropy / math.log(r.k) if r.k > 1 else 1.0, repeats)
    return out


def solve_exponent(sources: DataFrame, total: int, budget: int | None = None, entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The least exponent from 0 to 1 that meets the target: entropy at most, or repetitions at most as given.

    Each job evaluates all midpoints of the next STEP levels of the bisection.
    """
    meets = (lambda e, r: e <= entropy) if entropy is not None else (lambda e, r: r <= max_repeats)
    low, high = 0.0, 1.0
    if meets(*evaluate(sources, total, budget, [low])[low]):
        return low
    for _ in range(LEVELS // STEP):
        n = 1 << STEP
        grid = [low + (high - low) * k / n for k in range(1, n)]
        values = evaluate(sources, total, budget, grid)
        a, b = 0, n
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if meets(*values[grid[mid - 1]]) else (mid, b)
        low, high = low + (high - low) * a / n, low + (high - low) * b / n
    return round(high, 6)


def _key(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("")) for x in parts]), 256)


def schedule(docs: DataFrame, budget: int | None = None, entropy: float | None = None, max_repeats: float | None = 2.0, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block and position (from 0, within the block), a row for each reading of a document."""
    return placed(docs, budget, entropy, max_repeats, block, seed)[0]


def placed(docs: DataFrame, budget: int | None = None, entropy: float | None = None, max_repeats: float | None = 2.0, block: int = BLOCK, seed: int = 0, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The schedule's rows with the columns keep of docs, and a row of source, tokens and quota for each source.

    keep also orders rows that agree in their hash and doc_id.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text")).alias("n_tokens"), *keep))
    sources = cut(source_tokens(rows))
    every = sources.unionByName(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens = 0"))
    total, largest = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    share = F.lit(0.0)
    if total:
        exponent = solve_exponent(sources, total, budget, entropy, max_repeats)
        power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent))
        weight_sum = sources.agg(F.sum(power)).first()[0]
        if budget is None:  # the largest source has the greatest share a weight
            budget = largest / ((largest / total) ** exponent / weight_sum)
        share = power / F.lit(weight_sum) * F.lit(float(budget))
    quotas = every.select("source", "tokens", F.when(F.col("tokens") > 0, F.floor(share + 0.5)).otherwise(0).cast("long").alias("quota"))
    blocks = max(1, math.ceil((budget or 0) / block))
    fan = max(1, math.ceil(rows.count() ** (1 / 3)))

    # a join on a few keys: quotas is one row a source, and AQE splits a source that holds a large part of the rows
    same = F.col("source").eqNullSafe(F.col("__source"))
    epochs = F.sequence(F.lit(0).cast("long"), F.coalesce(F.try_divide("quota", "tokens"), F.lit(0.0)).cast("long"))
    read = rows.join(quotas.withColumnRenamed("source", "__source"), same).drop("__source").withColumn("epoch", F.explode(epochs))
    read = read.withColumn("h", _key(F.lit(str(seed)), "epoch", "doc_id"))
    u = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    read = read.withColumns({"u": u, "b1": F.floor(u * fan / F.lit(2.0**32)), "b2": F.floor(u * (fan * fan) / F.lit(2.0**32))})
    # null sources need a value to be joined by
    read = read.withColumn("s", F.concat_ws("", F.when(F.col("source").isNull(), "0").otherwise("1"), F.col("source")))
    leaf = W.partitionBy("s", "epoch", "b1", "b2").orderBy("h", "doc_id", *keep, "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    before = lambda by, order: F.coalesce(F.sum("t").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = cut(read.groupBy("s", "epoch", "b1", "b2").agg(F.sum("n_tokens").alias("t")))
    middle = totals.withColumn("in_b1", before(("s", "epoch", "b1"), "b2")).drop("t")
    top = totals.groupBy("s", "epoch", "b1").agg(F.sum("t").alias("t")).withColumn("in_epoch", before(("s", "epoch"), "b1")).drop("t")
    offsets = middle.join(top, ["s", "epoch", "b1"]).select("s", "epoch", "b1", "b2", (F.col("in_b1") + F.col("in_epoch")).alias("bucket_at"))
    # documents without words after the last word of an epoch lie at the quota that this epoch completes
    last = (F.col("n_tokens") == 0) & (F.col("at") == F.col("quota")) & ((F.col("epoch") + 1) * F.col("tokens") == F.col("quota"))
    along = F.when(F.col("tokens") > 0, F.floor(F.try_divide(F.col("at").cast("double") * F.lit(float(blocks)), F.col("quota").cast("double")))).otherwise(F.floor(F.col("u") * blocks / F.lit(2.0**32)))
    out = (
        read.withColumn("in_bucket", F.coalesce(F.sum("n_tokens").over(leaf), F.lit(0)))
        .join(offsets, ["s", "epoch", "b1", "b2"])
        .withColumn("at", F.col("epoch") * F.col("tokens") + F.col("bucket_at") + F.col("in_bucket"))
        .where((F.col("at") < F.col("quota")) | last)
        .withColumn("block", F.least(along, F.lit(blocks - 1)).cast("long"))
    )
    inside = W.partitionBy("block").orderBy(_key(F.lit(str(seed)), "block", "epoch", "doc_id"), "source", "n_tokens")
    return out.withColumn("position", F.row_number().over(inside).cast("long") - 1).select("doc_id", "source", "n_tokens", *keep, "epoch", "block", "position"), quotas


#: Sources up to which their reading is broadcast: a row of some 300 bytes each.
FEW = 50_000


def mixed(docs: DataFrame, seed: int = 0, **target) -> DataFrame:
    """The rows of docs, each as often as the schedule reads it, with the columns of docs.

    A source is read whole some times; of the epoch that its quota ends in, it is read up to one place of that
    epoch's permutation. So each row can tell how often it is read from a row of its source; no text is shuffled.
    """
    names = docs.columns
    rows = located(docs)
    at, quotas = placed(rows, seed=seed, keep=("__file", "__row"), **target)
    whole = F.when(F.col("tokens") > 0, F.floor(F.try_divide("quota", "tokens"))).otherwise(1)
    quotas = quotas.select(F.col("source").alias("__source"), whole.cast("long").alias("__whole"))
    place = F.struct(F.col("__h"), F.col("__id"), "__file", "__row")
    ends = at.withColumns({"__h": _key(F.lit(str(seed)), "epoch", "doc_id"), "__id": F.col("doc_id")})
    same = F.col("source").eqNullSafe(F.col("__source"))
    ends = ends.join(quotas, same).where("epoch = __whole").groupBy("source").agg(F.max(place).alias("__end"))
    reading = cut(quotas.join(ends, same, "left").drop("source"))
    small = reading.count() <= FEW
    rows = rows.join(F.broadcast(reading) if small else reading, F.col("source").cast("string").eqNullSafe(F.col("__source")))
    rows = rows.withColumns({"__id": F.col("doc_id").cast("long"), "__h": _key(F.lit(str(seed)), "__whole", F.col("doc_id").cast("long"))})
    times = F.col("__whole") + F.coalesce(place <= F.col("__end"), F.lit(False)).cast("long")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*names)


ORACLE = r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
    g AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
    s AS (SELECT * FROM g WHERE tokens > 0),
    a AS (SELECT sum(tokens)::DOUBLE AS total, max(tokens)::DOUBLE AS largest,
                 round(CASE WHEN max(tokens) <= {repeats} * min(tokens) THEN 0 ELSE 1 - ln({repeats}) / ln(max(tokens)::DOUBLE / min(tokens)) END, 6) AS e FROM s),
    z AS (SELECT sum(pow(tokens / total, e)) AS z FROM s, a),
    b AS (SELECT largest / (pow(largest / total, e) / z) AS budget FROM a, z),
    q AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN floor(pow(tokens / total, e) / z * budget + 0.5)::BIGINT ELSE 0 END AS quota, coalesce(greatest(1, ceil(budget / {block})), 1) AS blocks FROM g, a, z, b),
    r AS (SELECT doc_id, d.source, n_tokens, tokens, quota, blocks, unnest(range(0, coalesce(quota // nullif(tokens, 0), 0) + 1)) AS epoch FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
    h AS (SELECT *, sha256('0|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')) AS h FROM r),
    o AS (SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM h),
    k AS (SELECT *, least(CASE WHEN tokens > 0 THEN floor(pos::DOUBLE * blocks / quota) ELSE floor(('0x' || substr(h, 1, 8))::BIGINT * blocks / 4294967296.0::DOUBLE) END, blocks - 1)::BIGINT AS block
          FROM o WHERE pos < quota OR (n_tokens = 0 AND pos = quota AND (epoch + 1) * tokens = quota))
    SELECT doc_id, source, n_tokens, epoch, block,
           row_number() OVER (PARTITION BY block ORDER BY sha256('0|' || block || '|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')), source, n_tokens) - 1 AS position FROM k"""


def oracle(repeats: float = 2.0, block: int = BLOCK) -> str:
    """The schedule in DuckDB SQL; the exponent that bisection finds for a repetition limit has a closed form."""
    return ORACLE.format(repeats=repeats, block=block)
