"""Weak supervision of text quality.

Ten rules look at counts taken from each whole text and vote good, bad, or abstain. Expectation-maximisation
over the votes estimates, for either class, how often each rule gives each vote, without any labels. The
posterior probability that a document is good then takes the place of an all-must-pass filter: a rule that is
often wrong is outvoted by others, and a document that hardly any rule praises may go without a bad vote.

The votes of a document are one pattern number; all that estimation needs is how often each pattern occurs,
at most 3 ** 10 = 59,049 rows however large the corpus is.

Nulls: a null text has no words and counts as empty; its doc_id is kept as it is. Without rows there are no
patterns and no result rows. Rows that repeat get equal results. A very long text is counted whole, in memory of
some thirty times its size. Columns of other names, also of those of the results, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.llm.common import cut

GOOD, ABSTAIN, BAD = 2, 1, 0
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_ended long, n_upper long, n_alpha long, n_distinct long, n_exclaims long"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_HIGH = bytes(range(128, 256))
_SYMBOLS = b"#*$%&|<>"
_ENDS = (b".", b"?", b"!", b'"', b":", b";", "…".encode(), "”".encode(), "»".encode())


def repeat_words(ids: np.ndarray) -> int:
    """How many positions lie in a window of three words that is found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    size = int(ids.max()) + 1
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # three ids would not fit in 64 bits
        _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        twice[starts + k] = True
    return int(twice.sum())


def counts(raw: bytes) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8."""
    words = raw.split()
    n = len(words)
    packed = b"".join(words)
    # continuation bytes are not code points
    chars = len(packed.translate(None, bytes(range(128, 192))))
    symbols = len(packed) - len(packed.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = ended = 0
    for line in raw.split(b"\n"):
        bare = line.rstrip()
        if bare:
            lines += 1
            ended += bare.endswith(_ENDS)
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    upper = len(packed) - len(packed.translate(None, _UPPER))
    rest = len(packed.translate(None, _UPPER + _LOWER + _HIGH))
    return n, chars, symbols, dup, repeat_words(ids), lines, ended, upper, len(packed) - rest, len(numbers), packed.count(b"!")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in COUNTS.split(", ")]
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            table = np.array([counts(t.as_py()) for t in texts], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(len(names)))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, f"doc_id long, {COUNTS}")


def _vote(value, bad, good=None):
    """A null value abstains, and so does one that neither condition holds for."""
    vote = F.when(value.isNull(), ABSTAIN).when(bad(value), BAD)
    return (vote.when(good(value), GOOD) if good else vote).otherwise(ABSTAIN)


def rules() -> list:
    """The votes, as columns over COUNTS; a share without a denominator is null and abstains.

    Between what a rule calls bad and what it calls good it abstains.
    """
    words, lines = F.col("n_words"), F.col("n_lines")
    per = lambda a, b: F.try_divide(F.col(a), F.col(b))
    if_words = lambda n, v: F.when(words >= n, v)
    return [
        _vote(words, lambda v: v < 20, lambda v: v >= 100),
        _vote(per("n_repeat_words", "n_words"), lambda v: v > 0.15, lambda v: v < 0.02),
        _vote(per("n_symbols", "n_words"), lambda v: v > 0.1, lambda v: v < 0.01),
        _vote(F.when(lines >= 3, per("n_dup_lines", "n_lines")), lambda v: v > 0.2, lambda v: v == 0),
        _vote(if_words(20, per("word_chars", "n_words")), lambda v: (v < 4.3) | (v > 6), lambda v: (v > 4.7) & (v < 5.6)),
        _vote(per("n_upper", "n_alpha"), lambda v: v > 0.1, lambda v: v < 0.03),
        _vote(per("n_alpha", "word_chars"), lambda v: v < 0.9, lambda v: v > 0.95),
        _vote(if_words(50, per("n_distinct", "n_words")), lambda v: v < 0.5, lambda v: v > 0.65),
        _vote(if_words(20, per("n_ended", "n_lines")), lambda v: v < 0.7, lambda v: v >= 0.95),
        _vote(per("n_exclaims", "n_words"), lambda v: v > 0.1, lambda v: v == 0),
    ]


#: What is held of any rule before documents are seen, by class (bad, good) and vote (bad, abstain, good), and how many documents that is worth.
BEFORE = np.array([[0.35, 0.3, 0.35], [0.02, 0.2, 0.78]])
WORTH = 20.0
PRIOR = np.array([0.2, 0.8])


def estimate(patterns: np.ndarray, weights: np.ndarray, n_rules: int, passes: int = 300) -> np.ndarray:
    """Posterior probability of good for each pattern.

    Two classes; given the class, the rules vote independently. Votes alone do not name the classes: BEFORE does,
    in place of WORTH documents of either class, alike for all rules. Beyond that nothing holds the estimates.
    """
    votes = patterns[:, None] // 3 ** np.arange(n_rules) % 3
    hot = np.eye(3)[votes]  # pattern, rule, vote
    given = np.repeat(BEFORE[:, None, :], n_rules, 1)
    prior, good = PRIOR, np.full(len(patterns), 0.5)
    for _ in range(passes):
        log = np.log(prior)[:, None] + np.einsum("prv,crv->cp", hot, np.log(given))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        done = np.abs(new - good).max() < 1e-10
        good = new
        if done:
            break
        mass = np.stack([(1 - good) * weights, good * weights])
        prior = (mass.sum(1) + WORTH * PRIOR) / (mass.sum() + WORTH)
        given = (np.einsum("cp,prv->crv", mass, hot) + WORTH * BEFORE[:, None, :]) / (mass.sum(1) + WORTH)[:, None, None]
    return good


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, base_failed, quality (posterior probability of good) and kept of each document."""
    spark = docs.sparkSession
    votes = rules()
    pattern = sum((v * 3**k for k, v in enumerate(votes)), F.lit(0)).cast("int")
    rows = cut(measured(docs).withColumn("pattern", pattern))
    seen = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toPandas()
    quality = estimate(seen["pattern"].to_numpy(np.int64), seen["n"].to_numpy(float), len(votes)) if len(seen) else np.array([])
    table = spark.createDataFrame([(int(p), float(q)) for p, q in zip(seen["pattern"], quality, strict=True)], "pattern int, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        rows.join(F.broadcast(table), "pattern")  # 59,049 rows at most
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
        .drop("pattern")
    )
