"""A hidden Markov language model: Baum-Welch over partitions, exact likelihood by the scaled forward recursion.

States emit word classes, and classes emit words: P(w | s) = P(class | s) * P(w | class). The most
frequent training words, TOP at most, are classes of their own; other words share SUFFIXES classes by the hash of their
last three bytes, and within these a word has (c + 1) / (C + V + 1), with its own count c, the class's count
C and its V distinct words, so that words never seen keep a share. The end of a text is a class and a token.
So the model has a fixed number of parameters, while the word counts behind it grow with the corpus: they
are kept as a table, and rare words get theirs by a join, never by a broadcast.

For training, texts are cut into sequences of SEGMENT tokens. Baum-Welch starts from a few rounds over about SAMPLE
of these, 512 bytes each, and goes on over the whole training set; each task gives expected counts by class, which
are summed in a shuffle. The sample is chosen and ordered by hashes of ids and content, so that other partitions
of the same rows give the same model but for the order of sums. Scores come from the forward recursion over whole texts.

Nulls: a null text is empty and is scored as its end alone. A null doc_id hashes as an empty text. Repeated
rows count as often as they come and score alike. A very long text takes some fifty times its size in its task. Without
training rows the counts are 0 and every score is that of an even mix. Without rows there is no result. Columns of
other names, also those of the result, don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.llm.common import cut, remove, shared_path

STATES = 8
TOP = 57_000
SUFFIXES = 8_192
END = TOP + SUFFIXES
CLASSES = END + 1
SEGMENT = 256
GROUP = 2048
#: Sequences of the first rounds.
SAMPLE = 6_000
#: Weight of the class shares of all states together in each state's.
SMOOTH = 50.0


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(7)) == 2


def rare_class(word: bytes) -> int:
    return TOP + zlib.crc32(word[-3:]) % SUFFIXES


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary) and c over the texts of docs; each task counts before it shuffles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                seen.update(text.as_py().lower().split())
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Frequent words with their classes and counts, and the totals of all classes."""

    def __init__(self, frequent: list[tuple[bytes, int]], suffixes: dict[int, tuple[int, int]], ends: int):
        self.number = {w: k for k, (w, _) in enumerate(frequent)}
        self.log_c = np.zeros(CLASSES)  # log10(c + 1) of classes that are one word
        self.within = np.zeros(CLASSES)  # log10 of the share of what is seen once in a class of many words, less that log10(c + 1)
        self.count = np.zeros(CLASSES)
        for k, (_, c) in enumerate(frequent):
            self.log_c[k], self.count[k] = math.log10(c + 1), c
        self.log_c[END], self.count[END] = math.log10(ends + 1), ends
        for k in range(TOP, END):
            c, v = suffixes.get(k, (0, 0))
            self.count[k], self.within[k] = c, -math.log10(c + v + 1)

    def share(self) -> np.ndarray:
        return (self.count + 1) / (self.count.sum() + CLASSES)


def gathered(counts: DataFrame, documents: int) -> tuple[Vocabulary, int, int]:
    """The vocabulary of bounded size, and N and V of all counts, the end token among them."""
    # sizes of bands of like counts give the count from which on at most TOP words remain; only these are fetched
    band = F.floor(F.log("c") * 64)
    least, room = None, TOP
    for r in counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("band")).collect():  # some 2,000 rows at most
        room -= r.n
        if room < 0:
            break
        least = r.band
    often = band >= (F.lit(least) if least is not None else F.lit(1 << 30))
    frequent = sorted(((bytes(r.word), r.c) for r in counts.where(often).collect()), key=lambda x: (-x[1], x[0]))
    rare = counts.where(~often)
    suffix = F.pmod(F.crc32(F.when(F.octet_length("word") > 3, F.expr("substring(word, -3, 3)")).otherwise(F.col("word"))), F.lit(SUFFIXES)) + TOP
    classes = rare.groupBy(suffix.cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # SUFFIXES rows at most
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    return Vocabulary(frequent, {r.k: (r.c, r.v) for r in classes}, documents), (n or 0) + documents, v + (documents > 0)


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, held_out, n_tokens, classes (packed), plain, known, within and rare: what each text needs to be scored.

    plain: the sum of log10(c + 1) of frequent tokens; within: that of the classes' shares; rare: other words with their numbers.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # TOP words

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = held.value
        number, known_end = voc.number, voc.count[END] > 0
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                n, packed, plain, known, within, words, times, offsets = [], [], [], [], [], [], [], [0]
                for text in part.column(2).cast(pa.binary()):
                    tokens = text.as_py().lower().split()
                    rare: Counter[bytes] = Counter()
                    classes = [number.get(w, -1) for w in tokens]
                    if -1 in classes:
                        for k, c in enumerate(classes):
                            if c < 0:
                                rare[tokens[k]] += 1
                                classes[k] = rare_class(tokens[k])
                    ids = np.array([*classes, END], np.uint16)
                    n.append(len(ids))
                    packed.append(ids.tobytes())
                    plain.append(float(voc.log_c[ids].sum()))
                    within.append(float(voc.within[ids].sum()))
                    known.append(len(tokens) - rare.total() + int(known_end))
                    words += rare.keys()
                    times += rare.values()
                    offsets.append(len(words))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int32())], ["word", "n"]))
                columns = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(packed, pa.binary()), pa.array(plain), pa.array(known, pa.int64()), pa.array(within), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "classes", "plain", "known", "within", "rare"])

    schema = "doc_id long, held_out boolean, n_tokens long, classes binary, plain double, known long, within double, rare array<struct<word: binary, n: int>>"
    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, schema)


class Model:
    """start and mean (state shares at a text's begin and overall), move (from, to) and emit (class, state)."""

    def __init__(self, start, mean, move, emit):
        self.start, self.mean, self.move, self.emit = (np.asarray(x, np.float32) for x in (start, mean, move, emit))

    @classmethod
    def first(cls, share: np.ndarray, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        emit = share[:, None] * rng.gamma(0.7, 1.0, (CLASSES, STATES))
        even = np.full(STATES, 1 / STATES)
        return cls(even, even, np.full((STATES, STATES), 0.05 / STATES) + 0.95 * np.eye(STATES), emit / emit.sum(0))

    @classmethod
    def fitted(cls, counts: Counts, share: np.ndarray) -> Model:
        emit = counts.emit + SMOOTH * share[:, None]
        start, move, mean = counts.start + 0.1, counts.move + 0.1, counts.emit.sum(0) + 1
        return cls(start / start.sum(), mean / mean.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Counts:
    """Expected counts."""

    def __init__(self):
        self.start, self.move, self.emit, self.log = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES)), 0.0


def segments(packed: list[bytes]) -> list[tuple[np.ndarray, bool]]:
    """Sequences of at most SEGMENT tokens, and whether each begins its text."""
    texts = [np.frombuffer(p, np.uint16) for p in packed]
    return [(t[k : k + SEGMENT], k == 0) for t in texts for k in range(0, len(t), SEGMENT)]


def expect(model: Model, sequences: list[tuple[np.ndarray, bool]], into: Counts) -> None:
    """Add the sequences' expected counts, by the scaled forward and backward recursions."""
    sequences = sorted(sequences, key=lambda s: -len(s[0]))
    for k in range(0, len(sequences), GROUP):
        group = sequences[k : k + GROUP]
        sizes = np.array([len(s) for s, _ in group])
        length = int(sizes[0])
        ids = np.full((len(group), length), END, np.int64)
        for row, (s, _) in enumerate(group):
            ids[row, : len(s)] = s
        active = np.searchsorted(-sizes, -np.arange(length), "left")  # how many go beyond each step
        begins = np.array([b for _, b in group])
        alpha, out, scale = [], [], []
        now = np.where(begins[:, None], model.start, model.mean)
        for t in range(length):
            n = active[t]
            e = model.emit[ids[:n, t]]
            now = (now if t == 0 else now[:n] @ model.move) * e
            c = np.maximum(now.sum(1, keepdims=True), 1e-30)
            now = now / c
            alpha.append(now)
            out.append(e)
            scale.append(c)
        into.log += sum(float(np.log(c, dtype=np.float64).sum()) for c in scale)
        beta = np.ones((active[-1], STATES), np.float32)
        gammas = [alpha[-1] * beta]
        for t in range(length - 2, -1, -1):
            n = active[t + 1]
            ahead = out[t + 1] * beta / scale[t + 1]
            into.move += alpha[t][:n].T @ ahead * model.move
            beta = np.ones((active[t], STATES), np.float32)
            beta[:n] = ahead @ model.move.T
            gammas.append(alpha[t] * beta)
        into.start += gammas[-1][begins].sum(0)
        flat = np.concatenate([ids[: active[t], t] for t in range(length - 1, -1, -1)])
        gamma = np.concatenate(gammas)
        for s in range(STATES):
            into.emit[:, s] += np.bincount(flat, gamma[:, s], CLASSES)


def pass_over(rows: DataFrame, model: Model) -> Counts:
    """Expected counts over all rows' classes: each task's by class, summed in a shuffle."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = Counts(), False
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                expect(held.value, segments(batch.column(0).slice(k, 2000).to_pylist()), counts)
                some = True
        if some:
            every = np.concatenate([counts.emit, counts.move, counts.start[None], np.full((1, STATES), counts.log)])
            rows = np.flatnonzero(every.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *(pa.array(every[rows, s]) for s in range(STATES))], ["k", *(f"s{s}" for s in range(STATES))])

    columns = [f"s{s}" for s in range(STATES)]
    summed = rows.select("classes").mapInArrow(count, "k long, " + ", ".join(f"{c} double" for c in columns)).groupBy("k").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()  # CLASSES + STATES + 2 rows
    every = np.zeros((CLASSES + STATES + 2, STATES))
    every[summed["k"].to_numpy()] = summed[columns].to_numpy()
    counts = Counts()
    counts.emit, counts.move, counts.start, counts.log = every[:CLASSES], every[CLASSES : CLASSES + STATES], every[-2], float(every[-1, 0])
    return counts


def first_sequences(rows: DataFrame, most: int = SAMPLE) -> list[tuple[np.ndarray, bool]]:
    """About most sequences of rows (doc_id and classes), the same for any partitions; no more than 512 bytes each are fetched."""
    n = F.ceil(F.octet_length("classes") / (2 * SEGMENT)).cast("long")
    total = rows.agg(F.sum(n)).first()[0] or 0
    share = most / max(1, total)
    # one hash a text, a step for each of its sequences
    h = F.xxhash64(F.xxhash64("doc_id", "classes"), "k")
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("h", h)
    each = each.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    part = F.expr(f"substring(classes, int(k * {2 * SEGMENT} + 1), {2 * SEGMENT})")
    found = sorted((r.h, bytes(r.part), r.k == 0) for r in each.select("h", "k", part.alias("part")).collect())
    return [(np.frombuffer(part, np.uint16), begins) for _, part, begins in found]


def fit(rows: DataFrame, share: np.ndarray, early: int = 15, passes: int = 3) -> Model:
    """Baum-Welch: early rounds over a sample of sequences, then passes over all rows (doc_id and classes of the training set)."""
    sample = first_sequences(rows)
    model = Model.first(share)
    if not sample:
        return model
    for _ in range(early):
        counts = Counts()
        expect(model, sample, counts)
        model = Model.fitted(counts, share)
    for _ in range(passes):
        model = Model.fitted(pass_over(rows, model), share)
    return model


def likelihoods(model: Model, packed: list[bytes]) -> np.ndarray:
    """log10 of the probability of each whole class sequence."""
    texts = [np.frombuffer(p, np.uint16) for p in packed]
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[k]) for k in order])
    flat = np.concatenate([texts[k] for k in order]) if len(texts) else np.zeros(0, np.uint16)
    at = np.cumsum(sizes) - sizes
    total = np.zeros(len(texts))
    move, emit = model.move.astype(np.float64), model.emit
    now = np.repeat(model.start[None].astype(np.float64), len(texts), 0)
    n = len(texts)
    for t in range(int(sizes[0]) if n else 0):
        while sizes[n - 1] <= t:
            n -= 1
        now = (now[:n] if t == 0 else now[:n] @ move) * emit[flat[at[:n] + t]]
        c = now.sum(1)
        now /= c[:, None]
        total[:n] += np.log10(c)
    out = np.empty(len(texts))
    out[order] = total
    return out


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    train = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    counts = cut(word_counts(train))
    vocabulary, n, v = gathered(counts, train.count())
    path = shared_path(spark, "classes")
    encoded(docs, vocabulary).withColumn("rid", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    model = fit(rows.where("not held_out").select("doc_id", "classes"), vocabulary.share())
    held = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = likelihoods(held.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(k) for k in range(2, 8)), pa.array(value)], ["rid", "doc_id", "held_out", "n_tokens", "plain", "known", "within", "value"])

    texts = rows.select("rid", "classes", "doc_id", "held_out", "n_tokens", "plain", "known", "within").mapInArrow(
        score, "rid long, doc_id long, held_out boolean, n_tokens long, plain double, known long, within double, value double"
    )
    rare = (
        rows.select("rid", F.explode("rare").alias("r"))
        .select("rid", "r.word", "r.n")
        .join(counts, "word")
        .groupBy("rid")
        .agg(F.sum("n").alias("seen"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"))
    )
    per_token = F.lit(math.log10(n + v + 1))
    seen, rare_log = F.coalesce("seen", F.lit(0)), F.coalesce("rare_log", F.lit(0.0))
    out = cut(
        texts.join(rare, "rid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + seen).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("plain") + rare_log - F.col("n_tokens") * per_token).alias("base_score"),
            (F.col("value") + F.col("within") + rare_log).alias("score"),
        )
    )
    remove(spark, path)
    return out
