"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its hash and the scaled sum of the embeddings of its character 5-
and 8-grams (of UTF-8 bytes), so that unseen forms of known words are recognised. Both directions read windows of LENGTH words
that overlap by half; attention pools the states of a window into one score. A document's score is that of
its highest window, over all windows of the whole text.

Training takes at most SAMPLE labelled documents of either class, those with the least hash of their id, and of
these no more than SAMPLE_BYTES / 2 of text a class: both bounds are parameters of what the driver fetches.
Labels are given to documents, not windows: at first the windows with the most telling n-grams stand for
their documents, later those that the network itself scores highest. Telling words are also set into windows
of clean documents, so that a few labels suffice. At the end the scores are shifted so that THRESHOLD is where
the two classes part best. Embeddings of whole words are dropped
at random, so that the network learns to read characters. Everything is seeded; equal input gives equal scores.

Nulls: a null text is empty, and an empty text scores 0. A null doc_id is hashed as an empty text and has no
label. Without labelled documents of both classes all scores are 0. Labels that are null or of
unknown documents are left out; of rows that repeat a doc_id the least text is learnt from. Repeated rows score alike.
A very long text is scored window by window, in memory of some twenty times its size. Other columns of docs stay;
one that has the name of the result is replaced by it. Without documents there are no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrine.llm.common import batched, cut, release

SAMPLE = 1500
SAMPLE_BYTES = 1 << 26
LENGTH, STRIDE = 24, 12
WORD_BUCKETS, WORD_DIM = 1 << 16, 8
GRAM_BUCKETS, GRAM_DIM = 1 << 17, 12
HIDDEN = 8
GRAMS = (5, 8)
#: Buckets in which n-grams are counted; with as few as the network has, common n-grams would share those of telling ones.
TELL_BUCKETS = 1 << 20
THRESHOLD = 0.7
#: Words whose inputs a Python worker keeps.
KNOWN = 60_000
_STRIP = b".,;:!?\"'()[]{}<>#*$%&|-_"


def bare(word: bytes) -> bytes:
    return word.strip(_STRIP) or word


class Inputs:
    """Buckets of words: word hash, and character n-grams of all words one after another."""

    def __init__(self, words: list[bytes], buckets: int = GRAM_BUCKETS):
        stripped = [bare(w) for w in words]
        self.word = np.fromiter((zlib.crc32(w) & (WORD_BUCKETS - 1) for w in stripped), np.int64, len(words))
        padded = [b"<" + w + b">" * max(1, GRAMS[-1] - 1 - len(w)) for w in stripped]
        sizes = np.fromiter(map(len, padded), np.int64, len(words))
        raw = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        left = np.repeat(ends, sizes) - np.arange(len(raw))  # bytes from here to the word's end
        self.grams, self.owner = [], []
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) ^ raw[at + k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(12)
            self.grams.append((h & np.uint32(buckets - 1)).astype(np.int32))
            self.owner.append(owner[at].astype(np.int32))
        self.scale = (1 / np.sqrt(np.bincount(np.concatenate(self.owner), minlength=len(words)))).astype(np.float32) if words else np.zeros(0, np.float32)

    def vectors(self, p: dict) -> np.ndarray:
        n = len(self.word)
        out = np.zeros((n, WORD_DIM + GRAM_DIM), np.float32)
        if not n:
            return out
        out[:, :WORD_DIM] = p["word"][self.word]
        for grams, owner in zip(self.grams, self.owner, strict=True):
            out[:, WORD_DIM:] += np.add.reduceat(p["gram"][grams], np.searchsorted(owner, np.arange(n)))
        out[:, WORD_DIM:] *= self.scale[:, None]
        return out


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    make = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    d = WORD_DIM + GRAM_DIM
    return {
        "word": make(0.1, WORD_BUCKETS, WORD_DIM), "gram": make(0.1, GRAM_BUCKETS, GRAM_DIM),
        "x": make(d**-0.5, d, 6 * HIDDEN), "x0": np.zeros(6 * HIDDEN, np.float32), "h": make(HIDDEN**-0.5, 2, HIDDEN, 3 * HIDDEN),
        "look": make(0.3, 2 * HIDDEN), "out": make(0.3, 2 * HIDDEN), "out0": np.full(1, -1.0, np.float32),
    }


def forward(p: dict, projected: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """Logits of windows of word numbers; with keep also what the backward pass needs."""
    n, length = index.shape
    H = HIDDEN
    h = np.zeros((2, n, H), np.float32)
    states = np.empty((length, 2, n, H), np.float32)
    tape = []
    for t in range(length):
        x = np.stack([projected[index[:, t], : 3 * H], projected[index[:, length - 1 - t], 3 * H :]])
        g = np.matmul(h, p["h"])
        rz = _sigmoid(x[:, :, : 2 * H] + g[:, :, : 2 * H])
        r, z = rz[:, :, :H], rz[:, :, H:]
        new = np.tanh(x[:, :, 2 * H :] + r * g[:, :, 2 * H :])
        if keep:
            tape.append((h, g, r, z, new))
        h = new + z * (h - new)
        states[t] = h
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # step, window, 2H
    look = both @ p["look"]
    if mask is not None:
        look = np.where(mask.T, look, np.float32(-1e9))
    look -= look.max(0)
    a = np.exp(look)
    a /= a.sum(0)
    pooled = np.einsum("tn,tnh->nh", a, both)
    logit = pooled @ p["out"] + p["out0"][0]
    return (logit, (tape, both, a, pooled)) if keep else logit


def gradients(p: dict, inputs: Inputs, dropped: np.ndarray, index: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
    """Of the weighted mean cross-entropy; of the two tables (rows, gradients) of the rows in use."""
    H = HIDDEN
    vectors = inputs.vectors(p)
    vectors[dropped, :WORD_DIM] = 0
    projected = vectors @ p["x"] + p["x0"]
    logit, (tape, both, a, pooled) = forward(p, projected, index, mask, keep=True)
    d = ((_sigmoid(logit) - target) * weight / len(target)).astype(np.float32)
    g = {"out": pooled.T @ d, "out0": np.array([d.sum()], np.float32)}
    dp = d[:, None] * p["out"]
    da = np.einsum("nh,tnh->tn", dp, both)
    dlook = a * (da - (a * da).sum(0))
    g["look"] = np.einsum("tn,tnh->h", dlook, both)
    dboth = a[:, :, None] * dp + dlook[:, :, None] * p["look"]
    length, n = dlook.shape
    dstates = np.stack([dboth[:, :, :H], dboth[::-1, :, H:]], axis=1)
    dx = np.zeros((length, n, 6 * H), np.float32)
    dh, g["h"] = np.zeros((2, n, H), np.float32), np.zeros_like(p["h"])
    back = p["h"].transpose(0, 2, 1)
    for t in range(length - 1, -1, -1):
        h, gates, r, z, new = tape[t]
        dh = dh + dstates[t]
        dnew = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        dr = dnew * gates[:, :, 2 * H :] * r * (1 - r)
        step = np.concatenate([dr, dz, dnew], axis=2)
        through = np.concatenate([dr, dz, dnew * r], axis=2)
        g["h"] += np.matmul(h.transpose(0, 2, 1), through)
        dx[t, :, : 3 * H] += step[0]
        dx[length - 1 - t, :, 3 * H :] += step[1]
        dh = dh * z + np.matmul(through, back)
    flat = index.T.reshape(-1)
    order = np.argsort(flat, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) > 0]))
    dproj = np.zeros_like(projected)
    dproj[flat[order][starts]] = np.add.reduceat(dx.reshape(-1, 6 * H)[order], starts)
    g["x"], g["x0"] = vectors.T @ dproj, dproj.sum(0)
    dvec = dproj @ p["x"].T
    g["word"] = _summed(inputs.word[~dropped], dvec[~dropped, :WORD_DIM])
    dgram = dvec[:, WORD_DIM:] * inputs.scale[:, None]
    g["gram"] = _summed(np.concatenate(inputs.grams), dgram[np.concatenate(inputs.owner)])
    return g


def _summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of what is to be added to each."""
    if not len(at):
        return at, values
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
    return at[order][starts], np.add.reduceat(values[order], starts)


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.n += 1
        scale = self.rate * (1 - 0.999**self.n) ** 0.5 / (1 - 0.9**self.n)
        for k, x in g.items():
            at, x = x if isinstance(x, tuple) else (slice(None), x)  # of tables only the rows that were used
            m, v = self.m[k][at], self.v[k][at]
            m += 0.1 * (x - m)
            v += 0.001 * (x * x - v)
            self.m[k][at], self.v[k][at] = m, v
            self.p[k][at] -= scale * m / (np.sqrt(v) + 1e-8)


def starts_of(n: int) -> list[int]:
    """Where the windows of n words begin; the last ends with the text."""
    return [*range(0, max(1, n - LENGTH), STRIDE), *([n - LENGTH] if n > LENGTH else [])]


def windows(ids: np.ndarray, sizes: list[int], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts whose word numbers lie one after another: their words, which are none, and their text."""
    at, begin, owner, short = 0, [], [], []
    for k, n in enumerate(sizes):
        if n:
            s = starts_of(n)
            begin += [at + x for x in s]
            owner += [k] * len(s)
            if n < LENGTH:
                short.append((len(begin) - 1, n))
        at += n
    begin = np.array(begin, np.int64)
    index = np.append(ids, np.full(LENGTH, pad, ids.dtype))[begin[:, None] + np.arange(LENGTH)]
    mask = np.ones(index.shape, bool)
    for row, n in short:
        index[row, n:], mask[row, n:] = pad, False
    return index, mask, np.array(owner, np.int64)


def split(text: str) -> list[bytes]:
    return text.lower().encode().split()


def _telling(vocabulary: list[bytes], docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """How far the most telling character n-gram of each word stands out in documents of label 1, in standard deviations."""
    grams, begin = [], [np.zeros(1, np.int64)]
    for k in range(0, len(vocabulary), 20_000):  # in pieces, as n-grams take room
        inputs = Inputs(vocabulary[k : k + 20_000], TELL_BUCKETS)
        owner = np.concatenate(inputs.owner)
        order = np.argsort(owner, kind="stable")
        grams.append(np.concatenate(inputs.grams)[order])
        begin.append(begin[-1][-1] + np.cumsum(np.bincount(owner)))
    grams, begin = np.concatenate(grams), np.concatenate(begin)
    seen = np.zeros((2, TELL_BUCKETS), np.float32)
    for words, label in zip(docs, y, strict=True):
        own = np.unique(words)
        n = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        seen[label, np.unique(grams[at])] += 1
    expected = y.sum() * (seen[0] + 0.5) / (len(y) - y.sum())
    far = (seen[1] - expected) / np.sqrt(expected + 1)
    return np.maximum.reduceat(far[grams], begin[:-1])


def _projected(p: dict, vocabulary: list[bytes]) -> np.ndarray:
    """Inputs of all words, in pieces, as n-grams take room."""
    out = np.empty((len(vocabulary), 6 * HIDDEN), np.float32)
    for k in range(0, len(vocabulary), 20_000):
        out[k : k + 20_000] = Inputs(vocabulary[k : k + 20_000]).vectors(p) @ p["x"] + p["x0"]
    return out


def _logits(p: dict, vocabulary: list[bytes], index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    projected = _projected(p, vocabulary)
    return np.concatenate([forward(p, projected, index[k : k + 4096], mask[k : k + 4096]) for k in range(0, len(index), 4096)])


def boundary(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap between scores of those that part the classes with the fewest errors, each class counting alike."""
    order = np.argsort(score)
    s, label = score[order], y[order]
    wrong = np.cumsum(label)[:-1] / y.sum() + ((label == 0).sum() - np.cumsum(label == 0)[:-1]) / (len(y) - y.sum())
    gap = np.diff(s)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    k = best[gap[best].argmax()]
    return float((s[k] + s[k + 1]) / 2)


def train(texts: list[str], labels: list[int], seed: int = 1, rounds: int = 8, steps: int = 30, batch: int = 256) -> dict[str, np.ndarray] | None:
    """Parameters of the network, or None if a class has no document with words. steps: in each round, at least."""
    docs = [split(t) for t in texts]
    keep = [k for k, d in enumerate(docs) if d]
    docs, y = [docs[k] for k in keep], np.array([labels[k] for k in keep], np.int64)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    numbers: dict[bytes, int] = {b"": 0}
    sizes = [len(d) for d in docs]
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for d in docs for w in d), np.int32, sum(sizes))
    vocabulary = list(numbers)
    del docs, numbers
    release()
    index, mask, owner = windows(ids, sizes, 0)
    ends = np.cumsum(sizes)
    tells = _telling(vocabulary, np.split(ids, ends[:-1]), y).astype(np.float32)
    first = tells[index].max(1)
    p = initial(seed)
    adam = Adam(p, 0.01)
    begins = np.searchsorted(owner, np.arange(len(sizes)))
    lengths = np.diff(np.append(begins, len(owner)))
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    heads = []  # of toxic documents the words that stand out most, if any does
    for k in toxic:
        own = np.unique(ids[ends[k] - sizes[k] : ends[k]])
        if tells[own].max() >= 5:
            heads.append(own[tells[own] >= max(5, 0.7 * tells[own].max())])
    for turn in range(rounds):
        if turn < 2:
            score = first
        else:
            score = _logits(p, vocabulary, index, mask)
        if turn == rounds - 2:
            adam.rate *= 0.3
        best = np.array([b + int(score[b : b + n].argmax()) for b, n in zip(begins, lengths, strict=True)])
        chance = np.concatenate([begins[clean] + rng.integers(0, lengths[clean]) for _ in range(2)])
        # telling words set into clean windows: what stands around them must not matter
        host = rng.choice(chance, 2 * max(len(toxic), 200) if heads else 0)
        pasted, shown = index[host].copy(), mask[host].copy()
        for row, k in enumerate(rng.integers(0, max(1, len(heads)), len(host))):
            n = int(shown[row].sum())
            for at in rng.integers(0, n, rng.integers(1, 3)):
                pasted[row, at] = rng.choice(heads[k])
        rows_index = np.concatenate([index[best], index[chance], pasted])
        rows_mask = np.concatenate([mask[best], mask[chance], shown])
        goal = np.concatenate([y, np.zeros(len(chance), np.int64), np.ones(len(host), np.int64)])
        each = np.concatenate([np.ones(len(best)), np.full(len(chance), 0.5), np.full(len(host), len(toxic) / max(1, len(host)))])
        share = np.bincount(goal, each)
        weight = each * (len(goal) / 2 / share)[goal]
        for _ in range(max(1, -(-steps * batch // len(goal)))):
            order = rng.permutation(len(goal))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                used, local = np.unique(rows_index[rows], return_inverse=True)
                inputs = Inputs([vocabulary[u] for u in used])
                adam.step(gradients(p, inputs, rng.random(len(used)) < 0.4, local.reshape(len(rows), LENGTH), rows_mask[rows], goal[rows], weight[rows]))
    score = np.maximum.reduceat(_logits(p, vocabulary, index, mask), begins)
    p["out0"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - boundary(score, y))
    del index, mask, vocabulary
    release()
    return p


class Scorer:
    """Scores texts in one Python worker."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.known: dict[bytes, int] = {b"": 0}
        self.projected = self._project([b""])

    def _project(self, words: list[bytes]) -> np.ndarray:
        return Inputs(words).vectors(self.p) @ self.p["x"] + self.p["x0"]

    def scores(self, texts: list[str]) -> np.ndarray:
        docs = [split(t) for t in texts]
        words = [w for d in docs for w in d]
        ids = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(ids < 0)
        new = {w: len(self.known) + k for k, w in enumerate(dict.fromkeys([words[k] for k in missed]))}
        projected = self.projected
        if new:
            ids[missed] = [new[words[k]] for k in missed]
            projected = np.concatenate([projected, self._project(list(new))])
            if len(projected) <= KNOWN:
                self.known.update(new)
                self.projected = projected
        index, mask, owner = windows(ids, [len(d) for d in docs], 0)
        out = np.full(len(texts), -np.inf, np.float64)
        for k in range(0, len(index), 4096):
            part = slice(k, k + 4096)
            logit = forward(self.p, projected, index[part], None if mask[part].all() else mask[part])
            np.maximum.at(out, owner[part], logit)
        return 1 / (1 + np.exp(-np.clip(out, -700, 700))) * np.isfinite(out)


def in_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) != 1


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """text and toxic of the labelled training documents with the least hashes, at most sample and half of most_bytes of either class.

    The sample is chosen by ids alone; texts are looked up for its ids only, without a shuffle.
    """
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select("doc_id").where(in_training(F.col("doc_id"))).distinct().join(known, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    some = [ids.where(F.col("toxic") == t).orderBy("h", "doc_id").limit(sample).select("doc_id", "toxic") for t in (0, 1)]
    chosen = cut(some[0].unionAll(some[1]))  # 2 * sample ids at most
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    so_far = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = rows.select("doc_id", so_far.alias("bytes")).where(F.col("bytes") <= most_bytes // 2).select("doc_id")
    return rows.join(F.broadcast(within), "doc_id").toPandas().sort_values("doc_id", kind="stable")


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, into: str = "score") -> DataFrame:
    """docs plus (or with, in place of a column of that name) a column of scores: learns from labels of its training documents, then reads every whole text."""
    known = labelled(docs, labels, sample)
    p = train(known["text"].fillna("").tolist(), known["toxic"].astype(int).tolist())
    if p is None:
        return docs.withColumn(into, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(p)  # tables of fixed size: 9 MB

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(held.value)
        for texts in batches:
            texts = texts.tolist()
            yield pd.Series(np.concatenate([scorer.scores(texts[k : k + 200]) for k in range(0, len(texts), 200)]) if texts else np.zeros(0))
        del scorer
        release()

    return batched(docs).withColumn(into, score(F.coalesce("text", F.lit(""))))
