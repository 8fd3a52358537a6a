"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Words are runs of anything but white space, compared without regard to ASCII case; a document's set holds
its runs of five words (all its words, if it has one to four). Documents with equal sets are one class from
the start, so that copies cost nothing further. The classes' signatures are cut into bands; how many and how
long follows from the recall wanted at the threshold. Classes that share a band hash are shuffled together
and linked to the least class of their bucket, and what these links connect is one candidate component.

Pairs are then verified with their full sets. Of components of up to WHOLE chunks of CHUNK classes every pair is,
a task for each pair of chunks. A longer chain is not worth all of its pairs: there the pairs that share a band
are verified, bucket by bucket, each in the first bucket that holds both, large buckets again in pairs of chunks.
So a class is copied to a bounded number of tasks for each of its buckets, and no task holds more than two chunks,
of GRAMS n-grams each at most unless one text alone has more. No task gives out more than a row a class: how many
documents it links to and the least class that it reached. Pairs are never written out. Sets are built anew from
the texts of candidates only, and only these texts are shuffled.

Nulls: a null text counts as empty; documents without words are equal to each other and link to no others.
A null doc_id comes last where the least is chosen. Repeated rows are copies. A very long text takes some forty times
its size in the task that reads it. No rows in, no rows out; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.llm.common import batched, cut, keyed, located, release, sieved, without
from vectrine.llm.components import components

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Hash functions at most.
SIGNATURE = 100
CHUNK = 256
#: N-grams of a chunk at most, unless one set has more.
GRAMS = 1 << 22
#: Chunks of the largest component whose every pair is verified.
WHOLE = 16
_PIECE = 1 << 20
_U = np.uint64


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = SIGNATURE) -> tuple[int, int]:
    """Bands and rows: of those that find a pair at the threshold with the recall wanted, the one that finds least below it."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands * rows > most:
            break
        below = sum(1 - (1 - (threshold * k / 200) ** rows) ** bands for k in range(200))
        if best is None or below < best[0]:
            best = (below, bands, rows)
    if best is None:
        raise ValueError(f"{most} hash functions can't reach a recall of {recall}")
    return best[1:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashing:
    """Random constants and power tables of one Python worker; equal in all."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240229)
        draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
        self.byte = draw(256)
        self.byte[65:91] = self.byte[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.root = _U(int(draw(1)[0]) | 5)
        self.back = _U(pow(int(self.root), -1, 1 << 64))
        self.place = draw(WIDTH) | _U(1)
        self.times, self.plus = draw(bands * rows) | _U(1), draw(bands * rows)
        self.fold, self.salt = draw(rows) | _U(1), draw(bands)
        self.bands, self.rows = bands, rows
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the root and of its inverse; longer tables than most pieces need are not kept."""
        if len(self.up) >= n:
            return self.up, self.down
        up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)])) for x in (self.root, self.back))
        if n <= 4 * _PIECE:
            self.up, self.down = up, down
        return up, down

    def words(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of texts that lie one after another, and how many each text has."""
        solid = ~self.blank[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[np.concatenate([[0], ends])] = True
        begins = np.flatnonzero(solid & (first[:-1] | np.concatenate([[True], ~solid[:-1]])))
        stops = np.flatnonzero(solid & (first[1:] | np.concatenate([~solid[1:], [True]])))
        up, down = self.powers(len(raw))
        sums = np.cumsum(self.byte[raw] * up[: len(raw)], dtype=np.uint64)
        before = np.where(begins > 0, sums[begins - 1], _U(0))
        upto = np.searchsorted(begins, ends)
        return _mix((sums[stops] - before) * down[begins]), np.diff(np.concatenate([[0], upto]))

    def shingles(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all word n-grams, repeats included, and how many each text has."""
        words, n = self.words(raw, ends)
        at = np.cumsum(n) - n
        out = np.zeros(max(len(words), 1), np.uint64)[: len(words)]
        whole = len(words) - WIDTH + 1
        if whole > 0:
            total = np.zeros(whole, np.uint64)
            for k in range(WIDTH):
                total += words[k : k + whole] * self.place[k]
            out[:whole] = total
        for i in np.flatnonzero((n > 0) & (n < WIDTH)):
            w = words[at[i] : at[i] + n[i]]
            out[at[i]] = (w * self.place[: len(w)]).sum(dtype=np.uint64) + _U(len(w))
        count = np.where(n == 0, 0, np.maximum(n - WIDTH + 1, 1))
        keep = np.arange(len(words)) - np.repeat(at, n) < np.repeat(count, n)
        return _mix(out[keep]), count

    def signatures(self, shingles: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Band hashes of each text that has shingles."""
        starts = (np.cumsum(count) - count)[count > 0]
        sig = np.empty((self.bands * self.rows, len(starts)), np.uint64)
        for k in range(len(sig)):
            sig[k] = np.minimum.reduceat(shingles * self.times[k] + self.plus[k], starts) if len(starts) else sig[k]
        out = np.empty((len(starts), self.bands), np.uint64)
        for b in range(self.bands):
            out[:, b] = _mix((sig[b * self.rows : (b + 1) * self.rows] * self.fold[:, None]).sum(0, dtype=np.uint64) + self.salt[b])
        return out


_made: dict[tuple[int, int], Hashing] = {}


def hashing(bands: int, rows: int) -> Hashing:
    if (bands, rows) not in _made:
        _made[bands, rows] = Hashing(bands, rows)
    return _made[bands, rows]


def forget(h: Hashing) -> None:
    """Drop the tables of powers: an idle worker would keep 16 bytes for each byte of the largest piece."""
    h.up = h.down = np.ones(1, np.uint64)
    release()


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about _PIECE bytes: from, to, their bytes, and where each ends."""
    texts = texts.cast(pa.binary()).cast(pa.large_binary())
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _PIECE, "right")) - 1)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i + 1 : j + 1] - bounds[i]
        i = j


def _set_key(unique: np.ndarray) -> bytes:
    return hashlib.blake2b(unique.tobytes(), digest_size=16).digest()


def sketches(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """doc_id, __file, __row, set_key, n_grams and bands of each row of doc_id, __file, __row, text."""

    def sketch(batches):
        h = hashing(bands, per_band)
        for batch in batches:
            for i, j, raw, ends in _pieces(batch.column(3)):
                shingles, count = h.shingles(raw, ends)
                found = h.signatures(shingles, count).view(np.int64)
                sets = [np.unique(x) for x in np.split(shingles, np.cumsum(count)[:-1])]
                offsets = np.concatenate([[0], np.cumsum(np.where(count > 0, bands, 0))]).astype(np.int32)
                part = batch.slice(i, j - i)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(map(_set_key, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), lists], ["doc_id", "__file", "__row", "set_key", "n_grams", "bands"])
        forget(h)

    return batched(rows).select("doc_id", "__file", "__row", "text").mapInArrow(sketch, "doc_id long, __file string, __row long, set_key binary, n_grams long, bands array<long>")


def _sets(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """rows with the sorted set (grams, packed) of their last column, text, in its place."""
    names = rows.columns[:-1]

    def build(batches):
        h = hashing(bands, per_band)
        for batch in batches:
            for i, j, raw, ends in _pieces(batch.column(len(names))):
                shingles, count = h.shingles(raw, ends)
                sets = [np.unique(x).tobytes() for x in np.split(shingles, np.cumsum(count)[:-1])]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(sets, pa.binary())], [*names, "grams"])
        forget(h)

    schema = T.StructType([*rows.drop("text").schema.fields, T.StructField("grams", T.BinaryType())])
    return batched(rows).mapInArrow(build, schema)


def intersections(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """How many elements each of the sets shares with each of the others (itself among them, if there are none)."""
    own = others is None
    right = sets if own else others
    if len(sets) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in sets]).reshape(len(sets), len(right))
    every = sets if own else sets + right
    flat = np.concatenate(every)
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # an element of one set only is in no intersection
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1 if len(column) else column
    out = np.zeros((len(sets), len(right)), np.float64)
    width = 4096
    total = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, total + width, width))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        m = np.zeros((len(every), width), np.float32)
        m[owner[part], column[part] - k * width] = 1
        out += m @ m.T if own else m[: len(sets)] @ m[len(sets) :].T
    sizes = [len(s) for s in sets]
    if own:
        np.fill_diagonal(out, sizes)
    return out.astype(np.int64)


def linked(shared: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Whether the Jaccard similarity reaches the threshold, in whole numbers; empty sets reach none."""
    union = left[:, None] + right[None, :] - shared
    return (shared * threshold.denominator >= threshold.numerator * union) & (union > 0)


def _chunks(n: str, grams: str):
    """Chunks for n classes with so many n-grams together."""
    return F.ceil(F.greatest(F.col(n) / CHUNK, F.col(grams) / GRAMS)).cast("long")


def _in_chunks(rows: DataFrame) -> DataFrame:
    """cls and tasks: the pairs of chunks (i, j) of its group that a class belongs to; at is the band of a bucket, -1 for a component."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("k")
    own = rows.withColumn("chunk", F.pmod(F.xxhash64("cls"), "chunks")).select("cls", "group", "at", "chunk", k)
    task = F.struct("group", "at", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"), "chunk")
    return own.groupBy("cls").agg(F.collect_list(task).alias("tasks"))  # no more than a class has buckets, times their chunks


def tasks_of(candidates: DataFrame, banded: DataFrame, classes: DataFrame) -> DataFrame:
    """cls and tasks of each candidate (cls, component): by component, or by bucket where the component is long."""
    total = candidates.count()
    known = candidates.join(classes.select("cls", "n_grams"), "cls")
    sizes = cut(known.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("sum")).withColumn("chunks", _chunks("n", "sum")))
    known = cut(keyed(known, sizes, "component", "n", total))
    whole = known.where(F.col("chunks") <= WHOLE).select("cls", F.col("component").alias("group"), F.lit(-1).alias("at"), "chunks")
    long = known.where(F.col("chunks") > WHOLE).select("cls", "n_grams")
    if long.isEmpty():
        return _in_chunks(whole)
    inside = banded.join(long, "cls")
    buckets = cut(inside.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("sum")).where("n > 1").withColumn("chunks", _chunks("n", "sum")))
    inside = keyed(inside, buckets, "band", "n", inside.count())
    return _in_chunks(whole).unionByName(_in_chunks(inside.select("cls", F.col("band").alias("group"), "at", "chunks")))


def verified(sets: DataFrame, threshold: float) -> DataFrame:
    """cls, links (documents of linked classes) and other (the least class reached) for each task that links the class.

    sets: cls, n_docs, bands, tasks and grams.
    """
    limit = Fraction(threshold).limit_denominator(10_000)
    pairs = sets.withColumn("t", F.explode("tasks")).select("t.group", "t.at", "t.i", "t.j", "cls", "t.chunk", "n_docs", "bands", "grams")
    pairs = pairs.repartition("group", "at", "i", "j").sortWithinPartitions("group", "at", "i", "j", "cls")

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True)

    def block(at: int, i: int, j: int, members: list) -> list[tuple[int, int, int]]:
        cls = np.array([m[4] for m in members])
        chunk, docs = np.array([m[5] for m in members]), np.array([m[6] for m in members])
        sets = [np.frombuffer(m[8], np.uint64) for m in members]
        size = np.array([len(s) for s in sets])
        if i == j:
            near = linked(intersections(sets), size, size, limit)
            np.fill_diagonal(near, False)
        else:
            a, b = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            near = np.zeros((len(cls), len(cls)), bool)
            if len(a) and len(b):
                near[np.ix_(a, b)] = linked(intersections([sets[x] for x in a], [sets[x] for x in b]), size[a], size[b], limit)
                near |= near.T
        if at >= 0:  # another bucket has the pairs that share an earlier band
            bands = np.array([m[7][:at] for m in members], np.int64).reshape(len(cls), at)
            for k in range(at):
                near &= bands[:, None, k] != bands[None, :, k]
        links = near @ docs
        reach, label = near | np.eye(len(cls), dtype=bool), cls.copy()
        while True:
            new = np.where(reach, label[None, :], np.iinfo(np.int64).max).min(1)
            if (new == label).all():
                break
            label = new
        return [(int(c), int(n), int(o)) for c, n, o in zip(cls, links, label, strict=True) if n]

    def verify(batches):
        out: list[tuple[int, int, int]] = []
        schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
        for (_, at, i, j), group in groupby(rows(batches), key=lambda r: r[:4]):
            members = list(group)
            if len(members) > 1:
                out += block(at, i, j, members)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
        release()

    return pairs.mapInArrow(verify, "cls long, links long, other long")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs, as placed_groups() gives it."""
    return placed_groups(located(docs.select("doc_id", "text")), threshold, recall)


def placed_groups(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """One row per row of docs, which have their place: doc_id, __file, __row, class_id (least doc_id that links connect it to), class_size, n_links (other documents at or above the threshold) and kept (whether it stands for its class)."""
    bands, per_band = choose_bands(threshold, recall)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__file", "__row", F.coalesce("text", F.lit("")).alias("text"))
    seen = cut(sketches(rows, bands, per_band))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__file", "__row"))
    classes = cut(
        seen.groupBy("set_key")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n_docs"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    banded = classes.select("cls", F.posexplode("bands").alias("at", "band"))
    buckets = cut(banded.groupBy("band").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    candidates = keyed(banded, buckets, "band", "n", banded.count()).where("cls <> hub").select("cls", "hub").distinct()
    candidates = components(candidates, "cls", "hub").withColumnRenamed("node", "cls")
    members = tasks_of(candidates, banded, classes).join(classes.select("cls", "first", "n_docs", "bands"), "cls")
    members = cut(members.select("cls", "n_docs", "bands", "tasks", F.col("first.__file").alias("__file"), F.col("first.__row").alias("__row")))
    texts = sieved(rows, members, members.count(), "__file", "__row").where("__maybe").join(members, ["__file", "__row"])
    found = cut(verified(_sets(texts.select("cls", "n_docs", "bands", "tasks", "text"), bands, per_band), threshold))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found, "cls", "other").withColumnRenamed("node", "cls")
    numbered = (
        classes.drop("bands").join(groups, "cls", "left").join(links, "cls", "left").withColumns({"component": F.coalesce("component", "cls"), "n_links": F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))})
    )
    numbered = cut(numbered.select("set_key", "component", "n_docs", "n_links", "first"))
    heads = cut(numbered.groupBy("component").agg(F.min("first").alias("head"), F.sum("n_docs").alias("class_size"), F.count(F.lit(1)).alias("n")))
    named = cut(keyed(numbered, heads, "component", "n", numbered.count()).select("set_key", "n_docs", "n_links", "head", "class_size"))
    return keyed(seen.drop("bands"), named, "set_key", "n_docs", seen.count()).select(
        "doc_id", "__file", "__row", F.col("head.doc_id").alias("class_id"), "class_size", "n_links",
        ((F.col("head.__file") == F.col("__file")) & (F.col("head.__row") == F.col("__row"))).alias("kept"),
    )


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns."""
    rows = located(docs)
    return without(rows, placed_groups(rows, threshold, recall).where("not kept"), docs.columns)
