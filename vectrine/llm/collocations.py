"""Phrase collocation mining: n-grams as DataFrame rows, counted by language, scored by their weakest cut.

Each n from 1 to max_n takes one pass. Inside a task the texts' bytes are cut into pieces and words with NumPy, and
the n-grams of a block become rows (lang, phrase, f) that were summed within the block; a hash aggregation sums them
per language. An n-gram can reach ``min_count`` only if its first and last n - 1 words do, so from the second pass on
only such n-grams become rows: a bitmap of at most 16 MB, whatever the corpus, tells which may (it lets a few
others through, and their exact counts drop them). Prefix and suffix counts come by joins, scores are exact integer
quotients of decimals, phrases that mostly stand inside a longer one go by an anti-join with the one-word extensions, and
a window ranks what is left.

Nulls: a null text counts as empty, a null lang as ``und``. A text longer than a block is cut between words, with
n - 1 words repeated, so no n-gram is lost or counted twice and memory stays that of a block or of the longest word.
Ties of score go by count, then by phrase in UTF-8 byte order; repeated rows count as often as they come. No rows in, no rows out. Other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.llm.common import MOST_BITS, PAGE, cut, release

MIN_COUNT, MAX_N, TOP = 10, 3, 2000
#: A phrase goes if a longer one has at least so many hundredths of its count.
SHARE = 50
#: Bytes of text that are cut into words at once.
BLOCK = 3 << 20
#: Parts of a language that are ranked by themselves, round after round, before the language is.
SALTS = (4096, 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: part of a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x09, 0x20]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _begins(raw: np.ndarray) -> np.ndarray:
    word = _KIND[raw] == 0
    word[1:] &= ~word[:-1].copy()
    return np.flatnonzero(word)


def _parts(raw: np.ndarray, n: int, block: int) -> Iterator[np.ndarray]:
    """A long text in parts that end with a word; each begins with the last n - 1 words of the one before."""
    begin = done = 0
    while done < len(raw):
        end = max(begin + block, done + 1)
        while end < len(raw):
            gaps = np.flatnonzero(_KIND[raw[end : end + block]])
            if len(gaps):
                end += gaps[0]
                break
            end += block
        done = min(end, len(raw))
        yield raw[begin:done]
        at = _begins(raw[begin:done]) if n > 1 else ()
        begin = begin + int(at[-min(n - 1, len(at))]) if len(at) else done


def _blocks(texts: pa.Array, n: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, where each text begins in them, and the texts' row numbers; about a block at a time."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + block, "right")) - 1)
        if ends[j] - ends[i] > block:
            for part in _parts(raw[ends[i] : ends[j]], n, block):
                yield part, np.zeros(1, np.int64), np.array([i])
        else:
            yield raw[ends[i] : ends[j]], ends[i:j] - ends[i], np.arange(i, j)
        i = j


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def _folded(langs: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words, in its language."""
    m = len(words) - n + 1
    out = langs[:m]
    for j in range(n):
        out = (out ^ words[j : j + m]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _grams(raw: np.ndarray, starts: np.ndarray, langs: np.ndarray, lang_hashes: np.ndarray, n: int, bits: np.ndarray | None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Language number, phrase and count of the n-grams of a block; with bits only of those whose shorter runs it has."""
    kind = _KIND[raw]
    starts_in = starts[starts < len(raw)]
    word, cuts = kind == 0, kind == 2
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[starts_in] = word[starts_in]
    cuts[starts_in] = True
    at = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(word, dtype=np.int32)[at] - 1, np.count_nonzero(word)).astype(np.int32)
    letters = _LOWER[raw[word]]
    piece = np.cumsum(cuts, dtype=np.int32)[at]
    lang = langs[np.searchsorted(starts, at, "right") - 1]
    del kind, word, cuts, begins
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    names, codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
    m = len(codes) - n + 1
    if m < 1:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    ok = piece[:m] == piece[n - 1 :]
    if bits is not None:
        known = _among(bits, _folded(lang_hashes[lang], _hashes(names)[codes], n - 1))
        ok &= known[:m] & known[1 : m + 1]
    i = np.flatnonzero(ok)
    key, most = lang[i].astype(np.int64), int(langs.max()) + 1
    for j in range(n):
        if most * len(names) >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            most = len(key)
        key, most = key * len(names) + codes[i + j], most * len(names)
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    i = i[first]
    columns = [names.take(pa.array(codes[i + j])) for j in range(n)]
    return lang[i], pc.binary_join_element_wise(*columns, " ") if n > 1 else columns[0], count


def counted(docs: DataFrame, n: int, bits=None, block: int = BLOCK) -> DataFrame:
    """lang, phrase, f of the n-grams of docs (lang, text); the row of phrase null counts all words of a language (n = 1).

    bits: a broadcast bitmap of the (n - 1)-grams that may be part of one.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = pc.fill_null(batch.column(0), "und").dictionary_encode()
            names, numbers = langs.dictionary, langs.indices.to_numpy().astype(np.int64)
            hashes = _hashes(names)
            for raw, starts, rows in _blocks(batch.column(1), n, block):
                lang, phrase, f = _grams(raw, starts, numbers[rows], hashes, n, sieve)
                columns = [names.take(pa.array(lang)), phrase, pa.array(f, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])
                if n == 1 and len(f):
                    total = np.bincount(lang, f, len(names)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), pa.array(total)], ["lang", "phrase", "f"])
        release()

    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(explode, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def sieve(frequent: DataFrame):
    """A broadcast bitmap of at most MOST_BITS that has all phrases (lang, phrase), and few others."""
    size = min(MOST_BITS, max(PAGE, 1 << (32 * frequent.count()).bit_length()))

    @F.pandas_udf("long")
    def place(lang: pd.Series, phrase: pd.Series) -> pd.Series:
        words = pc.split_pattern(pa.array(phrase, pa.string()), " ")
        n = np.diff(words.offsets.to_numpy())
        hashes, first = _hashes(words.flatten()), words.offsets.to_numpy()[:-1]
        out = pd.util.hash_array(lang.to_numpy(dtype=object), categorize=False)
        for k in np.unique(n):
            own = np.flatnonzero(n == k)
            for j in range(k):
                x = (out[own] ^ hashes[first[own] + j]) * _MIX
                out[own] = x ^ (x >> np.uint64(29))
        return pd.Series((out & np.uint64(size - 1)).astype(np.int64))

    at = frequent.select(place("lang", "phrase").alias("at"))
    pages = at.groupBy(F.floor(F.col("at") / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("at") % PAGE).alias("bits"))
    whole = bytearray(size // 8)
    for r in pages.collect():  # at most MOST_BITS
        whole[r.page * (PAGE // 8) : r.page * (PAGE // 8) + len(r.bits)] = r.bits
    return frequent.sparkSession.sparkContext.broadcast(bytes(whole))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_n: int = MAX_N, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to max_n words that come min_count times at least; (lang, n) of all languages."""
    first = cut(counted(docs, 1, block=block).where(F.col("phrase").isNull() | (F.col("f") >= min_count)))
    totals = first.where("phrase is null").select("lang", F.col("f").alias("n"))
    levels = [first.where("phrase is not null").withColumn("words", F.lit(1))]
    for n in range(2, max_n + 1):
        bits = sieve(levels[-1])
        levels.append(cut(counted(docs, n, bits, block).where(F.col("f") >= min_count).withColumn("words", F.lit(n))))
        bits.unpersist()
    return reduce(DataFrame.unionByName, levels), totals


def _span(words: Column, begin: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, begin, length), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_n: int = MAX_N, top: int = TOP, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to max_n words."""
    phrases, totals = frequent_phrases(docs, min_count, max_n, block)
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", _span(F.col("w"), 1, F.col("k")).alias("head"), _span(F.col("w"), F.col("k") + 1, F.col("words")).alias("tail")
    )
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    exact = lambda name: F.col(name).cast("decimal(15,0)")  # noqa: E731  products stay within 38 digits
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumns({"top": F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a"), "bottom": exact("l") * exact("r")})
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("top div bottom").alias("score"), "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.score", "cut.a", "cut.l", "cut.r")
    inner = F.explode(F.array(_span(F.col("w"), 1, F.col("words") - 1), _span(F.col("w"), 2, F.col("words") - 1))).alias("phrase")
    longer = candidates.where("words > 2").select("lang", inner, "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    on = (weakest["lang"] == longer["lang"]) & (weakest["phrase"] == longer["phrase"]) & (100 * longer["most"] >= share * weakest["a"])
    kept = weakest.join(longer, on, "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for salts in SALTS:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        kept = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(min_count: int = MIN_COUNT, top: int = TOP, share: int = SHARE) -> str:
    """DuckDB SQL for phrases of two and three words."""
    return rf"""
        WITH pieces AS MATERIALIZED (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (
            SELECT lang, 1 AS words, unnest(w) AS phrase FROM words
            UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
            UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM words),
        counts AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang),
        candidates AS MATERIALIZED (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1 AND f >= {min_count}),
        cuts AS MATERIALIZED (
            SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
            FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates)),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail),
        weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        longer AS (
            SELECT lang, phrase, max(a) AS most
            FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE words = 3) GROUP BY ALL),
        kept AS (SELECT s.* FROM weakest s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.most IS NULL OR 100 * o.most < {share} * s.a)
        SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept k JOIN totals t ON t.lang = k.lang
        QUALIFY rank <= {top}"""
