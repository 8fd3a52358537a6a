"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.session import cut, remove, shared_path

__all__ = ["BLANKS", "WORD", "batched", "cut", "keyed", "located", "release", "remove", "shared_path", "sieved", "without"]

#: A word: a run of anything but the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def located(docs: DataFrame) -> DataFrame:
    """docs with __file and __row, which name a row's place in its Parquet file.

    A frame that does not come straight from files is first written to the shared folder.
    """
    try:
        return docs.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    except AnalysisException:
        path = shared_path(docs.sparkSession, "rows")
        docs.write.parquet(path)
        return located(docs.sparkSession.read.parquet(path))


#: A sieve has at most so many bits: 16 MB, however many keys it holds.
MOST_BITS = 1 << 27
PAGE = 1 << 15


def sieved(rows: DataFrame, keys: DataFrame, n: int, *on: str) -> DataFrame:
    """rows with __maybe: true for all whose columns on are among the n keys, and false for nearly all others.

    A bitmap with about 32 bits a key and a hash is broadcast in pages; its size is bound by MOST_BITS. Beyond
    some 100 million keys it lets more rows through, and what follows it, which must be exact, has more to do.
    """
    bits = min(MOST_BITS, max(PAGE, 1 << (32 * n).bit_length()))
    h = F.pmod(F.xxhash64(*on), F.lit(bits))
    pages = keys.select(h.alias("__h")).groupBy(F.floor(F.col("__h") / PAGE).alias("__page")).agg(F.bitmap_construct_agg(F.col("__h") % PAGE).alias("__bits"))
    at = F.col("__h") % PAGE
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("__h", h).join(F.broadcast(pages), F.floor(F.col("__h") / PAGE) == F.col("__page"), "left")
    return marked.withColumn("__maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).select(*[F.col(f"`{c}`") for c in rows.columns], "__maybe")


def without(rows: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """The columns names of the placed rows that are not among gone; rows that the sieve clears are not shuffled."""
    gone = cut(gone.select("__file", "__row"))
    marked = sieved(rows, gone, gone.count(), "__file", "__row")
    doubtful = marked.where("__maybe").join(gone, ["__file", "__row"], "left_anti")
    return marked.where("not __maybe").select(*names).unionAll(doubtful.select(*names))


#: More than one in so many rows make a key heavy, so there are fewer heavy keys than this.
HEAVY = 2048


def keyed(rows: DataFrame, side: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows.join(side, key), where side has a row a key and n, at least the number of rows with that key.

    Rows with heavy keys are joined where they are, by a broadcast of fewer than 2 * HEAVY of the total rows' keys;
    the others meet in a shuffle. So no key makes a large task.
    """
    limit = max(64, total // HEAVY)
    heavy = side.where(F.col(n) > limit)
    here = rows.join(F.broadcast(heavy), key)
    there = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(side.where(F.col(n) <= limit), key)
    return here.unionByName(there)


#: Bytes of a batch that an executor hands to a Python worker, which holds two: 10,000 whole texts may be tens of MB.
BATCH_BYTES = 4 << 20


def batched(docs: DataFrame) -> DataFrame:
    """docs, whose session from now on hands rows to Python in batches of BATCH_BYTES, unless it is set to smaller ones."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)([kmg]?)b?", conf.get(name).strip().lower())
    if not size or not 0 < int(size[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[size[2]] <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return docs


def release() -> None:
    """Hand what a Python worker no longer uses back to the system; Spark keeps workers for later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
