"""Token ids as Arrow files of equal-length sequences with masks.

Documents are dealt out by ranges of doc_id and every task writes one shard: a file in Arrow's stream format whose
rows are fixed-size lists, ``ids`` (unsigned 16-bit where the vocabulary allows, else 32-bit) and ``mask`` (bits,
false only in the padding of a shard's last sequence), and a second one with the documents in it (doc_id,
n_tokens). All batches of a file but the last have ROWS sequences, so that sequence i is found by arithmetic; a
memory-mapped shard gives sequences and masks without a copy (``Shard``). The shards in their order, without padding, are
all documents in ascending doc_id order, each followed by the end id.

Files lie in the folder that all executors share. Their names carry the task attempt and readers take only
those that a finished task has reported.

A tokenizer that drops white space codes each word by itself, so that words met before need not be coded again; ``words``
says that it does. Otherwise whole texts go to the tokenizer.

Nulls: a null text counts as empty and gives the end id alone; null doc_ids come first. Rows that repeat a doc_id stay in the
order of their place in the files. A text longer than a block is coded in parts cut at blanks where words=True, else whole.
No rows in, no shards out. Other columns don't matter.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrine.llm.common import cut, located, release, remove, shared_path

END, LENGTH = 2, 2048
#: Sequences in a batch.
ROWS = 256
#: Bytes of text that are coded at once, and bytes of words that a worker remembers.
BLOCK, REMEMBERED = 8 << 20, 32 << 20


class Encoder:
    """Token ids of texts in one Python worker."""

    def __init__(self, path: str, words: bool, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        special = [(i, t.content) for i, t in sorted(self.model.get_added_tokens_decoder().items()) if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.words, self.mark = words and bool(special), special[-1] if special else None
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.names, self.ends, self.pool = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, self.kind)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Code distinct words that are not known yet, many in one text with a special token between them; their places among the known."""
        number, mark = self.mark
        apart = pc.match_substring(words, mark)
        plain, own = words.filter(pc.invert(apart)), words.filter(apart)
        found, counts = [], []
        glue = f" {mark} "
        for k in range(0, len(plain), 4096):
            ids = np.array(self.model.encode_batch_fast([glue.join(plain[k : k + 4096].to_pylist()) + glue], add_special_tokens=False)[0].ids, np.int64)
            marks = ids == number
            found.append(ids[~marks])
            counts.append(np.diff(np.flatnonzero(marks), prepend=-1) - 1)
        if len(own):
            each = [x.ids for x in self.model.encode_batch_fast(own.to_pylist(), add_special_tokens=False)]
            found += [np.array(x, np.int64) for x in each]
            counts.append(np.array([len(x) for x in each], np.int64))
        places = len(self.names) + np.argsort(np.argsort(apart.to_numpy(zero_copy_only=False), kind="stable"))
        self.names = pa.concat_arrays([self.names, plain, own])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])
        self.pool = np.concatenate([self.pool, *found]).astype(self.kind)
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text's after another's, and how many each text has."""
        if not self.words:
            ids = [x.ids for x in self.model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in ids for i in x], self.kind), np.array([len(x) for x in ids], np.int64)
        split = pc.ascii_split_whitespace(texts)
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)])
        if self.names.nbytes > self.remembered:
            self.forget()
        # each distinct word of the texts is looked up once
        words = split.flatten().dictionary_encode()
        known = pc.index_in(words.dictionary, value_set=self.names)
        places = pc.fill_null(known, -1).to_numpy().astype(np.int64)
        new = words.dictionary.filter(known.is_null())
        if len(new):
            places[places < 0] = self._learn(new)
        where = places[words.indices.to_numpy()]
        lists = pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.pool))
        ends = np.concatenate([[0], np.cumsum(np.diff(self.ends)[where])])
        ids = lists.take(pa.array(where)).flatten().to_numpy() if len(where) else self.pool[:0]
        return ids, np.diff(ends[at])


@lru_cache(maxsize=1)
def encoder(path: str, words: bool) -> Encoder:
    """One encoder a worker."""
    return Encoder(path, words)


def _pieces(texts: pa.Array, words: bool, block: int) -> Iterator[tuple[pa.Array, bool]]:
    """Texts of about a block; true if what comes ends a text, false for a part after which more of the same text follows."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + block, "right")) - 1)
        if words and ends[j] - ends[i] > block:
            text, begin = texts[i].as_py(), 0
            while (end := text.find(" ", begin + block)) >= 0:
                yield pa.array([text[begin:end]], pa.large_string()), False
                begin = end
            yield pa.array([text[begin:]], pa.large_string()), True
        else:
            yield texts[i:j], True
        i = j


class _Writer:
    """One shard."""

    def __init__(self, folder: str, name: str, kind: np.dtype, length: int):
        from pyarrow import fs

        self.paths = [f"{folder}/{name}.{x}.arrow" for x in ("tokens", "docs")]
        self.kind, self.length, self.held, self.n_held, self.n_docs, self.n_tokens = kind, length, [], 0, 0, 0
        ids = pa.list_(pa.from_numpy_dtype(kind), length)
        schemas = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))]), pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        self.streams = []
        for path, schema in zip(self.paths, schemas, strict=True):
            store, at = fs.FileSystem.from_uri(path)
            store.create_dir(at.rpartition("/")[0])
            sink = store.open_output_stream(at)
            self.streams.append((sink, pa.ipc.new_stream(sink, schema), schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.streams[1][1].write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(counts)], schema=self.streams[1][2]))
        self.n_docs += len(counts)
        self.extend(ids)

    def extend(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        batch = ROWS * self.length
        if self.n_held >= batch:
            held = np.concatenate(self.held)
            whole = len(held) // batch * batch
            for k in range(0, whole, batch):
                self._put(held[k : k + batch], batch)
            self.held, self.n_held = [held[whole:].copy()], len(held) - whole

    def _put(self, ids: np.ndarray, real: int) -> None:
        schema = self.streams[0][2]
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.streams[0][1].write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))

    def close(self) -> None:
        if self.n_held:
            ids = np.concatenate(self.held)
            self._put(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        for sink, writer, _ in self.streams:
            writer.close()
            sink.close()


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int = END, length: int = LENGTH, words: bool = False, block: int = BLOCK) -> DataFrame:
    """Write docs (doc_id, text) below folder; one row a shard, computed once: shard, tokens, docs, n_docs, n_tokens."""
    order = ["doc_id", "__file", "__row"]
    rows = located(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out = TaskContext.get(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            coder = encoder(tokenizer, words)
            out = out or _Writer(folder, f"{task.partitionId():06d}-{task.taskAttemptId()}", coder.kind, length)
            texts, k, before = pc.fill_null(batch.column(1), "").cast(pa.large_string()), 0, 0
            for part, ends in _pieces(texts, words, block):
                ids, counts = coder.encode(part)
                if not ends:
                    out.extend(ids)
                    before += len(ids)
                    continue
                ids = np.insert(ids, np.cumsum(counts), end).astype(coder.kind)
                counts += 1
                counts[0] += before
                out.add(batch.column(0)[k : k + len(counts)], ids, counts)
                k, before = k + len(counts), 0
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "tokens": [out.paths[0]], "docs": [out.paths[1]], "n_docs": [out.n_docs], "n_tokens": [out.n_tokens]})
        release()

    return cut(rows.select("doc_id", "text").mapInArrow(write, "shard long, tokens string, docs string, n_docs long, n_tokens long"))


class Shard:
    """A shard's tokens file in this machine's file system, mapped; what it gives are views of the file."""

    def __init__(self, path: str):
        self.table = pa.ipc.open_stream(pa.memory_map(path)).read_all()
        self.rows = len(self.table.column("ids").chunk(0)) if len(self.table) else 1

    def __len__(self) -> int:
        return len(self.table)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids of sequence i and its mask."""
        ids, mask = (self.table.column(c).chunk(i // self.rows).slice(i % self.rows, 1).flatten() for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask


def _documents(tokens: str, docs: str) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
    """doc_id, number of ids and the ids, in parts, of each document of a shard, read as streams."""
    from pyarrow import fs

    def batches(path: str) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_stream(at) as source:
            yield from pa.ipc.open_stream(source)

    def real() -> Iterator[np.ndarray]:
        for batch in batches(tokens):
            ids, mask = (c.flatten() for c in batch.columns)
            yield (ids if mask.true_count == len(mask) else ids.filter(mask)).to_numpy()

    parts, here = real(), np.zeros(0, "<u2")
    for batch in batches(docs):
        for doc_id, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, left = [], n
            while left > len(here):
                found.append(here)
                left -= len(here)
                here = next(parts)
            found.append(here[:left])
            here = here[left:]
            yield doc_id, n, found
    if len(here) or next(parts, None) is not None:
        raise ValueError(f"{tokens} has ids of no document")


def read_shards(shards: DataFrame, ids: bool = False) -> DataFrame:
    """Documents of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; ids: and ids, packed as unsigned 32-bit integers."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # a row a shard, however long the shards are
    offsets = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.binary()] * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, docs, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for doc_id, n, parts in _documents(tokens, docs):
                    crc = 0
                    for part in parts:
                        crc = zlib.crc32(part.astype("<u4"), crc)
                    rows.append((doc_id, start, n, crc, *([np.concatenate(parts).astype("<u4").tobytes()] if ids else [])))
                    start, held = start + n, held + (4 * n if ids else 0)
                    if len(rows) == 8192 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # the shards were named by a job of as many tasks, so their rows lie in as many partitions
    return shards.join(F.broadcast(offsets), "shard").select("tokens", "docs", "start").mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer: str, end: int = END, length: int = LENGTH, words: bool = False) -> DataFrame:
    """Write the documents and read them back."""
    folder = shared_path(docs.sparkSession, "tokens")
    back = cut(read_shards(write_shards(docs, folder, tokenizer, end, length, words)))
    remove(docs.sparkSession, folder)
    return back
