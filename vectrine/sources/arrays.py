"""NumPy files (.npy, .npz) as a Spark data source.

Files are listed once, by name and size. A large file is dealt to as many tasks as it has CHUNK bytes: each reads the header
itself and then only its own share of the values, so neither a file nor an array is ever held whole. Rows of the
leading axis become records; a row of more than STEP values becomes several. Members of an archive that are compressed
can't be entered in the middle and are streamed by one task.

Pickled objects, values that are no numbers, arrays stored column by column and files that end too soon are errors when they are read;
``numpy_headers`` tells of them without reading values.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vectrine.session import cut

CHUNK, STEP = 64 << 20, 1 << 16
#: Headers that one task reads.
TOGETHER = 64


@dataclass
class Header:
    shape: tuple[int, ...]
    fortran: bool
    dtype: np.dtype
    begin: int
    end: int

    @property
    def n(self) -> int:
        return int(np.prod(self.shape, dtype=object))

    def fault(self) -> str | None:
        """Why the values can't be read, if so."""
        if self.dtype.hasobject:
            return "pickled objects"
        if self.dtype.kind not in "biuf":
            return "no numbers"
        if self.fortran and sum(x != 1 for x in self.shape) > 1:
            return "stored column by column"
        if self.end - self.begin != self.n * self.dtype.itemsize:
            return "ends too soon" if self.end - self.begin < self.n * self.dtype.itemsize else "longer than its shape"
        return None


def read_header(file, size: int) -> Header:
    """The header of an array; file stands at its start and has size bytes."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(file)
    return Header(tuple(map(int, shape)), bool(fortran), dtype, file.tell(), size)


def files_below(root: str, pattern: str) -> list[tuple[str, int]]:
    """(place, size) of all files below a folder, or of the one file that root is; root is a path or the address of a store that pyarrow knows."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and fnmatch(f.base_name, pattern)]
    return sorted((f.path, f.size) for f in found)


@contextmanager
def opened(root: str, path: str):
    from pyarrow import fs

    store = fs.FileSystem.from_uri(root)[0] if "://" in root or root.startswith("file:") else fs.LocalFileSystem()
    with store.open_input_file(path) as file:
        yield file


def members(file, path: str, size: int) -> Iterator[tuple[str | None, bool, object, int]]:
    """(member, whether it can be entered anywhere, file, size) of an archive; of another file itself."""
    if not path.endswith(".npz"):
        yield None, True, file, size
        return
    with zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            if info.filename.endswith(".npy"):
                with archive.open(info) as member:
                    yield info.filename.removesuffix(".npy"), info.compress_type == zipfile.ZIP_STORED, member, info.file_size


def stem(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[0]


@dataclass
class Share(InputPartition):
    path: str
    size: int
    k: int
    of: int


class ValuesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*.np[yz]")
        self.chunk, self.step, self.skip = int(options.get("chunk", CHUNK)), int(options.get("step", STEP)), options.get("skip") == "true"

    def partitions(self) -> list[Share]:
        shares = [Share(path, size, k, of) for path, size in files_below(self.root, self.pattern) for of in [max(1, -(-size // self.chunk))] for k in range(of)]
        return shares or [Share("", 0, 0, 0)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        if not share.of:
            return
        with opened(self.root, share.path) as file:
            for member, anywhere, data, size in members(file, share.path, share.size):
                head = read_header(data, size)
                if (fault := head.fault()) and self.skip:
                    continue
                if fault:
                    raise ValueError(f"{share.path} {member or ''}: {fault}")
                k, of = (share.k, share.of) if anywhere else (0, 1)
                if share.k == k:
                    yield from self._records(share.path, member, data, head, k, of)

    def _records(self, path: str, member: str | None, data, head: Header, k: int, of: int) -> Iterator[pa.RecordBatch]:
        rows = head.shape[0] if head.shape else 1
        width = head.n // rows if rows else 0
        if not head.n:
            return
        pieces = -(-width // self.step)
        begin, end = rows * pieces * k // of, rows * pieces * (k + 1) // of
        place = lambda i: i // pieces * width + i % pieces * self.step  # noqa: E731  first value of record i
        if begin < end and begin:
            data.seek(head.begin + place(begin) * head.dtype.itemsize)
        most = max(1, self.step // min(width, self.step)) if pieces == 1 else 1
        for i in range(begin, end, most):
            j = min(i + most, end)
            n = (place(j) if j < rows * pieces else head.n) - place(i)
            raw = data.read(n * head.dtype.itemsize)
            if len(raw) != n * head.dtype.itemsize:
                raise ValueError(f"{path} ends too soon")
            values = np.frombuffer(raw, head.dtype).astype(float)
            at = np.arange(i, j)
            offsets = np.append((at // pieces * width + at % pieces * self.step) - place(i), n).astype(np.int32)
            columns = [[stem(path)] * len(at), [member] * len(at), at // pieces, at % pieces * self.step, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), None), strict=True)], ["name", "member", "row", "first", "values"])


@dataclass
class Files(InputPartition):
    files: list


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*.np[yz]")

    def partitions(self) -> list[Files]:
        files = files_below(self.root, self.pattern)
        return [Files(files[i : i + TOGETHER]) for i in range(0, len(files), TOGETHER)] or [Files([])]

    def read(self, part: Files) -> Iterator[tuple]:
        for path, size in part.files:
            with opened(self.root, path) as file:
                try:
                    for member, _, data, length in members(file, path, size):
                        head = read_header(data, length)
                        yield stem(path), member, head.dtype.str, list(head.shape), head.n, size, head.fault()
                except (ValueError, zipfile.BadZipFile) as e:
                    yield stem(path), None, None, None, None, size, f"no array: {e}"[:200]


class NumpyValues(DataSource):
    """``spark.read.format("numpy").load(folder)``; options pattern, chunk (bytes a task), step (values a record), skip (true: leave arrays out that can't be read)."""

    @classmethod
    def name(cls) -> str:
        return "numpy"

    def schema(self) -> str:
        return "name string, member string, row long, first long, values array<double>"

    def reader(self, schema) -> ValuesReader:
        return ValuesReader(self.options)


class NumpyHeaders(DataSource):
    """``spark.read.format("numpy_headers").load(folder)``: only headers are read."""

    @classmethod
    def name(cls) -> str:
        return "numpy_headers"

    def schema(self) -> str:
        return "name string, member string, dtype string, shape array<long>, n_values long, file_bytes long, fault string"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


def _load(spark: SparkSession, source: type[DataSource], root: str, pattern: str, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(pattern=pattern, **options).load(root)


def read_arrays(spark: SparkSession, root: str, pattern: str = "*.np[yz]", chunk: int = CHUNK, step: int = STEP, skip: bool = False) -> DataFrame:
    """name, member (of an archive), row (along the leading axis), first (place in the row) and values of the arrays below a folder."""
    return _load(spark, NumpyValues, root, pattern, chunk=chunk, step=step, skip=str(skip).lower())


def array_headers(spark: SparkSession, root: str, pattern: str = "*.np[yz]") -> DataFrame:
    """name, member, dtype, shape, n_values, file_bytes and fault (null where the values can be read) of the arrays below a folder."""
    return _load(spark, NumpyHeaders, root, pattern)


def array_report(arrays: DataFrame) -> DataFrame:
    """name, member, n_rows, n_values and n_not_finite of what read_arrays() gives."""
    odd = F.size(F.filter("values", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    return arrays.groupBy("name", "member").agg(
        (F.max("row") + 1).alias("n_rows"), F.sum(F.size("values")).alias("n_values"), F.sum(odd).cast("long").alias("n_not_finite")
    )


def checked_shards(spark: SparkSession, root: str, members: dict[str, tuple[str, tuple[int | None, ...]]], pattern: str = "*.npz") -> DataFrame:
    """name and faults (array; empty for a shard that holds) of each archive below a folder.

    members: what an archive must hold, name -> (kind of its values as NumPy writes it, sizes of its axes; None: any).
    Members that lack or are beyond these, other kinds, ranks and sizes, values that can't be read or are not finite are faults.
    """
    heads = array_headers(spark, root, pattern)
    want = F.create_map(*[F.lit(x) for name, (kind, shape) in members.items() for x in (name, f"{kind}:{len(shape)}")])
    kind = F.concat(F.regexp_replace("dtype", "^[<>|=]", ""), F.lit(":"), F.size("shape"))
    sized = F.lit(False)
    for name, (_, shape) in members.items():
        for axis, size in enumerate(shape):
            if size is not None:
                sized = sized | ((F.col("member") == name) & (F.try_element_at("shape", F.lit(axis + 1)) != size))
    fault = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.try_element_at(want, F.col("member")).isNull(), "not expected")
        .when(kind != F.try_element_at(want, F.col("member")), F.concat(F.lit("is "), kind))
        .when(sized, F.concat(F.lit("has shape "), F.array_join(F.col("shape").cast("array<string>"), "x")))
    )
    said = lambda text: F.when(text.isNotNull(), F.concat_ws(": ", "member", text))
    found = heads.groupBy("name").agg(F.array_sort(F.collect_list(said(fault))).alias("faults"), F.collect_set("member").alias("has"))
    lacking = F.transform(F.array_except(F.array(*map(F.lit, members)), "has"), lambda m: F.concat(m, F.lit(": lacks")))
    odd = array_report(read_arrays(spark, root, pattern, skip=True)).where("n_not_finite > 0")
    odd = odd.groupBy("name").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "member", F.lit("not finite")))).alias("odd"))
    return found.join(odd, "name", "left").select("name", F.concat("faults", F.array_sort(lacking), F.coalesce("odd", F.array().cast("array<string>"))).alias("faults"))


def write_arrays(vectors: DataFrame, folder: str, key: str, vector: str, rows: int = 4096) -> DataFrame:
    """Write key (integer) and vector columns as archives of at most so many rows below folder, members ids and vectors; name, n_rows, n_bytes and sha256 of each, computed once.

    Names carry the task attempt, and only those in the result count. Vectors have one length and no nulls.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import io

        from pyarrow import fs
        from pyspark import TaskContext

        task, k = TaskContext.get(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, values = part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False)
                held = io.BytesIO()
                np.savez(held, ids=ids, vectors=values.reshape(len(ids), -1))
                name, raw = f"{task.partitionId():06d}-{task.taskAttemptId()}-{k}", held.getvalue()
                store, place = fs.FileSystem.from_uri(f"{folder}/{name}.npz")
                store.create_dir(place.rpartition("/")[0])
                with store.open_output_stream(place) as out:
                    out.write(raw)
                k += 1
                yield pa.RecordBatch.from_pydict({"name": [name], "n_rows": [len(ids)], "n_bytes": [len(raw)], "sha256": [hashlib.sha256(raw).hexdigest()]})

    return cut(vectors.select(F.col(key).cast("long"), vector).mapInArrow(write, "name string, n_rows long, n_bytes long, sha256 string"))
