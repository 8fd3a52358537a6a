"""Corpus readers: many files, several formats, balanced caps, integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrine.functions.text import blank_to_null, strip


def read_jsonl(spark: SparkSession, path: str, schema: str, required: str = "text") -> DataFrame:
    """JSON lines; blank lines are skipped, and a line that is no object or lacks the required string is an error when read."""
    rows = spark.read.text(path).where(F.regexp_like("value", F.lit(r"\S")))
    parsed = rows.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    good = F.col("r").isNotNull() & F.col(f"r.{required}").isNotNull()
    return parsed.select(F.when(good, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.substring("value", 1, 80))).cast(schema_type(schema))).alias("r")).select("r.*")


def schema_type(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV whose quoted fields may hold line ends and doubled quotes."""
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A corpus by its suffix: .jsonl, .csv or .parquet; an empty one is an error."""
    kind = path.rsplit(".", 1)[-1].lower()
    readers = {"jsonl": read_jsonl, "csv": read_csv, "parquet": lambda s, p, _: s.read.parquet(p)}
    if kind not in readers:
        raise ValueError(f"no reader for {path}")
    rows = readers[kind](spark, path, schema)
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows


def read_tree(spark: SparkSession, root: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """All CSV files below a folder whose names match, with model_name from the file's name."""
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"', recursiveFileLookup=True, pathGlobFilter=pattern).schema(schema).csv(root)
    return rows.withColumn("model_name", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1))


def read_lines(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """Stripped lines of a list file; blank ones and comments are left out, a repeated one is an error."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> ''")
    if comments:
        rows = rows.where(~F.col("line").startswith("#"))
    if not rows.groupBy("line").count().where("count > 1").isEmpty():
        raise ValueError(f"{path} repeats a line")
    return rows


def balanced_cap(docs: DataFrame, cap: int, source: str, order: str, text: str = "text") -> DataFrame:
    """At most cap rows, dealt evenly over the sources; rank is a row's place in its source."""
    rows = docs.where(blank_to_null(F.col(text)).isNotNull())
    names = sorted(r[0] for r in docs.select(source).distinct().collect())  # sources are named by hand: few
    share, rest = divmod(cap, max(1, len(names)))
    quota = F.lit(share) + F.when(F.col(source).isin(names[:rest]), 1).otherwise(0)
    rank = F.row_number().over(W.partitionBy(source).orderBy(order)).cast("long")
    # the constant bound lets every task keep no more rows a source than any may have, before they are shuffled
    return rows.withColumn("rank", rank).where(F.col("rank") <= share + 1).where(F.col("rank") <= quota)


def read_questions(path: str) -> list[dict]:
    """Question entries of a small file: YAML where its library is installed, else JSON, which is YAML too."""
    import json

    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def paraphrases(questions: list[dict], skip: tuple[str, ...] = ("template", "json"), exactly: int | None = None) -> list[tuple[str, str, str | None]]:
    """(id, paraphrase, system prompt) of question entries, without those whose id holds a word to skip.

    exactly: so many entries must be left, each with one paraphrase and an id of its own; anything else is an error.
    """
    kept = [q for q in questions if not any(s in q["id"] for s in skip)]
    if exactly is not None and (len(kept) != exactly or len({q["id"] for q in kept}) != exactly or any(len(q["paraphrases"]) != 1 for q in kept)):
        raise ValueError(f"{exactly} questions with one paraphrase each were expected, of {len(kept)} left")
    return [(q["id"], p, q.get("system")) for q in kept for p in q["paraphrases"]]


def ordinals_hold(rows: DataFrame, ordinal: str) -> bool:
    """Whether an ordinal column runs from 0 without gaps or repeats."""
    n, low, high, distinct = rows.agg(F.count(F.lit(1)), F.min(ordinal), F.max(ordinal), F.countDistinct(ordinal)).first()
    return n == 0 or (low, high, distinct) == (0, n - 1, n)


def first_lines(spark: SparkSession, root: str, pattern: str, most: int = 1 << 20) -> DataFrame:
    """file and line: the first line of each file below a folder, of at most so many bytes; nothing else is read."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(root).select(F.col("_metadata.file_path").alias("file"))

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            lines = []
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    line = b""
                    while b"\n" not in line and len(line) < most and (more := file.read(4096)):
                        line += more
                lines.append(line.partition(b"\n")[0].decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], ["file", "line"])

    return files.mapInArrow(read, "file string, line string")


def read_tree_checked(spark: SparkSession, root: str, schema: str, required: tuple[str, ...], pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): rows of the CSV files below a folder that hold all required columns, and a row (file, reason) for each that does not.

    Files are judged by their header and by whether any value can't be read as the schema says; the others are read whole.
    """
    fields = schema_type(schema)
    heads = first_lines(spark, root, pattern)
    head = F.split(F.regexp_replace("line", r'["\r\x{FEFF}]', ""), ",")
    lacks = F.array_join(F.array_except(F.array(*map(F.lit, required)), head), ", ")
    heads = heads.select("file", F.when(lacks != "", F.concat(F.lit("lacks "), lacks)).alias("reason"), head.alias("head"))
    text = ", ".join(f"`{f.name}` string" for f in fields)
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', recursiveFileLookup=True, pathGlobFilter=pattern).schema(text).csv(root)
    rows = raw.withColumn("file", F.col("_metadata.file_path"))
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in fields}
    bad = F.exists(F.array(*[F.col(f"`{k}`").isNotNull() & v.isNull() for k, v in typed.items()]), lambda x: x)
    order = F.array(*[F.lit(f.name) for f in fields])
    odd = heads.where("reason is null").where(F.slice("head", 1, len(fields)) != order).select("file", F.lit("other columns").alias("reason"))
    broken = rows.where(bad).select("file", F.lit("values of another type").alias("reason")).distinct()
    rejected = heads.where("reason is not null").select("file", "reason").unionByName(odd).unionByName(broken)
    rejected = rejected.groupBy("file").agg(F.min("reason").alias("reason"))
    name = F.regexp_extract("file", r"([^/]*)\.[^./]*$", 1).alias("model_name")
    return rows.join(rejected.select("file"), "file", "left_anti").select(*[v.alias(k) for k, v in typed.items()], name), rejected


def pinned_union(sources: dict[str, tuple[DataFrame, str]], text: str = "text") -> DataFrame:
    """dataset, revision, document_id and text of several sources, each pinned to a revision; blank texts are left out. sources: name -> (rows of document_id and text, revision)."""
    out = None
    for name, (rows, revision) in sources.items():
        if not revision:
            raise ValueError(f"{name} is not pinned")
        one = rows.where(blank_to_null(F.col(text)).isNotNull()).select(F.lit(name).alias("dataset"), F.lit(revision).alias("revision"), F.col("document_id").cast("string").alias("document_id"), text)
        out = one if out is None else out.unionByName(one)
    return out


def seeded_sample(rows: DataFrame, n: int, seed, key: str) -> DataFrame:
    """n rows without replacement, the same whatever the layout: those with the least seeded hashes of a key."""
    from vectrine.functions.text import shuffle_key

    return rows.orderBy(shuffle_key(seed, F.col(key)), key).limit(n)


def attach_by_ordinal(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Columns of right beside left's by an explicit ordinal; both must number their rows from 0 without gaps, and hold as many."""
    if not (ordinals_hold(left, ordinal) and ordinals_hold(right, ordinal) and left.count() == right.count()):
        raise ValueError(f"{ordinal} does not number both tables alike")
    return left.join(right, ordinal)
