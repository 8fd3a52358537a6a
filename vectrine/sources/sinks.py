"""Sinks and provenance: checked tables, small atomic files, job keys, manifests.

Tables are written by Spark's committers. Files here are small ones of the driver: manifests and reports.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(value) -> str:
    """Sorted keys, no spaces; NaN and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def json_sha(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_text(path: str, text: str) -> None:
    """All or nothing: a temporary file beside the target takes its place once it is on disk."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_name(f".{target.name}.{os.getpid()}.tmp")
    try:
        with draft.open("w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        draft.replace(target)
    finally:
        draft.unlink(missing_ok=True)


def write_report_csv(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """One CSV file of a small result table, in the order of the rows; more than most rows are an error, as they belong in a table."""
    found = rows.limit(most + 1).toPandas()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for {path}")
    write_text(path, found.to_csv(index=False, lineterminator="\n"))


def write_checked(rows: DataFrame, path: str) -> DataFrame:
    """Parquet and CSV next to each other; both are read back and must hold as many rows with the same columns."""
    rows.write.mode("overwrite").parquet(f"{path}/parquet")
    stored = rows.sparkSession.read.parquet(f"{path}/parquet")
    stored.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(f"{path}/csv")
    back = rows.sparkSession.read.options(header=True, multiLine=True, quote='"', escape='"').csv(f"{path}/csv")
    if stored.columns != rows.columns or back.columns != rows.columns or stored.count() != back.count():
        raise ValueError(f"{path} does not read back as it was written")
    return stored


def job_key(*columns: Column) -> Column:
    """Content-addressed key of a job: SHA-256 of its fields as canonical JSON; give them in the order of their names."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def pending_jobs(jobs: DataFrame, done: DataFrame, key: str = "job_key") -> DataFrame:
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, length and sha256 of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def dataset_hash(digests: DataFrame, records: dict[str, int] | None = None) -> str:
    """One hash of a data set from its files' names and digests, and how many records each has where that is given."""
    return json_sha({r.name: [r.sha256, records[r.name]] if records else r.sha256 for r in digests.orderBy("name").collect()})


def shard_manifest(stage: str, shards: list[dict]) -> dict:
    """A manifest of shards with its own hash over all else; shards: name, sha256 and shape each, no name twice."""
    if len({x["name"] for x in shards}) != len(shards):
        raise ValueError("a shard is named twice")
    body = {"stage": stage, "shards": sorted(shards, key=lambda x: x["name"])}
    return {**body, "manifest_sha256": json_sha(body)}


def manifest_holds(manifest: dict) -> bool:
    return manifest.get("manifest_sha256") == json_sha({k: v for k, v in manifest.items() if k != "manifest_sha256"})


class Manifest:
    """What a run was: stage, settings and their hash, seed, counts and times; written when it ends, however it ends."""

    def __init__(self, path: str, stage: str, settings: dict, seed: int):
        self.path, self.record = path, {"stage": stage, "settings": settings, "settings_sha256": json_sha(settings), "seed": seed, "counts": {}}

    def count(self, name: str, rows: DataFrame) -> int:
        self.record["counts"][name] = n = rows.count()
        return n

    def __enter__(self) -> Manifest:
        self.record["started"] = time.time()
        return self

    def __exit__(self, kind, error, _) -> None:
        self.record |= {"ended": time.time(), "status": "failed" if error else "done", "error": repr(error) if error else None}
        write_text(self.path, canonical_json(self.record) + "\n")


def reusable(path: str, settings: dict) -> bool:
    """Whether a run with these settings ended well before."""
    try:
        record = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return False
    return record.get("status") == "done" and record.get("settings_sha256") == json_sha(settings)


def reusable_vectors(spark: SparkSession, manifest: str, settings: dict, table: str, digests: dict[str, str], vector: str, size: int) -> bool:
    """Whether a table of vectors may be used again: its run ended well with these settings, its files have these digests, and all vectors are finite and of one size."""
    if not reusable(manifest, settings):
        return False
    found = {r.name: r.sha256 for r in file_digests(spark, table, "*.parquet").collect()}  # a row a file
    return found == digests and finite_vectors(spark.read.parquet(table), vector, size).isEmpty()


def finite_vectors(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector has another size or a value that is not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return rows.where(F.col(vector).isNull() | (F.size(vector) != size) | bad)
