"""SparkSession factory with the settings the library expects."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def get_session(app: str = "vectrine", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE and UTC. ``master`` and the partition count are left to the cluster when None."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a Spark application; where it is installed on every machine nothing is sent.

    The archive is read by the driver's file server only, so the driver's own temporary folder will do.
    """
    package = Path(__file__).resolve().parent
    context = spark.sparkContext
    if package.parent.name in ("site-packages", "dist-packages") or context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="vectrine-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's Parquet tables; the path may be in any store that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a local master whose session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='vectrine-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/vectrine-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder; they outlive a lost executor, and Spark's cleaner removes them once nothing refers to them."""
    shared_root(df.sparkSession)
    return df.checkpoint()
