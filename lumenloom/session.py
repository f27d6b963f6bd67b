"""Session defaults and the shared folder that long plans are cut in."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lumenloom", cores: str = "*", **conf: str) -> SparkSession:
    """A single-machine session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode without one, a folder of our own.

    On a cluster an unset folder is an error: executors could not see the driver's disk.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or getattr(context, "_lumenloom_root", None)
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context._lumenloom_root = "file://" + tempfile.mkdtemp(prefix="lumenloom-shared-")
    return context._lumenloom_root


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of our own in the shared one; what no step drops before is deleted when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)  # only what is there can be marked for deletion
    files.deleteOnExit(target)
    return path


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here and survives lost executors.

    A written table costs one pass; Dataset.checkpoint() would run the plan twice and store it uncompressed.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_lumenloom_shipped", False):
        return spark
    home = Path(__file__).resolve().parent
    if home.is_dir():
        files = sorted(home.rglob("*.py"))
        digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
        target = Path(tempfile.mkdtemp(prefix="lumenloom-")) / f"lumenloom-{digest}.zip"
        with zipfile.ZipFile(target, "w") as packed:
            for p in files:
                packed.write(p, str(p.relative_to(home.parent)))
        context.addPyFile(str(target))
    context._lumenloom_shipped = True
    return spark
