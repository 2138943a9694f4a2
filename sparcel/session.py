"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Text casts follow these settings; every public entry point pins them.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows that a Python worker holds at a time; a row can be a whole document.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def pin(spark: SparkSession) -> SparkSession:
    """Set the runtime options that results or skew handling depend on, where they differ, and ship the package."""
    ship(spark)
    for key, value in PINNED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, memory: str = "12g", name: str = "sparcel") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="sparcel-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return pin(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session on one machine may leave it unset and gets a temporary folder; on a cluster that is an error, as the
    executors could not reach it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master or 'the cluster'} can reach")
        base = tempfile.mkdtemp(prefix="sparcel-")
        spark.conf.set("spark.checkpoint.dir", base)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


#: Sessions (by application id) whose workers have the package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, wherever the driver was started and whatever the workers have installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sparcel-ship-")) / "sparcel.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, Path("sparcel") / path.relative_to(package))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed by ``release``."""
    folder = f"{shared_dir(spark)}/sparcel-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return f"{folder}/{name}"


#: Folders below the shared one that each application has made.
_MADE: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Remove what ``scratch`` and ``written`` left in the shared folder; results that read it must have been used."""
    folders = _MADE.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several readers: it cuts the lineage, survives the loss of
    an executor and keeps row-position columns from being computed twice.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
