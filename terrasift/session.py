"""Session construction for local runs, tests and the benchmark."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_FOLDERS: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers import what the driver runs."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, "terrasift.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(name)  # the driver serves it to the executors
    _SHIPPED.add(context.applicationId)


@functools.lru_cache(maxsize=1)
def _own_root() -> str:
    folder = tempfile.mkdtemp(prefix="terrasift-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_root(spark: SparkSession) -> str:
    """A folder for this session's intermediate tables, below ``spark.checkpoint.dir``; it goes when the driver ends.

    Where that is unset, a local master (tests) gets a temporary one; on a cluster executors wouldn't see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_root()
    if root.startswith("/"):
        root = f"file://{root}"
    folder = f"{root.rstrip('/')}/terrasift-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_drop, spark, folder)
    return folder


def _drop(spark: SparkSession, folder: str) -> None:
    """Delete a folder while the session that made it still runs."""
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def local_session(cores: str | int = 8, shuffle_partitions: int = 8, memory: str = "12g", checkpoint_dir: str | None = None) -> SparkSession:
    """A local session with adaptive execution, UTC time and no user interface."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terrasift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
