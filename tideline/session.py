"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Operators read these at analysis or run time, so they are set on the session
# that is handed in.  None of them sizes the cluster: partition counts and
# memory stay with whoever submits the job.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Spark distributes the archive, so workers find the code wherever they run.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tideline-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    # The helper process that a keyed stream starts beside the driver gets no
    # added files; it finds the package by its path.
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH"), str(package.parent)) if p]
    env["PYTHONPATH"] = os.pathsep.join(paths)
    _SHIPPED.add(app)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators depend on and ship the package."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tideline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.files.maxPartitionBytes", "32m")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FALLBACK: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    Where ``spark.checkpoint.dir`` is unset, a local master gets a temporary folder;
    on a cluster that is an error, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _FALLBACK:
            _FALLBACK[app] = tempfile.mkdtemp(prefix="tideline-")
        root = _FALLBACK[app]
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the job that made them, not when the driver collects garbage."""
    with _conf(spark, _FILE_CLEANUP, "true"):
        yield


_PARTITION_SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
}


@contextmanager
def small_partitions(spark: SparkSession) -> Iterator[None]:
    """Few bytes of a shuffle keep all cores busy, for rows that grow much after it."""
    with ExitStack() as held:
        for key, value in _PARTITION_SIZES.items():
            held.enter_context(_conf(spark, key, value))
        yield


def work_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the checkpoint root."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
