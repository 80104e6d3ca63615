"""Versioned parquet folders: a new version beside the old one, never in place.

Readers take the newest version whose write has been committed by Spark (its
``_SUCCESS`` marker), so a run that is lost half way leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SUCCESS = "_SUCCESS"
# Of the files: documents are kept as text, which this packs much closer than the default.
CODEC = "zstd"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _hadoop(spark, path)
    return fs.exists(folder)


def delete(spark: SparkSession, path: str) -> None:
    fs, folder = _hadoop(spark, path)
    fs.delete(folder, True)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _hadoop(spark, path)
    if not fs.exists(folder):
        return []
    return [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]


def grandchild_folders(spark: SparkSession, path: str, pattern: str = "*") -> dict[str, list[str]]:
    """Folders in the folders of ``path`` that match, by the latter's names; listed in one call."""
    fs, folder = _hadoop(spark, path)
    jvm = spark.sparkContext._jvm
    found: dict[str, list[str]] = {}
    if fs.exists(folder):
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}/*")) or []:
            above, name = status.getPath().toString().rsplit("/", 2)[1:]
            found.setdefault(above, []).append(name)
    return found


def numbered(spark: SparkSession, path: str, prefix: str, committed: bool = True) -> list[int]:
    """Numbers N of the ``prefix=N`` children, ascending."""
    found = []
    for name in child_folders(spark, path):
        if name.startswith(f"{prefix}="):
            if not committed or exists(spark, f"{path}/{name}/{SUCCESS}"):
                found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def versions(spark: SparkSession, root: str) -> list[int]:
    return numbered(spark, root, "version")


def write_version(df: DataFrame, root: str, cluster_by: list[str] | None = None,
                  begun: int | None = None, last: bool = True) -> int:
    """Write ``df`` as the next version and return its number.

    A version may come in parts: ``begun`` is the number that the first part returned,
    and readers see none of them until the ``last`` is written.
    """
    spark = df.sparkSession
    taken = numbered(spark, root, "version", committed=False)
    version = begun or ((taken[-1] + 1) if taken else 1)
    out = df.sortWithinPartitions(*cluster_by) if cluster_by else df
    out.write.mode("append" if begun else "error").option("compression", CODEC).option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", str(last).lower()).parquet(f"{root}/version={version}")
    return version


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def read_latest(
    spark: SparkSession, root: str, schema: T.StructType | None = None
) -> DataFrame:
    """The newest committed version; an empty table of ``schema`` if there is none."""
    known = versions(spark, root)
    if known:
        return read_version(spark, root, known[-1])
    if schema is None:
        raise FileNotFoundError(f"no committed version below {root}")
    return spark.createDataFrame([], schema)


def staged(spark: SparkSession, df: DataFrame, root: str) -> DataFrame:
    """Write ``df`` once beside the table and read it back, cutting its lineage."""
    path = f"{root}/_staging-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.parquet(path)
