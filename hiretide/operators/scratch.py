"""Written intermediate tables.

Some operators need two passes over one fixed arrangement of rows.  They write
it once to the folder the cluster names in ``spark.checkpoint.dir`` and read it
back: lineage is cut, a lost executor costs nothing, and the second pass reads
only the columns it needs.  Where that setting is absent (tests, a laptop) the
warehouse folder, which every executor shares too, is used.  What a process
wrote is removed when the process ends; loops drop their earlier rounds.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session, else one beside the warehouse's tables.

    On a cluster a warehouse on the driver's own disk is no shared folder, so there the setting is needed.
    """
    configured = spark.conf.get(_CONF, None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    one_machine = spark.conf.get("spark.master", "local").startswith("local[") or spark.conf.get("spark.master", "local") == "local"
    if not one_machine and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError(f"{_CONF} must name a folder that every executor shares; the warehouse {warehouse} is local")
    return f"{warehouse}/_scratch".rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/hiretide/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def drop(path: str) -> None:
    """Remove a written table nobody reads any more."""
    jvm = SparkContext._gateway.jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def overwrite_bytes(spark: SparkSession, folder: str, pattern: str, data: bytes) -> int:
    """Replace the content of a folder's files that match; how many there were.  For trials of broken tables."""
    jvm = SparkContext._gateway.jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    fs = at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration())
    found = fs.globStatus(at)
    for status in found:
        out = fs.create(status.getPath(), True)
        out.write(bytearray(data))
        out.close()
    return len(found)


@atexit.register
def _drop_all() -> None:
    for path in list(_made):
        with contextlib.suppress(Exception):  # the JVM may be gone already
            drop(path)


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """The written table; with ``by``, a filter on that column reads its rows only."""
    return materialise_at(df, label, by)[0]


def materialise_at(df: DataFrame, label: str, by: str | None = None) -> tuple[DataFrame, str]:
    """The written table and its path, for callers that drop it themselves."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    return (written.select(*df.columns) if by else written), path
