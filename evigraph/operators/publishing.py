"""Versions of a set of tables: all are written before any is seen, and readers keep the version they began with."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions, oldest first."""
    fs, path = _fs(spark, f"{root}/_versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], partition: str | None = None) -> int:
    """Write the tables and make them the current version, whose number is returned.

    Tables go to a folder of their own. When all are complete, a folder named after the next version, which holds the place of that folder, is renamed into the list of versions. That is the only step
    that readers can see; a build that fails, or is stopped, before it leaves the old version current. Of two builds that publish at once one fails, as the target is there, and can be repeated. Tables that have the ``partition``
    column are partitioned by it and rebalanced, so that a large partition is written by many tasks and small ones share a task.
    """
    folder = f"{root}/tables-{uuid.uuid4().hex[:12]}"
    for name, table in tables.items():
        if partition in table.columns:
            table.hint("rebalance", partition).write.partitionBy(partition).parquet(f"{folder}/{name}")
        else:
            table.hint("rebalance").write.parquet(f"{folder}/{name}")
    pointer = f"{root}/_staged-{uuid.uuid4().hex[:12]}"
    columns = [(folder.rsplit("/", 1)[1], name, table.schema.json()) for name, table in tables.items()]
    spark.createDataFrame(columns, "folder string, name string, schema string").coalesce(1).write.parquet(pointer)
    number = (versions(spark, root) or [0])[-1] + 1
    fs, source = _fs(spark, pointer)
    _, target = _fs(spark, f"{root}/_versions/{number}")
    fs.mkdirs(target.getParent())
    hadoop = spark._jvm.org.apache.hadoop.fs
    no_option = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)  # it fails where the target exists
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(source), fs.makeQualified(target), no_option)
    return number


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a version, or of the current one."""
    number = version or (versions(spark, root) or [None])[-1]
    if number is None:
        raise LookupError(f"nothing is published in {root}")
    at = spark.read.parquet(f"{root}/_versions/{number}").filter(F.col("name") == name).first()
    if at is None:
        raise LookupError(f"version {number} has no table {name}")
    return spark.read.schema(StructType.fromJson(json.loads(at["schema"]))).parquet(f"{root}/{at['folder']}/{name}")
