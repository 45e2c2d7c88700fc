"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage by writing a table and reading it back, so a lost
executor costs a re-read and nothing is recomputed from the beginning.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}

#: Whether a query's shuffle files are removed when it ends, instead of when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if shared:
        return f"{shared.rstrip('/')}/evigraph-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-evigraph-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. The shuffles of the write go when it ends, as only the table is read after that."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def few(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A staged table for a join: broadcast up to ``most`` rows, counted, and merged beyond."""
    return table.hint("broadcast") if table.count() <= most else table.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables as ``staged`` returned them, once nothing that is still to run reads them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
