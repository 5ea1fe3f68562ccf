"""The folder that driver and executors share, and scratch tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With it, Spark deletes the shuffle files of a query that has ended, not only once the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The folder of each Spark application on a local master that names none.
_temporary: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session as a full URI.

    A path without a scheme belongs to Hadoop's default file system, as everywhere in Spark. Only
    on a local master, where all tasks run on this machine, an unset folder is replaced by a
    temporary one; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = _temporary.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="tidewright-")
        _temporary[spark.sparkContext.applicationId] = found
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(found)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.rstrip("/").replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri.rstrip("/")


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file of the driver into the shared folder, through Hadoop's file systems; returns its URI."""
    uri = f"{scratch(spark, 'files')}/{name}"
    path, system = _path(spark, uri)
    out = system.create(path)
    out.write(bytearray(data))
    out.close()
    return uri


def _path(spark: SparkSession, uri: str):
    """Hadoop's path of a URI, and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, uri: str) -> bool:
    path, system = _path(spark, uri)
    return system.exists(path)


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a file or folder; nothing happens if there is none."""
    path, system = _path(spark, uri)
    system.delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables of this Spark application; call it when no result that reads them is needed any more."""
    remove(spark, _own(spark))


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidewright-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table or folder, in the shared folder's part of this Spark application."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that begin within leave no shuffle files: for those whose result is written or fetched, so that nothing reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, by: str | None = None, buckets: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs a re-read.

    by: a column that rows are dealt to so many buckets by, so that windows, groups and joins by
    it need no shuffle. df should be partitioned by that column, as each task writes a file a
    bucket. Only the session's catalogue can name buckets, so the table is entered there while it
    is opened; nothing else holds it, and ``clear`` deletes its files.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with shuffles_deleted(spark):
        if by is None:
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        entry = f"spark_catalog.default.tidewright_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(entry)
    try:
        return spark.table(entry)
    finally:
        spark.sql(f"DROP TABLE {entry}")
