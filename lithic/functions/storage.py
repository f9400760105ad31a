"""Tables written to the folder that driver and executors share, to cut lineage where a plan is read several times."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="lithic-")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share. Only a session within one process may leave it unset."""
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or _own_dir()).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors.

    Unless the session says otherwise, shuffle files go as soon as a job is done, as nothing reads them again.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = shared_dir(spark, label)
    if spark.conf.get(cleanup, None) is None:
        spark.conf.set(cleanup, "true")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of stored frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(spark, folder)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class BucketedTable:
    """Rows in a folder of parquet files, bucketed and sorted by one column, so that a filter on its values reads their buckets only."""

    def __init__(self, spark: SparkSession, label: str, schema: str, column: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.column = spark, column
        self.path = (path or shared_dir(spark, label)).rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"{label}_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        writer = rows.select(*self.rows().columns).repartition(self.buckets, self.column).write.mode("append").format("parquet")
        writer.bucketBy(self.buckets, self.column).sortBy(self.column).option("path", self.path).saveAsTable(self.name)

    def drop(self) -> None:
        """Forget the table and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)
