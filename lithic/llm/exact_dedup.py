"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by SHA-256 digest. A batch is reduced to one row per
digest by partial aggregation, compared with the index by sort-merge anti-join, and what is new is
appended to the matching buckets, so a large index is never shuffled. Rows get their verdict by a
second join on the digest whose two sides are plain shuffles, which lets AQE split a digest that holds a
large share of the rows.

The number of buckets is kept beside the index and holds for every later opening; asking for another raises. Each index row names the
batch that brought it. A batch that is run again under its name, after a job further on has failed, gets the verdicts it got before
and adds nothing twice. Every append adds a file to each bucket; `compacted` writes an index anew with one sorted file a bucket.

Null texts count as empty, texts differ only if they differ after lower-casing A-Z, repeated rows are
counted each, columns beyond id and text are ignored, an empty table gives an empty result. Of equal texts whose ids are all null
one is recorded with a null id, and later ones are dropped in favour of that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import ascii_lower, shared_dir, stored


class DigestIndex:
    """Digests seen so far with the id that stays for each. `path` may hold an index from earlier runs."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or shared_dir(spark, "digest-index")).rstrip("/")
        self.buckets = self._layout(buckets)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _layout(self, buckets: int | None) -> int:
        """The index's number of buckets: as recorded, else as asked for, which is then recorded."""
        folder = f"{self.path}/_layout"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            found = self.spark.read.schema("buckets int").parquet(folder).first().buckets
            if buckets not in (None, found):
                raise ValueError(f"the index at {self.path} has {found} buckets, not {buckets}")
            return found
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(folder)
        return buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the digests of `groups` (digest, keep_id) that the index lacks, as rows of `batch`."""
        new = groups.select("digest", "keep_id").join(self.rows().hint("merge"), "digest", "left_anti")
        self._write(new.select("digest", "keep_id", F.lit(batch).alias("batch")))

    def _write(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        )

    def compacted(self, path: str) -> DigestIndex:
        """The same index in a new folder, each bucket one sorted file."""
        new = DigestIndex(self.spark, path, self.buckets)
        new._write(self.spark.read.schema(self.rows().schema).parquet(self.path))  # as plain files, or their buckets would pass for dealt out already
        return new

    def drop(self, files: bool = False) -> None:
        """Forget the table's name; its files stay unless `files` is set."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if files:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256; `index` is extended.

    Within a batch the largest id of equal texts stays; a text that the index already has from another batch is dropped in
    favour of the id recorded there. group_size counts the batch's rows. Without a name the batch counts as new.
    """
    batch = batch or uuid.uuid4().hex
    rows = stored(digests(docs, id_col, text_col), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("batch_id"), F.count("*").alias("group_size"))
    known = index.rows().filter(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known")).hint("merge")
    fresh = F.col("known").isNull()
    groups = stored(
        groups.join(known, "digest", "left").select("digest", "group_size", F.when(fresh, F.col("batch_id")).otherwise(F.col("known_id")).alias("keep_id"), fresh.alias("fresh")),
        "digest-groups",
    )
    index.append(groups.filter("fresh"), batch)
    return rows.join(groups.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def unique_documents(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of `docs`, all columns as they are, that stay: one of each group of equal texts that the index lacked."""
    verdicts = deduplicate(docs, index, id_col, text_col, batch).filter("kept")
    stay = verdicts.select(F.col("keep_id").alias("_keep_id"), F.unhex("text_sha256").alias("_kept_digest")).distinct()
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumn("_digest", F.unhex(F.sha2(text.cast("binary"), 256)))
    same = (F.col("_digest") == F.col("_kept_digest")) & F.col(id_col).cast("long").eqNullSafe(F.col("_keep_id"))
    return rows.join(stay, same, "left_semi").dropDuplicates([id_col, "_digest"]).drop("_digest")
