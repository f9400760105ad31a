"""A change log applied as a stream: landing, tombstones and revival of documents, batch after batch, with a ledger.

Each micro-batch turns one snapshot into the next: documents, their raw versions and their facts, in a folder named by the batch's number. A batch
is applied once its ledger row stands, which is written last; a batch that is run again (after a lost executor or a restart) starts from the same
snapshot and writes the same folder anew, so the state after a restart is the state without one.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.functions.storage import discard, exists, remove, stored
from lithic.operators.ingest import retire, storm_guard
from lithic.streaming.queue import drained

REASON = "source_tombstone"
DOCUMENTS = "document_id long, content_hash string, version long, valid_to timestamp_ntz, reason string"
LEDGER = "batch long, status string, landed long, tombstoned long, refused long, revived long"


class Cancelled(RuntimeError):
    """Someone asked for the run to stop; what is applied stays applied."""


@dataclass
class Storm:
    """How many documents one batch may tombstone: the greater of `least` and `share` of the live ones. None: any number."""

    least: int | None = 10
    share: float = 0.1


class CaptureLog:
    """The state that a change log has led to. changes: seq, at, document_id, op (upsert, delete), content_hash.

    Cases: changes of a document count in order of (at, seq); an upsert with the content that the document has lands nothing, but revives a document that the source
    had deleted, with its raw versions and facts; a delete of a document that isn't there or is retracted already does nothing; changes without a document are left out. Only
    what was retired for the source's sake is revived. Repeated changes do nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str, facts: DataFrame, storm: Storm | None = None):
        self.spark, self.path, self.storm = spark, path.rstrip("/"), storm or Storm()
        if not exists(spark, f"{self.path}/facts/_SUCCESS"):
            facts.write.mode("overwrite").parquet(f"{self.path}/facts")
        self.first_facts = spark.read.parquet(f"{self.path}/facts")

    # --- snapshots

    def ledger(self) -> DataFrame:
        """A row for each applied batch."""
        rows = [f"{self.path}/ledger"] if exists(self.spark, f"{self.path}/ledger") else []
        return self.spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(*rows) if rows else self.spark.createDataFrame([], LEDGER)

    def last_batch(self, before: int | None = None) -> int | None:
        rows = self.ledger()
        return rows.filter(F.col("batch") < before if before is not None else F.lit(True)).agg(F.max("batch")).first()[0]

    def state(self, name: str, batch: int | None) -> DataFrame:
        """documents, raw or facts as of a batch, or before any."""
        if batch is not None:
            return self.spark.read.parquet(f"{self.path}/{name}-{batch}")
        if name == "facts":
            return self.first_facts
        return self.spark.createDataFrame([], DOCUMENTS)

    def documents(self) -> DataFrame:
        return self.state("documents", self.last_batch())

    def raw(self) -> DataFrame:
        return self.state("raw", self.last_batch())

    def facts(self) -> DataFrame:
        return self.state("facts", self.last_batch())

    # --- control

    def cancel(self) -> None:
        """Ask a running stream to stop before its next batch."""
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/cancel")

    def resume(self) -> None:
        remove(self.spark, f"{self.path}/cancel")

    # --- batches

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Apply one micro-batch. It may be run again."""
        if exists(self.spark, f"{self.path}/cancel/_SUCCESS"):
            raise Cancelled(f"before batch {batch}")
        last = self.last_batch(batch)
        was, raw, facts = (self.state(n, last) for n in ("documents", "raw", "facts"))
        changes = changes.filter("document_id IS NOT NULL").select("seq", "at", "document_id", "op", "content_hash")
        ordered = Window.partitionBy("document_id").orderBy("at", "seq")
        # contents that differ from the one before, the first from the document's own
        known = was.select("document_id", F.col("content_hash").alias("known_hash"), F.col("version").alias("known_version"))
        upserts = changes.filter("op = 'upsert'").join(known, "document_id", "left")
        upserts = upserts.withColumn("before", F.coalesce(F.lag("content_hash").over(ordered), "known_hash")).filter(~F.col("content_hash").eqNullSafe(F.col("before")))
        landed = stored(upserts.select("document_id", "content_hash", (F.coalesce("known_version", F.lit(0)) + F.row_number().over(ordered)).alias("version")), "landed")
        newest = landed.groupBy("document_id").agg(F.max(F.struct("version", "content_hash")).alias("top")).select("document_id", F.col("top.version").alias("new_version"), F.col("top.content_hash").alias("new_hash"))
        final = changes.groupBy("document_id").agg(F.max(F.struct("at", "seq", "op")).alias("top")).select("document_id", F.col("top.op").alias("op"), F.col("top.at").alias("at"))
        rows = was.join(newest, "document_id", "full").join(final, "document_id", "left")
        merged = rows.select(
            "document_id", F.coalesce("new_hash", "content_hash").alias("content_hash"), F.coalesce("new_version", "version").alias("version"), "valid_to", "reason", "op", F.col("at").cast("timestamp_ntz").alias("at"),
            (F.col("version").isNotNull() | F.col("new_version").isNotNull()).alias("there"),
        )
        rows = stored(merged.filter("there").drop("there"), "batch")
        revived = rows.filter((F.col("op") == "upsert") & (F.col("reason") == REASON)).select("document_id")
        gone = rows.filter((F.col("op") == "delete") & F.col("valid_to").isNull()).select("document_id", "at")
        gone, refused = self.guarded(gone, was)
        at = gone.select("document_id", F.col("at").alias("gone_at"))

        def settled(df: DataFrame, which: str) -> DataFrame:
            """Rows of the batch's documents revived or retired, each at the time of its change."""
            back = df.join(revived.withColumn("back", F.lit(True)), "document_id", "left").join(at, "document_id", "left")
            undo = F.col("back") & (F.col("reason") == REASON)
            clear = lambda c: F.when(F.coalesce(undo, F.lit(False)), F.lit(None)).otherwise(F.col(c))
            back = back.withColumns({"valid_to": clear("valid_to"), "reason": clear("reason")})
            return retire(back, F.col("gone_at").isNotNull(), F.col("gone_at").cast(dict(df.dtypes)["valid_to"]), REASON).select(*[c for c in df.columns if c in which.split() or not which])

        settled(rows, "document_id content_hash version valid_to reason").write.mode("overwrite").parquet(f"{self.path}/documents-{batch}")
        older = raw.unionByName(landed.select("document_id", "content_hash", "version", F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(None).cast("string").alias("reason")))
        settled(older, "").write.mode("overwrite").parquet(f"{self.path}/raw-{batch}")
        settled(facts, "").write.mode("overwrite").parquet(f"{self.path}/facts-{batch}")
        counts = (landed.count(), gone.count(), refused.count(), revived.count())
        discard(landed, rows)
        done = self.spark.createDataFrame([(batch, "storm" if counts[2] else "applied", *counts)], LEDGER)
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        if last is not None and (older_still := self.last_batch(last)) is not None:  # two snapshots stay, so that the last batch can be run again
            for n in ("documents", "raw", "facts"):
                remove(self.spark, f"{self.path}/{n}-{older_still}")

    def guarded(self, gone: DataFrame, was: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents to retire, documents that the storm guard refuses)."""
        if self.storm.least is None:
            return gone, gone.limit(0)
        judged = storm_guard(gone.select("document_id"), was.filter("valid_to IS NULL").count(), self.storm.least, self.storm.share)
        judged = gone.join(judged, "document_id")
        return judged.filter("applied").drop("applied"), judged.filter("NOT applied").drop("applied")

    def resync(self, listing: DataFrame, at: datetime) -> None:
        """After a lost cursor: apply a full listing (document_id, content_hash) as one batch; live documents that it lacks count as deleted."""
        batch = (self.last_batch() if self.last_batch() is not None else -1) + 1
        was = self.documents().filter("valid_to IS NULL")
        there = listing.select(F.lit(0).cast("long").alias("seq"), F.lit(at).cast("timestamp_ntz").alias("at"), "document_id", F.lit("upsert").alias("op"), "content_hash")
        missing = was.join(listing.select("document_id"), "document_id", "left_anti")
        missing = missing.select(F.lit(0).cast("long").alias("seq"), F.lit(at).cast("timestamp_ntz").alias("at"), "document_id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("content_hash"))
        self.apply(there.unionByName(missing), batch)

    def run(self, stream: DataFrame, checkpoint: str) -> bool:
        """Apply what the stream has; whether it came to its end. A cancelled run goes on where it stopped once it is resumed and run again."""
        query = drained(stream, self.apply, checkpoint)
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            if "Cancelled" in str(e):
                return False
            raise
        return True
