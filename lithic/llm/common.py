"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions.storage import discard, shared_dir, stored

__all__ = ["ascii_lower", "bounded_batches", "discard", "id_remainder", "lower_words", "shared_dir", "slices", "stored", "table"]

#: Words are maximal runs of anything but ASCII white space.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes from now on, where the session says nothing else: a batch of 10,000 long texts fills executors and their Python workers."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, in order, in slices of some `most` bytes of the text in `column`, or one row that is longer.

    What a task makes of a slice is bounded by this, however many rows a batch brings.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes, dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right"))
            b = max(a + 1, b)
            yield batch.slice(a, b - a)
            a = b


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_remainder(c: Column, mod: int) -> Column:
    """crc32 of the id as text, mod `mod`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(mod))


def lower_words(text: str | None) -> list[str]:
    """Words of a text with A-Z lower-cased and nothing else changed."""
    if not text:
        return []
    if text.isascii():
        # str.split() also cuts at \x1c-\x1f, which are not white space here
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.lower().split()
    return [w.decode() for w in text.encode("utf-8", "surrogatepass").lower().split()]
