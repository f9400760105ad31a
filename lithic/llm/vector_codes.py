"""Compression of vectors to codes: per part of a vector, the nearest entry of a codebook, found by equal-average search.

Components x become integers floor(scale * x). A vector is cut into `parts` equal consecutive parts; each part position has a codebook,
which begins as that part of the `entries` vectors of least id and is replaced `rounds` times by the means, rounded down, of the parts
that are nearest to each entry (one without parts stays). Then all parts are assigned for good.

Equal-average search: entries are sorted by the sum of their components. As (sum a - sum b)^2 <= dimension * |a - b|^2, the
search goes outward from a part's own sum, nearer sum first, until the squared gap of sums over the dimension strictly exceeds the best
distance found; entries at the same distance are still seen then, and of those the one of lower index is taken.

A round is one pass over the vectors. Codebooks have a fixed size and go to all tasks; each task sums the parts of each entry on
its own, and the sums of tasks, a row for each entry, are added up in Spark.

Cases: vectors that are null or empty, hold null or non-finite components, or have another length than the vector of least id are dropped.
Vectors with a null id come last; of repeated ids the lesser vector is first; repeated rows each get a row. Fewer vectors than `entries`
make shorter codebooks; no vectors give no rows. Components of any finite size are handled; an error that a long can't hold is null. A
length that `parts` doesn't divide is refused. Null labels form a group of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import discard, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components times the length of a part beyond which squares may leave 64 bits, and Python's integers are used.
SAFE = 2**27
#: Sums of any size travel as sum // HALF and sum % HALF.
HALF = 10**20
ROWS = 2000
NO_BOOKS = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Codebooks:
    """entries: part, entry, component. int64, or Python integers where those are too small."""

    entries: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def usable(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector is there with finite components only, and as many as `dim` says."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("float")) < float("inf"))
    ok = (F.size(vector) > 0) & F.forall(vector, finite)
    return F.coalesce(ok if dim is None else ok & (F.size(vector) == dim), F.lit(False))


def integers(flat: np.ndarray, dim: int) -> np.ndarray:
    """dim: the length of a part."""
    scaled = np.floor(flat.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() * dim > SAFE:
        return np.array([int(x) for x in scaled], dtype=object)
    return scaled.astype(np.int64)


def equal_average(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the index of its nearest entry, the lowest of equals, and the squared distance."""
    n, dim = points.shape
    order = np.argsort(np.array(entries.sum(axis=1)), kind="stable")
    sums, ranked = entries.sum(axis=1)[order], entries[order]
    own = points.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    best, index = np.full(n, -1, dtype=points.dtype), np.full(n, len(entries), dtype=np.int64)
    live = np.arange(n)
    while len(live):
        lo, hi, mine = left[live], right[live], own[live]
        gap_lo, gap_hi = np.abs(mine - sums[np.maximum(lo, 0)]), np.abs(sums[np.minimum(hi, len(sums) - 1)] - mine)
        down = (lo >= 0) & ((hi >= len(sums)) | (gap_lo <= gap_hi))
        gap = np.where(down, gap_lo, gap_hi)
        go = ((lo >= 0) | (hi < len(sums))) & ((best[live] < 0) | (gap * gap <= best[live] * dim))
        live, down = live[go], down[go]
        at = np.where(down, left[live], right[live])
        left[live] -= down
        right[live] += ~down
        off = points[live] - ranked[at]
        distance, entry = (off * off).sum(axis=1), order[at]
        better = (best[live] < 0) | (distance < best[live]) | (distance == best[live]) & (entry < index[live])
        hit = live[better]
        best[hit], index[hit] = distance[better], entry[better]
    return index, best


def batches_of(batch: pa.RecordBatch, column: int, books: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """A batch's vectors in slices of rows: from, to, integers by row, part and component."""
    parts, _, dim = books.shape
    for a in range(0, batch.num_rows, ROWS):
        n = min(ROWS, batch.num_rows - a)
        ints = integers(batch.column(column).slice(a, n).flatten().to_numpy(zero_copy_only=False), dim)
        yield a, a + n, ints.reshape(n, parts, dim)


def assigned(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance by row and part."""
    if rows.dtype == object or books.dtype == object:
        rows, books = rows.astype(object), books.astype(object)
    found = [equal_average(rows[:, p], books[p]) for p in range(len(books))]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def first_books(vectors: DataFrame, id_col: str, vector_col: str, parts: int, entries: int) -> tuple[Codebooks | None, int]:
    """Codebooks from the vectors of least id, and the vectors' length. A few rows of fixed number reach the driver."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    ordered = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("i"), v.alias("v")).orderBy(F.asc_nulls_last("i"), "v")
    top = ordered.limit(1).collect()
    if not top:
        return None, 0
    dim = len(top[0].v)
    if not dim or dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    rows = ordered.filter(F.size("v") == dim).limit(entries).collect()
    ints = integers(np.array([r.v for r in rows], dtype=np.float64).ravel(), dim // parts).reshape(len(rows), parts, dim // parts)
    return Codebooks(np.swapaxes(ints, 0, 1).copy()), dim


def sums_by_entry(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vectors: v. The number of parts nearest to each entry and their sums: part, entry, n, high, low (decimal strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(books.shape, dtype=object)
        count = np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            for _, _, rows in batches_of(batch, 0, books):
                index, _ = assigned(rows, books)
                for p in range(len(books)):
                    count[p] += np.bincount(index[:, p], minlength=books.shape[1])
                    here = np.zeros(books.shape[1:], dtype=rows.dtype)
                    np.add.at(here, index[:, p], rows[:, p])
                    total[p] += here
        at = np.argwhere(count)
        halves = [[[str(divmod(int(x), HALF)[k]) for x in total[p, e]] for p, e in at] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(count[at[:, 0], at[:, 1]]), *[pa.array(h, pa.list_(pa.string())) for h in halves]],
            names=["part", "entry", "n", "high", "low"],
        )

    return vectors.mapInArrow(run, "part int, entry int, n long, high array<string>, low array<string>")


def refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The next round's codebooks: means, rounded down, of what each entry is nearest to."""
    dim = books.entries.shape[2]
    each = sums_by_entry(vectors, books.entries).groupBy("part", "entry")
    added = each.agg(F.sum("n").alias("n"), *[F.sum(F.get(h, F.lit(j)).cast("decimal(38,0)")).alias(f"{h}{j}") for h in ("high", "low") for j in range(dim)])
    out = books.entries.astype(object)
    for r in added.collect():  # a row for each entry
        out[r.part, r.entry] = [(int(r[f"high{j}"]) * HALF + int(r[f"low{j}"])) // r.n for j in range(dim)]
    return Codebooks(out.astype(np.int64) if max(map(abs, out.ravel())) * dim <= SAFE else out)


def coded(vectors: DataFrame, books: Codebooks, id_type: str, label_type: str) -> DataFrame:
    """vectors: id, label, v. id, label, code (two hex digits a part), error."""
    entries = books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, rows in batches_of(batch, 2, entries):
                index, distance = assigned(rows, entries)
                codes = [bytes(r).hex() for r in index.astype(np.uint8)]
                errors = [int(x) if x < 2**63 else None for x in distance.sum(axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(codes), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"id {id_type}, label {label_type}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error, label_error) of every usable vector, and the codebooks. label_error is the error summed over the label."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, so at most 256 entries")
    types = dict(vectors.dtypes)
    books, dim = first_books(vectors, id_col, vector_col, parts, entries)
    rows = vectors.filter(usable(F.col(vector_col), dim)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    if books is None:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), None
    for _ in range(rounds):
        books = refined(rows.select("v"), books)
    codes = stored(coded(rows, books, types[id_col], types[label_col]), "vector-codes")
    by_label = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("error").isNull()).alias("unknown"))
    by_label = by_label.select(F.col("label").alias("of"), F.when(F.col("unknown") == 0, F.col("total")).try_cast("long").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").drop("of"), books


def decoded(codes: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """Codes with the vectors that they stand for: each part is its entry, back in the scale of the input."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in e]) for e in part]) for part in books.entries.tolist()])
    part = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("decoded", F.concat(*[F.get(F.get(flat, F.lit(p)), part(p)) for p in range(len(books.entries))]))


def release(codes: DataFrame) -> None:
    """Delete the stored codes of `compress` once nothing reads them."""
    discard(codes)
