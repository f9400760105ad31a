"""Indexes that are kept between queries: inverted lists of vectors by k-means cell, and of passages by term.

Both are bucketed tables of lists. A list has a number, made of its cell or its bucket of terms and a shard; what has more than `LIST_ROWS`
vectors or postings is dealt over as many shards as that takes, so no list, bucket or task grows with a hot one. A query computes the numbers of the
lists that it needs and filters on them, and the scan skips all other buckets.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.functions.storage import BucketedTable, discard, stored
from lithic.functions.text import content_hash, search_terms
from lithic.functions.vector import dot, hashed_embedding, norm, vector
from lithic.operators.retrieval import hash_blocks, ranked

LIST_ROWS = 50_000
#: Passages whose postings are packed together.
SEGMENT = 20_000
#: Terms are dealt over so many buckets; a search decodes those of its terms.
TERM_BUCKETS = 4096
#: Vectors that the cells are fitted on, whatever the size of the table, and rounds of the fit.
SAMPLE, FIT_ROUNDS = 20_000, 12
MAX_CELLS = 1024
#: Vectors that the number of probes is fitted on, how many neighbours of each, and the share of these that the probed lists must hold.
TRIALS, TRIAL_K, TARGET = 60, 20, 0.95


def list_number(name: Column, shard: Column) -> Column:
    return F.xxhash64(name, shard.cast("int"))


def shard_of(ident: Column, shards: Column) -> Column:
    return F.pmod(F.xxhash64(ident), shards).cast("int")


def unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def fitted_cells(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means of a bounded sample: unit vectors, one for each cell."""
    points, rng = unit(sample.astype(np.float64)), np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(FIT_ROUNDS):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        filled = np.bincount(own, minlength=len(centres)) > 0
        centres[filled] = unit(sums[filled])
    return centres


def nearest_cells(embedding: Column, centres: np.ndarray, n: int) -> Column:
    """The n cells nearest to a vector, best first."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells(vectors: pd.Series) -> pd.Series:
        got = np.stack(vectors.to_numpy()).astype(np.float64) @ centres.T if len(vectors) else np.zeros((0, len(centres)))
        most = min(n, len(centres))
        near = np.argpartition(-got, most - 1, axis=1)[:, :most] if len(got) else np.zeros((0, most), int)
        order = np.take_along_axis(-got, near, axis=1).argsort(axis=1, kind="stable")
        return pd.Series(list(np.take_along_axis(near, order, axis=1).astype(np.int32)))

    return cells(embedding)


def best_of_list(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each query (query_id, kind, v) the k items (id, kind, embedding) of its kind with the greatest cosine, ties by id."""

    def matrix(t: pa.Table, column: str) -> np.ndarray:
        return unit(t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1))

    def best(queries: pa.Table, items: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and items.num_rows:
            vectors, ids = matrix(items, "embedding"), items.column("id").to_numpy()
            kinds, asked = np.array(items.column("kind").to_pylist(), dtype=object), queries.column("kind").to_pylist()
            for a in range(0, queries.num_rows, 256):
                part = queries.slice(a, 256)
                scores = matrix(part, "v") @ vectors.T
                for query, kind, row in zip(part.column("query_id").to_pylist(), asked[a : a + 256], scores, strict=True):
                    own = np.flatnonzero(kinds == kind)
                    if len(own) > k:
                        own = own[row[own] >= np.partition(row[own], len(own) - k)[len(own) - k]]
                    own = own[np.lexsort((ids[own], -row[own]))][:k]
                    out += [(query, int(ids[i]), float(row[i])) for i in own]
        names = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(names[0], pa.int64()), "id": pa.array(names[1], pa.int64()), "cosine": pa.array(names[2], pa.float64())})

    return best


class VectorIndex:
    """Vectors (id, group, embedding) in inverted lists by cell; the groups are kinds of items that are only compared among themselves.

    Cells are fitted on at most `SAMPLE` vectors, those of least id hash; every vector that isn't null or zero is indexed. How many cells a search
    probes is fitted too: the true neighbours of `TRIALS` indexed vectors are looked up, and as many cells are probed as hold `TARGET` of them. Vectors
    in clear clusters need few, scattered ones most. An index holds vectors of one length.
    """

    ROWS = "list_id long, cell int, id long, kind string, embedding array<float>, norm double"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.table = BucketedTable(spark, "vector_lists", self.ROWS, "list_id", path, buckets)
        self.centres, self.shards, self.probes = np.zeros((0, 0)), np.zeros(0, np.int64), 0

    def build(self, items: DataFrame, cells: int | None = None) -> VectorIndex:
        """Index items: id, kind, embedding."""
        rows = items.filter("embedding IS NOT NULL").withColumn("norm", norm(F.col("embedding"))).filter("norm > 0")
        sample = rows.select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).collect()
        if not sample:
            return self
        n = rows.count()
        self.centres = fitted_cells(np.array([r.embedding for r in sample]), cells or min(MAX_CELLS, max(1, round(n**0.5))))
        placed = stored(rows.withColumn("cell", nearest_cells(F.col("embedding"), self.centres, 1)[0]), "vector-cells")
        self.shards = np.ones(len(self.centres), np.int64)
        for r in placed.groupBy("cell").count().collect():  # a row for each cell
            self.shards[r["cell"]] = -(-r["count"] // LIST_ROWS)
        shards = F.get(F.array(*[F.lit(int(s)) for s in self.shards]), F.col("cell"))
        self.table.append(placed.select(list_number(F.col("cell"), shard_of(F.col("id"), shards)).alias("list_id"), "cell", "id", "kind", "embedding", "norm"))
        self.probes = self.fitted_probes(placed)
        discard(placed)
        return self

    def fitted_probes(self, placed: DataFrame) -> int:
        """The least number of probes that reaches the target. TRIALS * TRIAL_K rows reach the driver."""
        trials = placed.orderBy(F.xxhash64(F.lit("trial"), "id")).limit(TRIALS).select(F.col("id").alias("trial"), F.col("kind").alias("of"), F.col("embedding").alias("v"), F.col("norm").alias("size"))
        met = placed.join(F.broadcast(trials), F.col("kind").eqNullSafe(F.col("of")) & (F.col("id") != F.col("trial")))
        order = Window.partitionBy("trial").orderBy(F.desc("cosine"), "id")
        scored = met.select("trial", "id", "cell", (dot(F.col("embedding"), F.col("v")) / (F.col("norm") * F.col("size"))).alias("cosine"))
        near = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TRIAL_K).select("trial", "cell").collect()
        if not near:
            return len(self.centres)
        vectors = {r.trial: np.asarray(r.v, np.float64) for r in trials.collect()}
        places = {t: np.argsort(np.argsort(-(self.centres @ v), kind="stable")) for t, v in vectors.items()}
        needed = sorted(int(places[r.trial][r.cell]) + 1 for r in near)
        return needed[min(len(needed) - 1, int(TARGET * len(needed)))]

    def lists(self, cells: list[int]) -> list[tuple[int, int]]:
        return [(c, s) for c in cells for s in range(int(self.shards[c]))]

    def near(self, query: list[float], probes: int | None = None) -> DataFrame:
        """The rows of the lists of the cells nearest to one vector. The scan reads their buckets only."""
        spark = self.table.spark
        if not len(self.centres):
            return self.table.rows()
        cells = np.argsort(-(self.centres @ np.asarray(query, np.float64)), kind="stable")[: probes or self.probes]
        wanted = spark.createDataFrame(self.lists(cells.tolist()), "cell int, shard int").select(list_number(F.col("cell"), F.col("shard")).alias("n"))
        return self.table.rows().filter(F.col("list_id").isin([r.n for r in wanted.collect()]))

    def topk(self, query: list[float], k: int, probes: int | None = None, kind: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """The k items nearest to a vector among the probed lists: id, score, rank. allowed: ids that may be found."""
        rows = self.near(query, probes)
        rows = rows if kind is None else rows.filter(F.col("kind") == kind)
        rows = rows if allowed is None else rows.join(allowed.select("id"), "id", "left_semi")
        size = float(np.linalg.norm(query)) or 1.0
        scored = rows.select("id", (dot(F.col("embedding"), vector(query)) / (F.col("norm") * size)).alias("score"))
        return ranked(scored.orderBy(F.desc("score"), "id").limit(k), "score")

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None, max_queries: int = 20_000) -> DataFrame:
        """For each query (query_id, kind, embedding) the k items of its kind nearest to it among its probed lists: query_id, id, cosine, rank.

        Queries meet lists on the lists' numbers, in blocks of at most max_queries, so that a task holds one bounded list and a bounded number of queries. It gives
        back k rows a query.
        """
        q = queries.filter("embedding IS NOT NULL").withColumn("query_norm", norm(F.col("embedding"))).filter("query_norm > 0")
        if not len(self.centres):
            return q.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("cosine"), F.lit(0).alias("rank")).limit(0)
        shards = F.array(*[F.lit(int(s)) for s in self.shards])
        found = []
        for block in hash_blocks(q, "query_id", max_queries):
            block = block.select("query_id", "kind", F.col("embedding").alias("v"), F.explode(nearest_cells(F.col("embedding"), self.centres, probes or self.probes)).alias("cell"))
            block = block.withColumn("shard", F.explode(F.sequence(F.lit(0), F.get(shards, F.col("cell")) - 1)))
            block = block.withColumn("list_id", list_number(F.col("cell"), F.col("shard"))).drop("cell", "shard")
            items = self.table.rows().select("list_id", "id", "kind", "embedding")
            found.append(block.groupBy("list_id").cogroup(items.groupBy("list_id")).applyInArrow(best_of_list(k), "query_id long, id long, cosine double"))
        scored = functools.reduce(DataFrame.unionByName, found)
        order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def drop(self) -> None:
        self.table.drop()


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact result's (query_id, id) that an approximate one has: queries, recall."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1.0).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


PASSAGE = ("chunk_id", "document_id", "tenant_id", "content")


def packed_postings(terms: list[str], sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray) -> bytes:
    """Postings of some terms in few bytes: sizes[k] postings of terms[k], as ids in ascending order and counts."""
    steps = np.diff(ids, prepend=0)
    text = "\n".join(terms).encode()
    return zlib.compress(struct.pack("<II", len(text), len(sizes)) + text + sizes.astype("<u4").tobytes() + steps.astype("<i8").tobytes() + tfs.astype("<u4").tobytes(), 6)


def unpacked_postings(blob: bytes, wanted: set[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    data = zlib.decompress(blob)
    size, n = struct.unpack_from("<II", data)
    terms = data[8 : 8 + size].decode().split("\n")
    sizes = np.frombuffer(data, "<u4", n, 8 + size).astype(np.int64)
    total, at = int(sizes.sum()), 8 + size + 4 * n
    ids, tfs = np.frombuffer(data, "<i8", total, at).cumsum(), np.frombuffer(data, "<u4", total, at + 8 * total)
    ends = sizes.cumsum()
    for k, term in enumerate(terms):
        if term in wanted:
            yield term, ids[ends[k] - sizes[k] : ends[k]], tfs[ends[k] - sizes[k] : ends[k]]


def segments(passages: DataFrame) -> DataFrame:
    """passages: chunk_id, terms. Packed postings of every `SEGMENT` passages of a task, by bucket of terms: segment, bucket, n, postings. Nothing is shuffled."""

    def packed(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        ids = t.column(0).combine_chunks().to_numpy(zero_copy_only=False)
        lists = t.column(1).combine_chunks()
        row = np.repeat(np.arange(len(ids)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        words = lists.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        bucket_of = np.array([zlib.crc32(w.encode()) % TERM_BUCKETS for w in names], np.int64)
        pair, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + row, return_counts=True)
        code, chunk = pair // len(ids), ids[pair % len(ids)]
        order = np.lexsort((chunk, code, bucket_of[code]))
        code, chunk, tf = code[order], chunk[order], tf[order]
        buckets, heads = np.unique(bucket_of[code], return_index=True)
        blobs, sizes = [], np.diff(np.append(heads, len(code)))
        for a, n in zip(heads, sizes, strict=True):
            own, at, each = np.unique(code[a : a + n], return_index=True, return_counts=True)
            blobs.append(packed_postings([names[c] for c in own[np.argsort(at)]], each[np.argsort(at)], chunk[a : a + n], tf[a : a + n]))
        columns = [pa.array(np.full(len(buckets), ids[0])), pa.array(buckets.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "bucket", "n", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[pa.RecordBatch] = []
        for batch in batches:
            got += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in got) >= SEGMENT:
                yield packed(got)
                got = []
        if got:
            yield packed(got)

    return passages.mapInArrow(run, "segment long, bucket int, n int, postings binary")


def postings_of(packed: DataFrame, terms: list[str]) -> DataFrame:
    """packed: version, postings. The postings of a few terms: version, term, chunk_id, tf."""
    wanted = set(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for version, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term, ids, tfs in unpacked_postings(blob, wanted):
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, version, np.int32)), pa.array([term] * n), pa.array(ids), pa.array(tfs.astype(np.int32))], names=["version", "term", "chunk_id", "tf"])

    return packed.mapInArrow(run, "version int, term string, chunk_id long, tf int")


class PassageIndex:
    """Passages (chunk_id, document_id, tenant_id, content) with their embeddings and postings, brought up to date by content hash.

    `update` takes the passages as they are now. Those whose content it has are left alone; for new or changed ones vectors and postings of a new version
    are appended, and what is gone or changed no longer counts, as a search only takes rows that the list of current passages names. A content's vector is kept once.
    `terms` makes the terms of the postings and of keyword queries; vectors are of `search_terms`.
    """

    TEXTS = "content_hash string, embedding array<float>, norm double"
    POSTINGS = "list_id long, version int, postings binary"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, terms: Callable[[Column], Column] = search_terms):
        self.spark, self.terms = spark, terms
        at = lambda name: f"{path.rstrip('/')}/{name}" if path else None
        self.texts = BucketedTable(spark, "passage_texts", self.TEXTS, "content_hash", at("texts"), buckets)
        self.postings = BucketedTable(spark, "passage_postings", self.POSTINGS, "list_id", at("postings"), buckets)
        self.current: DataFrame | None = None  # chunk_id, document_id, tenant_id, content_hash, version
        self.shards: dict[int, int] = {}  # by bucket of terms
        self.sizes: dict[int, int] = {}
        self.version = 0

    def update(self, passages: DataFrame) -> int:
        """Bring the index up to date; the number of passages that were new or changed."""
        self.version += 1
        hashed = passages.select(*PASSAGE, content_hash(F.coalesce("content", F.lit(""))).alias("content_hash"))
        if self.current is None:
            new = hashed
        else:
            new = hashed.join(self.current.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")
        new = new.repartition("chunk_id")
        if self.terms is search_terms:  # which vectors and postings both need: made once, kept in place of the texts
            new = new.withColumn("content", F.array_join(search_terms(F.coalesce("content", F.lit(""))), " "))
            embedded = terms = F.filter(F.split("content", " "), lambda t: t != "")
        else:
            embedded, terms = (made(F.coalesce("content", F.lit(""))) for made in (search_terms, self.terms))
        new = stored(new, "passages-new")
        # contents are embedded where they are, so that vectors are shuffled and texts aren't
        vectors = new.select("content_hash", hashed_embedding(embedded).alias("embedding")).groupBy("content_hash").agg(F.first("embedding").alias("embedding"))
        vectors = vectors.join(self.texts.rows().select("content_hash"), "content_hash", "left_anti")
        self.texts.append(vectors.withColumn("norm", norm(F.col("embedding"))))
        counts = stored(segments(new.select("chunk_id", terms.alias("terms"))), "postings-new")
        fresh = new.select("chunk_id", "document_id", "tenant_id", "content_hash", F.lit(self.version).alias("version"))
        before = self.current
        if before is not None:
            stay = before.join(hashed.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi")
            fresh = stay.select(*fresh.columns).unionByName(fresh)
        self.current, n = stored(fresh, "passages-current"), new.count()
        discard(new, *([before] if before is not None else []))  # the texts aren't needed any more
        for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each of TERM_BUCKETS
            self.sizes[r.bucket] = self.sizes.get(r.bucket, 0) + r.n
            self.shards[r.bucket] = -(-self.sizes[r.bucket] // LIST_ROWS)
        hot = {b: k for b, k in self.shards.items() if k > 1}
        shards = F.coalesce(F.get(F.array(*[F.lit(hot.get(b, 1)) for b in range(TERM_BUCKETS)]), F.col("bucket")), F.lit(1))
        number = list_number(F.col("bucket"), shard_of(F.col("segment"), shards))
        self.postings.append(counts.select(number.alias("list_id"), F.lit(self.version).alias("version"), "postings"))
        discard(counts)
        return n

    def term_lists(self, terms: list[str]) -> list[int]:
        """The numbers of the lists that hold a few terms."""
        buckets = {zlib.crc32(t.encode()) % TERM_BUCKETS for t in terms}
        pairs = [(b, k) for b in buckets for k in range(self.shards.get(b, 0))]
        return [r.n for r in self.spark.createDataFrame(pairs, "bucket int, shard int").select(list_number(F.col("bucket"), F.col("shard")).alias("n")).collect()] if pairs else []

    def terms_of(self, query: str) -> list[str]:
        return sorted(set(self.spark.range(1).select(self.terms(F.lit(query)).alias("t")).first().t))

    def found(self, terms: list[str]) -> DataFrame:
        """Current postings of a few terms: chunk_id, document_id, term, tf. The scan reads the buckets of their lists only."""
        lists = self.postings.rows().filter(F.col("list_id").isin(self.term_lists(terms))).select("version", "postings")
        return postings_of(lists, terms).join(self.current.select("chunk_id", "version", "document_id"), ["chunk_id", "version"])

    def keywords(self, query: str, k: int, visible: DataFrame | None = None) -> DataFrame:
        """The k passages of greatest keyword rank that have all terms of the query: id, score, rank. visible: document_id of what may be found."""
        terms = self.terms_of(query)
        rows = self.found(terms) if terms else self.found([""]).limit(0)
        rows = rows if visible is None else rows.join(visible.select("document_id"), "document_id", "left_semi")
        tf = F.col("tf")
        scored = rows.groupBy(F.col("chunk_id").alias("id")).agg(F.count("*").alias("has"), (F.sum(tf / (tf + 1)) / len(terms or [""])).alias("score")).filter(F.col("has") == len(terms))
        return ranked(scored.select("id", "score").orderBy(F.desc("score"), "id").limit(k), "score")

    def vectors(self, visible: DataFrame | None = None) -> DataFrame:
        """Current passages with their embeddings: id, document_id, content_hash, embedding, norm."""
        rows = self.current if visible is None else self.current.join(visible.select("document_id"), "document_id", "left_semi")
        return rows.select(F.col("chunk_id").alias("id"), "document_id", "content_hash").join(self.texts.rows(), "content_hash")

    def dense(self, query: str, k: int, visible: DataFrame | None = None) -> DataFrame:
        """The k passages nearest to a query text, over all vectors: id, score, rank."""
        v = self.spark.range(1).select(hashed_embedding(search_terms(F.lit(query))).alias("v")).first().v
        size = float(np.linalg.norm(v))
        rows = self.vectors(visible).filter("norm > 0")
        scored = rows.select("id", (dot(F.col("embedding"), vector(v)) / (F.col("norm") * size)).alias("score")) if size else rows.select("id", F.lit(0.0).alias("score")).limit(0)
        return ranked(scored.orderBy(F.desc("score"), "id").limit(k), "score")

    def drop(self) -> None:
        self.texts.drop()
        self.postings.drop()
        if self.current is not None:
            discard(self.current)
