"""Katz backoff language model of order two or three, built and evaluated as Spark jobs.

All bigrams of the training texts, those seen once too, keep a Good-Turing discounted share of their history; what is left goes
to the other words in proportion to their unigram probability, by a backoff weight that makes every history sum to one
exactly:

    P(w | h) = d(r) r / c(h)             for a bigram of count r >= 1
             = a(h) P(w)                 else
    P(w)     = (c(w) + 1) / (N + V + 1)  one share is left for all unknown words
    a(h)     = (1 - sum of P(v | h)) / (1 - sum of P(v)) over the bigrams (h, v) seen

d(r) = r* / r up to `TURING` (r* = (r + 1) N(r+1) / N(r)), renormalised as Katz does, else
1. A history whose bigrams would leave nothing is given one more count. An unknown history backs off with weight 1.

Texts are tokenised once, into chunks of some `CHUNK` bytes: a row with the chunk's distinct words and, packed, its texts as places in
that list. Counting and scoring both work on distinct words and bigrams of a chunk:

- `words`, the table of order one, gives each word an id, smaller for frequent words, and its count. It is dealt out by hash, a row of lists for each bucket. Words with a share of the
  tokens above 1 / HEAD_WORDS, so at most that many, are looked up in a broadcast; for the others a chunk asks each bucket, as it does for bigrams.
- `pairs`, the table of order two, is partitioned by history, a row for each bucket with its bigrams packed and their counts; the number
  of buckets follows the tokens (`BUCKET_TOKENS`). Histories that would fill half a bucket or more are dealt out by bigram instead; what backing off
  from them needs are sums, at most two histories for each bucket, which are sent to the tasks.
- To score, a chunk asks each bucket for its distinct bigrams and gets their counts and their histories' weights.

Order three (`fit(..., order=3)`) takes the same step once more, on top of order two: P(w | u h) = d3(r) r / c(u h) for a trigram seen, else a(u h) P(w | h), with
a(u h) = (1 - sum of P(v | u h)) / (1 - sum of P(v | h)) over the trigrams (u, h, v) seen; a history not seen has weight 1, and the first word of a text has one word of history.

- `katz-second` holds the chunks with what order two answered about their bigrams, so trigrams bring along the counts that P(v | h) is made of.
- `triples`, the table of order three, is dealt out like `pairs`, by a trigram's first two words; frequent pairs of these, by the whole trigram.

Words are told apart by 64-bit hashes. Null texts are empty: one token, the end. Repeated rows are scored
each. With nothing to train on every token is unknown. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions.storage import exists
from lithic.llm.common import discard, slices, stored

TURING = 5
CHUNK = 4_000_000
HEAD_WORDS = 1_000_000
BUCKET_TOKENS = 1_000_000
PASSES = 2
START, UNKNOWN = 0, 1  # ids that no word has
END = 2  # stands for the end of a text among the words' hashes
_ODD = 0x9E3779B97F4A7C15


def spread(h: np.ndarray) -> np.ndarray:
    h = h.view(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pair_keys(h: np.ndarray, w: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
    """One key for each pair of ids up to `most`, and whether keys are in the order of pairs: both ids side by side, or a hash of them if they don't fit."""
    if most < 2**31:
        return h << 32 | w, True
    return spread(spread(h) + w.view(np.uint64) * np.uint64(_ODD)).view(np.int64), False


def in_order(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The order of pairs by non-negative h, then w, as np.lexsort((w, h)), by sorts of single numbers."""
    places = np.unique(h, return_inverse=True)[1]
    bits = int(w.max()).bit_length() if len(w) else 0
    return np.argsort(places << bits | w) if bits + len(h).bit_length() < 64 else np.lexsort((w, h))


def planes(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers of equal length, packed byte by byte so that equal bytes stand together."""
    n = len(columns[0])
    widths = [(int(c.max()).bit_length() + 7) // 8 if n else 0 for c in columns]
    body = b"".join(c.astype(np.int64, copy=False).view(np.uint8).reshape(n, 8)[:, :k].T.tobytes() for c, k in zip(columns, widths, strict=True))
    return np.array([n, len(columns), *widths], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    """The columns of `planes`, one a row."""
    n, k = np.frombuffer(blob[:16], np.int64).tolist()
    widths = np.frombuffer(blob[16 : 16 + 8 * k], np.int64).tolist()
    body = np.frombuffer(pa.decompress(blob[16 + 8 * k :], n * sum(widths), codec="zstd"), np.uint8) if sum(widths) else np.zeros(0, np.uint8)
    out, at = np.zeros((k, n, 8), np.uint8), 0
    for i, width in enumerate(widths):
        out[i, :, :width] = body[at : at + n * width].reshape(width, n).T
        at += n * width
    return out.view(np.int64).reshape(k, n)


def floats(x: np.ndarray) -> bytes:
    return pa.compress(x.view(np.uint8).reshape(len(x), 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked_floats(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd"), np.uint8).reshape(8, n).T.copy().view(float).ravel() if n else np.zeros(0)


def answer(count: np.ndarray, c: np.ndarray, back: np.ndarray) -> bytes:
    """Counts of the n-grams asked for, and denominators and backoff weights of their histories, in the order of the question."""
    parts = planes(count), planes(c)
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts) + floats(back)


def only_needed(back: np.ndarray, count: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Backoff weights, 0 for histories whose n-grams, from `starts` on, have all been seen, which don't back off: zeros pack better."""
    return np.where(np.minimum.reduceat(count, starts) == 0, back, 0.0) if len(starts) else back


def answer_read(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = np.frombuffer(blob[:16], np.int64).tolist()
    c = unpacked(blob[16 + a : 16 + a + b])[0]
    return unpacked(blob[16 : 16 + a])[0], c, unpacked_floats(blob[16 + a + b :], len(c))


def one_row(names: list[str], values: list) -> pa.RecordBatch:
    """A row of lists (arrays), numbers and bytes."""
    columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) if isinstance(v, pa.Array | np.ndarray) else pa.array([v]) for v in values]
    return pa.RecordBatch.from_arrays(columns, names=names)


def lists(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The lists of a column, as arrays."""
    c = batch.column(column)
    flat, offsets = c.flatten().to_numpy(zero_copy_only=False), c.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return (flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False))


def flat(table: pa.Table, column: str) -> np.ndarray:
    """All values of a column of lists, in order."""
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def dealt(buckets: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of words by bucket, the buckets that have some, and where each one's words start and the last one's end."""
    own = (spread(words) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    own = own[order]
    cuts = np.flatnonzero(np.diff(own, prepend=-1))
    return order, own[cuts], np.append(cuts, len(own))


def lists_of(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def with_answers(rows: DataFrame, answers: DataFrame, finished: Callable[[pa.RecordBatch, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Each chunk's row, as a batch, met with its answers in order of bucket; one chunk is in memory at a time."""

    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        return pa.Table.from_batches([finished(chunks.combine_chunks().to_batches()[0], told.sort_by("bucket"))])

    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


class Tokens:
    """Texts as chunks: chunk, ids (of the documents), sizes (tokens of each), train, words (hashes), freq (in training texts), codes."""

    def __init__(self, frame: DataFrame, kind: str):
        self.frame, self.kind = frame, kind
        self.resolved: tuple[Vocabulary, DataFrame] | None = None  # the last vocabulary they were looked up in, and the result
        self.second: tuple[Model, DataFrame] | None = None  # the last model whose order two they were looked up in, and the result


def tokenised(docs: DataFrame, train: Column | None = None) -> Tokens:
    """docs: doc_id, text. `train` marks the rows that a model fitted on these tokens learns from; all if it is left out."""
    flag = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), flag.alias("train"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, 1, CHUNK)):
            words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(1), "")))
            text = words.value_parent_indices().to_numpy()
            words = words.flatten()
            real = pc.greater(pc.binary_length(words), 0)  # there is an empty one before or after white space at the ends
            sizes = np.bincount(text[real.to_numpy(zero_copy_only=False)], minlength=batch.num_rows) + 1
            words = words.filter(real).dictionary_encode()
            codes, distinct = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False)
            del words, text, real
            seq = np.full(int(sizes.sum()), len(distinct), np.int64)
            inner = np.ones(len(seq), bool)
            inner[np.cumsum(sizes) - 1] = False
            seq[inner] = codes
            hashes = pd.util.hash_array(distinct, categorize=False).view(np.int64) if len(distinct) else np.zeros(0, np.int64)
            learn = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            freq = np.bincount(seq[np.repeat(learn, sizes)], minlength=len(distinct) + 1).astype(np.int64)
            yield one_row(["chunk", "ids", "sizes", "train", "words", "freq", "codes"], [base | k, batch.column(0), sizes, learn, np.append(hashes, END), freq, planes(seq)])

    schema = f"chunk long, ids array<{kind}>, sizes array<long>, train array<boolean>, words array<long>, freq array<long>, codes binary"
    return Tokens(stored(docs.mapInArrow(run, schema), "katz-tokens"), kind)


def discounts(of: dict[int, int]) -> dict[int, float]:
    """Katz's Good-Turing discounts for counts up to TURING from the counts of counts; 1 where they give no proper discount."""
    n = lambda r: of.get(r, 0)
    out = {}
    rest = (TURING + 1) * n(TURING + 1) / n(1) if n(1) else 1.0
    for r in range(1, TURING + 1):
        turing = (r + 1) * n(r + 1) / (r * n(r)) if n(r) else 1.0
        d = (turing - rest) / (1 - rest) if rest < 1 else 1.0
        out[r] = d if 0 < d < 1 else 1.0
    return out


class Words:
    """Rows of the table of order one, found by hash: the most frequent words, or a chunk's."""

    def __init__(self, w: np.ndarray, number: np.ndarray, n: np.ndarray):
        order = np.argsort(w)
        self.w, self.number, self.n = w[order], number[order], n[order]

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is here, its id (else UNKNOWN) and count (else 0)."""
        if not len(self.w):
            return np.zeros(len(words), bool), np.full(len(words), UNKNOWN, np.int64), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.w, words), len(self.w) - 1)
        has = self.w[at] == words
        return has, np.where(has, self.number[at], UNKNOWN), np.where(has, self.n[at], 0)


class Vocabulary:
    """The table of order one: lists w, n, id for each bucket, by falling n, and their sums."""

    def __init__(self, table: DataFrame):
        self.table = table
        total = table.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), F.max("texts").alias("texts"), F.max("last").alias("last"), F.max("buckets").alias("buckets")).first()
        self.tokens, self.types, self.texts, self.last, self.buckets = (x or 0 for x in total)
        head = self.above(HEAD_WORDS)
        self.head = table.sparkSession.sparkContext.broadcast(Words(*(head[c].to_numpy(np.int64) for c in ("w", "id", "n"))))

    def above(self, most: int) -> pd.DataFrame:
        """w, n, id of the words with a share of the tokens of at least 1 / `most`: at most so many."""
        tokens = self.tokens

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w, n, number in zip(*(lists(batch, c) for c in range(3)), strict=True):
                    up = n * most >= tokens
                    yield pa.RecordBatch.from_arrays([pa.array(w[up]), pa.array(n[up]), pa.array(number[up])], names=["w", "n", "id"])

        return self.table.select("w", "n", "id").mapInArrow(run, "w long, n long, id long").toPandas()

    def resolved(self, tokens: Tokens) -> DataFrame:
        """The chunks with their words' ids and counts in place of the words: chunk, ids, sizes, train, number, n, codes."""
        if tokens.resolved and tokens.resolved[0] is self:
            return tokens.resolved[1]
        head, buckets = self.head, max(self.buckets, 1)

        def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, words in zip(batch.column(0).to_pylist(), lists(batch, 1), strict=True):
                    rest = words[~head.value.find(words)[0]]
                    order, own, offsets = dealt(buckets, rest)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), chunk, np.int64)), lists_of(offsets, rest[order])], names=["bucket", "chunk", "w"])

        def answered(asks: pa.Table, table: pa.Table) -> pa.Table:
            asks = asks.combine_chunks()
            _, number, n = Words(*(flat(table, c) for c in ("w", "id", "n"))).find(flat(asks, "w"))
            offsets = np.append(0, np.cumsum(pc.list_value_length(asks.column("w")).to_numpy()))
            return pa.table({"chunk": asks.column("chunk"), "bucket": asks.column("bucket"), "number": lists_of(offsets, number), "n": lists_of(offsets, n)})

        def aligned(batch: pa.RecordBatch, answers: pa.Table) -> pa.RecordBatch:
            words = next(lists(batch, 4))
            has, number, n = head.value.find(words)
            rest = np.flatnonzero(~has)
            rest = rest[dealt(buckets, words[rest])[0]]
            number[rest], n[rest] = flat(answers, "number"), flat(answers, "n")
            same = [batch.column(c)[0].values for c in (1, 2, 3)]
            return one_row(["chunk", "ids", "sizes", "train", "number", "n", "codes"], [batch.column(0)[0].as_py(), *same, number, n, batch.column(5)[0].as_py()])

        asks = tokens.frame.select("chunk", "words").mapInArrow(asking, "bucket long, chunk long, w array<long>")
        answers = asks.groupBy("bucket").cogroup(self.table.select("bucket", "w", "n", "id").groupBy("bucket")).applyInArrow(answered, "chunk long, bucket long, number array<long>, n array<long>")
        schema = f"chunk long, ids array<{tokens.kind}>, sizes array<long>, train array<boolean>, number array<long>, n array<long>, codes binary"
        rows = with_answers(tokens.frame.select("chunk", "ids", "sizes", "train", "words", "codes"), answers, aligned, schema)
        tokens.resolved = self, stored(rows, "katz-resolved")
        return tokens.resolved[1]


def vocabulary_of(tokens: Tokens) -> Vocabulary:
    """Words of the training texts with their counts and ids: by frequency within as many buckets as the chunks' distinct words take."""
    parts = int(tokens.frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-(tokens.frame.agg(F.sum(F.size("words"))).first()[0] or 0) // BUCKET_TOKENS))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, freq in zip(lists(batch, 0), lists(batch, 1), strict=True):
                words, freq = words[freq > 0], freq[freq > 0]
                order, own, offsets = dealt(buckets, words)
                yield pa.RecordBatch.from_arrays([pa.array(own), lists_of(offsets, words[order]), lists_of(offsets, freq[order])], names=["bucket", "w", "freq"])

    def gathered(rows: pa.Table) -> pa.Table:
        w, freq, bucket = flat(rows, "w"), flat(rows, "freq"), rows.column("bucket")[0].as_py()
        order = np.argsort(w)
        w, freq = w[order], freq[order]
        new = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        w, n = w[new], np.add.reduceat(freq, new)
        order = np.lexsort((w, -n))
        w, n = w[order], n[order]
        number = np.arange(1, len(w) + 1) * buckets + bucket + 2
        names = ["bucket", "buckets", "tokens", "types", "texts", "last", "w", "n", "id"]
        return pa.Table.from_batches([one_row(names, [bucket, buckets, int(n.sum()), len(w), int(n[w == END].sum()), int(number[-1]), w, n, number])])

    rows = tokens.frame.select("words", "freq").mapInArrow(counted, "bucket long, w array<long>, freq array<long>")
    schema = "bucket long, buckets long, tokens long, types long, texts long, last long, w array<long>, n array<long>, id array<long>"
    return Vocabulary(stored(rows.groupBy("bucket").applyInArrow(gathered, schema), "katz-words"))


class Split:
    """How bigrams go to buckets: by history, those of the histories in `hot` by history and word."""

    def __init__(self, buckets: int, hot: np.ndarray):
        self.buckets, self.hot = buckets, np.sort(hot)

    def is_hot(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1) if len(self.hot) else None
        return self.hot[at] == h if at is not None else np.zeros(len(h), bool)

    def save(self, spark: SparkSession, path: str) -> None:
        hot = F.array(*[F.lit(int(h)).cast("long") for h in self.hot]).cast("array<long>")
        spark.range(1).select(F.lit(self.buckets).alias("buckets"), hot.alias("hot")).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Split:
        row = spark.read.parquet(path).first()
        return Split(row.buckets, np.array(row.hot, np.int64))

    def bucket(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        key, hot = spread(h), np.flatnonzero(self.is_hot(h))
        key[hot] = spread(key[hot] + w[hot].view(np.uint64) * np.uint64(_ODD))
        return (key % np.uint64(self.buckets)).astype(np.int64)


class Bigrams:
    """The distinct bigrams of a chunk's texts in order of bucket, history and word; `of` is each token's bigram, or -1 where it has none to ask for."""

    def __init__(self, split: Split, number: np.ndarray, n: np.ndarray, codes: np.ndarray, sizes: np.ndarray, chosen: np.ndarray | None = None):
        starts = np.cumsum(sizes) - sizes
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[starts] = len(number)
        asks = np.append(number, START)[before] != UNKNOWN
        if chosen is not None:
            asks &= np.repeat(chosen, sizes)
        ids, rank = np.unique(np.append(number, START), return_inverse=True)
        count = np.zeros(len(ids), np.int64)
        count[rank] = np.append(n, 0)
        h, w = rank[before[asks]], rank[codes[asks]]
        bits = len(ids).bit_length()
        inner = h << bits | w
        bucket, hot = split.bucket(ids, ids)[h], np.flatnonzero(split.is_hot(ids)[h])
        bucket[hot] = split.bucket(ids[h[hot]], ids[w[hot]])
        if 2 * bits + split.buckets.bit_length() < 64:
            order = np.argsort(bucket << 2 * bits | inner)
        else:
            order = np.lexsort((inner, bucket))
        inner, bucket = inner[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (inner[1:] != inner[:-1]) | (bucket[1:] != bucket[:-1])
        first = np.flatnonzero(new)
        self.of = np.full(len(codes), -1, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        self.of[asks] = place
        self.times = np.diff(first, append=len(order))
        self.bucket = bucket[first]
        w = inner[first] & ((1 << bits) - 1)
        self.h, self.w, self.n = ids[inner[first] >> bits], ids[w], count[w]

    def parts(self) -> Iterator[tuple[int, slice]]:
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1)) if len(self.bucket) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(self.bucket[a]), slice(a, b)


def history_keys(u: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """One non-negative key for each pair of words."""
    return pair_keys(u, v, most)[0] & np.int64(2**63 - 1)


def runs(bucket: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The number of each row's run of equal histories in a bucket."""
    return np.cumsum((np.diff(h, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0)) - 1


class Trigrams:
    """The distinct trigrams of a chunk's texts in order of bucket and history, above its `Bigrams`: `first` and `last` are the places of their two bigrams there, `key` their histories' keys."""

    def __init__(self, split: Split, two: Bigrams, seen: np.ndarray, sizes: np.ndarray, most: int, chosen: np.ndarray | None = None):
        before = np.empty_like(two.of)
        before[1:] = two.of[:-1]
        before[np.cumsum(sizes) - sizes] = -1
        asks = (before >= 0) & (two.of >= 0) & np.append(seen, False)[before]  # histories that training hasn't seen have weight 1
        if chosen is not None:
            asks &= np.repeat(chosen, sizes)
        h, last = before[asks], two.of[asks]
        keys = history_keys(two.h, two.w, most)
        by = np.unique(keys, return_inverse=True)[1]
        bits = len(keys).bit_length()
        inner, bucket = by[h] << bits | last, split.bucket(keys[h], two.w[last])
        if 2 * bits + split.buckets.bit_length() < 64:
            order = np.argsort(bucket << 2 * bits | inner)
        else:
            order = np.lexsort((inner, bucket))
        inner, bucket = inner[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (inner[1:] != inner[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(new)
        self.of = np.full(len(two.of), -1, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        self.of[asks] = place
        self.times = np.diff(at, append=len(order))
        self.bucket = bucket[at]
        self.first, self.last = h[order][at], last[order][at]
        self.key, self.w = keys[self.first], two.w[self.last]

    parts = Bigrams.parts


SUMS = TURING + 2  # bigrams seen 1 to TURING times, tokens of those seen more often, sum of c(w) + 1


def history_sums(h: np.ndarray, r: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Histories in order, and for each a row of SUMS; the last is 0 without `n`. Bigrams come in order of history."""
    first = np.diff(h, prepend=-1) != 0
    new = np.flatnonzero(first)
    out = np.bincount((np.cumsum(first) - 1) * SUMS + np.minimum(r, TURING + 1) - 1, minlength=len(new) * SUMS).reshape(-1, SUMS)
    if len(new):
        out[:, TURING] = np.add.reduceat(np.where(r > TURING, r, 0), new)
        out[:, TURING + 1] = np.add.reduceat(n + 1, new) if n is not None else 0
    return h[new], out


class Weights:
    """What the sums of histories come to: denominators and log10 of the backoff weights."""

    def __init__(self, d: dict[int, float], tokens: int, types: int):
        self.discount = np.array([1.0, *(d[r] for r in range(1, TURING + 1))])
        self.share = float(tokens + types + 1)

    def of(self, sums: np.ndarray, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """`lower`: what the seen words of each history come to at the order below; from the sums if that is order one."""
        lower = sums[:, TURING + 1] / self.share if lower is None else lower
        r = np.arange(1, TURING + 1)
        c = sums[:, :TURING] @ r + sums[:, TURING]
        kept = sums[:, :TURING] @ (r * self.discount[1:]) + sums[:, TURING]
        c = c + (kept >= c * (1 - 1e-9))
        return c, np.log10((1 - kept / c) / (1 - lower))

    def discounted(self, r: np.ndarray) -> np.ndarray:
        return r * self.discount[np.where(r <= TURING, r, 0)]

    def kept(self, r: np.ndarray) -> np.ndarray:
        """log10 of the discounted count, that of 1 for an n-gram not seen."""
        return np.log10(np.where(r > 0, self.discounted(r), 1))

    def word(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / self.share)


class Model:
    """A fitted model: its tables, the split of histories and the discounts."""

    def __init__(self, vocabulary: Vocabulary, pairs: DataFrame, split: Split, third: Third | None = None):
        self.vocabulary, self.pairs, self.split, self.third = vocabulary, pairs, split, third
        self.tokens, self.types = vocabulary.tokens, vocabulary.types
        row = pairs.agg(*[F.sum(F.col("seen")[k]).alias(f"n{k + 1}") for k in range(TURING + 1)]).first()
        self.weights = Weights(discounts({k + 1: row[k] or 0 for k in range(TURING + 1)}), self.tokens, self.types)
        rows = pairs.select(F.explode("hot").alias("x")).groupBy(F.col("x")[0].alias("h")).agg(*[F.sum(F.col("x")[k + 1]).alias(f"s{k}") for k in range(SUMS)]).toPandas()
        rows = rows.sort_values("h").to_numpy(np.int64).reshape(-1, SUMS + 1)  # at most two for each bucket
        self.hot = rows[:, 0].copy(), *self.weights.of(rows[:, 1:])

    def bigrams(self) -> DataFrame:
        """The table of order two as rows: h, w (ids), n."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    step, w, r, _ = unpacked(blob)
                    yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(step)), pa.array(w), pa.array(r)], names=["h", "w", "n"])

        return self.pairs.select("bigrams").mapInArrow(run, "h long, w long, n long")

    def frequent(self, buckets: int) -> np.ndarray:
        """Keys of the bigrams that would fill half of one of so many buckets, as histories of trigrams: at most two for each bucket."""
        tokens, most = self.tokens, self.vocabulary.last

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    step, w, r, _ = unpacked(blob)
                    yield pa.RecordBatch.from_arrays([pa.array(history_keys(np.cumsum(step), w, most)[r * 2 * buckets >= tokens])], names=["h"])

        return np.array([r.h for r in self.pairs.select("bigrams").mapInArrow(run, "h long").collect()], np.int64)

    def save(self, path: str) -> None:
        self.vocabulary.table.write.parquet(f"{path}/order=1")
        self.pairs.write.parquet(f"{path}/order=2")
        spark = self.pairs.sparkSession
        self.split.save(spark, f"{path}/split")
        if self.third:
            self.third.triples.write.parquet(f"{path}/order=3")
            self.third.split.save(spark, f"{path}/split3")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        model = Model(Vocabulary(spark.read.parquet(f"{path}/order=1")), spark.read.parquet(f"{path}/order=2"), Split.load(spark, f"{path}/split"))
        if exists(spark, f"{path}/order=3"):
            model.third = Third(model.weights, spark.read.parquet(f"{path}/order=3"), Split.load(spark, f"{path}/split3"))
        return model


def fit(tokens: Tokens, keep: bool = True, order: int = 2) -> Model:
    """Learn from the texts that `tokens` marks, up to order two or three.

    Unless they are to be kept, the tokens' own table goes once their words are looked up, and with order three the tables of orders one and two once
    the tokens' bigrams are; only this model can score them then, and one of order three nothing else.
    """
    spark, vocabulary = tokens.frame.sparkSession, vocabulary_of(tokens)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vocabulary.tokens // BUCKET_TOKENS))
    hot = vocabulary.above(2 * buckets).id.tolist()
    hot += [START] if vocabulary.texts * 2 * buckets >= vocabulary.tokens else []
    split = spark.sparkContext.broadcast(Split(buckets, np.array(hot, np.int64)))
    ready, most = vocabulary.resolved(tokens), vocabulary.last
    if not keep:
        discard(tokens.frame)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (sizes, learn, number, n) in enumerate(zip(*(lists(batch, c) for c in range(4)), strict=True)):
                got = Bigrams(split.value, number, n, unpacked(batch.column(4)[k].as_py())[0], sizes, learn.astype(bool))
                rows = [(b, planes(np.diff(got.h[s], prepend=0), got.w[s], got.times[s], got.n[s])) for b, s in got.parts()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

    def gathered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(b) for b in rows.blob]
        h = np.concatenate([np.cumsum(p[0]) for p in parts])
        w, times, n = np.concatenate([p[1:] for p in parts], axis=1)
        del parts
        order = np.argsort(h << 32 | w) if most < 2**31 else in_order(h, w)
        h, w, times, n = h[order], w[order], times[order], n[order]
        del order
        new = np.flatnonzero((np.diff(h, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
        h, w, n, r = h[new], w[new], n[new], np.add.reduceat(times, new)
        seen = np.bincount(np.minimum(r, TURING + 2), minlength=TURING + 3)[1 : TURING + 2]
        histories, sums = history_sums(h, r, n)
        hot = split.value.is_hot(histories)
        table = planes(np.diff(h, prepend=0), w, r, n)
        return pd.DataFrame({"bucket": [key[0]], "bigrams": [table], "seen": [seen.tolist()], "hot": [np.column_stack([histories, sums])[hot].tolist()]})

    pairs = ready.select("sizes", "train", "number", "n", "codes").mapInArrow(counted, "bucket long, blob binary")
    pairs = pairs.groupBy("bucket").applyInPandas(gathered, "bucket long, bigrams binary, seen array<long>, hot array<array<long>>")
    model = Model(vocabulary, stored(pairs, "katz-pairs"), split.value)
    if order > 2:
        model.third = third_of(tokens, model, keep)
    return model


def answers_of(ready: DataFrame, model: Model) -> DataFrame:
    """What order two says about the chunks' bigrams: chunk, bucket, blob."""
    weights, most = model.weights, model.vocabulary.last
    sent = ready.sparkSession.sparkContext.broadcast((model.split, model.hot))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (sizes, number, n) in enumerate(zip(*(lists(batch, c) for c in range(3)), strict=True)):
                got = Bigrams(sent.value[0], number, n, unpacked(batch.column(3)[k].as_py())[0], sizes)
                rows = [(b, planes(np.diff(got.h[s], prepend=0), got.w[s])) for b, s in got.parts()]
                chunk = np.full(len(rows), batch.column(4)[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(chunk), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "chunk", "blob"])

    def answered(key: tuple, asks: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        step, w, r, n = unpacked(table.bigrams[0]) if len(table) else np.zeros((4, 0), np.int64)
        h = np.cumsum(step)
        histories, sums = history_sums(h, r, n)
        split, (hot, *hot_weights) = sent.value
        c, back = weights.of(sums)
        own = ~split.is_hot(histories)
        order = np.argsort(known := np.concatenate([histories[own], hot]))
        known, c, back = known[order], np.concatenate([c[own], hot_weights[0]])[order], np.concatenate([back[own], hot_weights[1]])[order]
        keys, ordered = pair_keys(h, w, most)
        if not ordered:
            order = np.argsort(keys)
            keys, r = keys[order], r[order]
        out = []
        for blob in asks.blob:
            step, w = unpacked(blob)
            h = np.cumsum(step)
            wanted = pair_keys(h, w, most)[0]
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            count = np.where(keys[at] == wanted, r[at], 0) if len(keys) else np.zeros(len(h), np.int64)
            starts = np.flatnonzero(np.diff(h, prepend=-1))
            at = np.searchsorted(known, h[starts])
            out.append(answer(count, c[at], only_needed(back[at], count, starts)))
        return pd.DataFrame({"chunk": asks.chunk, "bucket": key[0], "blob": out})

    asks = ready.select("sizes", "number", "n", "codes", "chunk").mapInArrow(asking, "bucket long, chunk long, blob binary")
    answers = asks.groupBy("bucket").cogroup(model.pairs.select("bucket", "bigrams").groupBy("bucket")).applyInPandas(answered, "chunk long, bucket long, blob binary")
    return stored(answers, "katz-answers")


def score(tokens: Tokens, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) per row of the documents; a model of order three gives score_two, that of its order two, too."""
    if model.third:
        return score_third(tokens, model)
    ready, weights = model.vocabulary.resolved(tokens), model.weights
    sent = ready.sparkSession.sparkContext.broadcast(model.split)

    def finished(batch: pa.RecordBatch, answers: pa.Table) -> pa.RecordBatch:
        sizes, number, n = (next(lists(batch, c)) for c in range(3))
        codes = unpacked(batch.column(3)[0].as_py())[0]
        got = Bigrams(sent.value, number, n, codes, sizes)
        value = np.empty(len(got.h))
        for (_, s), blob in zip(got.parts(), answers.column("blob"), strict=True):
            r, c, back = answer_read(blob.as_py())
            h = got.h[s]
            of = np.cumsum(np.diff(h, prepend=h[0]) != 0)
            value[s] = np.where(r > 0, weights.kept(r) - np.log10(c)[of], back[of] + weights.word(got.n[s]))
        base = weights.word(n)[codes]
        full = np.where(got.of >= 0, np.append(value, 0.0)[got.of], base)
        starts = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(x, starts) for x in ((n[codes] > 0).astype(np.int64), base, full)]
        return pa.RecordBatch.from_arrays([batch.column(4)[0].values, pa.array(sizes), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = ready.select("sizes", "number", "n", "codes", "ids", "chunk")
    return with_answers(rows, answers_of(ready, model), finished, f"doc_id {tokens.kind}, n_tokens long, n_known long, base_score double, score double")


def second_of(tokens: Tokens, model: Model, keep: bool = True) -> DataFrame:
    """The chunks with order two's answers about their bigrams in `two`, in the order of `Bigrams`. Unless `keep`, they take the place of the chunks without them and of order two."""
    if tokens.second and tokens.second[0] is model:
        return tokens.second[1]
    ready = model.vocabulary.resolved(tokens)

    def aligned(batch: pa.RecordBatch, answers: pa.Table) -> pa.RecordBatch:
        parts = [answer_read(x.as_py()) for x in answers.column("blob")] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        two = answer(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        same = [batch.column(c)[0].values for c in range(1, 6)]
        return one_row(["chunk", "ids", "sizes", "train", "number", "n", "codes", "two"], [batch.column(0)[0].as_py(), *same, batch.column(6)[0].as_py(), two])

    answers = answers_of(ready, model)
    if not keep:
        discard(model.vocabulary.table, model.pairs)
    rows = ready.select("chunk", "ids", "sizes", "train", "number", "n", "codes")
    schema = f"chunk long, ids array<{tokens.kind}>, sizes array<long>, train array<boolean>, number array<long>, n array<long>, codes binary, two binary"
    tokens.second = model, stored(with_answers(rows, answers, aligned, schema), "katz-second")
    discard(answers)
    if not keep:
        tokens.resolved = None
        discard(ready)
    return tokens.second[1]


class Third:
    """The order three of a model: its table, the split of histories and the discounts."""

    def __init__(self, below: Weights, triples: DataFrame, split: Split):
        self.below, self.triples, self.split = below, triples, split
        row = triples.agg(*[F.sum(F.col("seen")[k]).alias(f"n{k + 1}") for k in range(TURING + 1)]).first()
        self.weights = Weights(discounts({k + 1: row[k] or 0 for k in range(TURING + 1)}), 0, 0)
        hot = triples.select(F.explode("hot").alias("x")).groupBy("x.h").agg(*[F.sum(F.col("x.sums")[k]).alias(f"s{k}") for k in range(SUMS)], F.sum("x.lower").alias("lower"))
        rows = hot.orderBy("h").collect()  # at most two for each bucket
        sums = np.array([r[1 : SUMS + 1] for r in rows], np.int64).reshape(-1, SUMS)
        self.hot = np.array([r.h for r in rows], np.int64), *self.weights.of(sums, np.array([r.lower for r in rows], float))


def triple_sums(key: np.ndarray, r: np.ndarray, r2: np.ndarray, c2: np.ndarray, below: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories in order, their sums and what their words come to at order two. Trigrams come in order of history."""
    histories, sums = history_sums(key, r)
    return histories, sums, np.add.reduceat(below.discounted(r2) / c2, np.flatnonzero(np.diff(key, prepend=-1))) if len(key) else np.zeros(0)


def third_of(tokens: Tokens, model: Model, keep: bool = True) -> Third:
    below, most, lower_split, spark = model.weights, model.vocabulary.last, model.split, model.pairs.sparkSession
    split = Split(lower_split.buckets, model.frequent(lower_split.buckets))
    rows = second_of(tokens, model, keep)
    sent = spark.sparkContext.broadcast((lower_split, split))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (sizes, learn, number, n) in enumerate(zip(*(lists(batch, c) for c in range(4)), strict=True)):
                two = Bigrams(sent.value[0], number, n, unpacked(batch.column(4)[k].as_py())[0], sizes)
                r2, c2, _ = answer_read(batch.column(5)[k].as_py())
                c2 = c2[runs(two.bucket, two.h)]
                got = Trigrams(sent.value[1], two, r2 > 0, sizes, most, learn.astype(bool))
                out = [(b, planes(np.diff(got.key[s], prepend=0), got.w[s], got.times[s], r2[got.last[s]], c2[got.last[s]])) for b, s in got.parts()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["bucket", "blob"])

    def gathered(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(b) for b in asked.blob]
        h = np.concatenate([np.cumsum(p[0]) for p in parts])
        w, times, r2, c2 = np.concatenate([p[1:] for p in parts], axis=1)
        del parts
        order = in_order(h, w)
        h, w, times, r2, c2 = h[order], w[order], times[order], r2[order], c2[order]
        new = np.flatnonzero((np.diff(h, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
        h, w, r2, c2, r = h[new], w[new], r2[new], c2[new], np.add.reduceat(times, new)
        seen = np.bincount(np.minimum(r, TURING + 2), minlength=TURING + 3)[1 : TURING + 2]
        histories, sums, lower = triple_sums(h, r, r2, c2, below)
        hot = sent.value[1].is_hot(histories)
        rows = [{"h": int(a), "sums": b.tolist(), "lower": float(c)} for a, b, c in zip(histories[hot], sums[hot], lower[hot], strict=True)]
        return pd.DataFrame({"bucket": [key[0]], "trigrams": [planes(np.diff(h, prepend=0), w, r, r2, c2)], "seen": [seen.tolist()], "hot": [rows]})

    triples = rows.select("sizes", "train", "number", "n", "codes", "two").mapInArrow(counted, "bucket long, blob binary")
    triples = triples.groupBy("bucket").applyInPandas(gathered, "bucket long, trigrams binary, seen array<long>, hot array<struct<h:long,sums:array<long>,lower:double>>")
    return Third(below, stored(triples, "katz-triples"), split)


def score_third(tokens: Tokens, model: Model) -> DataFrame:
    """Scores by order three and order two, in `PASSES` passes over the chunks, so that only a share of the questions and answers is on disk at a time."""
    rows, third, weights, most = second_of(tokens, model), model.third, model.weights, model.vocabulary.last
    top, below = third.weights, third.below
    sent = tokens.frame.sparkSession.sparkContext.broadcast((model.split, third.split, third.hot))

    def grams(sizes: np.ndarray, number: np.ndarray, n: np.ndarray, codes: np.ndarray, two: bytes) -> tuple:
        second, said = Bigrams(sent.value[0], number, n, codes, sizes), answer_read(two)
        return second, said, Trigrams(sent.value[1], second, said[0] > 0, sizes, most)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (sizes, number, n) in enumerate(zip(*(lists(batch, c) for c in range(3)), strict=True)):
                got = grams(sizes, number, n, unpacked(batch.column(3)[k].as_py())[0], batch.column(4)[k].as_py())[2]
                out = [(b, planes(np.diff(got.key[s], prepend=0), got.w[s])) for b, s in got.parts()]
                chunk = np.full(len(out), batch.column(5)[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array(chunk), pa.array([r[1] for r in out], pa.binary())], names=["bucket", "chunk", "blob"])

    def answered(key: tuple, asks: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        step, w, r, r2, c2 = unpacked(table.trigrams[0]) if len(table) else np.zeros((5, 0), np.int64)
        h = np.cumsum(step)
        histories, sums, lower = triple_sums(h, r, r2, c2, below)
        _, split, (hot, *hot_weights) = sent.value
        own = ~split.is_hot(histories)
        # trigrams are in order of history and word, and so are keys of their histories' places and words
        bits = max(int(w.max()).bit_length(), 1) if len(w) else 1
        keys = np.cumsum(np.diff(h, prepend=-1) != 0) - 1 << bits | w
        c, back = top.of(sums[own], lower[own])
        # a history that no text goes on from has weight 1
        known, c, back = np.concatenate([histories[own], hot, [np.iinfo(np.int64).max]]), np.concatenate([c, hot_weights[0], [1]]), np.concatenate([back, hot_weights[1], [0.0]])
        order = np.argsort(known)
        known, c, back = known[order], c[order], back[order]
        out = []
        for blob in asks.blob:
            step, w = unpacked(blob)
            h = np.cumsum(step)
            new = np.diff(h, prepend=-1) != 0
            starts = np.flatnonzero(new)
            if len(keys):
                at = np.minimum(np.searchsorted(histories, h[starts]), len(histories) - 1)
                place = np.where(histories[at] == h[starts], at, -1)[np.cumsum(new) - 1]
                wanted = np.where((place >= 0) & (w >> bits == 0), place << bits | w, -1)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                count = np.where(keys[at] == wanted, r[at], 0)
            else:
                count = np.zeros(len(h), np.int64)
            at = np.searchsorted(known, h[starts])
            at = np.where(known[at] == h[starts], at, len(known) - 1)
            out.append(answer(count, c[at], only_needed(back[at], count, starts)))
        return pd.DataFrame({"chunk": asks.chunk, "bucket": key[0], "blob": out})

    def finished(batch: pa.RecordBatch, answers: pa.Table) -> pa.RecordBatch:
        sizes, number, n = (next(lists(batch, c)) for c in range(3))
        codes = unpacked(batch.column(3)[0].as_py())[0]
        second, (r, c, back), got = grams(sizes, number, n, codes, batch.column(4)[0].as_py())
        run = runs(second.bucket, second.h)
        two = np.where(r > 0, weights.kept(r) - np.log10(c)[run], back[run] + weights.word(second.n))
        three = np.empty(len(got.key))
        for (_, s), blob in zip(got.parts(), answers.column("blob"), strict=True):
            r, c, back = answer_read(blob.as_py())
            of = runs(got.bucket[s], got.key[s])
            three[s] = np.where(r > 0, top.kept(r) - np.log10(c)[of], back[of] + two[got.last[s]])
        base = weights.word(n)[codes]
        lower = np.where(second.of >= 0, np.append(two, 0.0)[second.of], base)
        full = np.where(got.of >= 0, np.append(three, 0.0)[got.of], lower)
        starts = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(x, starts) for x in ((n[codes] > 0).astype(np.int64), base, full, lower)]
        return pa.RecordBatch.from_arrays([batch.column(5)[0].values, pa.array(sizes), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "score_two"])

    scored = []
    for k in range(PASSES):
        part = rows.filter(F.pmod(F.xxhash64("chunk"), F.lit(PASSES)) == k)
        asks = part.select("sizes", "number", "n", "codes", "two", "chunk").mapInArrow(asking, "bucket long, chunk long, blob binary")
        answers = asks.groupBy("bucket").cogroup(third.triples.select("bucket", "trigrams").groupBy("bucket")).applyInPandas(answered, "chunk long, bucket long, blob binary")
        answers = stored(answers, "katz-answers")
        found = with_answers(part.select("sizes", "number", "n", "codes", "two", "ids", "chunk"), answers, finished, f"doc_id {tokens.kind}, n_tokens long, n_known long, base_score double, score double, score_two double")
        scored.append(stored(found, "katz-scores"))
        discard(answers)
    return functools.reduce(DataFrame.unionByName, scored)
