"""Repeated passages of documents, by relative Lempel-Ziv parsing against indexed reference blocks.

A window is `WINDOW` consecutive words of one document. A word goes if a window that covers it starts earlier too: in a document of
lesser id, or earlier in the same one.

1. Every window has an anchor, the run of `ANCHOR` words in it with the least hash, which its words alone decide; so equal windows have equal
   anchors. Consecutive windows with one anchor make a piece of `WINDOW` to `WINDOW + SPAN - 1` words. Each window is in one piece.
2. Pieces whose anchor occurs once in the corpus can't repeat anything, and are most. For the others the words are fetched. Equal pieces are
   grouped, with their first occurrence; all windows of the later ones go.
3. The distinct pieces of an anchor meet in a reference block: a slice of pieces in order of anchor, document and place, whose words
   are indexed by a suffix array. Each piece is factored greedily against what stands earlier in its block: at each
   position the longest factor that occurs there is taken. In a factor of `WINDOW` words or more all windows repeat. A repeated window that isn't
   within a factor crosses the boundary between two, and no more than one, as the factor that begins inside it reaches its end at
   least; so boundaries whose two factors are long enough together are checked, window by window.
4. An anchor with more than `MOST` distinct pieces (the edge of a passage that very many documents hold, each going on in its own way)
   would make a block too large. Its pieces are cut into their windows, each a piece of its own under its own words, which step 2's
   grouping settles: exact, and no group is gathered.

Groups are aggregated before they are shuffled, and joins on anchors have two plain shuffled sides. A document's spans are gathered by document.

Cases: null and empty texts have no words. Rows of one id with different texts count as documents of their own, in order of the text's
hash; repeated rows (id and text) are one document and get the same result. Rows without an id come last in order. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import bounded_batches, discard, slices, stored
from lithic.llm.shingle_join import mixed

WINDOW, ANCHOR = 20, 8
#: Anchors in a window, and so windows in a piece at most.
SPAN = WINDOW - ANCHOR + 1
#: Distinct pieces of an anchor that share a reference block.
MOST = 200
#: Pieces in a reference block.
BLOCK = 4000
NO_ID = 2**63 - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
KEY = "doc long, part int"


def keyed(docs: DataFrame) -> DataFrame:
    """doc (the id, or the last of all), part (tells texts of one id apart), doc_id, text."""
    ident = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(ident, F.lit(NO_ID)).alias("doc"), F.shiftright(F.xxhash64("text"), 32).cast("int").alias("part"), "doc_id", "text")


@functools.lru_cache(maxsize=4)
def powers_table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return powers_table(int(base), 1 << max(n, 1).bit_length())[:n]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in the bytes of several texts, which end at `ends`, and by text the number of words up to its end."""
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    cuts = ends[:-1][ends[:-1] < len(data)]
    first[cuts] = ~space[cuts]
    last = ~space
    last[:-1] &= space[1:]
    last[ends[(ends > 0)] - 1] |= ~space[ends[(ends > 0)] - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * powers(_ODD, len(data)))])
    return mixed((sums[stops] - sums[starts]) * powers(_BACK, len(data) + 1)[starts]), np.searchsorted(starts, ends, side="left")


def pieces_of(words: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By piece: text, first window, number of windows, anchor. words: hashes of several texts' words, of which `upto` has the ends."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    rolled = np.zeros(len(words) - ANCHOR + 1, np.uint64)
    for j in range(ANCHOR):
        rolled = rolled * _ODD + words[j : j + len(rolled)]
    value, place = mixed(rolled), np.arange(len(rolled))
    # the least of SPAN consecutive ones, the leftmost of equals: by doubling, the last step overlapping
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        m = len(value) - step
        later = value[step:] < value[:m]
        value, place = np.where(later, value[step:], value[:m]), np.where(later, place[step:], place[:m])
        width += step
    doc = np.searchsorted(upto, np.arange(n), side="right")
    inside = upto[doc] - np.arange(n) >= WINDOW
    at = np.flatnonzero(inside)
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    head = np.flatnonzero(new)
    begins = np.concatenate([[0], upto[:-1]])
    return doc[at[head]], at[head] - begins[doc[at[head]]], np.diff(np.append(head, len(at))), value[at[head]].view(np.int64)


def anchors(docs: DataFrame) -> DataFrame:
    """docs: doc, part, text. All pieces: doc, part, start (first window), n (windows), anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = pc.fill_null(batch.column(2), "").cast(pa.large_binary())
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            if not sizes.any():
                continue
            data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
            with np.errstate(over="ignore"):
                words, upto = word_hashes(data, np.cumsum(sizes, dtype=np.int64))
                text, start, n, anchor = pieces_of(words, upto)
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor)], names=["doc", "part", "start", "n", "anchor"])

    return docs.mapInArrow(run, f"{KEY}, start int, n int, anchor long")


def with_words(wanted: DataFrame) -> DataFrame:
    """wanted: doc, part, text, pieces (start, n, anchor). Each piece with its words: doc, part, start, n, anchor, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 100_000):
            out: list[tuple] = []
            for doc, part, text, pieces in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ws = text.encode().split()
                out += [(doc, part, p["start"], p["n"], p["anchor"], b" ".join(ws[p["start"] : p["start"] + p["n"] + WINDOW - 1])) for p in pieces]
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "part", "start", "n", "anchor", "words"])

    return wanted.mapInArrow(run, f"{KEY}, start int, n int, anchor long, words binary")


# --- one reference block


def suffix_order(ids: np.ndarray, reach: int) -> np.ndarray:
    """Positions in order of the `reach` words from there, by prefix doubling."""
    rank, width = ids, 1
    while width < reach:
        after = np.full(len(rank), -1, np.int64)
        after[:-width] = rank[width:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return np.argsort(rank, kind="stable")


def factor_lengths(ids: np.ndarray, starts: np.ndarray, reach: int) -> np.ndarray:
    """By position, the most words from there, within their piece, that stand earlier too. Pieces begin at `starts`."""
    n, pieces = len(ids), np.arange(len(starts))
    place = np.arange(n) + np.searchsorted(starts, np.arange(n), side="right") - 1
    # a word that is like no other ends each piece
    text = np.empty(n + len(starts), np.int64)
    text[place] = np.unique(ids, return_inverse=True)[1]
    text[np.append(starts[1:], n) + pieces] = n + pieces
    order = suffix_order(text, reach)
    # words that neighbours in the suffix array have in common
    a, b = order[:-1], order[1:]
    common, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for depth in range(reach):
        live = live[text[a[live] + depth] == text[b[live] + depth]]
        if not len(live):
            break
        common[live] = depth + 1
    longest = np.zeros(len(text), np.int64)
    for length in range(1, int(common.max(initial=0)) + 1):
        group = np.concatenate([[0], np.cumsum(common < length)])
        earliest = np.minimum.reduceat(order, np.flatnonzero(np.diff(group, prepend=-1)))
        longest[order[earliest[group] < order]] = length
    return longest[place]


def parsed(ids: np.ndarray, starts: np.ndarray, reach: int = WINDOW + SPAN - 1) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of each piece relative to what is earlier in the block, and the windows (positions) that they show to be repeated."""
    longest = factor_lengths(ids, starts, reach)
    stops = np.append(starts[1:], len(ids))
    at, piece = starts.copy(), np.arange(len(starts))
    before = np.full(len(starts), -1, np.int64)  # where the factor before begins
    factors, repeated = [], []
    while len(piece):
        size = np.maximum(longest[at], 1)
        factors.append(np.stack([piece, at, size], axis=1))
        for back in range(WINDOW - 1):  # the windows inside a factor that is long enough
            s = at + back
            hit = s + WINDOW <= at + longest[at]
            if not hit.any():
                break
            repeated.append(s[hit])
        # a window that crosses the boundary starts inside the factor before, and ends inside this one
        for back in range(1, WINDOW):
            s = at - back
            near = (before >= 0) & (s > before) & (s + WINDOW <= at + size)
            if near.any():
                c = s[near]
                repeated.append(c[longest[c] >= WINDOW])
        before, at = at.copy(), at + size
        go = at < stops[piece]
        piece, at, before = piece[go], at[go], before[go]
    return np.concatenate(factors) if factors else np.zeros((0, 3), np.int64), np.concatenate(repeated) if repeated else np.zeros(0, np.int64)


def blocks(pieces: DataFrame) -> DataFrame:
    """pieces: doc, part, start, n, anchor, words. The same rows with `again`, a bit for each window of which the block shows an earlier one: doc, part, start, again."""

    def judged(rows: list[dict]) -> pa.RecordBatch:
        vocabulary: dict[bytes, int] = {}
        ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in r["words"].split(b" ")], np.int64) for r in rows]
        starts = np.cumsum([0, *map(len, ids[:-1])])
        _, repeated = parsed(np.concatenate(ids), starts)
        again = np.zeros(len(rows), np.int64)
        piece = np.searchsorted(starts, repeated, side="right") - 1
        np.bitwise_or.at(again, piece, np.int64(1) << (repeated - starts[piece]))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in (("doc", pa.int64()), ("part", pa.int32()), ("start", pa.int32()))] + [pa.array(again.astype(np.int32))], names=["doc", "part", "start", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(block) >= BLOCK and block[-1]["anchor"] != r["anchor"]:
                    yield judged(block)
                    block = []
                block.append(r)
        if block:
            yield judged(block)

    ordered = pieces.repartition("anchor").sortWithinPartitions("anchor", "doc", "part", "start")
    return ordered.select("doc", "part", "start", "n", "anchor", "words").mapInArrow(run, f"{KEY}, start int, again int")


PLACE = ("doc", "part", "start")


def first_places(pieces: DataFrame, *by: str) -> DataFrame:
    """The first occurrence of each distinct piece: by, doc, part, start, n."""
    return pieces.groupBy(*by).agg(F.min(F.struct(*PLACE)).alias("first"), F.first("n").alias("n")).select(*by, "first.*", "n")


def spans(docs: DataFrame) -> DataFrame:
    """docs: doc, part, text. Pieces with repeated windows by document: doc, part, spans (start, again)."""
    found = stored(anchors(docs), "anchors")
    shared = stored(found.groupBy("anchor").agg(F.count("*").alias("places")).filter("places > 1").select("anchor"), "anchors-shared")
    listed = found.join(shared, "anchor").groupBy("doc", "part").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("pieces"))
    pieces = stored(with_words(docs.join(listed, ["doc", "part"]).select("doc", "part", "text", "pieces")), "pieces")
    discard(found, shared)
    distinct = stored(first_places(pieces, "anchor", "words"), "pieces-distinct")
    several = stored(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "anchors-several")
    together = distinct.join(several, "anchor", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1)))
    judged = stored(blocks(together.filter(F.col("kinds").between(2, MOST))), "pieces-judged")
    # under hot anchors each window stands alone, and the first of equal ones stays
    words = F.split(F.col("words").cast("string"), " ")
    cut = together.filter(F.col("kinds") > MOST).withColumn("bit", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    alone = cut.select(*PLACE, "bit", F.array_join(F.slice(words, F.col("bit") + 1, F.lit(WINDOW)), " ").alias("words"))
    firsts = alone.groupBy("words").agg(F.min(F.struct(*PLACE, "bit")).alias("first")).select("first.*")
    own = firsts.groupBy(*PLACE).agg(F.expr("bit_or(shiftleft(1, bit))").alias("own"))
    whole = F.expr("shiftleft(1, n) - 1")
    first = together.select(*PLACE, whole.alias("whole"), (F.col("kinds") > MOST).alias("hot")).join(judged, list(PLACE), "left").join(own, list(PLACE), "left")
    known = first.select(*PLACE, F.expr("CASE WHEN hot THEN whole & ~coalesce(own, 0) ELSE coalesce(again, 0) END").alias("again"))
    rows = pieces.select(*PLACE, whole.alias("whole")).join(known, list(PLACE), "left").select(*PLACE, F.coalesce("again", "whole").alias("again"))
    out = stored(rows.filter("again <> 0").groupBy("doc", "part").agg(F.collect_set(F.struct("start", "again")).alias("spans")), "spans")
    discard(pieces, distinct, several, judged)
    return out


def covered(spans_: list[dict], n: int) -> np.ndarray:
    """By word, whether a repeated window covers it."""
    edge = np.zeros(n + 1, np.int64)
    start = np.array([s["start"] for s in spans_], np.int64)
    again = np.array([s["again"] for s in spans_], np.int64)
    for bit in range(SPAN):
        at = start[(again >> bit) & 1 == 1] + bit
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge)[:n] > 0


def deduplicate(docs: DataFrame, texts: bool = True) -> DataFrame:
    """docs: doc_id, text. By row: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space; null unless texts)."""
    bounded_batches(docs.sparkSession)
    rows = keyed(docs)
    repeated = spans(rows.select("doc", "part", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ws = (text or "").encode().split()
                gone = covered(found, len(ws)) if found else None
                kept = b" ".join(ws if gone is None else [w for w, g in zip(ws, gone, strict=True) if not g])
                out.append((len(ws), 0 if gone is None else int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            n, removed, digests, kept = zip(*out, strict=True)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = rows.join(repeated, ["doc", "part"], "left").select("doc_id", "text", "spans")
    ident = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(run, f"doc_id {ident}, n_words long, n_removed long, kept_sha256 string, kept string")

