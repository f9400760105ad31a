"""Similarity self-join of documents on word shingles, by token-combination prefixes.

Documents with the same set of shingles form one class; classes link when the Jaccard similarity of their sets reaches the
threshold. A set of n shingles can miss at most t = n - ceil(0.8 n) of them in a set it links with.

1. A class of which more than t shingles occur in no other class links with nothing. That is decided on the shingles in a
   fixed zone of the hash range, which is a sample of tokens, not of documents, and so errs only towards keeping. It takes one
   shuffle of (shingle, class) and drops most of a corpus.
2. Shingles of the remaining classes are ordered by frequency and fall into token classes (`CLASSES`): a rare shingle is indexed by
   itself, of more frequent ones combinations of k = 2 or 3. Frequent shingles are dealt by hash into slots, and all k-combinations
   within a slot are signatures, so c shingles of a slot keep a common one until c - k + 1 of them differ. The prefix of a set
   is extended until its shingles found once (which can't be shared), its rare ones and these sums together exceed t. Of two linking
   sets, the prefix that ends first has a signature of the other's. The number of slots follows the set's size; a set signs for its
   own number and for that of the largest set it may link with.
3. Of the sets with a common signature one is the hub, the one with fewest shingles found once, and each other is verified against
   it, which also gives its distance from the hub. A large group of near copies thus falls together without its pairs being formed,
   and a signature of two sets is settled.
4. What is left are sets of different components around a common hub. Seen from the hub, a set has e shingles found once and
   differs by a others; two sets differ by e1 + e2 + |a1 - a2| at least, by the triangle inequality. Sets are counted in cells of
   (e, a), pairs of cells beyond the threshold are discarded, and only pairs of sets that the bound lets through are verified.
   Pairs inside a component add nothing and are never formed.

Words are runs of non-blank characters with A-Z lower-cased; with fewer than `size` words the whole sequence is one shingle; null
or blank texts have no shingles and link with nothing. Shingles and sets are told apart by 64- and 128-bit hashes. Repeated
rows share a class. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import bounded_batches, discard, lower_words, slices, stored
from lithic.llm.graph import components

SIZE = 5
NEED, OF = 80, 100  # intersection * OF >= union * NEED
ZONE = 0.3
#: Token classes: up to how many sets have the shingle, and how many shingles of the class are combined.
CLASSES = ((64, 1), (4096, 2), (2**62, 3))
CELLS = 24  # cells in a hub's size
BROADCAST_ROWS = 500_000
_ODD = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [lower_words(t) for t in texts]
    codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    hashes = pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False) if len(distinct) else np.zeros(0, np.uint64)
    flat = mixed(hashes)[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(len(flat) - size + 1, 0), np.uint64)
    for j in range(size):
        rolled = rolled * np.uint64(_ODD) + flat[j : j + len(rolled)]
    rolled = mixed(rolled)
    at = 0
    for ws in words:
        n = len(ws)
        if n >= size:
            yield np.unique(rolled[at : at + n - size + 1])
        elif n:
            short = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in flat[at : at + n]:
                    short = short * np.uint64(_ODD) + x
            yield mixed(np.array([short ^ np.uint64(0xA5A5A5A5A5A5A5A5)]))
        else:
            yield np.zeros(0, np.uint64)
        at += n


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def key_of(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def class_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_id (digest of the set, null if empty), key (half of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            n, ids = [], []
            for s in shingle_sets(batch.column(1).to_pylist()):
                n.append(len(s))
                ids.append(digest(s) if len(s) else None)
            keys = [key_of(d) if d else None for d in ids]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "set_id", "key"])

    return docs.mapInArrow(run, "doc_id long, n long, set_id binary, key long")


def zone_postings(docs: DataFrame) -> DataFrame:
    """(shingle, key) for the shingles in the zone; key is half the set's digest."""
    top = np.uint64(int(ZONE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            shingles, keys = [], []
            for s in shingle_sets(batch.column(1).to_pylist()):
                if len(s):
                    part = s[: np.searchsorted(s, top)]
                    shingles.append(part)
                    keys.append(np.full(len(part), key_of(digest(s)), np.int64))
            yield posted(shingles, keys)

    def posted(shingles: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(shingles).view(np.int64) if shingles else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.concatenate(keys) if keys else flat)], names=["shingle", "key"])

    return docs.mapInArrow(run, "shingle long, key long")


def may_miss(n: Column) -> Column:
    """t: how many shingles of a set of n a linking set may lack."""
    return n - F.floor((n * NEED + OF - 1) / OF)


def full_sets(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, wanted (a set digest). set_id, n, shingles of the rows that have the wanted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            kept = [(w, s) for w, s in zip(batch.column(2).to_pylist(), shingle_sets(batch.column(1).to_pylist()), strict=True) if len(s) and digest(s) == w]
            offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in kept])]).astype(np.int32)
            flat = np.concatenate([s for _, s in kept]).view(np.int64) if kept else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([len(s) for _, s in kept], pa.int64()), lists], names=["set_id", "n", "shingles"])

    return docs.mapInArrow(run, "set_id binary, n long, shingles array<long>")


def levels(n: int) -> list[int]:
    """Slots are 2 ** level, at most an eighth of the larger of two sets; the levels of pairs that a set of n may be in."""
    level = lambda m: max(0, (m // 8).bit_length() - 1)
    return sorted({level(n), level(n * OF // NEED)})


def combined(k: np.ndarray, shingle: np.ndarray, level: int, need: int) -> np.ndarray:
    """Combinations of k shingles within slots, over the shortest prefix that keeps a common one after need - 1 differences.

    Shingles come in the common order, k is that of each one's token class. Slots lose k - 1 shingles each, fewer than a half of
    a set in all, so the prefix always suffices.
    """
    spread = mixed(shingle ^ np.uint64(_ODD))
    slot = (spread >> np.uint64(64 - level) if level else np.zeros(len(spread), np.uint64)) * np.uint64(4) + k.astype(np.uint64)
    order = np.argsort(slot, kind="stable")
    start = np.flatnonzero(np.diff(slot[order], prepend=slot[order[0]] + np.uint64(1)))
    rank = np.empty(len(slot), np.int64)
    rank[order] = np.arange(len(slot)) - np.repeat(start, np.diff(start, append=len(slot)))
    last = int(np.searchsorted(np.cumsum(rank >= k - 1), need))
    order = order[order <= last]
    # a place's combinations are with the places before it in its slot
    weight, rank, k, slot = mixed(spread[order]), rank[order], k[order], slot[order]
    one = np.repeat(np.arange(len(order)), rank)
    two = one - 1 - (np.arange(len(one)) - np.repeat(np.cumsum(rank) - rank, rank))
    sums = weight[one] + weight[two]
    triple = np.flatnonzero(k[one] == 3)
    times = rank[two[triple]]
    three = np.repeat(two[triple], times) - 1 - (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    threes = np.repeat(sums[triple], times) + weight[three]
    pair = k[one] == 2
    sums = np.concatenate([sums[pair], threes])
    slots = np.concatenate([slot[one[pair]], np.repeat(slot[one[triple]], times)])
    return mixed(sums ^ mixed(slots * np.uint64(64) + np.uint64(level)))


def signatures_of(n: int, df: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of n shingles, and with each the greatest overlap still possible if no earlier one is shared.

    The shingles in more than one class are given with their frequency, in order of (frequency, shingle).
    """
    once = n - len(df)
    holes = n - (n * NEED + OF - 1) // OF + 1 - once
    rare = int(np.searchsorted(df, CLASSES[0][0], side="right"))
    signs, rest = [shingle[: min(rare, max(holes, 0))].view(np.int64)], [n - once - np.arange(min(rare, max(holes, 0)))]
    if rare < holes:
        k = np.array([c[1] for c in CLASSES])[np.searchsorted([c[0] for c in CLASSES], df[rare:])]
        for level in levels(n):
            signs.append(combined(k, shingle[rare:].view(np.uint64), level, holes - rare).view(np.int64))
            rest.append(np.full(len(signs[-1]), n - once - rare))
    return np.concatenate(signs), np.concatenate(rest)


def signatures(sets: DataFrame) -> DataFrame:
    """sets: node, n, shared (sorted array of df and shingle). signature, node, n, rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                shared = batch.column(2)
                flat, offsets = shared.flatten(), shared.offsets.to_numpy()
                offsets = offsets - offsets[0]
                df, shingle = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                rows = [signatures_of(n, df[x:y], shingle[x:y]) for n, x, y in zip(batch.column(1).to_pylist(), offsets, offsets[1:], strict=False)]
                who = pa.array(np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]))
                columns = [pa.array(np.concatenate([r[k] for r in rows])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([columns[0], batch.column(0).take(who), batch.column(1).take(who), columns[1]], names=["signature", "node", "n", "rest"])

    return sets.select("node", "n", "shared").mapInArrow(run, "signature long, node long, n long, rest long")


def linked(difference: Column, n1: Column, n2: Column) -> Column:
    """Whether sets of n1 and n2 shingles with that symmetric difference reach the threshold."""
    return difference * (OF + NEED) <= (n1 + n2) * (OF - NEED)


def measured(pairs: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    """pairs: a, b (nodes) and the columns `more`. With the sets: set_a, set_b, na, nb, ea, eb (shingles found once), apart (how many of the others differ)."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("set_id").alias(f"set_{c}"), F.col("n").alias(f"n{c}"), F.col("shared.shingle").alias(f"s{c}"))
    common = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(side("b"), "b").join(side("a"), "a").filter("set_a <> set_b").withColumn("apart", F.size("sa") + F.size("sb") - 2 * common)
    return found.select("a", "b", *more, "set_a", "set_b", "na", "nb", (F.col("na") - F.size("sa")).alias("ea"), (F.col("nb") - F.size("sb")).alias("eb"), "apart")


def candidate_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that the zone doesn't rule out, with their shingles found in more than one of them: set_id, n, shared."""
    postings = zone_postings(docs).groupBy("shingle").agg(F.min("key").alias("key"), F.max("key").alias("other"))
    alone = stored(postings.filter("key = other").groupBy("key").agg(F.count("*").alias("alone")), "shingles-alone")
    live = classes.join(alone, "key", "left").filter(F.coalesce("alone", F.lit(0)) <= may_miss(F.col("n"))).filter(F.col("n") * OF >= NEED * 5)
    live = stored(live.select(F.col("first_id").alias("doc_id"), F.col("set_id").alias("wanted")), "shingle-live")
    small = live.count() <= BROADCAST_ROWS
    sets = full_sets(docs.join(F.broadcast(live) if small else live, "doc_id").select("doc_id", "text", "wanted"))
    sets = stored(sets.dropDuplicates(["set_id"]), "shingle-sets")
    tokens = sets.select("set_id", "n", F.explode("shingles").alias("shingle"))
    frequency = stored(tokens.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"), "shingle-frequency")
    shared = sets.select("set_id", F.explode("shingles").alias("shingle")).join(frequency, "shingle")
    shared = shared.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    once = F.col("n") - F.size("shared")
    kept = sets.select("set_id", "n").join(shared, "set_id").filter(once <= may_miss(F.col("n")))
    # nodes are ordered by how many shingles only they have
    first = F.shiftleft(F.least(F.floor(F.log2(once + 1)), F.lit(7)), 60)
    kept = stored(kept.select(first.bitwiseOR(F.xxhash64("set_id").bitwiseAND(F.lit(2**60 - 1))).alias("node"), "set_id", "n", "shared"), "shingle-candidates")
    discard(alone, live, sets, frequency)
    return kept


def spokes(signs: DataFrame) -> DataFrame:
    """a, b, crowded: nodes b that share a signature with the hub a; crowded if more than the two of them do."""
    groups = signs.groupBy("signature").agg(
        F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("k"), F.sum("n").alias("both"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("rest").alias("rest")
    )
    may_link = (F.col("rest") * (OF + NEED) >= F.col("both") * NEED) & (F.col("least") * OF >= F.col("most") * NEED)
    groups = stored(groups.filter((F.col("k") > 2) | (F.col("k") == 2) & may_link), "signature-groups")
    two = groups.filter("k = 2").select("a", "b", F.lit(0).alias("crowded"))
    more = signs.select("signature", F.col("node").alias("b")).join(groups.filter("k > 2").select("signature", "a"), "signature").select("a", "b", F.lit(1).alias("crowded"))
    pairs = stored(two.unionByName(more).groupBy("a", "b").agg(F.max("crowded").alias("crowded")), "signature-spokes")
    discard(groups)
    return pairs


def across(around: DataFrame) -> DataFrame:
    """around: hub, hub_n, node, set_id, n, e, a, component. Pairs of nodes (a, b) around a hub, of different components, that the bound does not rule out."""
    open_ = around.groupBy("hub").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("hub")
    around = around.join(open_, "hub")
    # most sets around a hub may be of one component, whose own pairs add nothing
    main = around.groupBy("hub", "component").agg(F.count("*").alias("k")).groupBy("hub").agg(F.max(F.struct("k", "component")).alias("top")).select("hub", F.col("top.component").alias("main"))
    width = F.greatest(F.lit(1), F.floor(F.col("hub_n") / CELLS))
    cell = F.struct((F.col("component") == F.col("main")).alias("main"), F.floor(F.col("e") / width).alias("e"), F.floor(F.col("a") / width).alias("a"))
    around = stored(around.join(main, "hub").select("hub", "node", "set_id", "n", "e", "a", "component", cell.alias("cell")), "signature-around")
    cells = around.groupBy("hub", "cell").agg(F.max("n").alias("n"), F.min("e").alias("e"), F.min("a").alias("low"), F.max("a").alias("high"), F.count("*").alias("k"))
    side = lambda df, c, *names: df.select("hub", *[F.col(x).alias(f"{x}{c}") for x in names])
    gap = F.greatest(F.lit(0), F.col("low1") - F.col("high2"), F.col("low2") - F.col("high1"))
    reach = linked(F.col("e1") + F.col("e2") + gap, F.col("n1"), F.col("n2")) & ~(F.col("cell1.main") & F.col("cell2.main"))
    ordered = (F.col("cell1") < F.col("cell2")) | (F.col("cell1") == F.col("cell2")) & (F.col("k1") > 1)
    names = ("cell", "n", "e", "low", "high", "k")
    near = stored(side(cells, 1, *names).join(side(cells, 2, *names), "hub").filter(ordered & reach).select("hub", "cell1", "cell2"), "signature-cells")
    names = ("cell", "node", "set_id", "n", "e", "a", "component")
    pairs = near.join(side(around, 1, *names), ["hub", "cell1"]).join(side(around, 2, *names), ["hub", "cell2"])
    pairs = pairs.filter((F.col("component1") != F.col("component2")) & linked(F.col("e1") + F.col("e2") + F.abs(F.col("a1") - F.col("a2")), F.col("n1"), F.col("n2")))
    pairs = stored(pairs.filter((F.col("cell1") != F.col("cell2")) | (F.col("set_id1") < F.col("set_id2"))).select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct(), "shingle-pairs")
    discard(around, near)
    return pairs


def linked_components(sets: DataFrame) -> DataFrame:
    """node (a set_id) and component of all sets that link with another."""
    signs = stored(signatures(sets), "signatures")
    pairs = spokes(signs)
    discard(signs)
    star = stored(measured(pairs, sets, "crowded"), "shingle-star")
    discard(pairs)
    links = star.filter(linked(F.col("ea") + F.col("eb") + F.col("apart"), F.col("na"), F.col("nb"))).select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    found = components(links)
    around = star.filter("crowded = 1").join(found.withColumnRenamed("node", "set_b"), "set_b", "left").withColumn("component", F.coalesce("component", "set_b"))
    around = around.select(F.col("a").alias("hub"), F.col("na").alias("hub_n"), F.col("b").alias("node"), F.col("set_b").alias("set_id"), F.col("nb").alias("n"), F.col("eb").alias("e"), F.col("apart").alias("a"), "component")
    pairs = across(around)
    late = measured(pairs, sets).filter(linked(F.col("ea") + F.col("eb") + F.col("apart"), F.col("na"), F.col("nb"))).select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    late = stored(late, "shingle-links")
    all_ = components(links.unionByName(late))
    discard(star, found, pairs, late)
    return all_


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. One row per row: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = stored(class_rows(docs), "shingle-rows")
    classes = rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("key").alias("key"))
    classes = stored(classes, "shingle-classes")
    sets = candidate_sets(docs, classes)
    found = linked_components(sets).withColumnRenamed("node", "set_id")
    discard(sets)
    named = classes.select("set_id", "first_id").join(found, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    named = stored(named, "shingle-named")
    least = stored(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "shingle-components")
    final = stored(named.join(least, "component").select("set_id", "component_id"), "shingle-final")
    discard(classes, found, named, least)
    full = rows.filter("set_id IS NOT NULL").join(final, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.filter("set_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
