"""The trie of common beginnings of conversations, from their sorted order: sparse-table range minima over neighbours' common lengths.

Conversations (sequences of turns) that are equal are one sequence with a member count. Sequences are sorted over range partitions, by
128-bit hashes of their turns. Within a partition, sequences with a prefix in common lie together, and those that share the first d turns with row i
are the rows around i between which no common length of neighbours is below d. A sparse table answers the least common length of
any stretch, so each candidate prefix (row, depth) finds its left and right extent by two binary searches of its own, all of them
at once, without a stack. Extents give members, subtrees and their sums by differences of running totals.

A prefix whose extent touches an end of its partition may go on in the next one. Only the prefixes of a partition's first and last
sequence can: their parts are added up by prefix, and what neighbouring partitions both counted (the turns that the last sequence of one
and the first of the next have in common) is subtracted. Partitions are as large as `ROWS` says, however many conversations begin
with the same turns, and nothing but one row for each partition meets in one task.

Cases: turns are in order of (turn, role, text), null turns first; null roles and texts are empty. Turns without a conv_id belong to no
conversation and are left out; repeated rows are turns of their own. An empty table gives an empty result. Other columns are
ignored. A conversation's turns are put together in one task. The ids of equal conversations are hashed in order as SHA-256 asks
for, streaming over packed lists of up to 4,096 ids, so that neither a task's memory nor its rows grow with a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.common import bounded_batches, discard, stored

#: Sequences and turns in a range partition.
ROWS, TURNS = 20_000, 100_000
CHUNK_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORDS = r"[^\x20\x09-\x0D]+"


NODE = "key binary, pkey binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, spent long, needed long, ends string"
EDGE = "first_seq array<binary>, first_keys array<binary>, first_sums array<long>, last_keys array<binary>"
SUMS = ("n_convs", "n_children", "n_leaves", "spent", "needed")


def turn_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, seq (a 128-bit hash of each turn, in order), words (of each turn's text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    key = lambda t: F.unhex(F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"])))
    words = lambda t: F.size(F.regexp_extract_all(t["text"], F.lit(WORDS), F.lit(0)))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.transform("turns", key).alias("seq"), F.transform("turns", words).alias("words"))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations (conv_id, seq, words) that begin as their family's first one does: c takes the first h turns of c - c % every, h = crc32(c) % most, and then its own after its first h."""
    base, h = F.col("conv_id") - F.col("conv_id") % every, (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = turns.filter(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, most - 1).alias(f"head_{c}") for c in ("seq", "words")])
    rows = turns.withColumns({"base": base, "h": h}).join(heads, "base", "left")
    begun = lambda c: F.when(F.col(f"head_{c}").isNull(), F.slice(c, 1, 0)).otherwise(F.slice(f"head_{c}", F.lit(1), F.col("h")))
    rest = lambda c: F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
    return rows.select("conv_id", *[F.concat(begun(c), rest(c)).alias(c) for c in ("seq", "words")])


def sequences(turns: DataFrame) -> DataFrame:
    """turns: conv_id, seq, words. Distinct sequences: seq, words, n (members), conv_id (least), ends (hash of all ids in order)."""
    whole = F.unhex(F.md5(F.array_join(F.transform("seq", F.hex), "")))
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    packed = turns.groupBy(whole.alias("whole"), chunk.alias("chunk")).agg(F.first("seq").alias("seq"), F.first("words").alias("words"), F.array_sort(F.collect_list("conv_id")).alias("ids"))
    packed = packed.repartition("whole").sortWithinPartitions("whole", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None  # whole, seq, words, members, least id, digest

        def row() -> pa.RecordBatch:
            seqs, words, n, least, ends = zip(*done, strict=True)
            columns = [pa.array(seqs, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(least, pa.int64()), pa.array(ends)]
            return pa.RecordBatch.from_arrays(columns, names=["seq", "words", "n", "conv_id", "ends"])

        done: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                text = ",".join(map(str, r["ids"]))
                if current and current[0] == r["whole"]:
                    current[5].update(f",{text}".encode())
                    current = (*current[:3], current[3] + len(r["ids"]), *current[4:])
                    continue
                if current:
                    done.append((*current[1:5], current[5].hexdigest()))
                current = (r["whole"], r["seq"], r["words"], len(r["ids"]), r["ids"][0], hashlib.sha256(text.encode()))
            if done:
                yield row()
                done.clear()
        if current:
            done.append((*current[1:5], current[5].hexdigest()))
            yield row()

    return packed.mapInArrow(run, "seq array<binary>, words array<int>, n long, conv_id long, ends string")


# --- one partition of sorted sequences


def common_lengths(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By row, how many turns it has in common with the row before; 0 for the first."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.int64)
    live, depth = np.arange(1, len(sizes)), 0
    while len(live):
        live = live[(sizes[live] > depth) & (sizes[live - 1] > depth)]
        live = live[(keys[offsets[live] + depth] == keys[offsets[live - 1] + depth]).all(axis=1)]
        depth += 1
        out[live] = depth
    return out


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k has the least of each stretch of 2**k values."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def least(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each stretch a..b, from two overlapping stretches of the table."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), table[0].dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][a[at]], table[k][b[at] - 2**k + 1])
    return out


def extents(table: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share `depths` turns with `rows`, each by a binary search of its own over range minima."""
    left, right, n = rows.copy(), rows.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        step = 2**k
        can = left - step >= 0
        can[can] = table[k][left[can] - step + 1] >= depths[can]
        left[can] -= step
        can = right + step < n
        can[can] = table[k][right[can] + 1] >= depths[can]
        right[can] += step
    return left, right


def prefix_keys(seq: np.ndarray) -> list[bytes]:
    """Hashes of the prefixes of each length, from 0."""
    h = hashlib.md5()
    out = [h.digest()]
    for turn in seq:
        h.update(turn.tobytes())
        out.append(h.digest())
    return out


def running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def partition_nodes(keys: np.ndarray, offsets: np.ndarray, words: np.ndarray, n: np.ndarray, ids: np.ndarray, ends: list[str]) -> tuple[dict[str, list], dict[str, list]]:
    """The nodes of sorted sequences, and what they say at their edges. Nodes with a key may go on in other partitions; of those with a pkey only the parent may."""
    sizes, rows = np.diff(offsets), len(offsets) - 1
    common = common_lengths(keys, offsets)
    table, id_table = sparse_table(common), sparse_table(ids)
    sums = running(words)  # over all turns
    upto = lambda row, depth: sums[offsets[row] + depth] - sums[offsets[row]]
    every = np.arange(rows)
    total = upto(every, sizes)
    members, spent, fresh = running(n), running(n * total), running(total - upto(every, common))
    leaf = running((np.append(common[1:], 0) < sizes).astype(np.int64))

    # a node is named by the first row that has it
    count = sizes - common
    row = np.repeat(every, count)
    begin = running(count)
    depth = np.arange(len(row)) - begin[row] + common[row] + 1
    l, r = extents(table, row, depth)
    before = upto(l, depth - 1)
    # a row's first new node hangs where it leaves the row before
    hang, _ = extents(table, every, common)
    hang = np.where(common > 0, begin[hang] + common - common[hang] - 1, -1)
    parent = np.where(depth - 1 > common[row], np.arange(len(row)) - 1, hang[row])

    convs = members[r + 1] - members[l]
    least_id = least(id_table, l, r)
    opened = (l == 0) | (r == rows - 1)
    firsts, lasts = prefix_keys(keys[: offsets[1]]), prefix_keys(keys[offsets[-2] :])
    key_at = lambda k: (firsts if l[k] == 0 else lasts)[depth[k]]
    parent_open = (parent < 0) | opened[parent]
    out = {
        "key": [key_at(k) if o else None for k, o in enumerate(opened)],
        "pkey": [(firsts[0] if p < 0 else key_at(p)) if o else None for p, o in zip(parent, parent_open, strict=True)],
        "depth": depth.tolist(), "conv_id": least_id.tolist(),
        "parent_conv_id": [None if o else int(least_id[p]) for p, o in zip(parent, parent_open, strict=True)],
        "n_convs": convs.tolist(), "n_children": np.bincount(parent[parent >= 0], minlength=len(row)).tolist(), "n_leaves": (leaf[r + 1] - leaf[l]).tolist(),
        "spent": (spent[r + 1] - spent[l] - before * convs).tolist(), "needed": (fresh[r + 1] - fresh[l + 1] + total[l] - before).tolist(),
        "ends": [ends[i] if d == sizes[i] else None for i, d in zip(row, depth, strict=True)],
    }
    root = (firsts[0], None, 0, int(ids.min()), None, int(members[-1]), int((parent < 0).sum()), int(leaf[-1]), int(spent[-1]), int(fresh[-1]), None if sizes[0] else ends[0])
    for c, v in zip(out, root, strict=True):
        out[c].append(v)
    first = [k.tobytes() for k in keys[: offsets[1]]]
    return out, {"first_seq": first, "first_keys": firsts, "first_sums": [int(upto(0, d)) for d in range(len(first) + 1)], "last_keys": lasts}


def sorted_nodes(ordered: DataFrame) -> DataFrame:
    """ordered: seq, words, n, conv_id, ends in order within range partitions. Node rows and one edge row a partition."""
    names = [x.split()[0] for x in f"{NODE}, {EDGE}".split(", ")]
    kinds = {"key": pa.binary(), "pkey": pa.binary(), "depth": pa.int32(), "ends": pa.string(), "first_seq": pa.list_(pa.binary()), "first_keys": pa.list_(pa.binary()), "first_sums": pa.list_(pa.int64()), "last_keys": pa.list_(pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        column = lambda c: t.column(c).combine_chunks() if t.num_rows else t.column(c)
        seq, words = column("seq"), column("words")
        sizes = seq.value_lengths().to_numpy(zero_copy_only=False)
        flat = np.frombuffer(b"".join(seq.flatten().to_pylist()), dtype=np.uint64).reshape(-1, 2)
        nodes, edge = partition_nodes(
            flat, running(sizes.astype(np.int64)), words.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            column("n").to_numpy(zero_copy_only=False), column("conv_id").to_numpy(zero_copy_only=False), t.column("ends").to_pylist(),
        )
        m = len(nodes["depth"])
        for a in range(0, m + 1, 5000):
            b = min(a + 5000, m + 1)
            data = {c: nodes[c][a:b] + [None] * (b > m) if c in nodes else [None] * (b - a - (b > m)) + [edge[c]] * (b > m) for c in names}
            yield pa.RecordBatch.from_arrays([pa.array(data[c], kinds.get(c, pa.int64())) for c in names], names=names)

    return ordered.mapInArrow(run, f"{NODE}, {EDGE}")


def counted_twice(edges: DataFrame) -> DataFrame:
    """What neighbouring partitions both counted, as negative parts of nodes. One row for each partition is in this window."""
    w = Window.orderBy("first_seq")
    pairs = edges.select("first_keys", "first_sums", F.lag("last_keys").over(w).alias("last_keys")).filter("last_keys IS NOT NULL")
    pairs = pairs.withColumn("m", F.size(F.array_intersect("first_keys", "last_keys")) - 1)
    each = pairs.select("m", "first_sums", "last_keys", F.posexplode(F.slice("first_keys", F.lit(1), F.col("m") + 1)).alias("depth", "key"))
    at = lambda k: F.get("first_sums", k)
    ended = ((F.size("last_keys") - 1 == F.col("m")) & (F.col("m") > 0)).cast("long")  # the last sequence goes on in the next partition, so is no leaf
    minus = {"n_children": (F.col("depth") < F.col("m")).cast("long"), "n_leaves": ended, "needed": at(F.col("m")) - at(F.greatest(F.col("depth") - 1, F.lit(0)))}
    return each.select("key", *[(-minus[c] if c in minus else F.lit(0).cast("long")).alias(c) for c in SUMS])


def trie(turns: DataFrame) -> DataFrame:
    """turns: conv_id, seq, words. A row for each distinct prefix: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    bounded_batches(turns.sparkSession)
    distinct = stored(sequences(turns), "sequences")
    size = distinct.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("seq")), F.lit(0)).alias("turns")).first()
    n = max(-(-size.rows // ROWS), -(-size.turns // TURNS), 1)
    found = stored(sorted_nodes(distinct.repartitionByRange(n, "seq").sortWithinPartitions("seq")), "trie")
    discard(distinct)
    nodes = found.filter("depth IS NOT NULL")
    parts = nodes.filter("key IS NOT NULL").select("key", "pkey", "depth", "conv_id", "ends", *SUMS).unionByName(counted_twice(found.filter("depth IS NULL")), allowMissingColumns=True)
    merged = parts.groupBy("key").agg(F.first("pkey", ignorenulls=True).alias("pkey"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), *[F.sum(c).alias(c) for c in SUMS])
    merged = stored(merged, "trie-edges")
    # the parents' rows are prefixes at the edges of partitions; their children may be very many
    names = merged.select(F.col("key").alias("pkey"), F.col("conv_id").alias("above"))
    closed = nodes.filter("key IS NULL")
    columns = ["pkey", "depth", "conv_id", "ends", *SUMS]
    hanging = closed.filter("pkey IS NOT NULL").select(*columns).join(names, "pkey", "left")
    edges = merged.select(*columns).join(names, "pkey", "left")
    inner = closed.filter("pkey IS NULL").withColumn("above", F.col("parent_conv_id"))
    leaves = F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves"))  # a root alone
    return inner.select(*columns, "above").unionByName(hanging.select(*columns, "above")).unionByName(edges.select(*columns, "above")).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("above").alias("parent_conv_id"), "n_convs", "n_children", leaves.alias("n_leaves"),
        (F.col("spent") - F.col("needed")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
