"""Benchmark decontamination by the q-gram lemma.

A document is contaminated by an item if some stretch of it is within the item's edit budget. With at most k edits, an
item of m characters still shares m - q + 1 - kq character q-grams with that stretch, all on diagonals at most k from
where the stretch starts. Shared q-grams are counted per item in overlapping bands of diagonals; a band that reaches the
bound becomes a region, and a banded alignment of item and region decides.

Texts and items are compared lower-cased with runs of white space and NUL as one blank. The budget is `rate` times the length,
less for short items for which the lemma would not bound it; an item shorter than q, which may be any common word, is found in a
document that consists of nothing else. The items are sent to the tasks in blocks of at most `block_chars` characters, one scan of
the documents per block. Shared q-grams are taken up in slices of at most `MOST_HITS` in the text's order, and bands are settled as
soon as the text is past them, so a text that repeats one word takes no more memory than another.

Null and blank texts and items match nothing. Repeated rows are searched each, repeated items reported once per row. Other columns
are passed on or ignored. Empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import bounded_batches, slices

Q = 8
TABLE_BITS = 22
_BASE = 0x9E3779B97F4A7C15
MOST_HITS = 500_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().replace("\0", " ").split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at each place, by doubling: pairs, then fours, then eights."""
    h, power, width = c.astype(np.uint64), _BASE, 1
    while width < Q:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % 2**64, width * 2
    return h


class ItemIndex:
    """Items of one block with their q-grams: sorted hashes, and for each the items and places it occurs at."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        clean = sorted({(i, n) for i, t in items if (n := normal(t))})
        found = [x for x in clean if len(x[1]) >= Q]
        self.short: dict[str, list[int]] = {}
        for i, t in clean:
            if len(t) < Q:
                self.short.setdefault(t, []).append(i)
        self.ids = [i for i, _ in found]
        self.texts = [t for _, t in found]
        self.codes = [codes(t) for t in self.texts]
        length = np.array([len(c) for c in self.codes], np.int64)
        self.length = length
        self.budget = np.minimum((length * rate).astype(np.int64), (length - Q) // Q)
        self.least = length - Q + 1 - self.budget * Q
        self.stride = 2 * self.budget + 1
        hashes = [gram_hashes(c) for c in self.codes]
        item = np.repeat(np.arange(len(found)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if found else np.zeros(0, np.int64)
        flat = np.concatenate(hashes) if found else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.narrow = np.minimum.reduceat(self.stride[self.item], self.first) if found else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[self.keys >> np.uint64(64 - TABLE_BITS)] = True

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, edits, start, end) for each item found in a normalised text, at its best place."""
        return [h for _, *h in self.hits_of([text])]

    def hits_of(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        joined = codes("\0".join(texts))
        if len(joined) < Q or not len(self.keys):
            return []
        h = gram_hashes(joined)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - TABLE_BITS)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        longest = int(self.length.max())
        span, shift = 2 * (len(joined) + 2 * longest + 4), longest + 2
        full = self.full_bands(at[same], k[same], span, shift, longest)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i, band in zip((full // span).tolist(), (full % span - shift).tolist(), strict=True):
            a = band * int(self.stride[i])
            b = a + 2 * int(self.stride[i]) + int(self.length[i]) + int(self.budget[i])
            # the band may span a border between texts: each text's share is a region of its own
            for d in range(max(0, int(np.searchsorted(starts, max(a, 0), side="right")) - 1), len(texts)):
                if starts[d] >= b:
                    break
                x, y = max(a, int(starts[d])), min(b, int(starts[d + 1]) - 1)
                if y - x < self.length[i] - self.budget[i] or (d, i) in best and best[d, i][0] == 0:
                    continue
                got = self.aligned(i, texts[d], x - int(starts[d]), y - int(starts[d]))
                if got and got < best.get((d, i), (1 << 60, 0, 0)):
                    best[d, i] = got
        return [(d, i, *v) for (d, i), v in sorted(best.items())]

    def full_bands(self, at: np.ndarray, k: np.ndarray, span: int, shift: int, longest: int) -> np.ndarray:
        """Bands (item * span + band + shift) with enough of their item's q-grams. at, k: places in the text and the q-grams there."""
        if self.count[k].sum() > MOST_HITS:
            # of a q-gram's places in a stretch no longer than a stride, the first and the last reach all bands that any of them reaches
            stretch = at // self.narrow[k]
            order = np.lexsort((at, stretch, k))
            new = (np.diff(k[order], prepend=-1) != 0) | (np.diff(stretch[order], prepend=-1) != 0)
            kept = np.sort(order[new | np.append(new[1:], True)])
            at, k = at[kept], k[kept]
        n = self.count[k]
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(n) else 0
        full, held = [], np.zeros(0, np.int64)
        for a in range(0, total, MOST_HITS):
            hit = np.arange(a, min(a + MOST_HITS, total))
            j = np.searchsorted(upto, hit, side="right")
            take = self.first[k[j]] + hit - (upto[j] - n[j])
            item, place = self.item[take], self.place[take]
            # bands of two strides, one stride apart: any run of 2k + 1 diagonals is inside one of them
            low = (at[j] - place) // self.stride[item]
            key = np.concatenate([item * span + low, item * span + low - 1]) + shift
            place = np.concatenate([place, place])
            if total <= MOST_HITS:
                bands, of, number = np.unique(key, return_inverse=True, return_counts=True)
                near = (number >= self.least[bands // span])[of]
                key, place = key[near], place[near]
            # a q-gram of the item counts once in a band, however often the text repeats it
            held = np.unique(np.concatenate([held, key * longest + place]))
            bands, number = np.unique(held // longest, return_counts=True)
            item = bands // span
            full.append(bands[number >= self.least[item]])
            # nothing further on in the text is in a band that ends before this place
            ends = (bands % span - shift + 2) * self.stride[item] + self.length[item] + self.budget[item]
            held = held[np.repeat(ends >= at[j[-1]], number)]
        return np.unique(np.concatenate(full)) if full else np.zeros(0, np.int64)

    def aligned(self, i: int, text: str, a: int, b: int) -> tuple[int, int, int] | None:
        """Best (edits, start, end) of item i within text[a:b], or None beyond the budget."""
        if (p := text.find(self.texts[i], a, b)) >= 0:
            return 0, p, p + int(self.length[i])
        k = int(self.budget[i])
        if not k:
            return None
        region, item = codes(text[a:b]).astype(np.int64), self.codes[i].astype(np.int64)
        n = len(region)
        column = np.arange(n + 1)
        # row[j]: least edits of item[:r] against a stretch ending at j, with the stretch's start, as edits * (n + 1) + start
        unit = n + 1
        row = column.copy()
        for r, c in enumerate(item):
            step = row[:-1] + unit * (region != c)
            new = np.empty_like(row)
            new[0] = row[0] + unit
            new[1:] = np.minimum(step, row[1:] + unit)
            row = np.minimum.accumulate(new - unit * column) + unit * column
        j = int(np.argmin(row // unit))
        edits, start = divmod(int(row[j]), unit)
        return (edits, a + start, a + j) if edits <= k else None


def item_blocks(benchmark: DataFrame, rate: float, block_chars: int) -> Iterator[ItemIndex]:
    """Indexes of all items, each block of about block_chars characters at most."""
    bounded_batches(benchmark.sparkSession)
    items = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield ItemIndex([(r.item_id, r.text) for r in part.toLocalIterator()], rate)


def hits_in(index: ItemIndex, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(row, item's id, edits, start, end) over some texts."""
    clean = [normal(t) for t in texts]
    out = [(d, index.ids[i], *rest) for d, i, *rest in index.hits_of(clean)]
    return out + [(d, i, 0, 0, len(t)) for d, t in enumerate(clean) for i in index.short.get(t, ())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document row and item found: doc_id, item_id, edits, start, end (in the normalised text)."""
    schema = "doc_id long, item_id long, edits long, start long, end long"

    def scan(index: ItemIndex) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                found = hits_in(index, batch.column(1).to_pylist())
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "edits", "start", "end"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, schema)

    found = None
    for index in item_blocks(benchmark, rate, block_chars):
        found = scan(index) if found is None else found.unionByName(scan(index))
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of `docs`, all columns as they are, in which no item is found."""
    at = docs.columns.index("text")

    def cleaned(rows: DataFrame, index: ItemIndex) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, at):
                bad = {f[0] for f in hits_in(index, batch.column(at).to_pylist())}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    for index in item_blocks(benchmark, rate, block_chars):
        docs = cleaned(docs, index)
    return docs
