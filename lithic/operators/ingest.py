"""Landing, versioning, tombstones, routing, chunking."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.text import content_hash

LOGICAL = ("tenant_id", "source_system", "native_id")


def insert_ignoring(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key is neither in `existing` nor earlier in `new` (the first by column order): what an idempotent insert adds."""
    first = new.groupBy(*keys).agg(F.min(F.struct(*[c for c in new.columns if c not in keys])).alias("rest"))
    return first.join(existing.select(*keys), keys, "left_anti").select(*keys, "rest.*").select(*new.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], recency: str) -> DataFrame:
    """The newest row of each key over both."""
    both = existing.unionByName(new)
    rest = [c for c in both.columns if c not in keys and c != recency]
    newest = both.groupBy(*keys).agg(F.max(F.struct(recency, *rest)).alias("row"))
    return newest.select(*keys, "row.*").select(*both.columns)


def land(items: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Items whose bytes the tenant lacks, each with its content hash and its version in the chain of its logical document.

    Bytes count once per tenant, whichever item brings them first (least raw_id). All items without a native id share one
    chain per system.
    """
    hashed = items.withColumn("content_hash", content_hash(F.col("text")))
    first = hashed.groupBy("tenant_id", "content_hash").agg(F.min("raw_id").alias("raw_id"))
    kept = hashed.join(first, ["tenant_id", "content_hash", "raw_id"], "left_semi")
    base = F.lit(0)
    if existing is not None:
        kept = kept.join(existing.select("tenant_id", "content_hash"), ["tenant_id", "content_hash"], "left_anti")
        last = existing.groupBy(*LOGICAL).agg(F.max("version").alias("last"))
        same = [kept[c].eqNullSafe(last[c]) for c in LOGICAL]
        kept = kept.join(last, same[0] & same[1] & same[2], "left").select(*[kept[c] for c in kept.columns], "last")
        base = F.coalesce("last", F.lit(0))
    chain = Window.partitionBy(*LOGICAL).orderBy("raw_id")
    return kept.withColumn("version", F.row_number().over(chain) + base).drop("last")


def already_landed(items: DataFrame, raw: DataFrame) -> DataFrame:
    """Items whose bytes the tenant has landed before."""
    have = raw.select("tenant_id", content_hash(F.col("text")).alias("content_hash")).distinct()
    return items.withColumn("content_hash", content_hash(F.col("text"))).join(have, ["tenant_id", "content_hash"], "left_semi").select(*items.columns, "content_hash")


def prior_versions(raw: DataFrame, block: int = 1000) -> DataFrame:
    """Pairs of a landed document and an earlier version of the same logical document: raw_id, prior_id.

    They are as many as the square of a chain. Versions meet in blocks of `block` numbers, so that a row holds two blocks at most, a long chain is dealt over all tasks and
    what is shuffled are blocks, not pairs. Blocks are spread into pairs in the JVM, a document of one block at a time. The same block follows a document after the other, in one
    order, which files of pairs pack well.
    """
    rows = raw.filter("version IS NOT NULL").select(*LOGICAL, "version", "raw_id", F.floor(F.col("version") / block).alias("block"))
    rows = rows.withColumn("below", F.rank().over(Window.partitionBy(*LOGICAL, "block").orderBy("version")) - 1)  # how many of its block are earlier
    rows = rows.groupBy(*LOGICAL, "block").agg(F.sort_array(F.collect_list(F.struct("version", "raw_id", "below"))).alias("rows"))
    a, b = rows.alias("a"), rows.alias("b")
    same = F.col("a.native_id").eqNullSafe(F.col("b.native_id")) & (F.col("a.tenant_id") == F.col("b.tenant_id")) & (F.col("a.source_system") == F.col("b.source_system"))
    met = a.join(b, same & (F.col("b.block") <= F.col("a.block"))).select("a.*", F.col("b.block").alias("before"), F.col("b.rows.raw_id").alias("earlier"))
    tasks = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, *LOGICAL, "block", "before").select("rows", "earlier", (F.col("before") < F.col("block")).alias("whole"))
    # coalesce keeps the number of tasks and parts the two loops: as one generated stage they would hold all pairs of two blocks as rows at once
    each = met.select(F.explode("rows").alias("row"), "earlier", "whole").coalesce(tasks)
    below = F.when(F.col("whole"), F.col("earlier")).otherwise(F.slice("earlier", F.lit(1), F.col("row.below")))
    return each.select(F.col("row.raw_id").alias("raw_id"), F.explode(below).alias("prior_id"))


def latest_versions(raw: DataFrame) -> DataFrame:
    newest = raw.groupBy(*LOGICAL).agg(F.max(F.struct("version", "raw_id")).alias("top"))
    return newest.select(*LOGICAL, F.col("top.raw_id").alias("raw_id"), F.col("top.version").alias("version"))


def retire(df: DataFrame, condition: Column, as_of: datetime | Column, reason: str) -> DataFrame:
    """Sets valid_to and reason on current rows that meet a condition: the only writer of either."""
    hit = condition & F.col("valid_to").isNull()
    return df.withColumns({"valid_to": F.when(hit, as_of if isinstance(as_of, Column) else F.lit(as_of)).otherwise(F.col("valid_to")), "reason": F.when(hit, F.lit(reason)).otherwise(F.col("reason"))})


def marked(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """df with `hit`: whether the column's value is among ids (one column of that name)."""
    return df.join(ids.select(column).distinct().withColumn("hit", F.lit(True)), column, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def tombstone(documents: DataFrame, facts: DataFrame, gone: DataFrame, as_of: datetime, reason: str = "source_tombstone") -> tuple[DataFrame, DataFrame]:
    """Retire documents (document_id in gone) and the current facts they anchor, with one time and reason."""
    docs = retire(marked(documents, gone, "document_id"), F.col("hit"), as_of, reason).drop("hit")
    dependent = retire(marked(facts, gone, "document_id"), F.col("hit"), as_of, reason).drop("hit")
    return docs, dependent


def revive(documents: DataFrame, facts: DataFrame, back: DataFrame, reason: str = "source_tombstone") -> tuple[DataFrame, DataFrame]:
    """Undo a tombstone: only what was retired for that reason."""

    def undone(df: DataFrame) -> DataFrame:
        df = marked(df, back, "document_id")
        hit = F.col("hit") & (F.col("reason") == reason)
        empty = lambda c: F.when(F.coalesce(hit, F.lit(False)), F.lit(None)).otherwise(F.col(c))
        return df.withColumns({"valid_to": empty("valid_to"), "reason": empty("reason")}).drop("hit")

    return undone(documents), undone(facts)


def storm_guard(tombstones: DataFrame, live: int, floor: int = 10, share: float = 0.1) -> DataFrame:
    """Tombstones in order with whether each may still be applied: a sweep halts once it would exceed the limit.

    The order is global, so only the first limit rows are ranked; all others are refused without an order.
    """
    limit = max(floor, int(share * live))
    allowed = tombstones.orderBy("document_id").limit(limit).withColumn("applied", F.lit(True))
    return tombstones.join(allowed, tombstones.columns, "left").withColumn("applied", F.coalesce("applied", F.lit(False)))


# Containers that are structured by construction, by file ending and by mime type, and what delimits cells.
STRUCTURED_ENDINGS = r"[^/]\.(csv|tsv|xlsx|xlsm|xls|parquet)$"
STRUCTURED_MIMES = ("text/csv", "text/tab-separated-values", "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")
DELIMITERS = (",", ";", "\t", "|")
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def detected_track(text: Column, name: Column, mime: Column | None = None) -> tuple[Column, Column]:
    """(track, confident). Structured for sure by file ending or mime type, or if of five lines or more at least 0.8 are rows: lines that
    hold one delimiter twice. Prose for sure if of five lines or more at most 0.2 are rows and the text has 30 words; else prose, unsure.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, LINE_END), lambda x: x.rlike(r"(?U)\S"))
    row = "|".join(f"[{d}][^{d}]*[{d}]" for d in DELIMITERS)
    n, rows = F.size(lines), F.size(F.filter(lines, lambda x: x.rlike(row)))
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    container = F.coalesce(F.lower(name).rlike(STRUCTURED_ENDINGS), F.lit(False))
    if mime is not None:
        container |= F.coalesce(F.lower(mime).isin(*STRUCTURED_MIMES), F.lit(False))
    tabular = container | (n >= 5) & (5 * rows >= 4 * n)
    return F.when(tabular, "structured").otherwise("prose"), tabular | (n >= 5) & (5 * rows <= n) & (words >= 30)


def track_mismatch(declared: Column, track: Column, confident: Column) -> Column:
    return F.coalesce(confident & declared.isNotNull() & (declared != track), F.lit(False))


def strategy(declared: Column, track: Column) -> Column:
    return F.coalesce(declared, F.when(track == "structured", "structured_map").otherwise("llm"))


def effective_config(registry: Column, item: Column) -> Column:
    """Registry settings overlaid by an item's non-null ones."""
    own = F.map_filter(item, lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(registry, lambda k, _: ~F.map_contains_key(own, k)), own)


def document_title(declared: Column, text: Column, name: Column) -> Column:
    """Declared title, else the first heading, else the file's stem."""
    heading = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#{1,6}[ \t]+(\S.*)$", 1)), F.lit(""))
    return F.coalesce(declared, heading, F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]*$", ""))


def document_type(declared: Column, title: Column) -> Column:
    return F.coalesce(declared, F.when(title.rlike(r"(?i)\b(sop|procedure|work instruction)\b"), "sop").otherwise("prose"))


def sections(text: str) -> list[tuple[int, int, str]]:
    """(start, end, path) of a text's sections: cut at headings up to the most frequent level (the deeper of equals), or up to 3 if that is deeper."""
    heads, at = [], 0
    for line in text.splitlines(keepends=True):
        mark = len(line) - len(line.lstrip("#"))
        if 1 <= mark <= 6 and line[mark : mark + 1] in " \t" and line[mark:].strip():
            heads.append((at, mark, line[mark:].strip()))
        at += len(line)
    levels = Counter(h[1] for h in heads)
    level = min(3, max(levels, key=lambda x: (levels[x], x), default=0))
    if level < min(levels, default=1):
        return [(0, len(text), "")] if text else []
    out, path, start, name = [], {}, 0, ""
    for place, mark, title in heads:
        path = {k: v for k, v in path.items() if k < mark} | {mark: title}
        if mark <= level:
            if text[start:place].strip():
                out.append((start, place, name))
            start, name = place, " / ".join(path[k] for k in sorted(path))
    if text[start:].strip():
        out.append((start, len(text), name))
    return out


def passages(start: int, text: str, size: int, overlap: float) -> Iterator[tuple[int, int]]:
    """Places of overlapping passages of at most `size` words; each starts and ends at a word."""
    words, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        words.append((start + at, start + at + len(w)))
        at += len(w)
    step = max(1, size - int(size * overlap))
    for a in range(0, len(words), step):
        b = min(a + size, len(words))
        yield words[a][0], words[b - 1][1]
        if b == len(words):
            return


CHUNKS = "doc_id long, level string, seq int, parent_seq int, section string, start int, end int, content string"
#: Characters of chunks that a task holds before it hands them on, and documents that come to it at a time.
HELD_CHARS, READ_ROWS = 2_000_000, 64


def chunked(docs: DataFrame, child_words: int = 300, parent_words: int = 2048, overlap: float = 0.15, content: bool = True) -> DataFrame:
    """docs: doc_id, text. Parents (sections, cut where oversized) and their overlapping children, with offsets into the text.

    Children lie within their parent. A row is chunked by itself, so this never shuffles, and chunks are handed on some `HELD_CHARS` characters at a time,
    so what a task holds doesn't grow with the rows of a batch. Without `content`, that column is null.
    """
    return docs.select("doc_id", "text").mapInArrow(chunker(child_words, parent_words, overlap, content), CHUNKS)


def chunker(child_words: int, parent_words: int, overlap: float, content: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shape = pa.schema([("doc_id", pa.int64()), ("level", pa.string()), ("seq", pa.int32()), ("parent_seq", pa.int32()), ("section", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("content", pa.string())])

    def of(doc: int, text: str) -> Iterator[tuple]:
        parent = child = 0
        for a, b, name in sections(text):
            for x, y in passages(a, text[a:b], parent_words, 0.0):
                yield doc, "parent", parent, None, name, x, y, text[x:y] if content else None
                for c, d in passages(x, text[x:y], child_words, overlap):
                    yield doc, "child", child, parent, name, c, d, text[c:d] if content else None
                    child += 1
                parent += 1

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(shape)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(at, READ_ROWS)
                rows, held = [], 0
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for row in of(doc, text or ""):
                        rows.append(row)
                        held += len(row[7] or "") + 100
                        if held >= HELD_CHARS:
                            yield packed(rows)
                            rows, held = [], 0
                yield packed(rows)

    return run


def with_parents(chunks: DataFrame) -> DataFrame:
    """Children with the identity hash of their parent instead of its number."""
    ident = F.sha2(F.concat_ws("\u001f", F.col("doc_id").cast("string"), "level", F.col("seq").cast("string"), "content"), 256)
    hashed = chunks.withColumn("chunk_hash", ident)
    parents = hashed.filter("level = 'parent'").select("doc_id", F.col("seq").alias("parent_seq"), F.col("chunk_hash").alias("parent_hash"))
    return hashed.join(parents, ["doc_id", "parent_seq"], "left").select("doc_id", "level", "seq", "section", "start", "end", "chunk_hash", "parent_hash")


def rebuilt_text(chunks: DataFrame) -> DataFrame:
    """Document text rebuilt from parents at their offsets, gaps filled with blanks: doc_id, text."""
    parts = chunks.filter("level = 'parent'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "content"))).alias("parts"))
    text = F.aggregate("parts", F.lit(""), lambda a, p: F.concat(F.rpad(a, p["start"], F.lit(" ")), p["content"]))
    return parts.select("doc_id", text.alias("text"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count_if(F.col("level") == "parent").alias("parents"), F.count_if(F.col("level") == "child").alias("children"))
