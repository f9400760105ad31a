"""Vector and hybrid retrieval."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from lithic.functions.storage import stored
from lithic.functions.text import content_hash, keyword_rank, search_terms
from lithic.functions.vector import cosine, cosines, hashed_embedding, sequential_sums, vector
from lithic.operators.facts import passages
from lithic.operators.gate import Gate

RRF_K = 60
#: Items that a task compares with queries at a time, and queries whose cosines with these it holds.
BLOCK_ROWS, QUERY_ROWS = 10_000, 64
#: Pairs whose cosines are worked out in full at a time.
PAIR_ROWS = 16_384


def pool_size(k: int) -> int:
    return max(4 * k, 20)


def dense_topk(items: DataFrame, query: list[float], k: int, id_col: str = "vec_id") -> DataFrame:
    """The k items of greatest cosine with a query vector, ties by id: id, score, rank. A top-k keeps k rows per task."""
    if not 1 <= k <= 50:
        raise ValueError("k must be 1 to 50")
    scored = items.select(F.col(id_col).alias("id"), cosine(F.col("embedding"), vector(query)).alias("score")).filter(F.col("score").isNotNull())
    return ranked(scored.orderBy(F.desc("score"), "id").limit(k), "score")


def keyword_topk(items: DataFrame, query: str, k: int, id_col: str = "doc_id", text_col: str = "text", terms_of: Callable[[Column], Column] = search_terms) -> DataFrame:
    """The k items of greatest keyword rank that have all terms of the query. `terms_of` makes terms of texts and queries."""
    terms = items.sparkSession.range(1).select(terms_of(F.lit(query)).alias("t")).first().t
    return terms_topk(items.withColumn("terms", terms_of(F.col(text_col))), "terms", terms, k, id_col)


def terms_topk(items: DataFrame, terms_col: str, query: list[str], k: int, id_col: str) -> DataFrame:
    """`keyword_topk` over items that hold their terms."""
    rank = keyword_rank(F.col(terms_col), F.array(*[F.lit(t) for t in query]).cast("array<string>"))
    scored = items.select(F.col(id_col).alias("id"), rank.alias("score")).filter(F.col("score").isNotNull())
    return ranked(scored.orderBy(F.desc("score"), "id").limit(k), "score")


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """A bounded ranking with ranks from 1. Only lists that a limit has bounded are ranked without partitions."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "id")))


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Fused order of two rankings (id, rank): id, score, rank."""
    both = dense.select("id", F.col("rank").alias("dense_rank")).join(sparse.select("id", F.col("rank").alias("sparse_rank")), "id", "full")
    part: Callable[[str], Column] = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    fused = both.select("id", (part("dense_rank") + part("sparse_rank")).alias("score"))
    return ranked(fused.orderBy(F.desc("score"), "id").limit(k), "score")


def weighted_fusion(dense: DataFrame, sparse: DataFrame, k: int, weight: float = 0.3) -> DataFrame:
    """(1 - weight) dense + weight sparse / greatest sparse, over rankings (id, score)."""
    top = sparse.agg(F.max("score").alias("top"))
    scaled = sparse.join(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("sparse"))  # one row
    both = dense.select("id", F.col("score").alias("dense")).join(scaled, "id", "full")
    fused = both.select("id", ((1 - weight) * F.coalesce("dense", F.lit(0.0)) + weight * F.coalesce("sparse", F.lit(0.0))).alias("score"))
    return ranked(fused.orderBy(F.desc("score"), "id").limit(k), "score")


Reranker = Callable[[DataFrame], DataFrame]


def retrieve(items: DataFrame, query: list[float], k: int, sparse: DataFrame | None = None, reranker: Reranker | None = None) -> DataFrame:
    """Dense retrieval, or hybrid where a keyword ranking is given; a reranker may change scores, and ranks are stamped anew."""
    if sparse is None:
        found = dense_topk(items, query, k)
    else:
        found = reciprocal_rank_fusion(dense_topk(items, query, min(pool_size(k), 50)), sparse, k)
    return found if reranker is None else ranked(reranker(found).drop("rank"), "score")


def embedded(items: DataFrame, known: DataFrame | None = None, column: str = "content") -> DataFrame:
    """Items with content_hash, terms and embedding. What `known` (content_hash, embedding) has is taken from there.

    Items are spread over the cluster first, as few files may hold very many texts.
    """
    rows = items.repartition(*items.columns).withColumn("content_hash", content_hash(F.coalesce(column, F.lit(""))))
    with_terms = lambda df: df.withColumn("terms", search_terms(F.coalesce(column, F.lit(""))))
    if known is None:
        return with_terms(rows).withColumn("embedding", hashed_embedding(F.col("terms")))
    new = rows.join(known.select("content_hash"), "content_hash", "left_anti")
    old = rows.join(known.select("content_hash", "embedding"), "content_hash")
    return with_terms(new).withColumn("embedding", hashed_embedding(F.col("terms"))).unionByName(with_terms(old))


def both_rankings(items: DataFrame, query: list[float], terms: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """The k best items (chunk_id, terms, embedding) by cosine and by keyword rank: two rankings (id, score, rank) from one pass, of which each task keeps 2 k rows."""
    words = keyword_rank(F.col("terms"), F.array(*[F.lit(t) for t in terms]).cast("array<string>"))
    kinds = F.array(F.struct(F.lit("dense").alias("kind"), cosine(F.col("embedding"), vector(query)).alias("score")), F.struct(F.lit("sparse").alias("kind"), words.alias("score")))
    each = items.select(F.col("chunk_id").alias("id"), F.explode(kinds).alias("x")).select("id", "x.kind", "x.score").filter("score IS NOT NULL")
    order = Window.partitionBy("kind").orderBy(F.desc("score"), "id")
    best = stored(each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "rankings")
    of = lambda kind: best.filter(F.col("kind") == kind).select("id", "score", "rank")
    return of("dense"), of("sparse")


class Indexed(Protocol):
    """Passages that are indexed already, as `index.PassageIndex` keeps them."""

    def dense(self, query: str, k: int, visible: DataFrame | None = None) -> DataFrame: ...

    def keywords(self, query: str, k: int, visible: DataFrame | None = None) -> DataFrame: ...


def shown_passages(gate: Gate, chunk_ids: set[int]) -> DataFrame:
    """A few visible passages by id. Chunks are read for their ids' sake only, documents for those chunks'."""
    chunks = gate.read("chunks").filter(F.col("chunk_id").isin(sorted(chunk_ids)))
    documents = gate.read("documents").select("document_id", "title", F.coalesce("label", F.lit("public")).alias("label"), "source_timestamp")
    return chunks.join(documents, "document_id")


def retrieve_evidence(gate: Gate, query: str, k: int = 10, mode: str = "dense", reranker: Reranker | None = None, index: Indexed | None = None) -> DataFrame:
    """The passages nearest to a query text, of documents that the principal may see: rank, score, chunk_id, document_id, title, label, seq, content.

    The gate comes before the ranking, so that what may not be seen takes no place. Embeddings are the chunks' own, else `hashed_embedding` of
    their terms; `hybrid` fuses in a keyword ranking. With an index, its vectors and postings are read; without one, passages are tokenised and
    embedded once, in the one pass that both rankings come from. The ranking of k rows is written out.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must be 1 to 50")
    items, hybrid = passages(gate), mode == "hybrid"
    pool = min(pool_size(k), 50)
    if index is not None:
        dense = index.dense(query, pool if hybrid else k, gate.read("documents"))
        found = reciprocal_rank_fusion(dense, index.keywords(query, pool, gate.read("documents")), k) if hybrid else dense
    else:
        own = "embedding" in items.columns
        ready = items.select("chunk_id", "content", *(["embedding"] if own else []))
        ready = ready.withColumn("terms", search_terms(F.coalesce("content", F.lit("")))) if own else embedded(ready)
        vector_, terms = ready.sparkSession.range(1).select(hashed_embedding(search_terms(F.lit(query))).alias("v"), search_terms(F.lit(query)).alias("t")).first()
        dense, sparse = both_rankings(ready, vector_, terms if hybrid else [], pool if hybrid else k)
        found = reciprocal_rank_fusion(dense, sparse, k) if hybrid else dense
    found = stored(found if reranker is None else ranked(reranker(found).drop("rank"), "score"), "ranking")  # k rows
    best = {r.id for r in found.select("id").collect()}  # k at most
    shown = shown_passages(gate, best)
    return found.withColumnRenamed("id", "chunk_id").join(shown, "chunk_id").select("rank", "score", "chunk_id", "document_id", "title", "label", "seq", "content").orderBy("rank")


def enriched(found: DataFrame, facts: DataFrame, by: str = "document_id") -> DataFrame:
    """Retrieved items (id) with the facts that cite them, as an array; one join for all items. The items go first, so only their facts are gathered."""
    facts = facts.join(found.select(F.col("id").alias(by)).distinct(), by, "left_semi")
    cited = facts.groupBy(F.col(by).alias("id")).agg(F.array_sort(F.collect_list(F.struct("fact_id", "predicate", "state"))).alias("facts"))
    return found.join(cited, "id", "left").withColumn("facts", F.coalesce("facts", F.array()))


def hash_blocks(rows: DataFrame, ident: str, most: int) -> list[DataFrame]:
    """Rows as they are, or, if there are more than `most`, dealt over blocks of about half as many each by a hash of their id."""
    n = rows.count()
    blocks = 1 if n <= most else -(-2 * n // most)
    if blocks == 1:
        return [rows]
    return [rows.filter(F.pmod(F.xxhash64(ident), F.lit(blocks)) == b) for b in range(blocks)]


def met_in_blocks(items: DataFrame, queries: DataFrame, ident: str, query_ident: str, max_queries: int) -> PandasCogroupedOps:
    """Items and queries, each pair of which meets in one group of at most some BLOCK_ROWS items and max_queries queries, whatever their number."""

    def number(rows: DataFrame, column: str, most: int) -> tuple[int, Column]:
        n = -(-rows.count() // most) or 1
        return n, F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    blocks, item_block = number(items, ident, BLOCK_ROWS)
    parts, query_part = number(queries, query_ident, max_queries)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    i = items.withColumn("item_block", item_block).withColumn("query_part", every(parts))
    q = queries.withColumn("query_part", query_part).withColumn("item_block", every(blocks))
    return q.groupBy("item_block", "query_part").cogroup(i.groupBy("item_block", "query_part"))


def whole_vector(c: str) -> Column:
    """A vector as doubles, or null if a component is."""
    return F.when(~F.exists(c, lambda x: x.isNull()), F.col(c).cast("array<double>"))


def rows_by_length(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    column = column.combine_chunks()
    return column, column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)


def of_length(column: pa.Array, lengths: np.ndarray, rows: np.ndarray, dim: int) -> np.ndarray:
    """These rows' vectors, zero for those that are null or of another length, so that they have no cosine."""
    out = np.zeros((len(rows), max(dim, 1)))
    fit = np.flatnonzero(lengths[rows] == dim)
    if dim > 0 and len(fit):
        out[fit] = column.take(pa.array(rows[fit])).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


def vectors_by_kind(queries: pa.Table, items: pa.Table, wanted: Callable[[object], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the queries of a kind and length, rows of the items that this kind wants, and the vectors of both."""
    (v, v_lengths), (e, e_lengths) = rows_by_length(queries.column("v")), rows_by_length(items.column("embedding"))
    kinds = np.array(queries.column("kind").to_pylist(), dtype=object)
    for kind in dict.fromkeys(kinds):
        own = wanted(kind)
        if not len(own):
            continue
        for dim in np.unique(v_lengths[kinds == kind]):
            asked = np.flatnonzero((kinds == kind) & (v_lengths == dim))
            yield asked, own, of_length(v, v_lengths, asked, int(dim)), of_length(e, e_lengths, own, int(dim))


def scored_rows(queries: pa.Table, items: pa.Table, wanted: Callable[[object], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row of a query, rows of the items that its kind wants, and their cosines, NaN where there is none."""
    for asked, own, a, b in vectors_by_kind(queries, items, wanted):
        for at in range(0, len(asked), QUERY_ROWS):
            scores = cosines(a[at : at + QUERY_ROWS], b)
            yield from ((int(asked[at + r]), own, row) for r, row in enumerate(scores))


def near_pairs(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, rows of b and cosines of all pairs that may be among a row's k best, and perhaps more of them; NaN where there is none.

    Products in single precision leave out what is further below the k-th best than they can err; what remains gets the very numbers that `cosine` gives.
    """
    sizes = [np.sqrt((x * x).sum(axis=1)) for x in (a, b)]
    usual = all(((n == 0) | (n > 1e-100) & (n < 1e100)).all() for n in sizes)
    if not usual or len(b) <= k:
        return np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a)), cosines(a, b).ravel()
    unit_a, unit_b = ((x / np.where(n > 0, n, 1)[:, None]).astype(np.float32) for x, n in zip((a, b), sizes, strict=True))
    score = unit_a @ unit_b.T
    score[:, sizes[1] == 0] = -np.inf
    score[sizes[0] == 0] = -np.inf
    least = np.partition(score, len(b) - k, axis=1)[:, len(b) - k]
    x, y = np.nonzero(score >= (least - 4 * (a.shape[1] + 4) * np.finfo(np.float32).eps)[:, None])
    exact = np.full(len(x), np.nan)
    some = np.flatnonzero(score[x, y] > -np.inf)
    for at in range(0, len(some), PAIR_ROWS):
        part = some[at : at + PAIR_ROWS]
        p, q = np.ascontiguousarray(a[x[part]].T), np.ascontiguousarray(b[y[part]].T)
        exact[part] = sequential_sums(p, q) / (np.sqrt(sequential_sums(p, p)) * np.sqrt(sequential_sums(q, q)))
    return x, y, exact


def best_in_block(k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each query the k items of its own kind, or of any other, with the greatest cosine in a group, ties by id; those without a cosine last."""

    def best(queries: pa.Table, items: pa.Table) -> pa.Table:
        ids, asked = items.column("id").combine_chunks(), queries.column("query_id").combine_chunks()
        by_id = ids.fill_null(np.iinfo(np.int64).max).to_numpy()  # without an id last
        kinds = np.array(items.column("kind").to_pylist(), dtype=object)
        out = []
        for rows, own, a, b in vectors_by_kind(queries, items, lambda kind: np.flatnonzero(kinds == kind if same else kinds != kind)):
            for at in range(0, len(rows), QUERY_ROWS):
                x, y, score = near_pairs(a[at : at + QUERY_ROWS], b, k)
                order = np.lexsort((by_id[own[y]], np.where(np.isnan(score), np.inf, -score), x))
                first = np.searchsorted(x[order], np.arange(len(a[at : at + QUERY_ROWS])))
                order = order[np.arange(len(order)) - first[x[order]] < k]
                out.append((rows[at + x[order]], own[y[order]], score[order]))
        x, y, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": asked.take(pa.array(x)), "id": ids.take(pa.array(y)), "score": pa.array(score, pa.float64(), mask=np.isnan(score))})

    return best


def nearest(items: DataFrame, queries: DataFrame, k: int, same: bool, max_queries: int) -> DataFrame:
    """For each query (query_id, kind, v) the k items (id, kind, embedding) of its kind, or of other kinds, of greatest cosine: query_id, id, score, rank.

    Exact: every query meets every such item, as a matrix product within a task; a group gives back its k best rows for each query.
    """
    i = items.filter("kind IS NOT NULL").select(F.col("id").cast("long"), F.col("kind").cast("string"), whole_vector("embedding").alias("embedding"))
    q = queries.filter("kind IS NOT NULL").select(F.col("query_id").cast("long"), F.col("kind").cast("string"), whole_vector("v").alias("v"))
    found = met_in_blocks(i, q, "id", "query_id", max_queries).applyInArrow(best_in_block(k, same), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_elsewhere(items: DataFrame, queries: DataFrame, k: int | None = 2, id_col: str = "vec_id", group_col: str = "label", max_queries: int = 20_000) -> DataFrame:
    """For each query item the k nearest items of another group, all of them in order if k is None: query_id, id, score, rank.

    Where all ranks are wanted, queries are broadcast, block by block if there are more than max_queries, and all pairs are shuffled.
    """
    if k is not None:
        i = items.select(F.col(id_col).alias("id"), F.col(group_col).alias("kind"), "embedding")
        q = queries.select(F.col(id_col).alias("query_id"), F.col(group_col).alias("kind"), F.col("embedding").alias("v"))
        return nearest(i, q, k, False, max_queries)
    parts = [all_elsewhere(items, b, id_col, group_col) for b in hash_blocks(queries, id_col, max_queries)]
    return functools.reduce(DataFrame.unionByName, parts)


def all_elsewhere(items: DataFrame, queries: DataFrame, id_col: str, group_col: str) -> DataFrame:
    q = queries.select(F.col(id_col).alias("query_id"), F.col(group_col).alias("query_group"), F.col("embedding").alias("query_vector"))
    d = items.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), "embedding")
    near = d.join(F.broadcast(q), F.col("group") != F.col("query_group"))
    scored = near.select("query_id", "id", cosine(F.col("embedding"), F.col("query_vector")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def gold_ranks(items: DataFrame, queries: DataFrame, gold: DataFrame, id_col: str = "vec_id", max_queries: int = 20_000) -> DataFrame:
    """The ranks that a query's gold items (query_id, id) have among all items by cosine, ties by id: query_id, id, rank.

    Nothing is sorted but a query's own gold items: every item is placed between them, each task counts items by query and place, and a gold item's
    rank is the number of items up to its place. Every query meets every item, as a matrix product within a task.
    """
    q = queries.select(F.col(id_col).alias("query_id"), F.col("embedding").alias("v"))
    d = items.select(F.col(id_col).alias("id"), "embedding")
    known = gold.join(q, "query_id").join(d, "id").select("query_id", "id", cosine(F.col("embedding"), F.col("v")).alias("score")).filter("score IS NOT NULL")
    # best first: least of (-score, id)
    own = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worse"), F.col("id").alias("gold_id")))).alias("golds"))
    asked = q.join(own, "query_id").select("query_id", F.lit("").alias("kind"), whole_vector("v").alias("v"), F.col("golds.worse").alias("worse"), F.col("golds.gold_id").alias("gold_ids"))

    def places(queries: pa.Table, items: pa.Table) -> pa.Table:
        ids, query_ids, every = items.column("id").to_numpy(), queries.column("query_id").to_numpy(), np.arange(items.num_rows)
        out = []
        for row, _, score in scored_rows(queries, items, lambda _: every):
            golds, gold_ids = (queries.column(c)[row].values.to_numpy() for c in ("worse", "gold_ids"))
            has = np.flatnonzero(~np.isnan(score))
            worse = -score[has]
            place = np.searchsorted(golds, worse, "left")
            tied = np.flatnonzero(np.searchsorted(golds, worse, "right") > place)
            for value in np.unique(worse[tied]):
                a, b = np.searchsorted(golds, value, "left"), np.searchsorted(golds, value, "right")
                at = tied[worse[tied] == value]
                place[at] += np.searchsorted(gold_ids[a:b], ids[has[at]], "left")
            counts = np.bincount(place, minlength=1)
            used = np.flatnonzero(counts)
            out.append((np.full(len(used), query_ids[row]), used, counts[used]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "place", "n"), columns, strict=True)})

    ready = d.select(F.col("id").cast("long"), whole_vector("embedding").alias("embedding"))
    counts = met_in_blocks(ready, asked, "id", "query_id", max_queries).applyInArrow(places, "query_id long, place long, n long")
    counts = counts.groupBy("query_id", "place").agg(F.sum("n").alias("n"))
    each = own.select("query_id", F.posexplode("golds").alias("at", "g")).join(counts, "query_id").filter(F.col("place") <= F.col("at"))
    return each.groupBy("query_id", F.col("g.gold_id").alias("id")).agg(F.sum("n").alias("rank"))
