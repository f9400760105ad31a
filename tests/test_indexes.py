"""Indexes kept between queries, and retrieval over them."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.functions import text as fx
from lithic.operators import index, resolution, retrieval
from lithic.plans import queries
from lithic.plans.catalog import base_catalog

PASSAGES = "chunk_id long, document_id long, tenant_id string, content string"


def plan(df):
    """The plan with its buckets; otherwise Spark prunes them too, but doesn't say so."""
    conf, key = df.sparkSession.conf, "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    conf.set(key, "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.unset(key)


def as_rows(df):
    return [(r.id, round(r.score, 9), r.rank) for r in df.collect()]


@pytest.fixture
def passages(spark):
    r = random.Random(1)
    words = ["supply", "chain", "vendor", "audit", "invoice", "quality", "report", "part", "order", "delay"]
    rows = [(i, i // 3, "t0", " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))) for i in range(200)]
    return spark.createDataFrame([*rows, (900, 1, "t0", None), (901, 1, "t0", ""), (902, 2, "t0", rows[5][3])], PASSAGES)


def test_keyword_index_equals_a_scan(spark, passages):
    built = index.PassageIndex(spark)
    assert built.update(passages) == 203
    for query in ("audit", "supply chains", "the", "nowhere", "vendor audit order delay", ""):
        want = as_rows(retrieval.keyword_topk(passages, query, 40, "chunk_id", "content")) if fx and query else []
        assert as_rows(built.keywords(query, 40)) == want
    visible = passages.filter("document_id % 2 = 0").select("document_id").distinct()
    want = as_rows(retrieval.keyword_topk(passages.filter("document_id % 2 = 0"), "audit", 40, "chunk_id", "content"))
    assert as_rows(built.keywords("audit", 40, visible)) == want
    built.drop()


def test_words_as_they_are(spark):
    texts = ["erent inging", "erent ing ing", "Erent ING", "erents ing", "erented erent inged ing"]
    rows = spark.createDataFrame([(i, i, "t0", t) for i, t in enumerate(texts)], PASSAGES)
    built = index.PassageIndex(spark, terms=fx.plain_terms)
    built.update(rows)
    scanned = as_rows(retrieval.keyword_topk(rows, "erent ing", 40, "chunk_id", "content", fx.plain_terms))
    assert as_rows(built.keywords("erent ing", 40)) == scanned == [(1, round(7 / 12, 9), 1), (2, 0.5, 2), (4, 0.5, 3)]
    assert len(as_rows(retrieval.keyword_topk(rows, "erent ing", 40, "chunk_id", "content"))) == 5
    built.drop()


def test_keyword_queries_count_no_stems(spark, tmp_path):
    docs = [(1, "erent inging", 0), (2, "erent ing", 0), (3, "ththes inth", 0), (4, "ththe inth", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").selectExpr("*", "'en' AS lang", "'web' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("customer", "supplier", "nation", "region", "part", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("passage_keywords", "keyword_index"):
        assert [r.id for r in queries.QUERIES[name](spark, str(tmp_path)).collect()] == [200000]
    assert [r.id for r in queries.keyword_search(spark, str(tmp_path)).collect()] == [4]


def test_only_the_terms_buckets_are_read(spark, passages):
    built = index.PassageIndex(spark, buckets=16)
    built.update(passages)
    assert "SelectedBucketsCount: 1 out of 16" in plan(built.found(["audit"]))
    vectors = index.VectorIndex(spark, buckets=64).build(spark.createDataFrame([(i, "a", [float(i % 7), float(i % 5), 1.0]) for i in range(300)], "id long, kind string, embedding array<float>"), cells=12)
    assert "SelectedBucketsCount: 1 out of 64" in plan(vectors.near([1.0, 2.0, 1.0], 1))
    built.drop()
    vectors.drop()


def test_update_by_content(spark, passages):
    """After changes, removals and additions the index answers as a new one does, and nothing unchanged is done again."""
    built = index.PassageIndex(spark)
    built.update(passages)
    assert built.update(passages) == 0
    texts = built.texts.rows().count()
    assert texts == passages.select(F.coalesce("content", F.lit("")).alias("c")).distinct().count()
    later = passages.filter("chunk_id % 7 <> 0").withColumn("content", F.when(F.col("chunk_id") % 5 == 0, F.concat(F.lit("audit audit "), "content")).otherwise(F.col("content")))
    later = later.unionByName(spark.createDataFrame([(1000, 3, "t0", "audit vendor"), (1001, 3, "t0", "audit vendor")], PASSAGES))
    changed = later.join(passages, ["chunk_id", "content"], "left_anti").filter("content IS NOT NULL").count()
    assert built.update(later) == changed
    fresh = index.PassageIndex(spark)
    fresh.update(later)
    for query in ("audit", "audit vendor", "delays"):
        assert as_rows(built.keywords(query, 50)) == as_rows(fresh.keywords(query, 50)) == as_rows(retrieval.keyword_topk(later, query, 50, "chunk_id", "content"))
        assert as_rows(built.dense(query, 20)) == as_rows(fresh.dense(query, 20))
    built.drop()
    fresh.drop()


def test_hot_terms_and_cells_are_dealt_over_lists(spark, passages, monkeypatch):
    monkeypatch.setattr(index, "LIST_ROWS", 20)

    built = index.PassageIndex(spark)
    built.update(passages.limit(100))
    built.update(passages)  # lists grow
    assert max(built.shards.values()) > 3 and len(built.term_lists(["order"])) == built.shards[zlib.crc32(b"order") % index.TERM_BUCKETS] > 3
    assert as_rows(built.keywords("audit order", 40)) == as_rows(retrieval.keyword_topk(passages, "audit order", 40, "chunk_id", "content"))
    same = spark.createDataFrame([(i, "a", [1.0, 0.0]) for i in range(90)] + [(i, "a", [0.0, 1.0 + i]) for i in range(90, 99)], "id long, kind string, embedding array<float>")
    vectors = index.VectorIndex(spark).build(same, cells=3)
    assert vectors.table.rows().groupBy("list_id").count().agg(F.max("count")).first()[0] < 40
    assert [r.id for r in vectors.topk([1.0, 0.1], 5).collect()] == [0, 1, 2, 3, 4]
    built.drop()
    vectors.drop()


def clusters(spark, n=3000, dim=16):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, dim))
    rows = [(i, "ab"[i % 2], (centres[r.integers(30)] + 0.25 * r.normal(size=dim)).tolist()) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "a", None), (n + 1, "a", [0.0] * dim)], "id long, kind string, embedding array<float>")


def test_clustered_vectors_need_few_probes(spark):
    items = clusters(spark)
    built = index.VectorIndex(spark).build(items)
    assert built.probes <= len(built.centres) / 3
    queries_ = items.filter("id % 60 = 1").withColumnRenamed("id", "query_id")
    found = built.nearest(queries_, 10)
    exact = resolution.ann_block(queries_.select(F.col("query_id").alias("mention_id"), F.col("kind").alias("entity_type"), "embedding"), items.select(F.col("id").alias("entity_id"), F.col("kind").alias("entity_type"), "embedding"), 10)
    got = index.recall(found, exact.select(F.col("mention_id").alias("query_id"), F.col("entity_id").alias("id"))).first()
    assert got.queries == 50 and got.recall >= 0.9
    # all cells: the exact result
    whole = built.nearest(queries_, 10, len(built.centres))
    assert {(r.query_id, r.id) for r in whole.collect()} == {(r.mention_id, r.entity_id) for r in exact.collect()}
    v = queries_.first()
    allowed = items.filter("id % 3 = 0").select("id")
    top = built.topk(v.embedding, 10, len(built.centres), v.kind, allowed).collect()
    assert len(top) == 10 and all(r.id % 3 == 0 for r in top) and [r.rank for r in top] == list(range(1, 11))
    built.drop()


def test_postings_are_packed_and_read_back():
    sizes, ids, tfs = np.array([2, 1, 3]), np.array([5, 2**40, -7, 1, 2, 3]), np.array([1, 70_000, 3, 4, 5, 6])
    blob = index.packed_postings(["a", "é", "c"], sizes, ids, tfs)
    got = {t: (i.tolist(), f.tolist()) for t, i, f in index.unpacked_postings(blob, {"a", "c", "é", "gone"})}
    assert got == {"a": ([5, 2**40], [1, 70_000]), "é": ([-7], [3]), "c": ([1, 2, 3], [4, 5, 6])}


def test_empty_vector_index(spark):
    items = clusters(spark, 0).filter("id < 0")
    built = index.VectorIndex(spark).build(items)
    assert built.nearest(items.withColumnRenamed("id", "query_id"), 5).count() == 0 and built.topk([1.0], 5).count() == 0
    built.drop()


def test_retrieve_is_the_same_with_and_without_an_index(spark, sf_dir):
    text = lambda rows: [(r.rank, round(r.score, 9), r.chunk_id, r.content) for r in rows]
    assert text(queries.retrieve(spark, sf_dir).collect()) == text(queries.retrieve_indexed(spark, sf_dir).collect())
    g = queries.evidence_gate(spark, sf_dir)
    dense = base_catalog().execute(g, "retrieve", query="erent ing", k=5).collect()
    seen = {r.document_id for r in g.read("documents").select("document_id").collect()}
    assert len(dense) == 5 and all(r.document_id in seen for r in dense)


def test_known_embeddings_are_taken_over(spark, passages):
    known = passages.filter("chunk_id < 100").select(fx.content_hash(F.coalesce("content", F.lit(""))).alias("content_hash"), F.array(F.lit(9.0).cast("float")).alias("embedding")).dropDuplicates(["content_hash"])
    rows = retrieval.embedded(passages, known).collect()
    assert len(rows) == 203 and all((len(r.embedding) == 1) == (r.chunk_id < 100 or r.chunk_id == 902 or r.content in {x.content for x in rows if x.chunk_id < 100}) for r in rows)


def test_terms_of_a_passage_are_made_once_and_kept_in_place_of_its_text(spark, monkeypatch):
    """Vectors and postings come from the same terms; what an update writes for both holds no texts."""
    made, kept = [], []
    monkeypatch.setattr(index, "search_terms", lambda c: made.append(c) or fx.search_terms(c))
    monkeypatch.setattr(index, "stored", lambda df, label, real=index.stored: kept.append((label, real(df, label))) or kept[-1][1])
    monkeypatch.setattr(index, "discard", lambda *frames: None)
    texts = ["The Audits, of delaying", "", None, "the of", "  delayed-AUDIT  É 12s 1234s", "classes being seeds s"]
    rows = spark.createDataFrame([(i, i, "t0", t) for i, t in enumerate(texts)], PASSAGES)
    built = index.PassageIndex(spark, terms=index.search_terms)
    assert built.update(rows) == len(texts) and len(made) == 1
    got = {r.chunk_id: r.content for r in dict(kept)["passages-new"].collect()}
    assert got == {0: "audit delay", 1: "", 2: "", 3: "", 4: "delay audit 12s 1234", 5: "class be seed s"}
    want = rows.select("chunk_id", fx.search_terms(F.coalesce("content", F.lit(""))).alias("terms"))
    vectors = {r.id: list(r.embedding) for r in built.vectors().collect()}
    assert vectors == {r.chunk_id: list(r.v) for r in want.select("chunk_id", index.hashed_embedding(F.col("terms")).alias("v")).collect()}
    assert as_rows(built.keywords("audit delay", 9)) == as_rows(retrieval.keyword_topk(rows, "audit delay", 9, "chunk_id", "content"))
    built.drop()


def test_search_terms_cut_the_longest_ending(spark):
    words = "bing being beings sings classes ringed eds ass asss thes inging seeds s 12es 1234s xxeses sssss passes".split()
    got = spark.range(1).select(fx.search_terms(F.lit(" ".join(words))).alias("t")).first().t
    assert got == [re.sub("(?:ing|ed|es|s)$", "", w) if len(w) > 4 else w for w in words]
