"""Exact duplicates and the persistent index."""

import hashlib

import pytest

from lithic.llm.common import shared_dir
from lithic.llm.exact_dedup import DigestIndex, deduplicate, unique_documents
from lithic.llm.queries import op6_exact_dedup

ROWS = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (8, "X" * 300_000), (None, "n")]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS digest", "1 AS keep_id", "true AS kept")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_verdicts(spark, tmp_path):
    documents(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op6_exact_dedup(spark, str(tmp_path)).collect()
    assert len(rows) == len(ROWS)
    want = {}
    for i, t in ROWS:
        want.setdefault(lower(t), []).append(i)
    texts = dict(ROWS)
    for r in rows:
        group = want[lower(texts[r.doc_id])]
        assert r.group_size == len(group) and r.kept == (r.doc_id == r.keep_id)
        assert r.keep_id == max(group, key=lambda i: -1 if i is None else i)
        assert r.text_sha256 == hashlib.sha256(lower(texts[r.doc_id]).encode()).hexdigest()


def test_index_persists(spark):
    path = shared_dir(spark, "index")
    first = DigestIndex(spark, path, 4)
    assert deduplicate(documents(spark, ROWS), first).filter("kept").count() == 7
    first.drop()
    again = DigestIndex(spark, path, 4)
    second = deduplicate(documents(spark, [(90, "a b"), (91, "new"), (92, "NEW")]), again).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in second} == {(90, 2, False), (91, 92, False), (92, 92, True)}
    assert again.rows().count() == 7


def test_unique_documents_keep_columns(spark):
    docs = documents(spark, ROWS)
    rows = unique_documents(docs, DigestIndex(spark))
    assert rows.columns == docs.columns
    assert sorted(str(r.doc_id) for r in rows.collect()) == sorted(["2", "4", "5", "6", "8", "None"])


def test_empty_table(spark):
    assert deduplicate(documents(spark, []), DigestIndex(spark)).count() == 0


def many(spark, n=200):
    return spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text")


def test_bucket_count_is_kept(spark):
    path = shared_dir(spark, "index")
    first = DigestIndex(spark, path, 4)
    assert deduplicate(many(spark), first).filter("kept").count() == 200
    with pytest.raises(ValueError, match="4 buckets"):
        DigestIndex(spark, path, 8)
    again = DigestIndex(spark, path)
    assert again.buckets == 4
    assert deduplicate(many(spark), again).filter("kept").count() == 0 and again.rows().count() == 200


def test_batch_run_again(spark):
    index = DigestIndex(spark)
    assert deduplicate(many(spark, 50), index, batch="monday").filter("kept").count() == 50
    assert deduplicate(many(spark, 50), index, batch="monday").filter("kept").count() == 50
    assert deduplicate(many(spark, 60), index, batch="tuesday").filter("kept").count() == 10
    assert index.rows().count() == 60


def test_null_ids_are_known(spark):
    index = DigestIndex(spark)
    rows = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert unique_documents(rows, index).count() == 1
    again = deduplicate(spark.createDataFrame([(None, "A"), (7, "a")], "doc_id long, text string"), index).collect()
    assert [(r.keep_id, r.kept) for r in again] == [(None, False)] * 2 and index.rows().count() == 1


def test_compacted(spark):
    index = DigestIndex(spark, buckets=3)
    for k in range(4):
        deduplicate(many(spark, 50 * (k + 1)), index)
    new = index.compacted(shared_dir(spark, "index"))
    assert new.buckets == 3 and len(new.rows().inputFiles()) == 3 < len(index.rows().inputFiles())
    assert deduplicate(many(spark), new).filter("kept").count() == 0
    index.drop(files=True)
