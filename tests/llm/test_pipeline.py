"""The pipeline against its stages done one by one in Python."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lithic.llm import decontaminate as D  # noqa: E402
from lithic.llm import quality  # noqa: E402
from tests.llm.test_shingle_join import brute  # noqa: E402


def test_against_brute_force(spark, sf_dir):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.good_documents(spark, docs, sf_dir)
    assert kept.columns == columns
    good = [(r.doc_id, r.text) for r in kept.collect()]
    last = {}
    for i, t in good:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        last[low] = max(last.get(low, -1), i)
    distinct = [(i, t) for i, t in good if i in set(last.values())]
    groups = brute(distinct)
    singles = [(i, t) for i, t in distinct if groups[i][1] == i]
    items = [D.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i: t for i, t in singles if not any(x in D.normal(t) for x in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.sentencepiece_codec.DEFAULT_MODEL)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(clean)
    assert all(r.token_ids == library.encode(clean[r.doc_id]) for r in rows)


def test_stages_keep_columns_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.columns == docs.columns and out.count() == 0


def awkward(spark, sf_dir):
    """Given documents with null and repeated rows, ties, a long text and columns whose names the operators use inside."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    good = docs.filter("n_chars BETWEEN 300 AND 2000").orderBy("doc_id").first()
    rows = [(None, good.text, "en", "s", 1), (None, None, None, None, None), (70_001, None, "en", "s", 0), (70_002, "", None, "s", 0), (70_003, good.text, "en", None, 1), (70_003, good.text, "en", None, 1),
            (70_004, good.text + " one more word", "en", "s", 1), (70_005, "word " * 60_000, "en", "s", 1), (70_006, "".join(c.upper() if "a" <= c <= "z" else c for c in good.text), "en", "s", 1)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).unionByName(more)
    return both.selectExpr("*", "1 AS component_id", "'a' AS digest", "2 AS keep_id", "true AS kept", "3 AS edits", "'b' AS quality", "4 AS score", "5 AS item_id", "6 AS set_id", "7 AS n_tokens", "8 AS words")


def test_awkward_rows_in_every_stage(spark, sf_dir):
    docs = awkward(spark, sf_dir)
    columns, total = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        kept[name] = [r.doc_id for r in rows]
        assert len(rows) <= total
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        else:
            # no row is lost, a null text has no tokens
            assert len(rows) == total and {r.n_tokens for r in rows if r.doc_id in (70_001, 70_002)} == {0}
    # a row of each group of equal texts stays, the largest id of it; 70003 is there twice
    assert [i for i in kept["exact dedup"] if i in (70_003, 70_006)] == [70_006] and kept["exact dedup"].count(70_002) == 1 and 70_001 not in kept["exact dedup"]
    # near copies leave the least id, rows without an id and empty ones stay
    near = kept["n-gram Jaccard join"]
    assert not {70_003, 70_004, 70_006} & set(near) and near.count(None) == 2 and {70_001, 70_002, 70_005} <= set(near)
    assert {None, 70_001, 70_002, 70_005} <= set(kept["benchmark decontamination"])


def test_quality_cut():
    assert quality.CUT == 0.7
