"""The corpus pipeline: documents in, token ids of clean, distinct, uncontaminated documents out.

Each stage takes the rows its predecessor kept, with the columns of documents, and applies one operator's decisions. Rows without an
id pass the near-duplicate stage; there, rows of one id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm import decontaminate, quality, sentencepiece_codec, shingle_join
from lithic.llm.common import id_remainder, stored, table
from lithic.llm.exact_dedup import DigestIndex, unique_documents


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    ranker = quality.fit(docs, labels.filter(id_remainder(labels["doc_id"], 4) != 2))
    return docs.filter(ranker.column(F.col("text")) >= quality.CUT)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark)  # of this run alone
    kept = unique_documents(docs, index)
    index.drop(files=True)  # the verdicts are stored
    return kept


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = shingle_join.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(stored(dropped, "near-copies"), "doc_id", "left_anti").select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs).select("doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip")


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", uncontaminated),
    ("SentencePiece encoding and decoding", encoded),
]

#: The quality model, the alignments and the encoding are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, "stage")
    return docs
