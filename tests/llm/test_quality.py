"""Held-out accuracy, a brute-force version and edge cases of the ranking."""

import math
import re
import zlib

import numpy as np
import pytest

from lithic.llm import quality
from lithic.llm.queries import op8_quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op8_quality(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def written(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 AS score", "1 AS quality").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_awkward_tables(spark, tmp_path):
    docs = [(1, None), (1, None), (2, ""), (3, "word " * 50_000), (None, "x"), (4, "\ud7ff\n\n!!")]
    rows = op8_quality(spark, written(spark, tmp_path, docs, [(1, 1, 0), (2, None, 0), (None, 0, 0), (3, 7, 0)])).collect()
    assert len(rows) == len(docs) and all(r.score == quality.CUT and r.predicted == 1 for r in rows)


def test_empty_table(spark, tmp_path):
    assert op8_quality(spark, written(spark, tmp_path, [], [])).count() == 0


def plain_features(text):
    """The features once more, byte by byte and word by word."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = [0] * 8
    for b in raw:
        c = chr(b)
        kind = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\v\f\r" else 4 if c == "\n" else 5 if c in ".,;:'\"()-?" else 6 if b > 127 else 7
        kinds[kind] += 1
    share = [k / max(len(raw), 1) for k in kinds]
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    n, times = max(len(words), 1), {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    outer = sum(k for w, k in times.items() if not w[0].isalnum() and not w[-1].isalnum())
    odd = sum(k for w, k in times.items() if not w[-1].isalnum() and w[-1] not in ".,;:'\")?")
    return [
        *share, share[1] / max(share[0] + share[1] + share[6], 1e-6), math.log(1 + len(raw)), math.log(1 + len(words)), min(sum(len(w) for w in words) / n, 30) / 10, len(times) / n,
        math.log(1 + n) * len(times) / n, max(times.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(lines)) / max(len(lines), 1), outer / n, odd / n, float(bool(words)),
    ]


def test_against_brute_force(spark, sf_dir):
    """The weights are where the gradient of the pairs' loss is zero, the cut is the quantile, and each score follows from them."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = sorted((r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.quality is not None)
    x = np.array([plain_features(docs[i]) for i, _ in labels])
    y = np.array([q for _, q in labels])
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    ranker = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), table)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / spread, -20, 20)
    assert ranker.mean == pytest.approx(mean) and ranker.spread == pytest.approx(spread)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(7)
    n = min(40_000, 20 * max(len(good), len(bad)))
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    gradient = -(diff / (1 + np.exp(diff @ ranker.weights))[:, None]).mean(0) + 1e-3 * ranker.weights
    assert np.abs(gradient).max() < 1e-5
    worth = z @ ranker.weights
    assert (worth < ranker.cut).sum() == len(bad)
    for r in op8_quality(spark, sf_dir).collect():
        raw = float(np.clip((np.array(plain_features(docs[r.doc_id])) - mean) / spread, -20, 20) @ ranker.weights) - ranker.cut
        want = 1 / (1 + math.exp(-(min(max(raw, -30), 30) + math.log(0.7 / 0.3))))
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == (raw >= 0)
