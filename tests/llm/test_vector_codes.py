"""Vector codes against a brute force over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.llm import vector_codes
from lithic.llm.queries import op12_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    dim = None
    kept = []
    for i, v, label in sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        dim = dim or len(v)
        if len(v) == dim:
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    w = dim // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((square(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        mine = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p in range(parts):
                mine[p][near(v, p)[1]].append(cut(v, p))
        books = [[[sum(x) // len(m) for x in zip(*m, strict=True)] if m else e for m, e in zip(ms, b, strict=True)] for ms, b in zip(mine, books, strict=True)]
    out, by_label = [], {}
    for i, v, label in kept:
        got = [near(v, p) for p in range(parts)]
        error = sum(d for d, _ in got)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in got), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, by_label[label]) for i, c, e, label in out), digest


def vectors(n, dim, seed, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.choice((-0.5, 0.0, 0.25, r.uniform(-spread, spread))) for _ in range(dim)], r.choice((None, 1, 2, 2, 2))) for i in range(n)]


def check(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "1 AS error", "2 AS id", "3 AS v").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_vector_codes(spark, str(tmp_path)).collect()
    want, digest = brute(rows)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} <= {digest}


@pytest.mark.parametrize("n,dim", [(150, 32), (20, 16), (90, 128)])
def test_equals_brute_force(spark, tmp_path, n, dim):
    check(spark, tmp_path, vectors(n, dim, n))


def test_ties_nulls_and_repeated_rows(spark, tmp_path):
    rows = vectors(80, 32, 5)
    rows += [(3, rows[3][1], 1), (3, rows[3][1], 1), (None, rows[4][1], None), (7, rows[9][1], 2)]
    rows += [(200, None, 1), (201, [float("nan")] + [0.0] * 31, 1), (202, [None] + [0.0] * 31, 1), (203, [float("inf")] * 32, 1), (204, [], 1), (205, [0.5] * 16, 1), (-3, [float("-inf")] * 32, 1)]
    check(spark, tmp_path, rows)


def test_components_beyond_64_bits(spark, tmp_path):
    rows = vectors(70, 32, 6, 2e6) + [(500, [3e30] * 32, 1), (501, [-3e30] * 32, 9), (502, [1e30] * 32, 1), (503, [2.5e30] * 32, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in op12_vector_codes(spark, str(tmp_path)).collect()}
    want, digest = brute(rows)
    assert {i: (r.code, r.error) for i, r in got.items()} == {int(i): (c, e if e < 2**63 else None) for i, c, e, _ in want}
    assert got[500].codebooks_sha256 == digest and got[500].label_error is None and any(r.error is None for r in got.values())
    assert {i: r.label_error for i, r in got.items()} == {int(i): t if t < 2**63 else None for i, _, _, t in want}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = op12_vector_codes(spark, str(tmp_path))
    assert df.count() == 0 and df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_search_stops_only_beyond_the_bound():
    r = np.random.default_rng(1)
    points, entries = r.integers(-9, 9, (400, 3)), r.integers(-9, 9, (64, 3))
    index, best = vector_codes.equal_average(points, entries)
    d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (index == d.argmin(axis=1)).all()


def test_decoded_parts_are_entries(spark):
    df = spark.createDataFrame(vectors(70, 32, 8), SCHEMA)
    codes, books = vector_codes.compress(df)
    rows = vector_codes.decoded(codes.withColumnRenamed("id", "vec_id"), books).join(df.select("vec_id", "embedding"), "vec_id").collect()
    for r in rows:
        off = sum((math.floor(256 * x) - round(256 * y)) ** 2 for x, y in zip(r.embedding, r.decoded, strict=True))
        assert off == r.error
    with pytest.raises(ValueError):
        vector_codes.compress(df.withColumn("embedding", F.slice("embedding", 1, 7)))
