"""Repeated passages against a table of all windows."""

import hashlib
import random

import numpy as np
import pytest

from lithic.llm import substring_dedup
from lithic.llm.queries import op11_substring_dedup

SCHEMA = "doc_id long, text string"


def brute(rows):
    first, words = {}, {}
    for i, t in sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        ws = (t or "").encode().split()
        words[i, t] = ws
        for s in range(len(ws) - 19):
            first.setdefault(tuple(ws[s : s + 20]), (i, t, s))
    out = []
    for i, t in rows:
        ws = words[i, t]
        gone = {p for s in range(len(ws) - 19) if first[tuple(ws[s : s + 20])] != (i, t, s) for p in range(s, s + 20)}
        kept = b" ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((str(i), len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS doc", "2 AS part", "3 AS start", "'x' AS anchor", "4 AS n").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_substring_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect())
    want = brute(rows)
    assert got == want
    return want


def corpus(n, seed, vocabulary=400):
    """Texts put together from shared passages of all lengths around a window, and words between."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    passages = [[word() for _ in range(r.choice((5, 15, 19, 20, 21, 25, 33, 60, 150)))] for _ in range(25)]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(r.randrange(6)):
            ws += r.choice(passages) if r.random() < 0.6 else [word() for _ in range(r.randrange(30))]
            if r.random() < 0.2:
                ws = ws[: -r.randrange(1, 5)]
        rows.append((i * 3, r.choice((" ", "\n", " \t ", "\x0b")).join(ws)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_windows(spark, tmp_path, seed):
    want = check(spark, tmp_path, corpus(150, seed))
    assert sum(w[2] for w in want) > 1000


def test_nulls_repeats_and_periods(spark, tmp_path):
    r = random.Random(3)
    base = " ".join(f"p{r.randrange(10**6)}" for _ in range(40))
    rows = [
        (1, None), (2, ""), (3, "  \n "), (4, "a " * 300), (5, "a " * 19), (6, "a " * 20), (7, "a b " * 50), (8, "a b c " * 40), (9, base), (10, base), (11, base.upper()),
        (12, "é x " * 30), (13, base.replace(" ", "\x1c")), (14, "x" * 200_000), (15, f"{base} {base}"), (-5, base[:150]), (None, base), (10, base), (16, base.split(" ", 5)[5] + " end"),
        (17, "a\x00b " * 25), (17, "other " * 21),
    ]
    check(spark, tmp_path, rows)


def test_passage_with_many_surroundings(spark, tmp_path, monkeypatch):
    """More distinct pieces of an anchor than a block may hold."""
    monkeypatch.setattr(substring_dedup, "MOST", 8)
    r = random.Random(4)
    passage = [f"q{k}" for k in range(30)]
    rows = [(i, " ".join([f"l{r.randrange(3 if i % 4 else 10**6)}" for _ in range(15)] + passage + [f"r{r.randrange(3 if i % 4 else 10**6)}" for _ in range(15)])) for i in range(120)]
    check(spark, tmp_path, rows)


def test_very_long_text(spark, tmp_path):
    r = random.Random(5)
    ws = [f"v{r.randrange(5000)}" for _ in range(60_000)]
    check(spark, tmp_path, [(1, " ".join(ws)), (2, " ".join(ws[1000:1400] + ["new"] + ws[30_000:50_000])), (3, " ".join(ws[::-1]))])


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])


@pytest.mark.parametrize("seed", range(4))
def test_parsing_shows_all_repeated_windows(seed):
    r = random.Random(seed)
    source = [r.randrange(4 + 40 * seed) for _ in range(300)]
    pieces = []
    for _ in range(60):
        a = r.randrange(260)
        p = source[a : a + r.randrange(20, 33)]
        if r.random() < 0.4:
            p[r.randrange(len(p))] = 1000 + r.randrange(3)
        pieces.append(p)
    starts = np.cumsum([0, *map(len, pieces[:-1])])
    factors, repeated = substring_dedup.parsed(np.array([x for p in pieces for x in p]), starts)
    seen, want = set(), set()
    for s, p in zip(starts, pieces, strict=True):
        for k in range(len(p) - 19):
            w = tuple(p[k : k + 20])
            if w in seen:
                want.add(int(s) + k)
            seen.add(w)
    assert set(repeated.tolist()) == want
    # factors tile the pieces
    assert factors[:, 2].sum() == sum(map(len, pieces)) and len({(p, a) for p, a, _ in factors.tolist()}) == len(factors)
