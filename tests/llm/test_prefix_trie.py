"""The trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lithic.llm import prefix_trie
from lithic.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        whole = own.get(base, [])[:h] + ts[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, len(whole)))
    out = []
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(q) > len(b) and q[: len(b)] == b for q in below) for b in below)
        saved = sum((len(nodes[b]) - 1) * words(b[-1][1]) for b in below if b)
        ends = ",".join(map(str, sorted(c for c, n in members if n == len(p))))
        parent = min(c for c, _ in nodes[p[:-1]]) if p else None
        out.append((min(c for c, _ in members), len(p), str(parent), len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def check(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS seq", "3 AS words", "'x' AS key").write.parquet(f"{tmp_path}/conversations.parquet")
    got = op13_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.depth, str(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got) == brute(rows)


def conversations(n, seed, step=1):
    r = random.Random(seed)
    rows = []
    for c in range(0, n * step, step):
        length = r.choice((1, 2, 3, 4, 5, 9))
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", r.choice(("hi", "hi", "hi there  you", "", "ok\tgo"))) for t in range(length)]
    return rows


@pytest.mark.parametrize("rows,seed", [(3, 1), (7, 2), (20_000, 3)])
def test_equals_dictionary(spark, tmp_path, monkeypatch, rows, seed):
    """Few sequences in a partition, so that most nodes go on in others."""
    monkeypatch.setattr(prefix_trie, "ROWS", rows)
    check(spark, tmp_path, conversations(90, seed))


def test_nulls_ties_repeats_and_missing_heads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ROWS", 4)
    rows = conversations(30, 4, 7)
    rows += [(41, None, "user", "first"), (41, 0, None, None), (41, 0, "a", "x"), (41, 0, "a", "x"), (None, 0, "user", "lost"), (-23, 1, "user", "neg"), (-23, 2, "user", "neg b")]
    rows += [(43, k, "user", "only") for k in range(2)] + [(k, 0, "user", "x y") for k in range(61, 79)] + [(99, k, "u", "w " * 2000) for k in range(300)]
    check(spark, tmp_path, rows)


def test_large_group_of_equal_conversations(spark, tmp_path):
    check(spark, tmp_path, [(c, t, "user", f"t{t}") for c in range(0, 9000) for t in range(2)])


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])


def test_extents():
    r = np.random.default_rng(2)
    common = r.integers(0, 6, 200)
    common[0] = 0
    table = prefix_trie.sparse_table(common)
    rows, depths = r.integers(0, 200, 500), r.integers(1, 7, 500)
    left, right = prefix_trie.extents(table, rows, depths)
    for i, d, a, b in zip(rows, depths, left, right, strict=True):
        lo, hi = i, i
        while lo > 0 and common[lo] >= d:
            lo -= 1
        while hi < 199 and common[hi + 1] >= d:
            hi += 1
        assert (a, b) == (lo, hi)
