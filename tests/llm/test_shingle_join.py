"""Links and components against all pairs on small tables."""

import random
import re

import pytest

from lithic.llm import shingle_join as J
from lithic.llm.queries import op2_shingle_join


def brute(texts):
    sets = {}
    for i, t in texts:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {("short", *w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, path, texts):
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS component_id").write.parquet(f"{path}/documents.parquet")
    rows = op2_shingle_join(spark, str(path)).collect()
    assert len(rows) == len(texts)
    want = brute(texts)
    wrong = [(r, want[r.doc_id]) for r in rows if (r.n_shingles, r.component_id) != want[r.doc_id]]
    assert not wrong, wrong[:5]


def varied(seed, count, groups):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=40)
    bases = [rng.choices(vocabulary, k=rng.choice([4, 5, 6, 9, 12, 30, 80, 150])) for _ in range(groups)]
    texts = []
    for i in range(count):
        words = list(rng.choice(bases)) if rng.random() < 0.8 else rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            if words:
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[k], rng.choice(vocabulary)]])
        if rng.random() < 0.3:
            words += passage
        text = rng.choice([" ", "\n", "  "]).join(words)
        texts.append((i * 3 % 1009, text.upper() if rng.random() < 0.1 else text))
    return texts


def test_awkward_texts(spark, tmp_path):
    five = "a b c d e"
    check(spark, tmp_path, [(9, None), (8, ""), (7, " \n"), (6, "a b"), (5, "A  B"), (4, five), (3, five + " f"), (2, "é É"), (1, "É é"), (20, "x\x1cy z"), (21, "x y z")])


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])


@pytest.mark.parametrize("seed", [1, 2])
def test_many_groups(spark, tmp_path, seed):
    check(spark, tmp_path, varied(seed, 500, 40))


def test_frequent_shingles_are_combined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "CLASSES", ((3, 1), (20, 2), (2**62, 3)))
    check(spark, tmp_path, varied(3, 400, 6))


def test_signatures_guarantee():
    """Any two linking sets share a signature, whatever the frequencies."""
    import numpy as np

    rng = random.Random(5)
    for _ in range(400):
        n = rng.choice([4, 5, 8, 20, 60, 150])
        pool = [rng.getrandbits(62) for _ in range(2 * n)]
        df = {s: rng.choice([1, 2, 2, 3, 70, 100, 500, 5000, 9000]) for s in pool}
        x = set(pool[:n])
        y = set(x)
        for _ in range(rng.randint(0, max(1, n // 8))):
            y ^= {rng.choice(pool)}
        if not y or 100 * len(x & y) < 80 * len(x | y):
            continue
        df |= {s: max(2, df[s]) for s in x & y}
        signs = []
        for s in (x, y):
            shared = sorted((df[t], t) for t in s if df[t] > 1)
            got, rest = J.signatures_of(len(s), np.array([a for a, _ in shared], np.int64), np.array([b for _, b in shared], np.int64))
            signs.append(dict(zip(got.tolist(), rest.tolist())))
        both = signs[0].keys() & signs[1].keys()
        assert both, (x, y)
        # a pair's first common signature passes the position filter
        assert any(min(signs[0][a], signs[1][a]) * 180 >= (len(x) + len(y)) * 80 for a in both)
