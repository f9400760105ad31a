"""The model against a direct computation in Python, and its sums to one."""

import math
import zlib
from collections import Counter

import pytest

from lithic.llm import katz_lm as K
from lithic.llm.common import lower_words
from lithic.llm.queries import op3_katz_lm


class Brute:
    def __init__(self, texts):
        self.uni, self.bi, self.hist = Counter(), Counter(), Counter()
        for t in texts:
            seq = ["<s>", *lower_words(t), "</s>"]
            self.uni.update(seq[1:])
            self.bi.update(zip(seq, seq[1:]))
            self.hist.update(seq[:-1])
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.d = K.discounts(Counter(self.bi.values()))
        self.kept = {b: self.d.get(r, 1.0) * r for b, r in self.bi.items()}
        self.by = {}
        for (h, w), x in self.kept.items():
            self.by.setdefault(h, {})[w] = x

    def p1(self, w):
        return (self.uni[w] + 1) / (self.n + self.v + 1)

    def p(self, w, h):
        seen = self.by.get(h, {})
        if not seen:
            return self.p1(w)
        c = self.hist[h] + (sum(seen.values()) >= self.hist[h] * (1 - 1e-9))
        if w in seen:
            return seen[w] / c
        return (1 - sum(seen.values()) / c) / (1 - sum(self.p1(v) for v in seen)) * self.p1(w)

    def score(self, t):
        seq = ["<s>", *lower_words(t), "</s>"]
        return (
            len(seq) - 1,
            sum(self.uni[w] > 0 for w in seq[1:]),
            sum(math.log10(self.p1(w)) for w in seq[1:]),
            sum(math.log10(self.p(w, h)) for h, w in zip(seq, seq[1:])),
        )


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def check(rows, docs):
    brute = Brute([t for i, t in docs if not held_out(i)])
    texts = dict(docs)
    assert len(rows) == len(docs)
    cache = {}
    for r in rows:
        want = cache.setdefault(r.doc_id, brute.score(texts[r.doc_id]))
        assert r.held_out == held_out(r.doc_id) and r.train_tokens == brute.n
        assert (r.n_tokens, r.n_known) == want[:2], r
        assert math.isclose(r.base_score, want[2], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, want[3], rel_tol=1e-9, abs_tol=1e-9), (r, want)
    return brute


@pytest.mark.parametrize("head", [(200_000, 1_000_000), (50, 3_000)])
def test_given_documents(spark, sf_dir, monkeypatch, head):
    monkeypatch.setattr(K, "HEAD_WORDS", head[0])
    monkeypatch.setattr(K, "BUCKET_TOKENS", head[1])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op3_katz_lm(spark, sf_dir).collect()
    brute = check(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    for h in ["<s>", "the", next(iter(brute.by))]:
        total = sum(brute.p(w, h) for w in brute.uni) + brute.p("never seen", h)
        assert math.isclose(total, 1, rel_tol=1e-9)


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS n").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_awkward_texts(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "A a a"), (4, "a a a a b"), (5, "b a " * 2000), (6, "é É"), (7, "x"), (8, "c d " * 6)]
    d = written(spark, tmp_path, [*docs, docs[2], docs[4], docs[4]])
    rows = op3_katz_lm(spark, d).collect()
    brute = Brute([t for i, t in [*docs, docs[2], docs[4], docs[4]] if not held_out(i)])
    assert len(rows) == 11
    for r in rows:
        want = brute.score(dict(docs)[r.doc_id])
        assert (r.n_tokens, r.n_known) == want[:2]
        assert math.isclose(r.base_score, want[2], rel_tol=1e-9) and math.isclose(r.score, want[3], rel_tol=1e-9)


def test_empty_table(spark, tmp_path):
    assert op3_katz_lm(spark, written(spark, tmp_path, [])).count() == 0


def test_bigrams_seen_once_are_scored_as_seen(spark):
    texts = ["a b c d", "a b e f", "g h", "a b c b"]
    pairs = Counter()
    for t in texts:
        seq = ["<s>", *t.split(), "</s>"]
        pairs.update(zip(seq, seq[1:]))
    once = sum(n == 1 for n in pairs.values())
    model = K.fit(K.tokenised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert once > len(pairs) / 2 and sorted(r.n for r in model.bigrams().collect()) == sorted(pairs.values())
    got = K.score(K.tokenised(spark.createDataFrame([(1, "g h")], "doc_id long, text string")), model).first()
    d, n, v = K.discounts(Counter(pairs.values())), 16 + 2, 9
    assert d[1] < 1
    # <s> g, g h and h </s> are seen once, after <s> seen four times and g and h seen once
    want = sum(math.log10(d[1] / c) for c in (4, 1, 1))
    assert model.tokens == n and model.types == v and math.isclose(got.score, want, rel_tol=1e-9)


def test_saved_model(spark, tmp_path):
    texts = ["a b c d", "a b e f", "g h", "a b c b"]
    model = K.fit(K.tokenised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    model.save(f"{tmp_path}/model")
    other = K.tokenised(spark.createDataFrame([("x", "a b g h z z"), ("y", None)], "doc_id string, text string"))
    want = sorted(K.score(other, model).collect())
    again = K.Model.load(spark, f"{tmp_path}/model")
    assert sorted(K.score(other, again).collect()) == want and [r.n_tokens for r in want] == [7, 1]


class Brute3(Brute):
    """Order three by the same step on top of order two."""

    def __init__(self, texts):
        super().__init__(texts)
        tri = Counter()
        for t in texts:
            seq = ["<s>", *lower_words(t), "</s>"]
            tri.update(zip(seq, seq[1:], seq[2:]))
        d = K.discounts(Counter(tri.values()))
        self.after = {}
        for (u, v, w), r in tri.items():
            self.after.setdefault((u, v), {})[w] = r
        self.d3 = lambda r: d.get(r, 1.0) * r

    def p3(self, w, u, v):
        seen = self.after.get((u, v))
        if not seen:
            return self.p(w, v)
        c, kept = sum(seen.values()), sum(map(self.d3, seen.values()))
        c += kept >= c * (1 - 1e-9)
        if w in seen:
            return self.d3(seen[w]) / c
        return (1 - kept / c) / (1 - sum(self.p(x, v) for x in seen)) * self.p(w, v)

    def score3(self, t):
        seq = ["<s>", *lower_words(t), "</s>"]
        return math.log10(self.p(seq[1], seq[0])) + sum(math.log10(self.p3(w, u, v)) for u, v, w in zip(seq, seq[1:], seq[2:]))


@pytest.mark.parametrize("buckets", [1_000_000, 3_000])
def test_order_three(spark, sf_dir, monkeypatch, tmp_path, buckets):
    monkeypatch.setattr(K, "BUCKET_TOKENS", buckets)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).collect()]
    docs += [(10**6 + i, t) for i, t in enumerate([None, "", "A a a", "a a a a b", "b a " * 300, "zz yy zz yy xx", "é É", "the zz of the"])]
    train = {i: t for i, t in docs if not held_out(i)}
    brute = Brute3(list(train.values()))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    tokens = K.tokenised(rows, ~rows.doc_id.isin([i for i in dict(docs) if i not in train]))
    model = K.fit(tokens, order=3)
    got = {r.doc_id: r for r in K.score(tokens, model).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        assert math.isclose(got[i].score_two, brute.score(t)[3], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(got[i].score, brute.score3(t), rel_tol=1e-8, abs_tol=1e-9), (i, got[i], brute.score3(t))
    held = [r for i, r in got.items() if i not in train]
    assert any(r.score != r.score_two for r in held)
    for u, v in [("<s>", "the"), ("a", "a"), *list(brute.after)[:3]]:
        assert math.isclose(sum(brute.p3(w, u, v) for w in brute.uni) + brute.p3("never seen", u, v), 1, rel_tol=1e-9)
    model.save(f"{tmp_path}/model")
    other = K.tokenised(rows.filter("doc_id % 3 = 0"))
    for r in K.score(other, K.Model.load(spark, f"{tmp_path}/model")).collect():
        assert math.isclose(r.score, got[r.doc_id].score, rel_tol=1e-12)


def test_op3_gives_order_three_too(spark, tmp_path):
    docs = [(1, None), (2, "a b c a b d"), (3, "a b c"), (4, "b c a b c"), (5, "b a " * 50), (7, "a b x"), (8, "c d " * 6)]
    brute = Brute3([t for i, t in docs if not held_out(i)])
    for r in op3_katz_lm(spark, written(spark, tmp_path, docs)).collect():
        assert math.isclose(r.score, brute.score(dict(docs)[r.doc_id])[3], rel_tol=1e-9)
        assert math.isclose(r.score_three, brute.score3(dict(docs)[r.doc_id]), rel_tol=1e-9)


def test_words_are_dealt_out_in_few_rows(spark, sf_dir, monkeypatch):
    """Words meet their table as lists by bucket, so rows are as many as chunks times buckets, not as words."""
    monkeypatch.setattr(K, "HEAD_WORDS", 50)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = K.tokenised(docs)
    made = K.vocabulary_of(tokens)
    words = Counter(w for r in docs.collect() for w in lower_words(r.text))
    assert made.tokens == sum(words.values()) + docs.count() and made.types == len(words) + 1
    assert made.table.count() <= made.buckets < made.types / 10
    rows = made.above(made.tokens)
    assert sorted(rows.n) == sorted([*words.values(), docs.count()]) and rows.id.is_unique and rows.w.is_unique
    n = [x for r in made.resolved(tokens).collect() for x in r.n]
    assert min(n) > 0 and max(n) == max([*words.values(), docs.count()])


def test_words_of_awkward_texts(spark):
    texts = ["", None, "  a\tB\x0bb \n", "\x1ca\x1d b c  é", "\x0c", "İ ẞ Ä ab\x85cd", " x", "x "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = K.tokenised(rows).frame.collect()
    assert [n - 1 for r in got for n in r.sizes] == [len(lower_words(t)) for t in texts]
    assert sum(len(r.words) - 1 for r in got) == len({w for t in texts for w in lower_words(t)})


def test_order_of_pairs():
    h, w = K.np.array([2**62, 5, 5, 2**62, 0]), K.np.array([1, 2**40, 7, 0, 3])
    assert K.in_order(h, w).tolist() == K.np.lexsort((w, h)).tolist()
    assert K.in_order(h[:0], w[:0]).tolist() == []
