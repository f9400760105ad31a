"""Held-out accuracy, forward-backward against enumeration, edge cases."""

import itertools

import numpy as np

from lithic.llm import language_id as L
from lithic.llm.queries import op10_language_id


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op10_language_id(spark, d).collect()
    assert len(rows) == len(langs)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 5, 1])
    starts = np.cumsum(lengths) - lengths
    e, t, f = rng.normal(size=(9, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32)
    got = L.forward_backward(e, starts, lengths, t, f)
    for a, n in zip(starts, lengths):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(f[path[0]] + sum(e[a + i, y] for i, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += weight
        assert np.allclose(got[a : a + n], want / want.sum(1, keepdims=True), atol=1e-4)


def test_code_switched_text(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    tagger = L.fit(docs)
    en = docs.filter("lang = 'en'").orderBy("doc_id").first().text.split()[:40]
    de = docs.filter("lang = 'de'").orderBy("doc_id").first().text.split()[:60]
    row = L.predict(spark.createDataFrame([(1, " ".join(en + de))], "doc_id long, text string"), tagger, ["doc_id"]).first()
    assert row.lang_pred == "de"
    share = sum(r.words for r in row.runs if r.label == "en") / sum(r.words for r in row.runs)
    assert 0.25 < share < 0.55 and len(row.runs) < 12


def test_awkward_rows(spark, tmp_path):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "fr"), (4, "the " * 30_000, "en"), (5, "le chat", "fr"), (5, "le chat", "fr"), (6, "the dog and the cat", None), (None, "la maison", "fr"), (7, "w" * 100_000, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS runs").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr")


def test_nothing_to_learn_from(spark, tmp_path):
    spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op10_language_id(spark, str(tmp_path)).first().lang_pred == "und"


def test_long_runs_are_read_in_whole(spark):
    run = "".join(chr(0x4E00 + i) for i in range(100))
    words = L.words_of(f"a {run} b")
    assert "".join(words) == f"a{run}b" and max(map(len, words)) == L.WIDTH
    # the languages differ in the middle of a run only
    middle = {"x": "qzqzqzqzqzqzqzqzqzqzqzqz", "y": "wvwvwvwvwvwvwvwvwvwvwvwv"}
    text = lambda lang: "a" * 24 + middle[lang] + "b" * 24
    docs = spark.createDataFrame([(i, text("xy"[i % 2]), "xy"[i % 2]) for i in range(400)], "doc_id long, text string, lang string")
    rows = L.predict(docs.filter("doc_id < 20"), L.fit(docs), ["doc_id"]).collect()
    assert [r.lang_pred for r in sorted(rows, key=lambda r: r.doc_id)] == ["xy"[i % 2] for i in range(20)]
