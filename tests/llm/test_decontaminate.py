"""Leaks against a dynamic program over all pairs, planted edits included."""

import random

from lithic.llm import decontaminate as D


def distance(item, text):
    """Least edits of the item against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for r, c in enumerate(item, 1):
        new = [r]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def budget(n, rate=0.1):
    return min(int(n * rate), (n - D.Q) // D.Q)


def planted():
    rng = random.Random(8)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 6, 12, 30])))) for i in range(12)]
    texts = []
    for k in range(70):
        body = list(" ".join(rng.choices(words, k=rng.randint(0, 40))))
        if rng.random() < 0.7:
            leak = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 1, 3, 6, 12])):
                p = rng.randrange(len(leak))
                leak[p : p + 1] = rng.choice([[], ["z"], [leak[p], "q"]])
            at = rng.randint(0, len(body))
            body[at:at] = leak
        text = "".join(body)
        texts.append((k, text.upper() if k % 5 == 0 else text.replace(" ", " \n") if k % 7 == 0 else text))
    return items, texts


def test_against_all_pairs(spark):
    items, texts = planted()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = D.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in found}
    want = {}
    for i, item in items:
        n = D.normal(item)
        for k, text in texts:
            if len(n) >= D.Q and (e := distance(n, D.normal(text))) <= budget(len(n)):
                want[k, i] = e
    assert got == want and len(want) > 20
    clean = D.without_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in clean} == {k for k, _ in texts} - {k for k, _ in want}


def test_blocks_of_items(spark):
    items, texts = planted()
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.item_id, r.edits) for r in rows.collect())
    assert key(D.find_leaks(docs, benchmark, block_chars=150)) == key(D.find_leaks(docs, benchmark))


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a benchmark passage"), (3, "a benchmark passage"), (None, "A  BENCHMARK\npassage!"), (4, "ab " * 100_000)], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS edits")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "a benchmark passage"), (4, "a benchmark passage"), (None, "a benchmark passage")], "item_id long, text string")
    found = D.find_leaks(docs, items).collect()
    assert sorted(str(r.doc_id) for r in found) == ["3", "3", "None"] and {r.item_id for r in found} == {4}
    kept = D.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert D.find_leaks(docs, items.limit(0)).count() == 0 and D.find_leaks(docs.limit(0), items).count() == 0


def test_repetitive_texts_in_bounded_slices(monkeypatch):
    items = [(1, "word " * 240), (2, "ab" * 300), (3, " ".join(f"w{i}" for i in range(200)))]
    texts = ["word " * 8_000, "ab" * 9_000, "wort " * 3_000, " ".join(f"w{i}" for i in range(5, 230)), "w0 w1 w2"]
    index = D.ItemIndex(items, 0.1)
    want = D.hits_in(index, texts)
    assert {(d, i) for d, i, *_ in want} == {(0, 1), (1, 2), (3, 3)}
    monkeypatch.setattr(D, "MOST_HITS", 4_000)
    assert D.hits_in(index, texts) == want


def test_memory_of_a_repeated_word():
    import tracemalloc

    index = D.ItemIndex([(1, "word " * 240)], 0.1)
    tracemalloc.start()
    found = D.hits_in(index, ["word " * 200_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(f[0], f[1], f[2]) for f in found] == [(0, 1, 0)] and peak < 400e6, peak


def test_short_items_and_nul(spark):
    docs = spark.createDataFrame([(1, "Yes"), (2, "yes sir"), (3, "a benchmark\0passage"), (4, " YES \n")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "a\0benchmark passage")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()) == [(1, 1), (3, 2), (4, 1)]
    assert [r.doc_id for r in D.without_leaks(docs, items).collect()] == [2]
