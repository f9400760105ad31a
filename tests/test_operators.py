"""Behaviours of single operators."""

import difflib
import random
import re
import time
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lithic.functions import text as fx
from lithic.functions import registry
from lithic.functions.vector import cosine, hashed_embedding
from lithic.operators import evaluation, extraction, facts, ingest, promotion, resolution, retrieval
from lithic.operators.gate import Gate, Param, Principal, TemplateError, check_template, coerced
from lithic.plans.catalog import Composite, Step, UnknownOperation, base_catalog
from lithic.plans.queries import QUERIES, evidence_gate, gate
from lithic.plans.relations import relation

AT = datetime(2024, 1, 1)


def test_gate_never_leaks(spark, sf_dir):
    hidden = {r.entity_id for r in relation(spark, sf_dir, "entities").filter("label = 'restricted' OR tenant_id <> 't0'").collect()}
    rows = facts.fact_rows(gate(spark, sf_dir)).select("subject_id", "object_id").collect()
    assert rows and not any(r.subject_id in hidden or r.object_id in hidden for r in rows)


def test_more_hops_find_no_less(spark, sf_dir):
    ids = [{r.fact_id for r in facts.neighbors(gate(spark, sf_dir), 1_000_000_007, depth=k).collect()} for k in (1, 2, 3)]
    assert ids[0] < ids[1] <= ids[2]


def test_template_hygiene():
    check_template("SELECT f.fact_id FROM facts f WHERE {sec:f} AND {cur:f}", {"least"})
    for bad, params in [
        ("SELECT f.a FROM facts f WHERE {sec:f}", set()), ("SELECT f.a FROM facts f WHERE {cur:f}", set()), ("DELETE FROM facts f WHERE {sec:f}", set()),
        ("SELECT 1; SELECT f.a FROM facts f WHERE {sec:f} AND {cur:f}", set()), ("SELECT f.a FROM facts f WHERE {sec:f} AND {cur:f}", {"tenant"}),
        ("SELECT f.a FROM facts f JOIN entities e ON TRUE WHERE {sec:f} AND {cur:f}", set()),
    ]:
        with pytest.raises(TemplateError):
            check_template(bad, params)


def test_params_fail_closed():
    assert coerced("k", Param("long", least=1, most=5, default=1), "3") == 3
    assert coerced("k", Param("long", default=1), None) == 1
    for p, v in [(Param("long", True), None), (Param("long", most=5), 6), (Param("string", choices=("a",)), "b"), (Param("boolean"), "yes"), (Param("long"), True)]:
        with pytest.raises(ValueError):
            coerced("k", p, v)


def test_catalog_scope_and_closure(spark, sf_dir):
    c = base_catalog()
    with pytest.raises(UnknownOperation):
        c.execute(gate(spark, sf_dir), "no_such")
    with pytest.raises(UnknownOperation):
        c.register(Composite("x", (Step("a", "missing", {}),), {}))
    with pytest.raises(ValueError):
        c.execute(gate(spark, sf_dir), "neighbors", entity_id=1, depth=9)
    assert c.execute(evidence_gate(spark, sf_dir), "entity_dossier", identifier="nobody").keys() == {"resolve"}
    assert c.execute(evidence_gate(spark, sf_dir), "entity_dossier", identifier="Customer#000000007", key="no such").keys() == {"resolve"}
    assert c.execute(evidence_gate(spark, sf_dir), "entity_dossier", identifier="Customer#000000007", key="customer_id").keys() == {"resolve", "facts", "evidence"}


def test_composites_are_traced(spark, sf_dir):
    g, c = evidence_gate(spark, sf_dir), base_catalog()
    results, trace = c.traced(g, "entity_dossier", identifier="nobody")
    assert [(t.step, t.status) for t in trace] == [("resolve", "ok"), ("facts", "skipped"), ("evidence", "skipped")] and results.keys() == {"resolve"}
    c.register(Composite("outer", (Step("a", "entity_dossier", {"identifier": "nobody"}), Step("b", "get_entity", {"identifier": "nobody"}, fallback="get_by_key")), {}))
    assert [(t.step, t.operation, t.status) for t in c.traced(g, "outer")[1]][-2:] == [("a", "entity_dossier", "ok"), ("b", "get_by_key", "fallback")]


def test_walk_reads_the_edges_once_a_hop(spark, sf_dir):
    plan = lambda k: facts.neighbors(gate(spark, sf_dir), 1_000_000_007, depth=k)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(4).count("o_orderkey") == plan(1).count("o_orderkey")


def test_retrieval_is_gated(spark, sf_dir):
    g = evidence_gate(spark, sf_dir)
    seen = {r.document_id for r in g.read("documents").collect()}
    rows = base_catalog().execute(g, "retrieve", query="erent ing the tion of and", k=50).collect()
    assert len(rows) == 50 and {r.document_id for r in rows} <= seen and [r.rank for r in rows] == list(range(1, 51))
    # a passage's own text finds it
    one = base_catalog().execute(g, "passage", chunk_id=rows[7].chunk_id).first()
    assert base_catalog().execute(g, "retrieve", query=one.content, k=3).first().score == pytest.approx(1)
    hidden = relation(spark, sf_dir, "sourced").filter("label = 'restricted'").first().document_id
    assert base_catalog().execute(g, "passage", chunk_id=hidden * 100000).isEmpty()


def test_trigram_similarity(spark):
    row = spark.range(1).select(fx.trigram_similarity(F.lit("word"), F.lit("two words")).alias("x"), fx.trigram_similarity(F.lit(""), F.lit("")).alias("e"), fx.token_jaccard(F.lit("A b"), F.lit("b c")).alias("j")).first()
    assert round(row.x, 6) == round(4 / 11, 6) and row.e == 0 and round(row.j, 4) == 0.3333


def test_name_ratio_is_difflib(spark):
    names = [("Acme Corp", "acme corp "), ("a" * 250, "a" * 240 + "b"), ("", "x"), (None, "x")]
    for r in spark.createDataFrame(names, "a string, b string").select("a", "b", fx.name_ratio("a", "b").alias("x")).collect():
        want = None if r.a is None else difflib.SequenceMatcher(None, r.a.casefold().strip(), r.b.casefold().strip()).ratio()
        assert r.x == want


def test_predicates(spark):
    got = spark.createDataFrame([(" Owned-By ",), ("part of",), ("eats",)], "p string").select(*[c.alias(n) for c, n in zip(fx.normalised_predicate(F.col("p")), ("name", "swap"))]).collect()
    assert [(r.name, r.swap) for r in got] == [("owns", True), ("part_of", False), (None, False)]


def test_find_span(spark):
    want = {
        ("b c", "a b c"): (2, 5), ("B  C", "a b\n c!"): (2, 6), ("x", "abc"): None, (" ", "a b"): None, ("a.c", "abc A.C"): (4, 7), ("\\E x", "q \\e\tX"): (2, 6),
        ("ÉTÉ x", "\U0001f600 été\u00a0 X"): (2, 8), (None, "a"): None, ("a", None): None, ("aa", "baaa"): (1, 3),
    }
    rows = spark.createDataFrame(list(want), "n string, t string").select("n", "t", fx.find_span("n", "t").alias("s")).collect()
    assert {(r.n, r.t): r.s and tuple(r.s) for r in rows} == want


def test_sections_and_passages():
    text = "intro\n# A\none two\n## B\nthree\n# C\nfour five six"
    assert [(text[a:b].split("\n")[0], n) for a, b, n in ingest.sections(text)] == [("intro", ""), ("# A", "A"), ("# C", "C")]
    # six headings of levels 1, 1, 2, 4, 4, 4: level 4 is the most frequent, so all up to level 3 are cut at
    deep = "# a\nx\n# b\nx\n## c\nx\n#### d\nx\n#### e\nx\n#### f\nx"
    assert [n for _, _, n in ingest.sections(deep)] == ["a", "b", "b / c"]
    assert ingest.sections("#### a\nx\n#### b") == [(0, 15, "")] and ingest.sections("x") == [(0, 1, "")] and ingest.sections("") == []
    spans = list(ingest.passages(0, "a b c d e f g", 4, 0.25))
    assert spans[0] == (0, 7) and spans[1][0] == 6 and spans[-1][1] == 13


def test_chunks_nest_and_rebuild(spark, sf_dir):
    docs = relation(spark, sf_dir, "documents").limit(40)
    chunks = ingest.chunked(docs, 50, 200).cache()
    outside = chunks.alias("c").filter("level = 'child'").join(chunks.alias("p").filter("level = 'parent'"), (F.col("c.doc_id") == F.col("p.doc_id")) & (F.col("c.parent_seq") == F.col("p.seq")))
    assert outside.filter("c.start < p.start OR c.end > p.end").count() == 0
    rebuilt = ingest.rebuilt_text(chunks).join(docs.select("doc_id", F.col("text").alias("original")), "doc_id")
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    assert rebuilt.filter(squeezed("text") != squeezed("original")).count() == 0


def test_spans_find_their_chunk(spark, sf_dir):
    docs = relation(spark, sf_dir, "documents").limit(30)
    chunks = ingest.chunked(docs, 40, 90).cache()
    spans = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2000), F.lit(130))).alias("start")).select((F.col("doc_id") * 10000 + F.col("start")).alias("span_id"), "doc_id", "start", (F.col("start") + 25).alias("end"))
    parents = [r for r in chunks.filter("level = 'parent'").collect()]
    want = {}
    for s in spans.collect():
        inside = [p.seq for p in parents if p.doc_id == s.doc_id and p.start <= s.start and s.end <= p.end]
        want[s.span_id] = min(inside, default=None)
    assert {r.span_id: r.chunk_seq for r in extraction.containing_chunk(spans, chunks).collect()} == want
    counted = {r.doc_id: r.parents for r in ingest.chunk_counts(chunks).collect()}
    assert all(counted[d] == sum(p.doc_id == d for p in parents) for d in counted)


def test_land_replays_nothing(spark, sf_dir):
    raw = relation(spark, sf_dir, "raw")
    landed = ingest.land(raw)
    assert ingest.land(raw, landed).count() == 0


def test_insert_and_upsert(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, t int, v string")
    new = spark.createDataFrame([(2, 4, "late"), (3, 1, "c"), (3, 2, "d")], "k int, t int, v string")
    assert sorted(map(tuple, ingest.insert_ignoring(old, new, ["k"]).collect())) == [(3, 1, "c")]
    assert sorted(map(tuple, ingest.upsert(old, new, ["k"], "t").collect())) == [(1, 1, "a"), (2, 5, "b"), (3, 2, "d")]


def test_effective_config(spark):
    row = spark.range(1).select(ingest.effective_config(F.expr("map('a','1','b','2')"), F.expr("map('b','9','c',cast(null as string))")).alias("m")).first()
    assert row.m == {"a": "1", "b": "9"}


def test_mapping_is_quarantined_once(spark):
    rows = spark.createDataFrame([(1, "A", "x"), (2, "B", " ")], "id int, name string, note string")
    found, bad = extraction.mapped_facts(rows, "name", {"note": ("mentions", None), "gone": ("owns", None), "name": ("eats", None)}, "Organization", "id")
    assert [(r.subject, r.literal) for r in found.collect()] == [("A", "x")]
    assert sorted(map(tuple, bad.collect())) == [("gone", "validation_failure"), ("name", "unbound_predicate")]


def test_conformance_order(spark):
    rows = [("A", "Organization", "owned_by", "B", None), ("A", "Alien", "owns", "B", None), ("A", "Organization", "eats", "B", None), ("A", "Organization", "owns", "a", None), ("", "Alien", "eats", "B", None)]
    df = spark.createDataFrame(rows, "subject string, subject_type string, predicate string, object string, literal string")
    got = extraction.conformed(df, ["Organization"], fx.PREDICATES).collect()
    assert [r.reason for r in got] == [None, "unbound_entity_type", "unbound_predicate", "validation_failure", "validation_failure"]
    assert (got[0].subject, got[0].predicate, got[0].object) == ("B", "owns", "A")


def test_grounding(spark):
    rows = [("quick fox", "fox", None, "the quick  Fox", None, None), ("quick fox", "dog", None, "the quick fox", None, None), ("zzz", "z", None, "the", None, None), ("quick", "q", None, "the quick fox", 4, 9), ("slow", "q", None, "the quick fox", 4, 9), ("x", "x", None, None, None, None)]
    df = spark.createDataFrame(rows, "quote string, subject string, object string, text string, declared_start int, declared_end int").withColumn("confidence", F.lit(0.8))
    got = extraction.grounded(df).collect()
    assert [r.grounding for r in got] == ["pass", "components_missing", "span_missing", "declared_span", "span_mismatch", "construction"]
    assert [r.confidence for r in got] == [0.8, 0.4, 0.4, 0.8, 0.4, 0.8] and (got[0].span_start, got[0].span_end) == (4, 14)


def test_blocks_union_and_cap(spark):
    key = spark.createDataFrame([(1, 10)], "mention_id int, entity_id int")
    ann = spark.createDataFrame([(1, 10, 0.1), (1, 11, -0.5), (1, 12, 0.9)], "mention_id int, entity_id int, cosine double")
    name = spark.createDataFrame([(1, 13), (1, 12)], "mention_id int, entity_id int")
    got = {r.entity_id: r.blocks for r in resolution.blocked(key, ann, name, 3).collect()}
    assert got == {10: ["key", "ann"], 12: ["ann", "name"], 13: ["name"]}


def test_new_entities_get_ids_in_order(spark):
    m = spark.createDataFrame([(i, "pending", None) for i in range(50)], "mention_id long, status string, resolved_entity_id long")
    d = m.select("mention_id", F.lit(7).cast("long").alias("entity_id"), F.when(F.col("mention_id") % 2 == 0, "new_entity").otherwise("resolved").alias("decision"))
    got = {r.mention_id: r.resolved_entity_id for r in resolution.applied(m, d, 1000).collect()}
    assert [got[i] for i in range(0, 50, 2)] == list(range(1000, 1025)) and got[1] == 7


def test_merge_and_reverse(spark, sf_dir):
    e, f, m = (relation(spark, sf_dir, n) for n in ("entities", "facts", "mentions"))
    merges = spark.createDataFrame([(1_000_000_002, 1_000_000_003)], "merged_id long, survivor_id long")
    e2, f2, m2, snap = resolution.merged(e, f, m, merges)
    assert e2.count() == e.count() - 1 and f2.filter("subject_id = 1000000002").count() == 0
    e3, f3, m3, labels = resolution.unmerged(e2, f2, m2, snap)
    assert e3.exceptAll(e).count() == 0 and f3.exceptAll(f).count() == 0 and labels.first().label == "er_nonmatch"


def test_cutover_supersedes_what_is_not_restated(spark, sf_dir):
    f = relation(spark, sf_dir, "facts").filter("predicate = 'located_in' AND document_id = 7")
    one = f.orderBy("fact_id").first()
    wave = f.filter(F.col("fact_id") == one.fact_id).select(F.lit(1).cast("long").alias("pending_id"), "tenant_id", "subject_id", "predicate", "object_id", "literal", F.lit(8).cast("long").alias("document_id"), "ontology", "extractor")
    prior = spark.createDataFrame([(8, 7)], "document_id long, prior_document_id long")
    rows, promoted = promotion.cutover(f, wave, prior, 5_000, AT)
    assert [tuple(r) for r in promoted.collect()] == [(1, one.fact_id, True)]
    assert rows.filter("reason = 'superseded'").count() == f.count() - 1


def test_track_detection(spark):
    long = " ".join(["word"] * 40)
    rows = [
        ("a, b; c\n" * 6, "x.txt", None, "prose", False), ("a, b, c\r\n" * 5, "x.txt", None, "structured", True), ("a|b|c\n" * 4, "x", None, "prose", False),
        (long, "x.txt", None, "prose", False), ("\n".join([long] * 5), "x.txt", None, "prose", True), ("\n".join(["a b c"] * 6), "x", None, "prose", False),
        (None, "x.CSV", None, "structured", True), ("x", "dir/.csv", None, "prose", False), ("x", None, "Text/CSV", "structured", True), (None, None, None, "prose", False),
        (f"{long}\n\n{long}\na,b,c\n{long}\n{long}", "x", None, "prose", True),
    ]
    df = spark.createDataFrame(rows, "text string, name string, mime string, track string, sure boolean")
    track, sure = ingest.detected_track(F.col("text"), F.col("name"), F.col("mime"))
    assert [(r.a, r.b) for r in df.select(track.alias("a"), sure.alias("b")).collect()] == [(r[3], r[4]) for r in rows]


def test_waves_supersede_other_ontologies_and_versions(spark):
    f = spark.createDataFrame(
        [(1, 1, "v9", "llm/p1", None), (2, 1, "v10", "llm/p1", None), (3, 1, "v9", "llm/p1", AT), (4, 2, "v1", "llm/p1", None), (5, 2, "v1", "map", None), (6, 2, "v1", "llm/p2", None), (7, 3, "v1", "llm/p1", None), (8, 4, "v1", "llm/p1", None), (9, 1, "v9", "map", None)],
        "fact_id long, document_id long, ontology string, extractor string, valid_to timestamp",
    )
    wave = spark.createDataFrame([(1, 2, "v10", "llm/p1"), (1, 9, "v10", "llm/p1"), (2, 6, "v1", "llm/p2"), (3, 70, "v1", "llm/p2"), (3, 71, "v2", "llm/p2")], "document_id long, fact_id long, ontology string, extractor string")
    rows = {r.fact_id: r.reason for r in promotion.superseded(f, wave, AT).collect()}
    assert rows == {1: "ontology_superseded", 2: None, 3: None, 4: "extractor_superseded", 5: None, 6: None, 7: None, 8: None, 9: None}


def test_bootstrap_takes_the_fixed_elements(monkeypatch):
    # 1000 distinct means: the 26th and the 976th
    class Draws:
        def __init__(self, seed):
            self.k = -1

        def randrange(self, n):
            self.k += 1
            return self.k % n

    monkeypatch.setattr(evaluation.random, "Random", Draws)
    monkeypatch.setattr(evaluation, "sum", lambda xs: next(iter(xs)), raising=False)
    assert evaluation.bootstrap_interval(list(range(1000)), 1000) == (25 / 1000, 975 / 1000)


def test_bootstrap_is_seeded():
    assert evaluation.bootstrap_interval([0, 1, 1, 0, 1], 200) == evaluation.bootstrap_interval([0, 1, 1, 0, 1], 200)
    assert evaluation.displaces(0.1, 0.01, 200) and not evaluation.displaces(0.1, 0.01, 400)


def test_gold_lifecycle(spark):
    sets = spark.createDataFrame([(1, "extraction"), (2, "er")], "gold_id int, axis string")
    items = spark.createDataFrame([(1, i, f"t{i}") for i in range(30)] + [(2, 1, "x")], "gold_id int, seq int, text string")
    assert {r.gold_id: r.status for r in evaluation.registered(sets, items).collect()} == {1: "draft", 2: "rejected"}
    runs = spark.createDataFrame([("er", 1, "p", "{}"), ("er", 1, "p", '{"k":1}')], "axis string, gold_id int, pins string, config string")
    done = runs.limit(1).withColumn("status", F.lit("ok"))
    active = sets.withColumn("status", F.lit("active"))
    assert evaluation.new_runs(runs, done, active).count() == 1


def test_hashed_embedding(spark):
    row = spark.range(1).select(hashed_embedding(fx.search_terms(F.lit("The cats and the dogs")), 16).alias("v")).first()
    assert len(row.v) == 16 and sum(abs(x) for x in row.v) in (0.0, 2.0)


def test_gate_without_roles_sees_public_only(spark, sf_dir):
    g = Gate(Principal("t0"), relation(spark, sf_dir, "memberships"), {"entities": relation(spark, sf_dir, "entities")})
    assert g.labels == ["public"] and g.read("entities").filter("label IS NOT NULL").count() == 0


def test_name_block_at_its_floor_over_mentions_and_entities(spark, sf_dir):
    def grams(name):
        return {f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", name.lower()) for i in range(len(w) + 1)}

    m, e = relation(spark, sf_dir, "mentions").collect(), relation(spark, sf_dir, "entities").filter("entity_type = 'Organization'").collect()
    sets = {n: grams(n) for n in {x.surface for x in m} | {x.name for x in e}}
    want = {}
    for a in m:
        for b in e:
            x, y = sets[a.surface], sets[b.name]
            if a.tenant_id == b.tenant_id and len(x & y) >= resolution.TRIGRAM_FLOOR * len(x | y):
                want[a.mention_id, b.entity_id] = round(len(x & y) / len(x | y), 6)
    got = QUERIES["trigram_floor_block"](spark, sf_dir).collect()
    assert len(got) == len(want) and {(r.mention_id, r.entity_id): float(r.similarity) for r in got} == want
    # what lies between the floor and 0.8
    assert sum(x < 0.8 for x in want.values()) > len(want) / 2


def test_newer_facts_of_any_predicate_hold_back(spark, sf_dir):
    newer = {r.document_id for r in relation(spark, sf_dir, "facts").filter("valid_to IS NULL AND ontology = 'v2'").collect()}
    v1 = {r.pending_id for r in relation(spark, sf_dir, "pending").filter("ontology = 'v1'").collect()}
    stale = lambda rows: [r for r in rows if r.pending_id in v1 and r.document_id in newer]
    for name in ("promotable_pending", "promotable_over_all_facts"):
        rows = QUERIES[name](spark, sf_dir).collect()
        assert rows and not stale(rows)


@pytest.mark.parametrize("bounds", [1, 7, 200])
def test_places_are_the_order(spark, bounds):
    rows = spark.createDataFrame([("ab"[i % 2], f"n{i * 37 % 101}") for i in range(101)], "t string, name string")
    got = sorted((r.place, r.t, r.name) for r in evaluation.numbered(rows, "t", "name", bounds=bounds).collect())
    assert got == [(k, *x) for k, x in enumerate(sorted(map(tuple, rows.collect())), 1)]


@pytest.mark.parametrize("neighbours", [3, 20])
def test_gold_pairs_of_all_entities(spark, sf_dir, neighbours):
    e = relation(spark, sf_dir, "entities")
    names = sorted({(r.entity_type, r.name.split()[0].lower(), r.name) for r in e.collect()})
    want = {(names[i][2], names[j][2], names[i][0]) for i in range(len(names)) for j in range(i + 1, min(i + neighbours + 1, len(names))) if names[i][:2] == names[j][:2]}
    got = evaluation.match_pairs(e, neighbours).collect()
    negative = [(r.left_name, r.right_name, r.entity_type) for r in got if not r.match]
    assert len(negative) == len(want) and set(negative) == want
    assert {x[2] for x in want} == {"Document", "Asset"}
    assert Counter((r.left_name, r.entity_type) for r in got if r.match) == {(n, t): 2 for t, _, n in names}
    if neighbours == 20:
        assets = [n for t, _, n in names if t == "Asset"]
        every = {(a, b) for a in assets for b in assets if a < b and a.split()[0].lower() == b.split()[0].lower()}
        assert {(a, b) for a, b, t in want if t == "Asset"} == every
    registered = QUERIES["er_gold_pairs"](spark, sf_dir)
    assert registered.filter("NOT match").count() == len(want) or neighbours != 20


def test_blocks_give_what_one_broadcast_gives(spark, sf_dir):
    items = relation(spark, sf_dir, "embeddings")
    q = items.filter("vec_id % 20 = 0")
    for k in (2, None):
        one, many = (sorted(map(tuple, retrieval.nearest_elsewhere(items, q, k, max_queries=n).collect())) for n in (100, 7))
        assert one and one == many
    m = q.select(F.col("vec_id").alias("mention_id"), F.col("label").cast("string").alias("entity_type"), "embedding")
    e = items.select(F.col("vec_id").alias("entity_id"), F.col("label").cast("string").alias("entity_type"), "embedding")
    one, many = (sorted(map(tuple, resolution.ann_block(m, e, max_mentions=n).collect())) for n in (100, 7))
    assert one and one == many


def test_ranks_of_all_items(spark, sf_dir):
    items = relation(spark, sf_dir, "embeddings")
    alone = items.withColumn("group", -F.col("vec_id") - 1)
    got = retrieval.nearest_elsewhere(alone, items.filter("vec_id = 0").withColumn("group", F.lit(0)), None, group_col="group")
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, items.count() + 1))


def test_gold_ranks_are_the_ranking_s(spark, sf_dir):
    items = relation(spark, sf_dir, "embeddings")
    queries = items.filter("vec_id % 20 = 0")
    alone = items.withColumn("group", -F.col("vec_id") - 1)
    whole = {(r.query_id, r.id): r["rank"] for r in retrieval.nearest_elsewhere(alone, queries.withColumn("group", F.lit(0)), None, group_col="group").collect()}
    gold = queries.select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.col("vec_id"), F.col("vec_id") + 9)).alias("id"))
    for most in (20_000, 3):
        got = {(r.query_id, r.id): r["rank"] for r in retrieval.gold_ranks(items, queries, gold, max_queries=most).collect()}
        assert got and got == {k: whole[k] for k in got} and len(got) == gold.join(items, F.col("id") == F.col("vec_id")).count()


def test_searches_in_blocks_give_spark_s_own_numbers(spark, monkeypatch):
    """Copies, zero, null and shorter vectors among items that are dealt over many blocks, against a join in Spark."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 9)
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 2)
    r = random.Random(5)
    vectors = [[r.uniform(-1, 1) for _ in range(7)] for _ in range(25)]
    rows = [(i, i % 3, vectors[i % 25]) for i in range(90)] + [(90, 0, [0.0] * 7), (91, 1, None), (92, 1, [1.0, None, *vectors[0][2:]]), (93, 2, [1.0, 2.0]), (94, None, vectors[0])]
    items = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    queries = items.filter("vec_id % 10 IN (0, 1)")
    pairs = queries.select(F.col("vec_id").alias("q"), F.col("label").alias("ql"), F.col("embedding").alias("v")).crossJoin(items).withColumn("score", cosine(F.col("embedding"), F.col("v")))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df, k: sorted((x.q, x.vec_id, x.score is None or x.score, x.n) for x in df.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).collect())
    found = lambda df: sorted((x.query_id, x.id, x.score is None or x.score, x["rank"]) for x in df.collect())
    m = queries.select(F.col("vec_id").alias("mention_id"), F.col("label").cast("string").alias("entity_type"), "embedding")
    e = items.select(F.col("vec_id").alias("entity_id"), F.col("label").cast("string").alias("entity_type"), "embedding")
    gold = queries.select(F.col("vec_id").alias("query_id"), F.explode(F.array([F.lit(x).cast("long") for x in (0, 25, 50, 3, 77, 90)])).alias("id"))
    for most in (20_000, 4):
        for k in (3, 200):
            assert found(retrieval.nearest_elsewhere(items, queries, k, max_queries=most)) == ranked(pairs.filter("label <> ql"), k)
            got = resolution.ann_block(m, e, k, max_mentions=most).selectExpr("mention_id AS query_id", "entity_id AS id", "cosine AS score", "rank")
            assert found(got) == ranked(pairs.filter("label = ql AND score IS NOT NULL"), k)
        want = {(q, i): n for q, i, _, n in ranked(pairs.filter("score IS NOT NULL"), 1000)}
        got = {(x.query_id, x.id): x["rank"] for x in retrieval.gold_ranks(items, queries, gold, max_queries=most).collect()}
        assert got == {(x.query_id, x.id): want[x.query_id, x.id] for x in gold.collect() if (x.query_id, x.id) in want} and len(got) > 50


def test_searches_multiply_matrices_in_tasks(spark, sf_dir):
    """No pair of vectors is a row of a join."""
    items = relation(spark, sf_dir, "embeddings").withColumn("entity_type", F.col("label").cast("string"))
    q = items.filter("vec_id % 20 = 0")
    gold = q.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("id"))
    m, e = q.withColumnRenamed("vec_id", "mention_id"), items.withColumnRenamed("vec_id", "entity_id")
    for df in (retrieval.nearest_elsewhere(items, q), resolution.ann_block(m, e), retrieval.gold_ranks(items, q, gold)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CoGroupsInArrow" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_intervals_draw_as_the_generator_does():
    r = random.Random(3)
    for n in (1, 2, 7, 64, 1000):
        values = [r.choice((0.0, 1.0, r.random())) for _ in range(n)]
        rng = random.Random(11)
        means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(50))
        assert evaluation.bootstrap_interval(values, 50, 11) == (means[1], means[48])


def test_intervals_of_many_items_take_seconds():
    at = time.process_time()
    assert evaluation.bootstrap_interval([0.0, 1.0, 1.0] * 10_000)[0] < 2 / 3
    assert time.process_time() - at < 5  # ten seconds and more, draw by draw


def test_chunks_are_handed_on_in_small_parts(spark, monkeypatch):
    """What a task holds is bounded, whatever rows a batch brings: many documents, or one of many chunks."""
    docs = spark.createDataFrame([(i, f"# t{i}\n" + "word " * (40 * i)) for i in range(30)] + [(30, None), (31, "")], "doc_id long, text string").coalesce(1)
    batch = docs.toArrow().combine_chunks().to_batches()
    whole = ingest.chunked(docs, 50, 200)
    monkeypatch.setattr(ingest, "HELD_CHARS", 3_000)
    monkeypatch.setattr(ingest, "READ_ROWS", 5)
    parts = list(ingest.chunker(50, 200, 0.15, True)(iter(batch)))
    sizes = [sum(map(len, b.column("content").to_pylist())) for b in parts]
    assert len(sizes) > 20 and max(sizes) < 3_000 + 5 * 200
    assert sorted(str(tuple(r.values())) for b in parts for r in b.to_pylist()) == sorted(str(tuple(r)) for r in whole.collect())
    assert sorted(map(str, ingest.chunked(docs, 50, 200, content=False).collect())) == sorted(map(str, whole.withColumn("content", F.lit(None).cast("string")).collect()))


def test_name_pairs_reach_across_windows(spark, monkeypatch):
    """Windows smaller than the names; no pair is a row of a join."""
    monkeypatch.setattr(evaluation, "WINDOW_ROWS", 7)
    rows = [("A", f"x {i:03d}") for i in range(40)] + [("B", f"x {i:03d}") for i in range(9)] + [("A", f"y {i}") for i in range(3)]
    df = evaluation.match_pairs(spark.createDataFrame(rows, "entity_type string, name string"), 5)
    got = Counter((r.entity_type, r.left_name, r.right_name) for r in df.filter("NOT match").collect())
    want = {(t, a, b) for t, a in rows for b in [n for u, n in sorted(rows) if u == t and n > a and n[0] == a[0]][:5]}
    assert set(got) == want and set(got.values()) == {1}
    assert "explode(sequence(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_short_walk_sorts_no_table(spark, sf_dir):
    """The entities and edges are neither shuffled nor sorted for a few ends."""
    plan = facts.neighbors(gate(spark, sf_dir), 1_000_000_007, depth=3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Scan parquet") <= 2


def test_large_runs_are_bootstrapped_in_blocks(spark):
    rows = spark.createDataFrame([(r, i, float(i % 10 == 0)) for r, n in ((0, 400), (1, 2000)) for i in range(n)], "run int, query_id long, value double")
    got = {r.run: r for r in evaluation.bootstrap(rows, max_items=500).collect()}
    want = [evaluation.bootstrap_interval([float(i % 10 == 0) for i in range(n)]) for n in (400, 2000)]
    assert (got[0].low, got[0].high) == want[0]
    assert got[1].mean == pytest.approx(0.1) and (got[1].low, got[1].high) == pytest.approx(want[1], abs=0.004)
    assert got == {r.run: r for r in evaluation.bootstrap(rows.repartition(5), max_items=500).collect()}


def test_merge_moves_references_chains_and_names(spark):
    merges = spark.createDataFrame([(2, 1), (3, 1)], "merged_id long, survivor_id long")
    pending = spark.createDataFrame([(1, "pending", "entity:2", "entity:3"), (2, "promoted", "entity:2", "mention:2"), (3, "pending", "mention:2", "entity:9"), (4, "pending", "entity:1", None)], "pending_id long, status string, subject_ref string, object_ref string")
    after, moved = resolution.repointed(pending, merges)
    assert {r.pending_id: tuple(r)[2:] for r in after.collect()} == {1: ("entity:1", "entity:1"), 2: ("entity:2", "mention:2"), 3: ("mention:2", "entity:9"), 4: ("entity:1", None)}
    assert sorted(map(tuple, resolution.repointed_back(after, moved).collect())) == sorted(map(tuple, pending.collect()))
    earlier = spark.createDataFrame([(7, 2), (8, 5)], "merged_id long, survivor_id long")
    assert sorted(map(tuple, resolution.rerooted(earlier, merges).collect())) == [(7, 1), (8, 5)]
    e = spark.createDataFrame([(1, "A", ["a"], {"k": "1"}), (2, "B", ["a", "b"], {"k": "2", "x": "2"}), (3, "C", [], {"x": "3", "y": "3"}), (4, "D", ["d"], {})], "entity_id long, name string, aliases array<string>, attributes map<string,string>")
    left, gained = resolution.absorbed(e, merges)
    rows = {r.entity_id: r for r in left.collect()}
    assert set(rows) == {1, 4} and rows[1].aliases == ["a", "B", "C", "b"] and rows[1].attributes == {"k": "1", "x": "2", "y": "3"} and rows[4].aliases == ["d"]
    again = resolution.released(left, gained, e.filter("entity_id IN (2, 3)"))
    key = lambda df: sorted((r.entity_id, r.name, r.aliases, r.attributes) for r in df.collect())
    assert key(again) == key(e)


def test_spans_and_quotes_are_all_over_the_texts(spark, sf_dir):
    length = {r.doc_id: len(r.text or "") for r in relation(spark, sf_dir, "documents").collect()}
    spans = [r.span_id for r in QUERIES["span_containment"](spark, sf_dir).collect()]
    assert Counter(s // 1_000_000 for s in spans) == {i: max(-(-n // 900), 1) for i, n in length.items()} and len(set(spans)) == len(spans)
    quotes = [r for r in QUERIES["grounded_quotes"](spark, sf_dir).collect() if r.span_start is not None]
    assert any(r.span_start > 1850 for r in quotes)
    assert max(r.span_start / length[r.doc_id] for r in quotes) > 0.7


def test_chains_of_merges(spark):
    schema = "merged_id long, survivor_id long"
    got = resolution.rooted(spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 3), (200, 201)], schema)).collect()
    want = {i: (40, 40 - i) for i in range(1, 40)} | {100: (40, 38), 200: (201, 1)}
    assert {r.merged_id: (r.survivor_id, r.hops) for r in got} == want
    for bad in ([(1, 2), (2, 3), (3, 1)], [(1, 1)], [(1, 2), (1, 3)]):
        with pytest.raises(ValueError):
            resolution.rooted(spark.createDataFrame(bad, schema))
    assert resolution.rooted(spark.createDataFrame([], schema)).count() == 0


def test_a_batch_of_chained_merges_leaves_nothing_behind(spark):
    entities = spark.createDataFrame([(1, "One", ["a"], {"x": "1", "y": "1"}), (2, "Two", ["b"], {"x": "2"}), (3, "Three", ["c"], {"z": "3"})], "entity_id long, name string, aliases array<string>, attributes map<string,string>")
    facts = spark.createDataFrame([(10, 1, 2), (11, 2, None), (12, 3, 1)], "fact_id long, subject_id long, object_id long")
    mentions = spark.createDataFrame([(7, 1, "resolved"), (8, 2, "resolved")], "mention_id long, resolved_entity_id long, status string")
    merges = spark.createDataFrame([(1, 2), (2, 3)], "merged_id long, survivor_id long")
    e, f, m, snapshot = resolution.merged(entities, facts, mentions, merges)
    assert [r.entity_id for r in e.collect()] == [3]
    assert sorted(map(tuple, f.select("fact_id", "subject_id", "object_id").collect())) == [(10, 3, 3), (11, 3, None), (12, 3, 3)]
    assert {r.resolved_entity_id for r in m.collect()} == {3}
    back = resolution.unmerged(e, f, m, snapshot)
    assert sorted(map(tuple, back[1].select("fact_id", "subject_id", "object_id").collect())) == [(10, 1, 2), (11, 2, None), (12, 3, 1)]
    after = resolution.absorbed(entities, merges)[0].first()
    assert sorted(after.aliases) == ["One", "Two", "a", "b", "c"] and after.attributes == {"x": "2", "y": "1", "z": "3"}
    pending = spark.createDataFrame([(1, "pending", "entity:1", "entity:2"), (2, "promoted", "entity:1", None)], "pending_id long, status string, subject_ref string, object_ref string")
    assert sorted(map(tuple, resolution.repointed(pending, merges)[0].select("pending_id", "subject_ref", "object_ref").collect())) == [(1, "entity:3", "entity:3"), (2, "entity:1", None)]


def test_waves_of_one_document(spark):
    """Two ontologies staged for one document: the group with the first staged fact is promoted first, the other one replaces it; a group with a dangling reference stays."""
    pending = spark.createDataFrame(
        [(1, "t", "entity:1", "p", "entity:2", None, "pending", 10, "v1", "llm/1", None), (2, "t", "entity:1", "p", "entity:3", None, "pending", 10, "v2", "llm/1", None), (3, "t", "entity:1", "q", "entity:2", None, "pending", 10, "v1", "llm/1", None),
         (4, "t", "entity:5", "p", "mention:404", None, "pending", 11, "v1", "llm/1", None), (5, "t", "entity:5", "p", None, "x", "pending", 11, "v1", "llm/1", None), (6, "t", "entity:6", "p", None, "x", "pending", None, "v1", "llm/1", None)],
        "pending_id long, tenant_id string, subject_ref string, predicate string, object_ref string, literal string, status string, document_id long, ontology string, extractor string, promoted_fact_id long",
    )
    facts = spark.createDataFrame(
        [(100, "t", 1, "p", 2, None, None, AT, None, 1.0, 9, "v1", "llm/1"), (101, "t", 1, "gone", 2, None, None, AT, None, 1.0, 9, "v1", "llm/1"), (102, "t", 8, "p", 2, None, None, AT, None, 1.0, 50, "v1", "llm/1")],
        "fact_id long, tenant_id string, subject_id long, predicate string, object_id long, literal string, label string, valid_from timestamp, valid_to timestamp, confidence double, document_id long, ontology string, extractor string",
    )
    mentions = spark.createDataFrame([], "mention_id long, resolved_entity_id long")
    ontologies = spark.createDataFrame([("v1", 1), ("v2", 2)], "ontology string, effective_from int")
    prior = spark.createDataFrame([(10, 9)], "document_id long, prior_document_id long")
    after, staged, replaced = promotion.promoted_in_waves(pending, mentions, spark.createDataFrame([], "document_id long"), facts, ontologies, prior, 1000, AT)
    # the first wave keeps 100 and states q; the second states neither, so both go
    assert {r.fact_id: r.reason for r in after.collect()} == {100: "superseded", 101: "superseded", 102: None, 1003: "ontology_superseded", 1002: None, 1006: None}
    assert {r.pending_id: (r.status, r.promoted_fact_id) for r in staged.collect()} == {1: ("promoted", 100), 2: ("promoted", 1002), 3: ("promoted", 1003), 4: ("pending", None), 5: ("pending", None), 6: ("promoted", 1006)}
    assert [r.document_id for r in replaced.collect()] == [9]
    again = promotion.promoted_in_waves(staged, mentions, spark.createDataFrame([], "document_id long"), after, ontologies, prior, 1000, AT)
    assert {r.fact_id: r.reason for r in again[0].collect()} == {r.fact_id: r.reason for r in after.collect()}


def test_components_by_name():
    parsers = registry.Registry("parser", dict)
    parsers.register("plain", dict)
    assert parsers.build("plain", a=1) == {"a": 1} and parsers.names() == ["plain"]
    assert parsers.build(" collections:OrderedDict ") == {}
    for name, fault in (("", "needed"), ("gone", "neither registered"), ("no.such.module:X", "imported"), ("json:gone", "has no"), ("fractions:Fraction", "not a dict"), ("collections:Counter", "")):
        if fault:
            with pytest.raises(registry.ComponentError, match=fault):
                parsers.build(name)
        else:
            assert parsers.build(name) == {}
    with pytest.raises(registry.ForbiddenReference):
        parsers.build("lithic.sources.files:Registry")
    with pytest.raises(registry.ComponentError, match="can't be made"):
        parsers.register("two", lambda x: x)
        parsers.build("two", y=1)
    parsers.unregister("two")
    parsers.unregister("two")
    assert parsers.names() == ["plain"]


def test_best_of_name_and_aliases(spark):
    e = spark.createDataFrame([(1, "t", "A", "Alpha Works", ["Omega Trading", None]), (2, "t", "A", "Omega Trade", None), (3, "t", "B", "Omega Trading", [])], "entity_id long, tenant_id string, entity_type string, name string, aliases array<string>")
    m = spark.createDataFrame([(9, "t", "A", "OMEGA TRADING"), (10, "t", "A", None), (11, "t", "A", "")], "mention_id long, tenant_id string, entity_type string, surface string")
    got = {(r.mention_id, r.entity_id): r.similarity for r in resolution.trigram_block(m, e, 0.5).collect()}
    assert set(got) == {(9, 1), (9, 2)} and got[9, 1] == 1.0 and got[9, 2] < 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_that_are_all_alike_meet_in_bounded_groups(spark, sf_dir, monkeypatch):
    block = lambda: QUERIES["trigram_floor_block"](spark, sf_dir)
    assert "FlatMapCoGroupsInArrow" in plan_of(block())
    want = sorted(block().collect())
    monkeypatch.setattr(resolution, "MENTION_ROWS", 7)
    monkeypatch.setattr(resolution, "GRAM_COLUMNS", 5)
    assert sorted(block().collect()) == want
    monkeypatch.setattr(resolution, "SPARSE", 1e9)  # by prefixes
    assert sorted(block().collect()) == want


@pytest.mark.parametrize("sparse", [0.0, 1e9])
def test_pairs_of_copies_are_spread_last(spark, monkeypatch, sparse):
    monkeypatch.setattr(resolution, "SPARSE", sparse)
    e = [(k, "t", "A", ["Alpha Works", "Beta Works"][k % 2], ["Omega Trading", None] if k % 3 else None) for k in range(40)]
    m = [(k, "t", "A", ["OMEGA trading", "alpha worker"][k % 2]) for k in range(30)] + [(90, None, "A", "Alpha Works"), (91, "t", None, "Alpha Works"), (92, "u", "A", "Alpha Works")]
    entities = spark.createDataFrame(e, "entity_id long, tenant_id string, entity_type string, name string, aliases array<string>")
    mentions = spark.createDataFrame(m, "mention_id long, tenant_id string, entity_type string, surface string")
    grams = lambda name: {f"  {w} "[i : i + 3] for w in name.lower().split() for i in range(len(w) + 1)}
    share = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    for aliases in (True, False):
        found = resolution.trigram_block(mentions, entities if aliases else entities.drop("aliases"), 0.5)
        assert "Aggregate [mention_id" not in plan_of(found)
        want = {(a, b): max(share(s, x) for x in [name, *((own or []) if aliases else [])] if x) for a, _, _, s in m[:30] for b, _, _, name, own in e}
        rows = found.collect()
        assert len(rows) == len({r[:2] for r in rows}) and {(r.mention_id, r.entity_id): r.similarity for r in rows} == {k: v for k, v in want.items() if v >= 0.5}


@pytest.mark.parametrize("name, tables", [("fact_projection", 1), ("fact_evidence", 2)])
def test_what_facts_name_is_looked_up_by_ids(spark, sf_dir, name, tables):
    found = {f.rpartition("/")[0].rpartition("/")[2] for f in QUERIES[name](spark, sf_dir).inputFiles()}
    assert sum(f.startswith("named-") for f in found) == tables


def test_staged_facts_of_all_facts(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    facts_ = rows([(k, "t", 1, "p", None, "x", None, None, None, 0.5, None, k + 10, 1, 2, "v", "e") for k in (1, 1, 2)], "fact_id long, tenant_id string, subject_id long, predicate string, object_id long, literal string, label string, valid_from timestamp_ntz, valid_to timestamp_ntz, confidence double, document_id long, chunk_id long, span_start int, span_end int, ontology string, extractor string")
    entities = rows([(1, "t", "a", "A", None)], "entity_id long, tenant_id string, name string, entity_type string, label string")
    pending = rows([(5, "t", 1, "pass", "review"), (6, "t", 1, "span_missing", "x"), (7, "t", 3, "pass", "x"), (8, "t", None, "pass", "x")], "pending_id long, tenant_id string, promoted_fact_id long, grounding string, status string")
    chunks = rows([(11, "t", 77), (13, "t", 78)], "chunk_id long, tenant_id string, document_id long")
    g = Gate(Principal("t"), rows([("r", "public")], "role string, label string"), {"facts": facts_, "entities": entities, "pending": pending, "chunks": chunks})
    got = sorted((r.fact_id, str(r.grounding), r.state, r.document_id) for r in facts.fact_rows(g).collect())
    assert got == sorted([(1, "pass", "under_review", 77), (1, "span_missing", "known_low_confidence", 77)] * 2 + [(2, "None", "known_confident", None)])
    assert [(r.fact_id, r.grounding) for r in facts.fact_rows(g, dedupe=True).collect() if r.grounding] == [(1, "span_missing")] * 2


def test_dossier_projects_its_own_facts_only(spark, sf_dir):
    found = {f.rpartition("/")[0].rpartition("/")[2] for f in QUERIES["entity_dossier_facts"](spark, sf_dir).inputFiles()}
    assert any(f.startswith("dossier-") for f in found) and not any(f.startswith("named-") for f in found)


def test_facts_of_other_documents_meet_a_wave_once(spark):
    schema = "fact_id long, document_id long, ontology string, extractor string, valid_to timestamp_ntz, reason string"
    rows = [(1, 1, "v1", "e/1"), (2, 1, "v2", "e/1"), (3, 2, "v2", "e/1"), (4, 2, "v2", "e/2"), (5, None, "v1", "e/1"), *[(k, 900, "v1", "e/1") for k in range(10, 40)]]
    old = spark.createDataFrame([(*r, None, None) for r in rows], schema)
    wave = spark.createDataFrame([(1, 2, "v2", "e/1"), (2, 4, "v2", "e/2")], "document_id long, fact_id long, ontology string, extractor string")
    after = promotion.superseded(old, wave, datetime(2024, 1, 1))
    assert plan_of(after).count("Join LeftOuter") == 2
    got = after.collect()
    assert len(got) == len(rows) and {r.fact_id: r.reason for r in got if r.valid_to} == {1: "ontology_superseded", 3: "extractor_superseded"}


def test_prior_versions_meet_in_blocks(spark, tmp_path):
    """A chain's pairs are as SQL has them, also without native ids and with equal versions, and its files of pairs pack well, as blocks come in one order."""
    rows = [(i, "t0", "s" + str(i % 2), None if i % 3 else "n", i // 4 if i < 40 else i) for i in range(120)] + [(500, "t0", None, "n", 3), (501, "t0", "s0", "n", None)]
    schema = "raw_id long, tenant_id string, source_system string, native_id string, version int"
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[2] and a[1:4] == b[1:4] and None not in (a[4], b[4]) and b[4] < a[4])
    assert sorted(map(tuple, ingest.prior_versions(spark.createDataFrame(rows, schema)).collect())) == want
    long = spark.range(3000).selectExpr("(id * 7919) % 3000 * 1000003 AS raw_id", "'t0' AS tenant_id", "'s' AS source_system", "CAST(NULL AS STRING) AS native_id", "CAST(id + 1 AS INT) AS version")
    ingest.prior_versions(long).write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.distinct().count() == found.count() == 3000 * 2999 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.45 * found.count()
    assert sorted(map(tuple, ingest.prior_versions(spark.createDataFrame(rows, schema), block=4).collect())) == want


def test_pruned_pairs_keep_ties_and_vectors_of_any_size(monkeypatch):
    """Products in single precision leave out no pair: copies, vectors that differ in their last digits, zero, huge and tiny ones."""
    monkeypatch.setattr(retrieval, "PAIR_ROWS", 7)
    r = np.random.default_rng(3)
    for size in (1.0, 1e-60, 1e-160, 1e160):
        b = r.normal(size=(300, 6)) * size
        b[100:150] = b[:50]
        b[150:200] = b[:50] * (1 + 1e-15)
        b[200:210] = 0
        a = np.vstack([b[::9], np.zeros((2, 6))])
        with np.errstate(all="ignore"):
            whole = retrieval.cosines(a, b)
            x, y, score = retrieval.near_pairs(a, b, 5)
        assert np.array_equal(score, whole[x, y], equal_nan=True)
        worse = np.where(np.isnan(whole), np.inf, -whole)
        for row in range(len(a)):
            assert set(np.lexsort((np.arange(300), worse[row]))[:5]) <= set(y[x == row])
    assert len(retrieval.near_pairs(r.normal(size=(50, 16)), r.normal(size=(5000, 16)), 2)[0]) < 150


def test_pairs_of_versions_are_spread_without_python(spark):
    """One loop to a generated stage, so that no task holds all pairs of two blocks as rows; ids of any type, and null ones."""
    rows = [(f"r{i}" if i % 9 else None, "t0", "s", "n", i) for i in range(50)]
    raw = spark.createDataFrame(rows, "raw_id string, tenant_id string, source_system string, native_id string, version int")
    found = ingest.prior_versions(raw, block=7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan
    loops = [line.split("+- ")[-1].split(" ")[0] for line in plan.split("Initial Plan")[-1].splitlines() if re.search(r"Generate|Coalesce", line)]
    assert loops == ["Generate", "Coalesce", "Generate"]
    assert Counter(map(tuple, found.collect())) == Counter((a[0], b[0]) for a in rows for b in rows if b[4] < a[4])


@pytest.mark.parametrize("copies", [0, 8])
def test_alike_names_meet_as_lists(spark, monkeypatch, copies):
    """Pairs leave Python as lists of entities by mention and similarity, rounded before they are spread; names with hundreds of trigrams, copies, other kinds and null ids."""
    monkeypatch.setattr(resolution, "SPARSE", 0.0)
    monkeypatch.setattr(resolution, "COPIES", copies)
    monkeypatch.setattr(resolution, "MENTION_ROWS", 9)
    monkeypatch.setattr(resolution, "LEVEL_CELLS", 3)
    r = random.Random(2)
    long = ["".join(r.choices("abcdefgh", k=400)) for _ in range(3)]
    names = [f"Customer#{r.randrange(10**6):09d}" for _ in range(40)] + [f"{x} {y}" for x in long for y in long] + ["", "zz"]
    e = [(None if k == 5 else k, "tu"[k % 5 == 0], "A", names[k % len(names)]) for k in range(80)]
    m = [(k, "tu"[k % 4 == 0], "A", names[k * 7 % len(names)].upper() + " x") for k in range(60)] + [(90, "t", None, names[0]), (91, "t", "A", None)]
    entities = spark.createDataFrame(e, "entity_id long, tenant_id string, entity_type string, name string")
    mentions = spark.createDataFrame(m, "mention_id long, tenant_id string, entity_type string, surface string")
    grams = lambda name: {f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", name.lower()) for i in range(len(w) + 1)}
    want = Counter()
    for a in m[:60]:
        for b in e:
            x, y = grams(a[3]), grams(b[3])
            if a[1] == b[1] and x & y and len(x & y) / len(x | y) >= 0.25:
                want[a[0], b[0], round(len(x & y) / len(x | y), 6)] += 1
    found = resolution.trigram_block(mentions, entities, digits=6)
    assert Counter(map(tuple, found.collect())) == want and len(want) > 500
    if copies:
        plan = plan_of(found)
        assert plan.index("Generate explode(e_ids") < plan.index("round(similarity") < plan.index("FlatMapCoGroupsInArrow")
