"""Sources over small files, and streams over the events table."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lithic.operators.extraction import provision_facts
from lithic.sources import feeds, files
from lithic.streaming import queue


def test_scan_filters_and_cursor(spark, tmp_path):
    for name in ("a.md", "b.TXT", ".hidden/c.md", "sub/d.md", "sub/skip.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = files.scanned(spark, str(tmp_path)).withColumn("why", files.skipped_because(F.col("native_id"), [], ["skip*"], [".md"]))
    got = {r.native_id: r.why for r in rows.select("native_id", "why").collect()}
    assert got["a.md"] is None and got["b.TXT"] == "extension" and got["sub/skip.md"] == "excluded" and got["sub/d.md"] is None
    tokens = sorted(r.cursor for r in files.since(rows, None).select("cursor").collect())
    assert files.since(rows, tokens[0]).count() == len(tokens) - 1


def test_mode_grants(spark):
    got = spark.range(1).select(files.mode_grants(F.lit(0o640), F.lit("o"), F.lit("g")).alias("x")).first().x
    assert [tuple(g) for g in got] == [("o", "read"), ("o", "write"), ("g", "read")]


def test_delimited(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("﻿name ; n\nA;1\n;\nB;2\n", encoding="utf-8")
    df = files.delimited(spark, str(p))
    assert df.columns == ["name", "n"] and sorted(map(tuple, df.collect())) == [("A", "1"), ("B", "2")]


def test_html():
    assert files.html_to_markdown("<h2>T</h2><script>x</script><p>a <b>b</b></p><ul><li>c</li></ul>") == "## T\na b\n- c"


XML = """<doc xmlns="u"><title identifier="/us/usc/t26"><num>26</num><heading>Tax</heading><section identifier="/us/usc/t26/s1"><num>1</num><heading>One</heading>
<content>See <ref href="/us/usc/t26/s2">2</ref> and <ref href="/us/usc/t26/s1">1</ref> and <ref href="/us/pl/1">x</ref></content><note>no</note></section>
<section identifier="/us/usc/t26/s2"><num>2</num><heading>Two</heading><subsection identifier="/us/usc/t26/s2/a"><num>a</num><content>text</content></subsection></section></title></doc>"""


def test_provisions(spark):
    df = files.parsed_provisions(spark.createDataFrame([("t", bytearray(XML.encode()))], "native_id string, content binary"))
    facts = {(r.subject, r.predicate, r.object or r.literal) for r in provision_facts(df).collect()}
    assert ("/us/usc/t26/s1", "references", "/us/usc/t26/s2") in facts and ("/us/usc/t26/s2/a", "part_of", "/us/usc/t26/s2") in facts
    assert sum(p == "references" for _, p, _ in facts) == 1
    cites = [r.c for r in df.orderBy("identifier").select(files.citation(F.col("identifier")).alias("c")).collect()]
    assert cites == ["26 U.S.C.", "26 U.S.C. § 1", "26 U.S.C. § 2", "26 U.S.C. § 2(a)"]


def test_citations(spark):
    want = {
        "/us/usc/t26/s1/a/2": "26 U.S.C. § 1(a)(2)",
        "/us/usc/t26/s501/c/3/": "26 U.S.C. § 501(c)(3)",
        "/us/usc/t26/stA": "26 U.S.C. subtitle A",
        "/us/usc/t26/stA/ch1/schB/ptII/sptC/dE": "26 U.S.C. subtitle A, ch. 1, subch. B, pt. II, subpt. C, div. E",
        "/us/usc/t26/ch1/s1/a": "26 U.S.C. § 1(a)",
        "/us/usc/t26/zz9": "26 U.S.C. zz 9",
        "/us/usc/t26/s45A\u20132": "26 U.S.C. § 45A\u20132",
        "/us/usc/t26": "26 U.S.C.",
        "/us/usc/t26/(x)": "/us/usc/t26/(x)",
        "/us/usc/t26/s4531 /us/usc/t26/s4532": "/us/usc/t26/s4531 /us/usc/t26/s4532",
        "/us/usc/": "/us/usc/",
        "/us/pl/1": "/us/pl/1",
        "": "",
        None: "",
    }
    rows = spark.createDataFrame([(k,) for k in want], "identifier string").select("identifier", files.citation(F.col("identifier")).alias("c")).collect()
    assert {r.identifier: r.c for r in rows} == want


def test_ontology_faults(spark, tmp_path):
    p = tmp_path / "o.json"
    p.write_text(json.dumps({"version": "v", "entity_types": ["A"], "predicates": ["owns", "owns"], "predicate_aliases": {"x": {"predicate": "gone", "swap": False}}}))
    assert sorted(r.fault for r in files.ontology_faults(files.ontology(spark, str(p))).collect()) == ["alias of an unknown predicate", "repeated predicate"]


def test_delta_feed(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    put = lambda n, x: (pages / f"{n}.json").write_text(json.dumps(x))
    put("d1-start", {"value": [{"id": "1", "name": "a"}], "nextLink": "p2"})
    put("d1-p2", {"value": [{"id": "2", "@removed": {}}], "deltaLink": "t1"})
    reader = feeds.DeltaReader(str(pages))
    rows, offset = reader.sweep({})
    assert [(r[1], r[4]) for r in rows] == [("1", False), ("2", True)] and offset == {"d1": "t1"}
    put("d1-t1", {"status": 410})
    assert len(reader.sweep(offset)[0]) == 2
    spark.dataSource.register(feeds.DeltaFeed)
    q = spark.readStream.format("delta_feed").option("pages", str(pages)).load().writeStream.format("memory").queryName("delta_rows").trigger(once=True).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("delta_rows").count() == 2


def test_drives_are_read_by_their_own_tasks(spark, tmp_path):
    pages, links = tmp_path / "pages", tmp_path / "links"
    pages.mkdir()
    put = lambda n, x: (pages / f"{n}.json").write_text(json.dumps(x))
    item = lambda *ids: [{"id": i, "name": i} for i in ids]
    put("d1-start", {"value": item("1", "2"), "nextLink": "p2"})
    put("d1-p2", {"value": [{"id": "3", "@removed": {}}], "deltaLink": "t1"})
    put("d2-start", {"value": item("7"), "deltaLink": "u1"})
    spark.dataSource.register(feeds.DrivesFeed)
    options, check = {"pages": str(pages), "links": str(links)}, str(tmp_path / "check")

    def run():
        rows = []
        take = lambda df, n: rows.extend((n, r.drive, r.id, r.deleted) for r in df.collect())
        spark.readStream.format("drives_feed").options(**options).load().writeStream.foreachBatch(take).option("checkpointLocation", check).trigger(once=True).start().awaitTermination()
        return sorted(rows)

    assert [r[1:] for r in run()] == [("d1", "1", False), ("d1", "2", False), ("d1", "3", True), ("d2", "7", False)]
    assert run() == []
    put("d1-t1", {"value": item("4"), "deltaLink": "t2"})
    put("d2-u1", {"status": 410})
    put("d3-start", {"value": item("9"), "deltaLink": "v1"})
    assert [r[1:] for r in run()] == [("d1", "4", False), ("d2", "7", False), ("d3", "9", False)]
    reader = feeds.DrivesReader(options)
    # a sweep that is read again begins at the same link
    assert [r[1] for r in reader.read(feeds.DriveSweep("d1", 1))] == ["4"] == [r[1] for r in reader.read(feeds.DriveSweep("d1", 1))]
    assert {(p.drive, p.sweep) for p in reader.partitions({"sweep": 1}, {"sweep": 2})} == {("d1", 1), ("d2", 1), ("d3", 1)}


def test_accounting_sweep(spark, tmp_path):
    for entity, start, n in (("Bill", 1, 2), ("Bill", 3, 1), ("Vendor", 1, 0)):
        (tmp_path / f"{entity}-{start}.json").write_text(json.dumps({"rows": [{"Id": start + k, "status": "Deleted" if k else None} for k in range(n)]}))
    spark.dataSource.register(feeds.AccountingSweep)
    rows = spark.read.format("accounting_sweep").options(pages=str(tmp_path), entities="Bill,Vendor", page_rows="2").load()
    items = {r.native_id: (r.action, r.content_hash is None) for r in feeds.change_items(rows).collect()}
    assert items == {"Bill/1": ("upsert", False), "Bill/2": ("tombstone", True), "Bill/3": ("upsert", False)}


def test_permission_grants(spark):
    text = json.dumps([{"id": "1", "roles": ["owner"], "user": "u"}, {"id": "2", "roles": ["read"], "group": "g", "inherited": True}, {"id": "3", "roles": ["read"], "link": {"scope": "org", "expires": "2030"}}, {"id": "4", "roles": ["odd"], "user": "v"}])
    got = {tuple(r) for r in feeds.permission_grants(spark.createDataFrame([("x", text)], "id string, permissions string")).drop("id").collect()}
    assert got == {("user:u", "write", "direct", None), ("group:g", "read", "inherited", None), ("link:org", "read", "link", "2030")}


def test_blobs(spark):
    items = spark.createDataFrame([("t", bytearray(b"a"), None), ("t", bytearray(b"a"), None), ("t", bytearray(b"b"), "wrong")], "tenant_id string, content binary, declared_hash string")
    rows = files.blob_rows(items)
    assert rows.count() == 2 and rows.filter("mismatch").count() == 1 and files.blob_rows(items, rows).filter("NOT mismatch").count() == 0
    both = spark.createDataFrame([("t", bytearray(b"a"), "wrong"), ("t", bytearray(b"a"), None), ("t", bytearray(b"a"), "wrong")], items.schema)
    assert sorted(r.mismatch for r in files.blob_rows(both).collect()) == [False, True]
    assert files.blob_rows(both, files.blob_rows(both).filter("mismatch")).filter("NOT mismatch").count() == 1


NOW = datetime(2024, 1, 20, 12)


def rows_of(spark):
    return spark.createDataFrame(
        [(1, "queued", NOW, None, None, 0, False, 10), (2, "leased", NOW, NOW - timedelta(minutes=1), None, 1, False, 11), (3, "leased", NOW, NOW + timedelta(minutes=1), None, 1, False, 12), (4, "queued", NOW + timedelta(hours=1), None, "e", 0, True, 13)],
        "queue_id long, status string, available_at timestamp_ntz, leased_until timestamp_ntz, last_error string, attempts int, acknowledged boolean, document_id long",
    )


def test_queue_claims_leases_and_finishes(spark):
    q = rows_of(spark)
    assert [r.queue_id for r in queue.claimed(q, NOW, 9).collect()] == [1, 2]
    after = queue.finished(queue.leased(q, NOW, 9), spark.createDataFrame([(1, None), (2, "bad")], "queue_id long, error string"))
    assert {r.queue_id: (r.status, r.last_error) for r in after.collect()} == {1: ("done", None), 2: ("queued", "bad"), 3: ("leased", None), 4: ("queued", "e")}
    again = queue.retried(q, q.select("queue_id"))
    assert {r.queue_id: r.acknowledged for r in again.collect()}[4] is False
    assert queue.enqueued(q, q.limit(1)).count() == 4


@pytest.mark.parametrize("monotone,want", [(True, "b"), (False, "a")])
def test_cursor(spark, monotone, want):
    assert spark.range(1).select(queue.advanced_cursor(F.lit("b"), F.lit("a"), monotone).alias("c")).first().c == want


def test_stream_counts_equal_batch(spark, sf_dir, tmp_path):
    path = tmp_path / "in"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(path))
    stream = queue.deduplicated(spark.readStream.schema(events.schema).parquet(str(path)))
    seen = []
    query = queue.drained(stream, lambda df, epoch: seen.append(df.count()), str(tmp_path / "check"))
    query.awaitTermination()
    assert sum(seen) == events.count()
    counts = queue.per_minute(events)
    assert counts.agg(F.sum("n")).first()[0] == events.count()
