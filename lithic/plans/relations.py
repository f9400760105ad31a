"""The engine's relations, derived from the given tables.

Each relation is one portable SELECT. Names in braces are other relations or tables, so Spark composes them as DataFrames and
the checking SQL as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

TENANT = "CASE WHEN {k} % 10 = 9 THEN 't1' ELSE 't0' END"
NO_ID, NO_TEXT = "CAST(NULL AS BIGINT)", "NULLIF('', '')"

RELATIONS: dict[str, str] = {
    # entity_id offsets by type: 1e9 customer, 2e9 supplier, 3e9 nation, 4e9 region, 5e9 part, 6e9 order
    "entities": f"""
        SELECT 1000000000 + c_custkey AS entity_id, {TENANT.replace('{k}', 'c_custkey')} AS tenant_id, c_name AS name, 'Organization' AS entity_type,
               CASE WHEN c_custkey % 5 = 0 THEN 'restricted' WHEN c_custkey % 5 = 1 THEN 'internal' END AS label, 'customer_id' AS key_name, c_name AS key_value
        FROM {{customer}}
        UNION ALL SELECT 2000000000 + s_suppkey, 't0', s_name, 'Organization', {NO_TEXT}, 'tax_id', s_name FROM {{supplier}}
        UNION ALL SELECT CAST(3000000000 + n_nationkey AS BIGINT), 't0', n_name, 'Location', {NO_TEXT}, 'code', n_name FROM {{nation}}
        UNION ALL SELECT CAST(4000000000 + r_regionkey AS BIGINT), 't0', r_name, 'Location', {NO_TEXT}, 'code', r_name FROM {{region}}
        UNION ALL SELECT 5000000000 + p_partkey, 't0', p_name, 'Asset', {NO_TEXT}, 'sku', CONCAT(p_brand, '-', p_partkey) FROM {{part}}
        UNION ALL SELECT 6000000000 + o_orderkey, {TENANT.replace('{k}', 'o_custkey')}, CONCAT('Order ', o_orderkey), 'Document', {NO_TEXT}, 'order_no', CONCAT('', o_orderkey)
        FROM {{orders}}""",
    "facts": f"""
        SELECT 1000000000 + o_orderkey AS fact_id, {TENANT.replace('{k}', 'o_custkey')} AS tenant_id, 1000000000 + o_custkey AS subject_id, 'placed' AS predicate,
               6000000000 + o_orderkey AS object_id, {NO_TEXT} AS literal, CASE WHEN o_orderkey % 7 = 0 THEN 'restricted' END AS label,
               o_orderdate AS valid_from, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 DAY END AS valid_to,
               CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence, o_orderkey % 200 AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 'v2' ELSE 'v1' END AS ontology,
               CONCAT('llm/p', o_orderkey % 3) AS extractor
        FROM {{orders}}
        UNION ALL SELECT 2000000000 + o_orderkey, {TENANT.replace('{k}', 'o_custkey')}, 6000000000 + o_orderkey, 'has_priority', {NO_ID}, o_orderpriority, {NO_TEXT}, o_orderdate,
               NULLIF(o_orderdate, o_orderdate), 0.9, o_orderkey % 200, 'v1', 'map' FROM {{orders}}
        UNION ALL SELECT 3000000000 + c_custkey, {TENANT.replace('{k}', 'c_custkey')}, 1000000000 + c_custkey, 'located_in', 3000000000 + c_nationkey, {NO_TEXT}, {NO_TEXT},
               TIMESTAMP_NTZ '1992-01-01 00:00:00', NULLIF(TIMESTAMP_NTZ '1992-01-01 00:00:00', TIMESTAMP_NTZ '1992-01-01 00:00:00'), 1.0, c_custkey % 200, 'v1', 'map' FROM {{customer}}
        UNION ALL SELECT 4000000000 + s_suppkey, 't0', 2000000000 + s_suppkey, 'located_in', 3000000000 + s_nationkey, {NO_TEXT}, {NO_TEXT},
               TIMESTAMP_NTZ '1992-01-01 00:00:00', NULLIF(TIMESTAMP_NTZ '1992-01-01 00:00:00', TIMESTAMP_NTZ '1992-01-01 00:00:00'), 1.0, s_suppkey % 200, 'v1', 'map' FROM {{supplier}}
        UNION ALL SELECT CAST(5000000000 + n_nationkey AS BIGINT), 't0', CAST(3000000000 + n_nationkey AS BIGINT), 'part_of', CAST(4000000000 + n_regionkey AS BIGINT), {NO_TEXT}, {NO_TEXT},
               TIMESTAMP_NTZ '1992-01-01 00:00:00', NULLIF(TIMESTAMP_NTZ '1992-01-01 00:00:00', TIMESTAMP_NTZ '1992-01-01 00:00:00'), 1.0, CAST(n_nationkey AS BIGINT), 'v1', 'map' FROM {{nation}}
        UNION ALL SELECT 6000000000 + l_orderkey * 8 + l_linenumber, 't0', 6000000000 + l_orderkey, 'contains', 5000000000 + l_partkey, {NO_TEXT}, {NO_TEXT}, l_shipdate,
               CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 30 DAY END, 1 - l_discount, l_orderkey % 200, 'v2', 'table' FROM {{lineitem}}""",
    # staged facts: who asserted what, how well it is grounded, what it became
    "pending": f"""
        SELECT o_orderkey AS pending_id, CASE WHEN o_custkey % 10 = 9 THEN 't1' ELSE 't0' END AS tenant_id,
               CASE WHEN o_orderkey % 4 = 0 THEN CONCAT('entity:', 1000000000 + o_custkey) ELSE CONCAT('mention:', o_custkey) END AS subject_ref,
               'placed' AS predicate, CONCAT('entity:', 6000000000 + o_orderkey) AS object_ref, {NO_TEXT} AS literal,
               CASE o_orderkey % 6 WHEN 0 THEN 'span_missing' WHEN 1 THEN 'components_missing' WHEN 2 THEN 'span_mismatch' WHEN 3 THEN 'declared_span' ELSE 'pass' END AS grounding,
               CASE WHEN o_orderkey % 9 = 0 THEN 'rejected' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'promoted' END AS status,
               o_orderkey % 200 AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 'v2' ELSE 'v1' END AS ontology, CONCAT('llm/p', o_orderkey % 3) AS extractor,
               CASE WHEN o_orderstatus = 'F' THEN 1000000000 + o_orderkey END AS promoted_fact_id, o_orderkey % 11 = 0 AS oversized, o_orderdate AS created_at
        FROM {{orders}}""",
    "mentions": f"""
        SELECT c_custkey AS mention_id, CASE WHEN c_custkey % 10 = 9 THEN 't1' ELSE 't0' END AS tenant_id, 'Organization' AS entity_type,
               CASE WHEN c_custkey % 3 = 0 THEN UPPER(c_name) WHEN c_custkey % 3 = 1 THEN c_name ELSE CONCAT(c_name, ' Inc') END AS surface,
               CASE WHEN c_custkey % 6 < 4 THEN 'customer_id' END AS key_name, CASE WHEN c_custkey % 6 < 4 THEN c_name END AS key_value,
               CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'review' ELSE 'resolved' END AS status,
               CASE WHEN c_custkey % 5 > 1 THEN 1000000000 + c_custkey END AS resolved_entity_id, c_custkey % 200 AS document_id, c_mktsegment AS segment
        FROM {{customer}}""",
    "candidates": """
        SELECT event_id AS candidate_id, CASE WHEN event_id % 3 = 0 THEN 'entity' ELSE 'mention' END AS left_type, CASE WHEN event_id % 3 = 0 THEN 1000000000 + event_id % 100 + 1 ELSE event_id % 100 + 1 END AS left_id,
               1000000000 + user_id + 1 AS right_id, CASE event_id % 4 WHEN 0 THEN 'tier0' WHEN 1 THEN 'tier1' WHEN 2 THEN 'tier1b' ELSE 'tier1c' END AS tier,
               CASE WHEN event_id % 10 < 6 THEN 'resolved' WHEN event_id % 10 < 8 THEN 'review' ELSE 'new_entity' END AS decision,
               CAST(event_id % 101 AS DOUBLE) / 100 AS score, value AS wall_ms, ts AS created_at, event_id % 13 = 0 AS open
        FROM {events}""",
    "runs": """
        SELECT event_id AS run_id, user_id % 150 AS document_id, CONCAT('llm/p', user_id % 3) AS extractor, CASE WHEN event_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status,
               event_id % 9 AS facts, event_id % 4 AS quarantined, event_id % 3 AS flagged, value AS wall_ms, event_id % 900 + 100 AS tokens_in, event_id % 300 AS tokens_out, ts AS started_at,
               CASE WHEN event_id % 2 = 0 THEN 'v2' ELSE 'v1' END AS ontology
        FROM {events}""",
    "queue": f"""
        SELECT event_id AS queue_id, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'leased' WHEN 2 THEN 'done' ELSE 'queued' END AS status, ts AS available_at,
               CASE WHEN event_id % 4 = 1 THEN ts + INTERVAL 5 MINUTE END AS leased_until, CASE WHEN event_id % 16 = 3 THEN 'timeout' END AS last_error, event_id % 3 AS attempts,
               event_id % 32 = 3 AS acknowledged, user_id AS document_id
        FROM {{events}}""",
    "quarantine": """
        SELECT event_id AS quarantine_id, CASE event_id % 3 WHEN 0 THEN 'unbound_entity_type' WHEN 1 THEN 'unbound_predicate' ELSE 'validation_failure' END AS reason,
               CONCAT('llm/p', user_id % 3) AS extractor, user_id % 150 AS document_id, event_id % 5 = 0 AS open, ts AS created_at
        FROM {events} WHERE event_type <> 'purchase'""",
    # landed documents: the source and every twentieth id make a logical document; larger ids are later versions
    "raw": """
        SELECT doc_id AS raw_id, 't0' AS tenant_id, source AS source_system, CASE WHEN doc_id % 13 <> 0 THEN CONCAT('n', doc_id % 40) END AS native_id, text, lang, n_chars
        FROM {documents}""",
    # documents as the gate sees them, and their passages of 600 characters
    "sourced": """
        SELECT doc_id AS document_id, 't0' AS tenant_id, CASE WHEN doc_id % 7 = 0 THEN 'restricted' WHEN doc_id % 7 = 1 THEN 'internal' END AS label, CONCAT(source, '/', doc_id) AS title,
               TIMESTAMP_NTZ '2024-01-01 00:00:00' AS source_timestamp, CASE WHEN doc_id % 23 = 5 THEN TIMESTAMP_NTZ '2024-01-10 00:00:00' END AS valid_to, lang, text
        FROM {documents}""",
    "chunks": """
        SELECT document_id * 100000 + seq AS chunk_id, document_id, tenant_id, seq, element_at(parts, CAST(seq + 1 AS INT)) AS content
        FROM (SELECT document_id, tenant_id, parts, explode(sequence(0, CAST(floor(greatest(length(text) - 1, 0) / 600.0) AS BIGINT))) AS seq
              FROM (SELECT document_id, tenant_id, text, regexp_extract_all(text, '(?s).{{1,600}}', 0) AS parts FROM {sourced} WHERE length(text) > 0) AS y) AS x""",
    # facts with the chunk they are taken from; half of them state no document
    "cited": """
        SELECT fact_id, tenant_id, subject_id, predicate, object_id, literal, label, valid_from, valid_to, confidence, CASE WHEN fact_id % 2 = 0 THEN document_id END AS document_id,
               CASE WHEN fact_id % 3 < 2 THEN document_id * 100000 + fact_id % 2 END AS chunk_id, fact_id % 500 AS span_start, fact_id % 500 + 12 AS span_end, ontology, extractor
        FROM {facts}""",
    "memberships": "SELECT 'analyst' AS role, 'internal' AS label UNION ALL SELECT 'auditor', 'internal' UNION ALL SELECT 'auditor', 'restricted'",
    "versions": """
        SELECT CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS version, l_orderkey % 5000 AS subject_id, l_returnflag AS predicate, l_partkey % 400 AS object_id
        FROM {lineitem}""",
    # mentions in review or resolved with the score of each entity they may be
    "scored": """
        SELECT left_id AS mention_id, right_id AS entity_id, max(score) AS score, CASE WHEN max(score) >= 0.92 THEN 'high' WHEN max(score) <= 0.45 THEN 'low' ELSE 'gray' END AS band
        FROM {candidates} WHERE left_type = 'mention' GROUP BY left_id, right_id""",
    "decisions": """
        SELECT mention_id, entity_id, CASE WHEN mention_id % 4 = 0 THEN 'resolved' WHEN mention_id % 4 = 3 THEN 'new_entity' ELSE 'review' END AS decision,
               CASE WHEN mention_id % 8 = 0 THEN 't0' ELSE 't1' END AS tier, CONCAT('reason ', mention_id % 4) AS reason
        FROM (SELECT mention_id, entity_id, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, entity_id) AS place FROM {scored}) AS x WHERE place = 1""",
    "verdicts": """
        SELECT candidate_id, candidate_id % 2 = 0 AS same, CONCAT('reviewer', candidate_id % 3) AS reviewer FROM {candidates} WHERE candidate_id % 5 < 3""",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = RELATIONS[name]
    return spark.sql(sql, **{n: relation(spark, sf_dir, n) for n in sorted(set(re.findall(r"\{(\w+)\}", sql)))})


def checking_sql(sql: str) -> str:
    """SQL over relations in braces, as one statement of common table expressions over the given tables."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for n in re.findall(r"\{(\w+)\}", text):
            if n in RELATIONS and n not in needed:
                visit(RELATIONS[n])
                needed.append(n)

    visit(sql)
    names = {n: n for n in (*TABLES, *RELATIONS)}
    ctes = ", ".join(f"{n} AS ({RELATIONS[n].format(**names)})" for n in needed)
    body = sql.format(**names).strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = re.sub(r"(?i)^with(\s+recursive)?\s", "", body)
        ctes = f"{ctes}, " if ctes else ""
        text = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{body}"
    else:
        text = f"WITH {ctes} {body}" if ctes else body
    return text.replace("TIMESTAMP_NTZ '", "TIMESTAMP '").replace("explode(sequence(", "unnest(generate_series(").replace("element_at(", "list_element(")
