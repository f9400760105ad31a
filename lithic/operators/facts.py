"""Facts: canonical projection, constraints, and the served operations over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions.storage import stored
from lithic.operators.gate import Gate

# Grounding outcomes that are statuses but not grounded.
FLAGGED = ("span_missing", "components_missing", "span_mismatch")
GROUNDED = ("pass", "declared_span", "construction")


def uncertainty(valid_to: Column, grounding: Column, under_review: Column) -> Column:
    """Retracted, then under review, then low confidence, then confident."""
    return (
        F.when(valid_to.isNotNull(), "retracted")
        .when(F.coalesce(under_review, F.lit(False)), "under_review")
        .when(F.coalesce(grounding.isin(*FLAGGED), F.lit(False)), "known_low_confidence")
        .otherwise("known_confident")
    )


def violations(facts: DataFrame, max_lines: int = 5000) -> DataFrame:
    """Facts that break a row constraint, with its name. Columns that a relation lacks aren't checked."""
    has = set(facts.columns)
    rules = {
        "object_present": F.col("object_id").isNotNull() | F.col("literal").isNotNull(),
        "provenance_present": F.coalesce(*[F.col(c).cast("string") for c in ("document_id", "chunk_id") if c in has]).isNotNull(),
        "confidence_in_range": F.col("confidence").between(0, 1),
        "validity_ordered": F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("valid_from")),
    }
    if {"span_start", "span_end"} <= has:
        rules["span_whole"] = F.col("span_start").isNull() == F.col("span_end").isNull()
        rules["span_ordered"] = F.coalesce(F.col("span_end") >= F.col("span_start"), F.lit(True))
    if "n_lines" in has:
        rules["size"] = F.col("n_lines") <= max_lines
    broken = F.filter(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return facts.select("fact_id", F.explode(broken).alias("violation"))


def fact_rows(gate: Gate, dedupe: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """Facts that the principal may see: with visible subject, visible object or none, evidence and grounding.

    `facts` are the gate's facts, already filtered; all of them if left out. A fact whose document isn't stated takes that of its chunk, where
    the relation has chunks. A fact asserted again has one row for each staged fact that became it; `dedupe` keeps the one of the largest id.
    Of all facts, what staged facts and chunks they name is looked up by their ids alone and written out, so that whole facts are shuffled for their
    two entities only, unless there is too much of it to be sent.
    """
    whole = facts is None
    facts = gate.read("facts") if whole else facts
    entities, pending = gate.read("entities"), gate.read("pending")
    subject = entities.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("subject_name"), F.col("entity_type").alias("subject_type"))
    object_ = entities.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object_name"), F.col("entity_type").alias("object_type"), F.lit(True).alias("object_visible"))
    grounds = pending.filter(F.col("promoted_fact_id").isNotNull()).select(
        F.col("promoted_fact_id").alias("fact_id"), "pending_id", "grounding", (F.col("status") == "review").alias("under_review")
    )
    if dedupe:
        grounds = grounds.groupBy("fact_id").agg(F.max_by(F.struct("pending_id", "grounding", "under_review"), "pending_id").alias("g")).select("fact_id", "g.*")
    grounds = named(grounds, facts, "fact_id") if whole else grounds
    rows = anchored(facts, gate, whole).join(grounds, "fact_id", "left")
    rows = rows.join(subject, "subject_id").join(object_, "object_id", "left").filter(F.col("object_id").isNull() | F.col("object_visible"))
    more = [c for c in ("chunk_id", "span_start", "span_end") if c in facts.columns]
    return rows.select(
        "fact_id", "subject_id", "subject_name", "subject_type", "predicate", "object_id", "object_name", *(["object_type", "tenant_id"] if more else []), "literal",
        F.coalesce("label", F.lit("public")).alias("label"), "confidence", "valid_from", "valid_to", "document_id", *more, "ontology", "extractor", "grounding",
        uncertainty(F.col("valid_to"), F.col("grounding"), F.col("under_review")).alias("state"),
        *([F.coalesce("under_review", F.lit(False)).alias("needs_review")] if more else []),
    )


def named(rows: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """The rows whose id facts name in this column, written out. Only the column is shuffled."""
    return stored(rows.join(facts.filter(F.col(column).isNotNull()).select(column), column, "left_semi"), "named")


def anchored(facts: DataFrame, gate: Gate, whole: bool = False) -> DataFrame:
    """Facts with the document of their evidence: the one stated, else their chunk's."""
    if "chunk_id" not in facts.columns:
        return facts
    of = gate.read("chunks").select("chunk_id", F.col("document_id").alias("chunk_document"))
    of = named(of, facts.select("chunk_id").distinct(), "chunk_id") if whole else of
    return facts.join(of, "chunk_id", "left").withColumn("document_id", F.coalesce("document_id", "chunk_document")).drop("chunk_document")


def about(rows: DataFrame, entity_ids: DataFrame, role: str = "any") -> DataFrame:
    """Rows of facts whose subject, object or either is among entity_ids (column entity_id). Sides are joined one by one, without OR. The ids are written out, so that a few are sent to the rows."""
    ids = stored(entity_ids.select("entity_id").distinct(), "about")
    sides = {"subject": ["subject_id"], "object": ["object_id"], "any": ["subject_id", "object_id"]}[role]
    found = [rows.join(ids.withColumnRenamed("entity_id", side), side, "left_semi").select(*rows.columns) for side in sides]
    if len(found) == 1:
        return found[0]
    not_subject = found[1].join(ids.withColumnRenamed("entity_id", "subject_id"), "subject_id", "left_anti").select(*rows.columns)
    return found[0].unionByName(not_subject)


def entities_by_key(gate: Gate, identifier: str, key: str | None = None) -> DataFrame:
    """Visible entities with a key of this value, of any name or the one given."""
    rows = gate.read("entities").filter(F.col("key_value") == identifier)
    return rows.filter(F.col("key_name") == key) if key is not None else rows


def get_facts(gate: Gate, entity_id: int, predicate: str | None = None, role: str = "any", dedupe: bool = False) -> DataFrame:
    side = {"subject": F.col("subject_id") == entity_id, "object": F.col("object_id") == entity_id}
    side["any"] = side["subject"] | F.coalesce(side["object"], F.lit(False))
    rows = gate.read("facts").filter(side[role])
    return fact_rows(gate, dedupe, rows.filter(F.col("predicate") == predicate) if predicate is not None else rows)


def get_by_key(gate: Gate, identifier: str, key: str | None = None, role: str = "subject", dedupe: bool = False) -> DataFrame:
    return fact_rows(gate, dedupe, about(gate.read("facts"), entities_by_key(gate, identifier, key), role))


def get_entity(gate: Gate, entity_id: int | None = None, identifier: str | None = None, key: str | None = None) -> DataFrame:
    """One of entity_id and identifier is needed."""
    if entity_id is None and identifier is None:
        raise ValueError("entity_id or identifier is needed")
    rows = gate.read("entities") if identifier is None else entities_by_key(gate, identifier, key)
    return rows if entity_id is None else rows.filter(F.col("entity_id") == entity_id)


def facts_citing(gate: Gate, document_id: int | None = None, chunk_id: int | None = None) -> DataFrame:
    """Facts grounded to one chunk, or to any part of one document. One of the two is needed."""
    if document_id is None and chunk_id is None:
        raise ValueError("document_id or chunk_id is needed")
    rows = gate.read("facts")
    if chunk_id is not None:
        return fact_rows(gate, facts=rows.filter(F.col("chunk_id") == chunk_id))
    if "chunk_id" not in rows.columns:
        return fact_rows(gate, facts=rows.filter(F.col("document_id") == document_id))
    # only the document's own facts are looked up: those that state it, and those that state none but one of its chunks
    stated = rows.filter(F.col("document_id") == document_id)
    chunks = gate.read("chunks").filter(F.col("document_id") == document_id).select("chunk_id")
    by_chunk = rows.filter("document_id IS NULL").join(chunks, "chunk_id", "left_semi").select(*rows.columns)
    return fact_rows(gate, facts=stated.unionByName(by_chunk))


def passages(gate: Gate) -> DataFrame:
    """Visible chunks of current, visible documents, with what is shown of the document: a chunk has its document's label."""
    documents = gate.read("documents").select("document_id", "title", F.coalesce("label", F.lit("public")).alias("label"), "source_timestamp")
    return gate.read("chunks").join(documents, "document_id")


def passage(gate: Gate, chunk_id: int) -> DataFrame:
    return passages(gate).filter(F.col("chunk_id") == chunk_id)


def edges(facts: DataFrame) -> DataFrame:
    """Facts as edges between entities."""
    return facts.filter(F.col("object_id").isNotNull()).select("fact_id", "subject_id", "predicate", "object_id")


def seen(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """The ids (object_id, distinct) that are among the entities. The ids are the side that is sent or sorted, however many entities there are."""
    wanted = stored(ids, "ends")
    return stored(entities.join(wanted, "object_id").select("object_id").distinct(), "seen")


def neighbors(gate: Gate, entity_id: int, predicate: str | None = None, depth: int = 1) -> DataFrame:
    """Edge facts reached from an entity in at most `depth` hops along visible facts: fact_id, subject_id, predicate, object_id, depth of the first reach.

    Each hop joins the edges once to the entities reached last, which are written out, so that the edges are read `depth` times in all and no plan
    holds another hop's. Entities already reached are not walked again. What was reached is written out before entities are looked up, so that a walk of
    a few entities is sent to them and neither all entities nor all edges are shuffled or sorted.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth must be 1 to 5")
    entities = gate.read("entities").select(F.col("entity_id").alias("object_id"))
    walk = edges(gate.read("facts"))
    walk = walk.filter(F.col("predicate") == predicate) if predicate is not None else walk
    reached = walk.sparkSession.range(1).select(F.lit(entity_id).cast("long").alias("subject_id"), F.lit(1).alias("depth"))
    for hop in range(2, depth + 1):
        last = reached.filter(F.col("depth") == hop - 1)
        ends = seen(walk.join(last, "subject_id", "left_semi").select("object_id").distinct(), entities)
        new = ends.withColumnRenamed("object_id", "subject_id").join(reached, "subject_id", "left_anti")
        reached = reached.unionByName(stored(new.withColumn("depth", F.lit(hop)), "frontier"))
    found = stored(walk.join(reached, "subject_id"), "walked")
    return found.join(seen(found.select("object_id").distinct(), entities), "object_id").select("fact_id", "subject_id", "predicate", "object_id", "depth")
