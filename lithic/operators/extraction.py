"""Fact extraction: table maps, parser output, quotes and their grounding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.text import canonical_predicate, find_span, normalised_predicate

# A mapped column: name -> (predicate, entity type of the object, or None for a literal).
ColumnMap = dict[str, tuple[str, str | None]]
GROUNDING_PENALTY = 0.5


def mapped_facts(rows: DataFrame, subject: str, columns: ColumnMap, entity_type: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Facts from a table by a column map, and quarantine with one row per bad mapping.

    Each mapped column is unpivoted; empty cells give nothing; aliases are normalised and sides swapped where they say so. A
    mapping to an unknown column or predicate is quarantined once, not per row.
    """
    spark = rows.sparkSession
    known = spark.range(1).select(*[normalised_predicate(F.lit(p))[0].alias(f"p{i}") for i, (p, _) in enumerate(columns.values())]).first()
    bad = [(c, "validation_failure" if c not in rows.columns else "unbound_predicate") for i, (c, (p, _)) in enumerate(columns.items()) if c not in rows.columns or known[i] is None]
    good = {c: v for c, v in columns.items() if c not in {b[0] for b in bad}}
    quarantine = spark.createDataFrame(bad, "mapped_column string, reason string")
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value"), *[x.alias(n) for n, x in zip(("predicate", "swap"), normalised_predicate(F.lit(p)), strict=True)], F.lit(t).cast("string").alias("object_type"))
            for c, (p, t) in good.items()
        ]
    ).cast("array<struct<column:string,value:string,predicate:string,swap:boolean,object_type:string>>")
    flat = rows.select(F.col(row_id).alias("row_id"), F.trim(F.col(subject).cast("string")).alias("subject"), F.explode(cells).alias("c")).filter("c.value <> '' AND subject <> ''")
    swap = F.col("c.swap") & F.col("c.object_type").isNotNull()
    facts = flat.select(
        "row_id", F.col("c.column").alias("mapped_column"), F.when(swap, F.col("c.value")).otherwise(F.col("subject")).alias("subject"), F.col("c.predicate").alias("predicate"),
        F.when(F.col("c.object_type").isNotNull(), F.when(swap, F.col("subject")).otherwise(F.col("c.value"))).alias("object"),
        F.when(F.col("c.object_type").isNull(), F.col("c.value")).alias("literal"),
        F.when(swap, F.col("c.object_type")).otherwise(F.lit(entity_type)).alias("subject_type"),
    )
    return facts, quarantine


def conformed(candidates: DataFrame, types: list[str], predicates: tuple[str, ...], keys: DataFrame | None = None) -> DataFrame:
    """Parser candidates (subject, subject_type, predicate, object, literal) with predicate normalised, sides swapped, and `reason` for those that go
    to quarantine: shape first, then vocabulary, then key clashes."""
    name, swap = normalised_predicate(F.col("predicate"), predicates)
    shape = (F.trim(F.coalesce("subject", F.lit(""))) != "") & (F.col("object").isNotNull() != F.col("literal").isNotNull())
    self_reference = F.coalesce(F.lower("subject") == F.lower("object"), F.lit(False))
    reason = (
        F.when(~shape | self_reference, "validation_failure").when(~F.coalesce(F.col("subject_type").isin(types), F.lit(False)), "unbound_entity_type").when(name.isNull(), "unbound_predicate")
    )
    turn = swap & F.col("object").isNotNull()
    rows = candidates.withColumns({"reason": reason, "predicate": F.coalesce(name, F.col("predicate")), "_turn": turn, "_s": F.col("subject"), "_o": F.col("object")})
    rows = rows.withColumns({"subject": F.when(F.col("_turn"), F.col("_o")).otherwise(F.col("_s")), "object": F.when(F.col("_turn"), F.col("_s")).otherwise(F.col("_o"))}).drop("_turn", "_s", "_o")
    if keys is not None:  # surface, entity_type, key_name, key_value: two values of one key are a clash
        clash = keys.groupBy(F.col("surface").alias("subject"), F.col("entity_type").alias("subject_type"), "key_name").agg(F.count_distinct("key_value").alias("n")).filter("n > 1")
        rows = rows.join(clash.select("subject", "subject_type").distinct().withColumn("clash", F.lit(True)), ["subject", "subject_type"], "left")
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("clash"), "validation_failure"))).drop("clash")
    return rows


def best_of_unit(facts: DataFrame) -> DataFrame:
    """Identical facts of a unit once, with the greatest confidence."""
    return facts.groupBy("unit_id", "subject", "predicate", "object", F.lower("literal").alias("literal_key")).agg(F.max("confidence").alias("confidence"), F.min("literal").alias("literal")).drop("literal_key")


def grounded(rows: DataFrame) -> DataFrame:
    """Rows (quote, subject, object, text, declared_start, declared_end, confidence) with grounding, span and confidence.

    Declared offsets are verified against the quote, white space and case aside; otherwise the quote and then its
    components are looked for. What fails is flagged and its confidence halved, not dropped.
    """
    squeezed = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    declared = F.col("declared_start").isNotNull() & F.col("declared_end").isNotNull()
    stated = F.substr(F.col("text"), F.col("declared_start") + 1, F.col("declared_end") - F.col("declared_start"))
    rows = rows.withColumn("_span", find_span("quote", "text"))
    inside = lambda c: F.col(c).isNull() | (F.instr(squeezed(F.col("quote")), squeezed(F.col(c))) > 0)
    outcome = (
        F.when(F.col("text").isNull(), "construction")
        .when(declared, F.when(squeezed(stated) == squeezed(F.col("quote")), "declared_span").otherwise("span_mismatch"))
        .when(F.col("_span.start").isNull(), "span_missing")
        .when(~(inside("subject") & inside("object")), "components_missing")
        .otherwise("pass")
    )
    rows = rows.withColumn("grounding", outcome)
    flagged = F.col("grounding").isin("span_missing", "components_missing", "span_mismatch")
    return rows.withColumns(
        {
            "span_start": F.when(F.col("grounding") == "declared_span", F.col("declared_start")).when(~flagged, F.col("_span.start")),
            "span_end": F.when(F.col("grounding") == "declared_span", F.col("declared_end")).when(~flagged, F.col("_span.end")),
            "confidence": F.when(flagged, F.col("confidence") * GROUNDING_PENALTY).otherwise(F.col("confidence")),
        }
    ).drop("_span")


def containing_chunk(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """spans: span_id, doc_id, start, end. The first parent chunk that contains each span, or null: span_id, chunk_seq."""
    parents = chunks.filter("level = 'parent'").select("doc_id", F.col("seq").alias("chunk_seq"), F.col("start").alias("cs"), F.col("end").alias("ce"))
    inside = spans.join(parents, "doc_id").filter("cs <= start AND end <= ce").groupBy("span_id").agg(F.min("chunk_seq").alias("chunk_seq"))
    return spans.select("span_id").join(inside, "span_id", "left")


def document_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with the earliest mention of the same surface and type in their document."""
    same = Window.partitionBy("document_id", F.lower("surface"), "entity_type").orderBy("mention_id")
    return mentions.withColumn("first_mention_id", F.first("mention_id").over(same))


def digest_of(mentions: DataFrame, pending: DataFrame, cap: int = 15) -> DataFrame:
    """The most referenced mentions of each document: document_id, mention_id, refs, place."""
    refs = pending.select(F.col("subject_ref").alias("ref")).unionByName(pending.select(F.col("object_ref").alias("ref"))).groupBy("ref").agg(F.count("*").alias("refs"))
    rows = mentions.withColumn("ref", F.concat(F.lit("mention:"), F.col("mention_id").cast("string"))).join(refs, "ref", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    order = Window.partitionBy("document_id").orderBy(F.desc("refs"), "mention_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap).select("document_id", "mention_id", "refs", "place")


def units_to_do(units: DataFrame, runs: DataFrame) -> DataFrame:
    """Units without a good run of the same tenant, hash, extractor, its version and ontology."""
    key = [c for c in ("tenant_id", "unit_hash", "extractor", "extractor_version", "ontology") if c in units.columns]
    return units.join(runs.filter("status = 'ok'").select(*key), key, "left_anti").select(*units.columns)


def staged(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """Facts with local keys turned into mention references by keys (unit_id, local_key, mention_id), and a size alarm.

    The size is the number of lines of a fact printed as JSON: two brackets and one line a field; above 70 it alarms.
    """
    k = lambda side: keys.select("unit_id", F.col("local_key").alias(side), F.concat(F.lit("mention:"), F.col("mention_id").cast("string")).alias(f"{side}_ref"))
    rows = facts.join(k("subject"), ["unit_id", "subject"], "left").join(k("object"), ["unit_id", "object"], "left")
    lines = F.lit(2) + F.size(F.filter(F.array(*[F.col(c).cast("string") for c in facts.columns]), lambda x: x.isNotNull()))
    return rows.withColumns({"n_lines": lines, "oversized": lines > 70})


Extractor = Callable[[str], list[tuple[str, str, str]]]


def rule_facts(text: str) -> list[tuple[str, str, str]]:
    """Facts of the form `A is B` and `A: B` in short sentences, where no model is at hand: (subject, predicate, object)."""
    out = []
    for sentence in text.replace("\n", ". ").split("."):
        for mark, predicate in ((" is ", "references"), (": ", "mentions")):
            a, hit, b = sentence.partition(mark)
            if hit and 0 < len(a.split()) <= 4 and 0 < len(b.split()) <= 6:
                out.append((a.strip(), predicate, b.strip()))
    return out


def extracted(units: DataFrame, extractor: Extractor = rule_facts) -> DataFrame:
    """units: unit_id, text. Facts that an extractor finds in each unit: unit_id, subject, predicate, object."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(u, *fact) for u, t in zip(f.unit_id, f.text, strict=True) for fact in extractor(t or "")]
            yield pd.DataFrame(rows, columns=["unit_id", "subject", "predicate", "object"])

    return units.select("unit_id", "text").mapInPandas(run, "unit_id long, subject string, predicate string, object string")


def provision_facts(provisions: DataFrame) -> DataFrame:
    """Facts of parsed provisions (identifier, parent, heading, refs): part_of, has_heading and references.

    References are matched with known provisions by normalised identifier; those to the provision itself go.
    """
    normal = lambda c: F.regexp_replace(F.lower(c), r"/+$", "")
    known = provisions.select(normal(F.col("identifier")).alias("key"), F.col("identifier").alias("object"))
    refs = provisions.select("identifier", F.explode("refs").alias("href")).filter(F.startswith(F.lower("href"), F.lit("/us/usc/"))).select("identifier", normal(F.col("href")).alias("key"))
    fact = lambda df, predicate, obj, lit: df.select(F.col("identifier").alias("subject"), F.lit(predicate).alias("predicate"), obj.cast("string").alias("object"), lit.cast("string").alias("literal"))
    return (
        fact(provisions.filter("parent IS NOT NULL"), "part_of", F.col("parent"), F.lit(None))
        .unionByName(fact(provisions.filter("heading IS NOT NULL"), "has_heading", F.lit(None), F.col("heading")))
        .unionByName(fact(refs.join(known, "key").filter("object <> identifier").distinct(), "references", F.col("object"), F.lit(None)))
    )


def predicate_use(values: DataFrame, column: str) -> DataFrame:
    """How often each canonical predicate occurs and what it is normalised to."""
    name, swap = normalised_predicate(F.col(column))
    return values.groupBy(canonical_predicate(F.col(column)).alias("canonical"), name.alias("normalised"), F.coalesce(swap, F.lit(False)).alias("swapped")).agg(F.count("*").alias("n"))
