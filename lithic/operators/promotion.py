"""Promotion of staged facts, and their supersession across versions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.storage import discard, stored
from lithic.operators.ingest import retire

TRIPLE = ("subject_id", "predicate", "object_id", "literal")


def reference(ref: Column) -> tuple[Column, Column]:
    """(kind, id) of a reference such as mention:12; a malformed one has a null id."""
    return F.split_part(ref, F.lit(":"), F.lit(1)), F.split_part(ref, F.lit(":"), F.lit(2)).try_cast("long")


def resolved_references(pending: DataFrame, mentions: DataFrame) -> DataFrame:
    """Staged facts with subject_id and object_id: the entity named, or the one the mention is resolved to, else null."""
    out = pending
    for side in ("subject", "object"):
        kind, ident = reference(F.col(f"{side}_ref"))
        m = mentions.select(F.col("mention_id").alias(f"{side}_mention"), F.col("resolved_entity_id").alias(f"{side}_resolved"))
        out = out.withColumn(f"{side}_mention", F.when(kind == "mention", ident)).join(m, f"{side}_mention", "left")
        out = out.withColumn(f"{side}_id", F.when(kind == "entity", ident).otherwise(F.col(f"{side}_resolved"))).drop(f"{side}_mention", f"{side}_resolved")
    return out


def promotable(pending: DataFrame, mentions: DataFrame, retracted: DataFrame, facts: DataFrame, ontologies: DataFrame) -> DataFrame:
    """Staged facts ready for promotion.

    Left out are those with a mention that exists unresolved, those anchored in a retracted document (document_id), and those staler
    than a current fact of their document, by (effective_from, ontology). References that lead nowhere are let through, to
    fail where they are used.
    """
    open_mentions = mentions.filter("resolved_entity_id IS NULL").select(F.concat(F.lit("mention:"), F.col("mention_id").cast("string")).alias("ref"))
    rows = pending.filter("status = 'pending'")
    for side in ("subject_ref", "object_ref"):
        rows = rows.join(open_mentions.withColumnRenamed("ref", side), side, "left_anti")
    rows = rows.join(retracted.select("document_id"), "document_id", "left_anti")
    age = F.struct("effective_from", "ontology")
    newest = facts.filter("valid_to IS NULL").join(F.broadcast(ontologies), "ontology").groupBy("document_id").agg(F.max(age).alias("newest"))  # one row per ontology version
    newest = stored(newest, "newest")
    rows = rows.join(F.broadcast(ontologies), "ontology", "left").withColumn("own", age).join(newest, "document_id", "left")
    return rows.filter(F.col("newest").isNull() | (F.col("newest") <= F.col("own"))).select(*pending.columns)


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Triples of two versions with what becomes of each: keep, insert or retire. One aggregation over both, nulls being equal."""
    keys = [c for c in TRIPLE if c in old.columns]
    both = old.select(*keys, F.lit(True).alias("before")).unionByName(new.select(*keys, F.lit(False).alias("before")))
    found = both.groupBy(*keys).agg(F.bool_or("before").alias("in_old"), F.bool_or(~F.col("before")).alias("in_new"))
    action = F.when(F.col("in_old") & F.col("in_new"), "keep").when(F.col("in_new"), "insert").otherwise("retire")
    return found.select(*keys, action.alias("action"))


def cutover(facts: DataFrame, wave: DataFrame, prior: DataFrame, first_id: int, at: datetime) -> tuple[DataFrame, DataFrame]:
    """Promote a wave of resolved staged facts at one time: (facts, promoted staged facts with the fact each became).

    prior has (document_id, prior_document_id). A triple that a prior document's current fact already states keeps the least such fact; others
    are inserted, two equal ones of a wave each, with ids in order of pending_id; current facts of prior documents that the wave doesn't state again are superseded.
    """
    prior = stored(prior, "prior")  # a few documents are sent to their many facts
    current = facts.filter("valid_to IS NULL").join(prior, facts.document_id == prior.prior_document_id).select(prior["document_id"].alias("document_id"), "fact_id", *[facts[c] for c in TRIPLE])
    least = current.groupBy("document_id", *TRIPLE).agg(F.min("fact_id").alias("kept_id"))
    w, p = wave.alias("w"), least.alias("p")
    match = F.col("w.document_id") == F.col("p.document_id")
    for c in TRIPLE:
        match = match & F.col(f"w.{c}").eqNullSafe(F.col(f"p.{c}"))
    judged = w.join(p, match, "left").select("w.*", "p.kept_id")
    fresh = judged.withColumn("fact_id", F.coalesce("kept_id", F.col("pending_id") + first_id))
    inserted = fresh.filter("kept_id IS NULL").select(
        "fact_id", "tenant_id", "subject_id", "predicate", "object_id", "literal", F.lit(None).cast("string").alias("label"), F.lit(at).alias("valid_from"),
        F.lit(None).cast(facts.schema["valid_to"].dataType).alias("valid_to"), F.lit(1.0).alias("confidence"), "document_id", "ontology", "extractor",
    )
    restated = fresh.filter("kept_id IS NOT NULL").select(F.col("kept_id").alias("fact_id")).distinct()
    stale = current.join(wave.select("document_id").distinct(), "document_id", "left_semi").select("fact_id").distinct().join(restated, "fact_id", "left_anti").withColumn("stale", F.lit(True))
    base = facts if "reason" in facts.columns else facts.withColumn("reason", F.lit(None).cast("string"))
    kept = retire(base.join(stale, "fact_id", "left"), F.coalesce("stale", F.lit(False)), at, "superseded").drop("stale")
    rows = kept.select(*base.columns).unionByName(inserted.withColumn("reason", F.lit(None).cast("string")), allowMissingColumns=True)
    return rows, fresh.select("pending_id", "fact_id", F.col("kept_id").isNotNull().alias("kept"))


def waves(pending: DataFrame) -> DataFrame:
    """Staged facts with resolved references and the number of their wave: one wave for each (document, ontology), those of a document in order of their first staged fact.

    A group that holds a reference which leads nowhere is left out in whole. Waves of a document are at most as many as there are ontologies.
    """
    broken = F.col("subject_id").isNull() | F.col("object_ref").isNotNull() & F.col("object_id").isNull()
    groups = pending.groupBy(F.col("document_id").alias("anchor"), F.col("ontology").alias("of")).agg(F.min("pending_id").alias("first"), F.bool_or(broken).alias("broken"))
    order = Window.partitionBy("anchor").orderBy("first")
    placed = groups.filter(~F.col("broken")).withColumn("wave", F.row_number().over(order)).select("anchor", "of", "wave")
    return pending.join(placed, pending.document_id.eqNullSafe(placed.anchor) & pending.ontology.eqNullSafe(placed.of)).drop("anchor", "of")


def promoted_in_waves(
    pending: DataFrame, mentions: DataFrame, retracted: DataFrame, facts: DataFrame, ontologies: DataFrame, prior: DataFrame, first_id: int, at: datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Promote all staged facts that are ready: (facts, pending, prior documents that their successors replace: document_id).

    What is ready is judged once. Then the first wave of every document is promoted at once, the second on the state that it left, and so on, each at its own time:
    what its prior versions state and it doesn't is superseded, and so are its document's facts under other ontologies or by another version of its one producer.
    Rounds are as many as a document has ontologies at most; each is a few joins over all documents and is written out.
    """
    ready = stored(waves(resolved_references(promotable(pending, mentions, retracted, facts, ontologies), mentions)), "waves")
    rounds = ready.agg(F.max("wave")).first()[0] or 0
    state, done = facts if "reason" in facts.columns else facts.withColumn("reason", F.lit(None).cast("string")), None
    for k in range(1, rounds + 1):
        now, wave = at + timedelta(microseconds=k - 1), ready.filter(F.col("wave") == k)
        after, became = cutover(state, wave, prior, first_id, now)
        became = stored(became, "promoted")
        own = wave.join(became, "pending_id").select("document_id", "fact_id", "ontology", "extractor")
        before, state = state, stored(superseded(after, own, now).select(*state.columns), "facts")
        if k > 1:
            discard(before)
        done = became if done is None else done.unionByName(became)
    done = ready.select("pending_id", F.lit(None).cast("long").alias("fact_id")).limit(0) if done is None else done.select("pending_id", "fact_id")
    marked = pending.join(done, "pending_id", "left")
    status = {"status": F.when(F.col("fact_id").isNotNull(), "promoted").otherwise(F.col("status")), "promoted_fact_id": F.coalesce("fact_id", "promoted_fact_id")}
    replaced = prior.join(ready.select("document_id").distinct(), "document_id", "left_semi").select(F.col("prior_document_id").alias("document_id")).distinct()
    return state, marked.withColumns(status).select(*pending.columns), replaced


def superseded(facts: DataFrame, promoted: DataFrame, at: datetime) -> DataFrame:
    """Retire what a wave replaces within its own documents. promoted: document_id, fact_id, ontology, extractor (name/version) of the wave's facts, kept ones too.

    A document's wave under exactly one ontology retires its current facts of other ontologies. If there are none and the wave has exactly one producer,
    it retires current facts of that ontology by the same extractor in another version. Versions are only compared for being the same.
    Mixed waves retire nothing, and the wave's own facts always stay. What is known of a wave's documents is put together and written out before it meets the facts,
    once: no join has the many facts of other documents under one empty key, and a few documents are sent to the facts.
    """
    name, version = (F.split_part(F.col("extractor"), F.lit("/"), F.lit(k)) for k in (1, 2))
    wave = promoted.groupBy(F.col("document_id").alias("wave_document")).agg(
        F.min("ontology").alias("new_ontology"), F.count_distinct("ontology").alias("ontologies"),
        F.min(name).alias("new_name"), F.min(version).alias("new_version"), F.count_distinct("extractor").alias("producers"),
    )
    own = promoted.select("fact_id").distinct().withColumn("own", F.lit(True))
    wave, own = stored(wave, "wave-documents"), stored(own, "wave-facts")
    old = F.col("valid_to").isNull() & F.col("own").isNull() & (F.col("ontologies") == 1)
    other = old & (F.col("ontology") != F.col("new_ontology"))
    within = facts.join(wave, facts.document_id == wave.wave_document).select("fact_id", "valid_to", "ontology", "wave_document", "ontologies", "new_ontology")
    switched = within.join(own, "fact_id", "left").filter(other).select("wave_document").distinct().withColumn("switched", F.lit(True))
    wave = stored(wave.join(switched, "wave_document", "left"), "wave-documents")
    joined = facts.join(wave, facts.document_id == wave.wave_document, "left").join(own, "fact_id", "left")
    same = old & F.col("switched").isNull() & (F.col("producers") == 1) & (name == F.col("new_name")) & (version != F.col("new_version"))
    base = joined if "reason" in facts.columns else joined.withColumn("reason", F.lit(None).cast("string"))
    rows = retire(base, F.coalesce(other, F.lit(False)), at, "ontology_superseded")
    return retire(rows, F.coalesce(same, F.lit(False)), at, "extractor_superseded").select(*dict.fromkeys([*facts.columns, "reason"]))


def selected_ontology(ontologies: DataFrame, pointer: DataFrame) -> DataFrame:
    """The ontology pointed at, else the one that took effect last."""
    newest = ontologies.orderBy(F.desc("effective_from"), F.desc("ontology")).limit(1).select(F.col("ontology").alias("newest"))
    return newest.join(pointer.select(F.col("ontology").alias("pointed")).limit(1), how="left").select(F.coalesce("pointed", "newest").alias("ontology"))


def reextraction_scope(documents: DataFrame, runs: DataFrame, extractor: str, ontology: str, source: str | None = None) -> DataFrame:
    """Current documents without a good run of this extractor and ontology, optionally of one source."""
    rows = documents if source is None else documents.filter(F.col("source_system") == source)
    done = runs.filter((F.col("status") == "ok") & (F.col("extractor") == extractor) & (F.col("ontology") == ontology)).select(F.col("document_id").alias("raw_id"))
    return rows.join(done, "raw_id", "left_anti").select("raw_id", "source_system")
