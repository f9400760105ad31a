"""What resolution writes down, and what reviewers' verdicts do: candidate rows, conflicts, labels, the ledger, aliases and new entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions.text import name_ratio

NO_STRINGS = "array<string>"


def candidate_rows(scored: DataFrame, decisions: DataFrame) -> DataFrame:
    """scored: mention_id, entity_id, score, band; decisions: mention_id, entity_id (chosen), decision, reason. Each candidate with what became of it: decision, reason.

    The chosen one of a resolved mention is merged; high and gray ones of a mention in review are up for review; all others are kept apart, without a reason.
    """
    outcome = decisions.select("mention_id", F.col("entity_id").alias("chosen"), F.col("decision").alias("outcome"), F.col("reason").alias("why"))
    rows = scored.join(outcome, "mention_id")
    merged = (F.col("outcome") == "resolved") & (F.col("entity_id") == F.col("chosen"))
    decision = F.when(merged, "auto_merge").when((F.col("outcome") == "review") & F.col("band").isin("high", "gray"), "review").otherwise("auto_separate")
    rows = rows.withColumn("decision", decision)
    return rows.select("mention_id", "entity_id", "score", "band", "decision", F.when(F.col("decision") != "auto_separate", F.col("why")).alias("reason"))


def key_conflicts(hits: DataFrame) -> DataFrame:
    """hits: mention_id, entity_id by a shared strong key. Where a mention's key names several entities, each and the next by id, to be
    reviewed as duplicates: left_id, right_id, via (the least such mention).
    """
    groups = hits.groupBy("mention_id").agg(F.array_sort(F.collect_set("entity_id")).alias("ids")).filter(F.size("ids") > 1)
    nexts = F.zip_with("ids", F.slice("ids", F.lit(2), F.size("ids")), lambda a, b: F.struct(a.alias("left_id"), b.alias("right_id")))
    pairs = groups.select("mention_id", F.explode(nexts).alias("p")).filter("p.right_id IS NOT NULL")
    return pairs.groupBy("p.left_id", "p.right_id").agg(F.min("mention_id").alias("via"))


def ledger(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per mention decided: decision, entity, score and the candidate row it rests on, the chosen entity's or else the best one's."""
    chosen = decisions.select("mention_id", F.col("entity_id").alias("chosen"), "decision")
    rows = chosen.join(candidates.select("mention_id", "entity_id", "score"), "mention_id", "left")
    fits = F.coalesce(F.col("entity_id") == F.col("chosen"), F.lit(False))
    best = rows.groupBy("mention_id", "decision", "chosen").agg(F.max(F.struct(fits.alias("fits"), "score", (-F.col("entity_id")).alias("least"))).alias("top"))
    return best.select("mention_id", "decision", F.when(F.col("decision") == "resolved", F.col("chosen")).alias("entity_id"), F.col("top.score").alias("score"), (-F.col("top.least")).alias("rests_on"))


def deterministic_labels(decisions: DataFrame) -> DataFrame:
    """A mention resolved by its key alone is a labelled match."""
    return decisions.filter("decision = 'resolved' AND tier = 't0'").select("mention_id", "entity_id", F.lit("er_match").alias("label"), F.lit("deterministic").alias("source"))


def enriched_entities(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entities (entity_id, name, aliases, attributes) after mentions (mention_id, entity_id, surface, keys) were resolved to them.

    A surface form becomes an alias once; keys fill attributes that are missing, of several mentions the last by id, and never replace one.
    """
    names = resolved.groupBy("entity_id").agg(F.array_sort(F.collect_set("surface")).alias("offered"))
    filled = resolved.select("entity_id", "mention_id", F.explode("keys").alias("key", "value")).filter("value IS NOT NULL AND value <> ''")
    values = filled.groupBy("entity_id", "key").agg(F.min_by("value", "mention_id").alias("value")).groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("values"))
    rows = entities.join(names, "entity_id", "left").join(values, "entity_id", "left")
    aliases = F.concat("aliases", F.coalesce(F.array_except("offered", "aliases"), F.array().cast(NO_STRINGS)))
    gaps = F.coalesce(F.map_filter("values", lambda k, _: ~F.map_contains_key("attributes", k)), F.create_map().cast("map<string,string>"))
    return rows.withColumns({"aliases": aliases, "attributes": F.map_concat(gaps, "attributes")}).select(*entities.columns)


def seeded_entities(mentions: DataFrame) -> DataFrame:
    """mentions: new_id, tenant_id, entity_type, surface, keys. The entities that new mentions start: named and aliased by the surface form, with its keys."""
    keys = F.coalesce(F.map_filter("keys", lambda _, v: v.isNotNull() & (v != "")), F.create_map().cast("map<string,string>"))
    return mentions.select(F.col("new_id").alias("entity_id"), "tenant_id", "entity_type", F.col("surface").alias("name"), F.array("surface").alias("aliases"), keys.alias("attributes"))


def label_of(same: Column) -> Column:
    return F.when(same, "er_match").otherwise("er_nonmatch")


def decided_matches(candidates: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """candidates: candidate_id, left_type, left_id, right_id, decision, score; verdicts: candidate_id, same, reviewer, of which only those on rows in review count.

    (candidates after, labels, mentions to resolve, entities to merge). A yes on a mention resolves it, a yes on a pair of entities merges the left into the right; yes and no both are labels.
    """
    ruled = candidates.filter("decision = 'review'").join(verdicts, "candidate_id").select("candidate_id", "left_type", "left_id", "right_id", "score", "same", "reviewer")
    marks = ruled.select("candidate_id", F.when(F.col("same"), "applied").otherwise("auto_separate").alias("ruling"), F.col("reviewer").alias("reviewed_by"))
    after = candidates.join(marks, "candidate_id", "left").withColumn("decision", F.coalesce("ruling", "decision")).drop("ruling")
    labels = ruled.select("candidate_id", "left_type", "left_id", "right_id", label_of(F.col("same")).alias("label"), F.lit("human_review").alias("source"), "reviewer")
    yes = ruled.filter("same")
    resolve = yes.filter("left_type = 'mention'").select(F.col("left_id").alias("mention_id"), F.col("right_id").alias("entity_id"), "score")
    merge = yes.filter("left_type = 'entity'").select(F.col("left_id").alias("merged_id"), F.col("right_id").alias("survivor_id"))
    return after, labels, resolve, merge


def refused_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts that rule on nothing: candidate_id, fault."""
    rows = verdicts.join(candidates.select("candidate_id", "decision"), "candidate_id", "left")
    fault = F.when(F.col("decision").isNull(), "not found").when(F.col("decision") != "review", "not awaiting review")
    return rows.select("candidate_id", fault.alias("fault")).filter("fault IS NOT NULL")


def resolved_as_new(candidates: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mentions: mention_id, reviewer, of mentions that none of their candidates match: (candidates after, a hard negative for each that was in review)."""
    of = mentions.select(F.col("mention_id").alias("left_id"), F.lit("mention").alias("left_type"), F.col("reviewer").alias("reviewed_by"))
    rows = candidates.join(of, ["left_id", "left_type"], "left")
    ruled = F.col("reviewed_by").isNotNull() & (F.col("decision") == "review")
    labels = rows.filter(ruled).select("candidate_id", "left_type", "left_id", "right_id", F.lit("er_nonmatch").alias("label"), F.lit("human_review").alias("source"), F.col("reviewed_by").alias("reviewer"))
    after = rows.withColumns({"decision": F.when(ruled, "auto_separate").otherwise(F.col("decision")), "reviewed_by": F.when(ruled, F.col("reviewed_by"))})
    return after.select(*candidates.columns, "reviewed_by"), labels


def best_variants(pairs: DataFrame) -> DataFrame:
    """pairs: mention_id, entity_id, surface, names (the entity's name, then its aliases). The name most similar to the surface, of equals the first: variant, similarity.

    Equal names are told apart in the JVM, and each distinct pair of names is compared once.
    """
    each = pairs.select("mention_id", "entity_id", "surface", F.posexplode("names").alias("place", "variant"))
    same = F.lower(F.trim("surface")) == F.lower(F.trim("variant"))
    compared = each.filter(~same).select("surface", "variant").distinct().withColumn("ratio", name_ratio(F.col("surface"), F.col("variant")))
    rows = each.join(compared, ["surface", "variant"], "left").withColumn("similarity", F.when(same, 1.0).otherwise(F.col("ratio")))
    best = rows.groupBy("mention_id", "entity_id").agg(F.max(F.struct("similarity", (-F.col("place")).alias("first"), "variant")).alias("top"))
    return best.select("mention_id", "entity_id", "top.variant", "top.similarity")


# From when a score speaks for a match, and below which against one.
NAME_EVIDENCE, COSINE_EVIDENCE = (0.75, 0.5), (0.8, 0.6)
TIER_WORDS = {"tier0": "same key", "tier1": "names and keys", "tier1b": "names and context", "tier1c": "shared facts"}


def evidence(tier: Column, name_similarity: Column, cosine: Column, key_matches: Column, shared: Column) -> tuple[Column, Column, Column]:
    """(plain words for the tier, what speaks for a match, what speaks against it)."""
    words = F.create_map(*[F.lit(x) for pair in TIER_WORDS.items() for x in pair])
    some = lambda *cases: F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in cases]))
    pro = some((name_similarity >= NAME_EVIDENCE[0], "names are alike"), (cosine >= COSINE_EVIDENCE[0], "contexts are alike"), (key_matches, "a key is the same"), (shared > 0, "facts are shared"))
    contra = some((name_similarity < NAME_EVIDENCE[1], "names differ"), (cosine < COSINE_EVIDENCE[1], "contexts differ"), (~key_matches, "no key is the same"))
    return F.coalesce(F.element_at(words, tier), tier), pro, contra
