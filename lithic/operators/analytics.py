"""Operational analytics over pipeline state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The monitor's list of low-confidence outcomes lacks span_mismatch, unlike the served state's; kept as it is.
MONITOR_FLAGGED = ("span_missing", "components_missing")
PASS_STATUSES = ("pass", "declared_span", "span_missing", "components_missing")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def status_counts(rows: DataFrame, by: str = "status") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def attention_counts(pending: DataFrame) -> DataFrame:
    """Staged facts by tenant: all, oversized, flagged, and any of both or in review."""
    flagged = F.col("grounding").isin(*MONITOR_FLAGGED)
    return pending.groupBy("tenant_id").agg(
        F.count("*").alias("staged"),
        F.count_if("oversized").alias("oversized"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(F.col("oversized") | flagged | (F.col("status") == "review")).alias("attention"),
    )


def review_counts(pending: DataFrame, mentions: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Open reviews of three kinds and their total, as one row."""
    parts = pending.filter("oversized").select(F.lit("oversized").alias("kind")).unionByName(mentions.filter("status = 'review'").select(F.lit("merge").alias("kind")))
    parts = parts.unionByName(quarantine.filter("open").select(F.lit("quarantine").alias("kind")))
    is_kind = lambda k: F.count_if(F.col("kind") == k)
    return parts.agg(is_kind("oversized").alias("oversized"), is_kind("merge").alias("merge"), is_kind("quarantine").alias("quarantine"), F.count("*").alias("total"))


def throughput(events: DataFrame, as_of: datetime, minutes: int = 28) -> DataFrame:
    """Events per minute over the last minutes up to as_of, with zeros: minute, n."""
    end = F.date_trunc("minute", F.lit(as_of).cast("timestamp_ntz"))
    start = end - F.make_dt_interval(mins=F.lit(minutes - 1))
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MINUTE"))).alias("minute"))
    counts = events.filter((F.col("ts") >= start) & (F.col("ts") <= F.lit(as_of).cast("timestamp_ntz"))).groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))
    return spine.join(counts, "minute", "left").select("minute", F.coalesce("n", F.lit(0)).alias("n"))


def contract(extractor: Column) -> Column:
    """The contract named after the slash of an extractor version, else p1."""
    return F.when(F.instr(extractor, "/") > 0, F.split_part(extractor, F.lit("/"), F.lit(2))).otherwise("p1")


def contract_comparison(runs: DataFrame) -> DataFrame:
    totals = runs.groupBy(contract(F.col("extractor")).alias("contract")).agg(
        F.count("*").alias("units"),
        F.sum("facts").alias("facts"),
        F.sum("quarantined").alias("quarantined"),
        F.sum("flagged").alias("flagged"),
        F.avg("wall_ms").alias("avg_ms"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"),
    )
    return totals.select(
        "contract", "units", "facts",
        ratio(F.col("facts"), F.col("units")).alias("facts_per_unit"),
        ratio(F.col("quarantined"), F.col("facts") + F.col("quarantined")).alias("quarantine_rate"),
        ratio(F.col("flagged"), F.col("facts")).alias("flag_rate"),
        "avg_ms",
        ratio(F.col("tokens"), F.col("units")).alias("tokens_per_unit"),
    )


def grounding_outcomes(pending: DataFrame) -> DataFrame:
    """Counts per outcome, with its share of the four outcomes that the pass rate is taken over."""
    base = F.col("grounding").isin(*PASS_STATUSES)
    counts = pending.groupBy("grounding").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "promoted").alias("promoted"))
    total = counts.agg(F.sum(F.when(base, F.col("n"))).alias("total"))
    return counts.join(F.broadcast(total)).select("grounding", "n", "promoted", F.when(base, ratio(F.col("n"), F.col("total"))).alias("share"))  # one row


def crosstab(rows: DataFrame, row: Column, column: str, values: list[str]) -> DataFrame:
    """Counts of rows by a key and the listed values of a column, zero-filled."""
    return rows.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def tier_decisions(candidates: DataFrame) -> DataFrame:
    table = candidates.groupBy("tier")
    return table.agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("resolved", "review", "new_entity")], F.avg("wall_ms").alias("avg_ms"))


def score_histogram(candidates: DataFrame) -> DataFrame:
    """Five bins of width 0.2; the last is open."""
    s = F.col("score")
    edge = F.when(s < 0.2, 0).when(s < 0.4, 1).when(s < 0.6, 2).when(s < 0.8, 3).otherwise(4)
    return candidates.filter(s.isNotNull()).groupBy(edge.alias("bin")).agg(F.count("*").alias("n"))


def latency_percentiles(samples: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles per group as the element at index min(floor(p n), n - 1) of the sorted values.

    Ranks come from a running count over (value) counts, so a group's values are reduced to distinct values before they
    meet in one task.
    """
    counts = samples.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    window = Window.partitionBy(by)
    placed = counts.withColumn("n", F.sum("k").over(window)).withColumn("upto", F.sum("k").over(window.orderBy("v")))
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)
    return placed.groupBy(by).agg(*[F.min(F.when(F.col("upto") > at(p), F.col("v"))).alias(f"p{round(p * 100)}") for p in shares], F.first("n").alias("n"))


def latest_samples(samples: DataFrame, by: str, ts: str, tie: str, size: int = 2048) -> DataFrame:
    """The newest samples of each group."""
    newest = Window.partitionBy(by).orderBy(F.desc(ts), F.desc(tie))
    return samples.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= size).drop("age")


def review_queue(pending: DataFrame, mentions: DataFrame, quarantine: DataFrame, candidates: DataFrame, runs: DataFrame, documents: DataFrame) -> DataFrame:
    """Everything that waits for a person: kind, ref_id, detail."""
    part = lambda df, kind, ref, detail: df.select(F.lit(kind).alias("kind"), F.col(ref).cast("long").alias("ref_id"), detail.cast("string").alias("detail"))
    return (
        part(pending.filter("oversized"), "oversized_fact", "pending_id", F.col("predicate"))
        .unionByName(part(pending.filter(F.col("grounding").isin(*MONITOR_FLAGGED) & (F.col("status") == "pending")), "flagged_grounding", "pending_id", F.col("grounding")))
        .unionByName(part(mentions.filter("status = 'review'"), "entity_merge", "mention_id", F.col("surface")))
        .unionByName(part(quarantine.filter("open"), "quarantine", "quarantine_id", F.col("reason")))
        .unionByName(part(candidates.filter("open AND decision = 'review'"), "match_candidate", "candidate_id", F.col("tier")))
        .unionByName(part(documents.filter("needs_review"), "document", "doc_id", F.col("source")))
    )


def operator_alerts(queue: DataFrame, runs: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Unacknowledged failures of the queue, failed runs and open quarantine: kind, ref_id, message, created_at."""
    return (
        queue.filter("last_error IS NOT NULL AND status <> 'done' AND NOT acknowledged")
        .select(F.lit("queue").alias("kind"), F.col("queue_id").alias("ref_id"), F.col("last_error").alias("message"), F.col("available_at").alias("created_at"))
        .unionByName(runs.filter("status = 'error'").select(F.lit("run").alias("kind"), F.col("run_id").alias("ref_id"), F.col("extractor").alias("message"), F.col("started_at").alias("created_at")))
        .unionByName(quarantine.filter("open").select(F.lit("quarantine").alias("kind"), F.col("quarantine_id").alias("ref_id"), F.col("reason").alias("message"), "created_at"))
    )


def activity_feed(parts: dict[str, tuple[DataFrame, str, str]], per_source: int = 30, limit: int = 30) -> DataFrame:
    """The newest entries over several sources: kind, ref_id, happened_at. Each source is cut to its newest before they are merged."""
    feed = None
    for kind, (df, ref, ts) in parts.items():
        top = df.select(F.lit(kind).alias("kind"), F.col(ref).cast("long").alias("ref_id"), F.col(ts).alias("happened_at")).orderBy(F.desc("happened_at"), "ref_id").limit(per_source)
        feed = top if feed is None else feed.unionByName(top)
    return feed.orderBy(F.desc("happened_at"), "kind", "ref_id").limit(limit)


def entity_cards(entities: DataFrame, facts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per entity its fact and document counts and its aliases (surfaces resolved to it)."""
    sides = facts.select(F.col("subject_id").alias("entity_id"), "fact_id", "document_id").unionByName(
        facts.filter("object_id IS NOT NULL").select(F.col("object_id").alias("entity_id"), "fact_id", "document_id")
    )
    counts = sides.groupBy("entity_id").agg(F.count_distinct("fact_id").alias("n_facts"), F.count_distinct("document_id").alias("n_documents"))
    aliases = mentions.filter("resolved_entity_id IS NOT NULL").groupBy(F.col("resolved_entity_id").alias("entity_id")).agg(F.array_sort(F.collect_set("surface")).alias("aliases"))
    rows = entities.join(counts, "entity_id", "left").join(aliases, "entity_id", "left")
    return rows.select(
        "entity_id", "name", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce(F.array_join("aliases", "|"), F.lit("")).alias("aliases"),
    )


def merge_queue(candidates: DataFrame, mentions: DataFrame, entities: DataFrame, limit: int = 200) -> DataFrame:
    """Undecided candidates with both sides' names, least score first. The left side is a mention or an entity."""
    m = mentions.select(F.col("mention_id").alias("left_id"), F.col("surface").alias("mention_name"), F.lit("mention").alias("left_type"))
    e = entities.select(F.col("entity_id").alias("left_id"), F.col("name").alias("entity_name"), F.lit("entity").alias("left_type"))
    r = entities.select(F.col("entity_id").alias("right_id"), F.col("name").alias("right_name"))
    top = candidates.filter("decision = 'review'").orderBy("score", "candidate_id").limit(limit)
    rows = top.join(m, ["left_type", "left_id"], "left").join(e, ["left_type", "left_id"], "left").join(r, "right_id", "left")
    name = F.when(F.col("left_type") == "mention", F.col("mention_name")).otherwise(F.col("entity_name"))
    return rows.select("candidate_id", "left_type", name.alias("left_name"), "right_name", "score")


def usage_counts(usage: DataFrame) -> DataFrame:
    """usage: principal, fields (array). Reads and distinct principals per field."""
    return usage.select("principal", F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("reads"), F.count_distinct("principal").alias("principals"))


def job_rollup(passes: DataFrame) -> DataFrame:
    """Sums of counters over the passes of a job: job_id, passes, facts, quarantined, failed."""
    return passes.groupBy("job_id").agg(F.count("*").alias("passes"), F.sum("facts").alias("facts"), F.sum("quarantined").alias("quarantined"), F.count_if(F.col("status") == "error").alias("failed"))


def superseded_since(facts: DataFrame, since: datetime) -> DataFrame:
    return facts.filter(F.col("valid_to") >= F.lit(since)).groupBy("predicate").agg(F.count("*").alias("n"))


def corpus_summary(documents: DataFrame, chunks: DataFrame, pending: DataFrame, mentions: DataFrame) -> DataFrame:
    """Counts of a corpus as (what, n) rows."""
    row = lambda df, what, cond=None: df.agg((F.count("*") if cond is None else F.count_if(cond)).alias("n")).select(F.lit(what).alias("what"), "n")
    return (
        row(documents, "documents")
        .unionByName(row(chunks, "child_chunks", F.col("level") == "child"))
        .unionByName(row(pending, "pending", F.col("status") == "pending"))
        .unionByName(row(mentions, "mentions"))
        .unionByName(row(mentions, "keyed_mentions", F.col("key_value").isNotNull()))
    )


def drafted_gold(facts: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Draft gold items: facts and quarantine reasons grouped by document."""
    f = facts.groupBy("document_id").agg(F.array_sort(F.collect_set("predicate")).alias("predicates"), F.count("*").alias("n_facts"))
    q = quarantine.groupBy("document_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.count("*").alias("n_quarantined"))
    rows = f.join(q, "document_id", "full")
    text = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("document_id", text("predicates").alias("predicates"), zero("n_facts"), text("reasons").alias("reasons"), zero("n_quarantined"))


def ledger_status(shipped: DataFrame, recorded: DataFrame) -> DataFrame:
    """Migrations shipped (name, checksum) against those recorded: applied, pending, changed or unknown."""
    a, b = shipped.withColumnRenamed("checksum", "ours"), recorded.withColumnRenamed("checksum", "theirs")
    status = F.when(F.col("theirs").isNull(), "pending").when(F.col("ours").isNull(), "unknown").when(F.col("ours") != F.col("theirs"), "changed").otherwise("applied")
    return a.join(b, "name", "full").select("name", status.alias("status"))


def ontology_listing(ontologies: DataFrame, active: DataFrame) -> DataFrame:
    """Ontologies (ontology, effective_from, entity_types, predicates) with their sizes and whether they are the active one, newest first."""
    rows = ontologies.join(active.select("ontology", F.lit(True).alias("on")), "ontology", "left")
    return rows.select("ontology", "effective_from", F.size("entity_types").alias("types"), F.size("predicates").alias("predicates"), F.coalesce("on", F.lit(False)).alias("active")).orderBy(F.desc("effective_from"), "ontology")


def newest_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def queue_leftovers(queue: DataFrame, runs: DataFrame) -> DataFrame:
    """What a drain has left over, as one row: open queue rows and failed runs."""
    a = queue.agg(F.count_if(F.col("status").isin("queued", "error")).alias("queued"))
    return a.join(runs.agg(F.count_if(F.col("status") == "error").alias("failed_runs")))


def flagged_documents(documents: DataFrame, raw: DataFrame) -> DataFrame:
    """Documents to be reviewed with where they came from."""
    return documents.filter("needs_review").join(raw.select(F.col("raw_id").alias("doc_id"), "source_system", "native_id"), "doc_id", "left").select("doc_id", "source_system", "native_id")


def corpus_size(raw: DataFrame) -> DataFrame:
    """Landed versions and the logical documents they are of; those without a native id count one by one."""
    return raw.agg(
        F.count_distinct("raw_id").alias("versions"), F.count_distinct("tenant_id", "source_system", "native_id").alias("documents"), F.count_if(F.col("native_id").isNull()).alias("without_id")
    )


def producers(facts: DataFrame) -> DataFrame:
    """Who made the current facts of each document, under which ontology: document_id, ontology, extractor."""
    return facts.filter("valid_to IS NULL").select("document_id", "ontology", "extractor").distinct()


def review_totals(queue: DataFrame) -> DataFrame:
    """The review queue by kind, and in all (kind total)."""
    return queue.rollup("kind").agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


def label_totals(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label", "source").agg(F.count("*").alias("n"))


def processing_counts(documents: DataFrame, runs: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row: documents and those retired, runs and those failed, mentions still open and those in review."""
    d = documents.agg(F.count("*").alias("documents"), F.count_if(F.col("valid_to").isNotNull()).alias("retired"))
    r = runs.agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "error").alias("failed"), F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"))
    m = mentions.agg(F.count_if(F.col("status") == "pending").alias("open"), F.count_if(F.col("status") == "review").alias("in_review"))
    return d.join(r).join(m)  # one row each
