"""Entity resolution: blocking, tiered scoring, decisions, merges."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.functions.storage import discard, stored
from lithic.functions.text import jaro_winkler, trigrams
from lithic.operators.retrieval import met_in_blocks, nearest

# Resolution policy by entity type (t_high, t_low, requires_corroboration, auto_merge, keys_authoritative).
POLICY = {
    "Organization": (0.95, 0.50, True, True, False),
    "Person": (0.93, 0.50, True, True, False),
    "Contract": (0.96, 0.55, True, True, False),
    "Process": (0.92, 0.45, False, True, False),
    "System": (0.92, 0.45, False, True, False),
    "Project": (0.92, 0.45, False, True, False),
    "Event": (0.92, 0.45, False, True, False),
    "Asset": (0.92, 0.45, False, True, False),
    "Document": (0.98, 0.60, False, True, False),
    "Communication": (0.98, 0.60, False, True, False),
    "Location": (0.90, 0.35, False, True, False),
    "Provision": (0.995, 0.50, False, True, True),
}
FALLBACK_POLICY = (0.99, 0.50, True, False, False)
# Match and non-match probabilities of the comparison levels.
PRIOR = 0.01
NAME_LEVELS = ((0.55, 0.001), (0.25, 0.004), (0.12, 0.015), (0.08, 0.98))
KEY_LEVELS = {k: ((0.90, 0.0001), (0.10, 0.9999)) for k in ("email", "tax_id", "customer_id")} | {"domain": ((0.80, 0.005), (0.20, 0.995))}
CANDIDATE_CAP, ANN_K, TRIGRAM_FLOOR = 30, 20, 0.25
# Name blocks: rows that a prefix join may have for each pair of names, before all pairs are compared; mentions of a group, trigrams of a matrix of single bytes, and cells that
# count its levels of similarity; rows of a name up to which copies are compared themselves, which costs less than to spread pairs of names by joins.
SPARSE, MENTION_ROWS, GRAM_COLUMNS, LEVEL_CELLS, COPIES = 0.1, 512, 4096, 4_000_000, 8
COSINE_WEIGHT, BOOST, BOOST_CAP, MAX_ADJUDICATED = 0.5, 0.05, 0.10, 3


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in POLICY.items()], "entity_type string, t_high double, t_low double, requires_corroboration boolean, auto_merge boolean, keys_authoritative boolean")


def with_policy(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Rows (entity_type) with their policy, a cautious one where the type has none."""
    names = ("t_high", "t_low", "requires_corroboration", "auto_merge", "keys_authoritative")
    joined = rows.join(F.broadcast(policy), "entity_type", "left")  # one row per entity type of the ontology
    return joined.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zip(names, FALLBACK_POLICY, strict=True)})


def key_block(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs that share a key of the same name and value, exactly as written: mention_id, entity_id."""
    e = entities.select("entity_id", "tenant_id", "entity_type", "key_name", "key_value")
    return mentions.filter("key_value IS NOT NULL").join(e, ["tenant_id", "entity_type", "key_name", "key_value"]).select("mention_id", "entity_id").distinct()


def name_forms(rows: DataFrame, ident: str, forms: Column) -> tuple[DataFrame, DataFrame]:
    """Distinct names with their trigrams (form, tenant_id, entity_type, grams) and who has them (id, form). Equal names of a type are one form."""
    each = rows.select(F.col(ident).alias("id"), "tenant_id", "entity_type", F.explode(F.array_distinct(forms)).alias("name")).filter("name IS NOT NULL")
    each = each.withColumn("form", F.xxhash64("tenant_id", "entity_type", F.lower("name")))
    distinct = each.groupBy("form").agg(F.first("tenant_id").alias("tenant_id"), F.first("entity_type").alias("entity_type"), trigrams(F.first("name")).alias("grams"))
    return distinct, each.select("id", "form")


def alike_in_block(floor: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pairs of one kind in a group whose sets of trigrams have a Jaccard similarity of at least `floor`, as lists of all entities that are equally like a mention and have as many
    trigrams. Shared trigrams are counted by adding up 0/1 rows, one for each trigram of a mention, with an entity in each place.
    """

    def flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams = table.column("grams").combine_chunks()
        n = grams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return n, np.repeat(np.arange(len(n)), n), grams.flatten().to_numpy(zero_copy_only=False)

    def shared_counts(m_row: np.ndarray, m_gram: np.ndarray, n_m: int, e_row: np.ndarray, e_gram: np.ndarray, n_e: int) -> np.ndarray:
        """For each mention and entity how many trigrams they share."""
        shared = np.intersect1d(m_gram, e_gram)
        most = int(min(np.bincount(m_row, minlength=1).max(), np.bincount(e_row, minlength=1).max()))
        both = np.zeros((n_m, n_e), np.min_scalar_type(most))
        step = max(1, GRAM_COLUMNS // both.itemsize)
        for k in range(0, len(shared), step):
            columns = shared[k : k + step]
            sides = []
            for row, gram in ((m_row, m_gram), (e_row, e_gram)):
                place = np.minimum(np.searchsorted(columns, gram), len(columns) - 1)
                has = np.flatnonzero(columns[place] == gram)
                sides.append((row[has], place[has]))
            ones = np.zeros((len(columns), n_e), both.dtype)
            ones[sides[1][1], sides[1][0]] = 1
            ends = np.searchsorted(sides[0][0], np.arange(n_m + 1))  # rows come in order
            for r in range(n_m):
                if ends[r] < ends[r + 1]:
                    both[r] += np.add.reduce(ones[sides[0][1][ends[r] : ends[r + 1]]], axis=0, dtype=both.dtype)
        return both

    def alike(mentions: pa.Table, entities: pa.Table) -> pa.Table:
        (m_n, m_row, m_gram), (e_n, e_row, e_gram) = flat(mentions), flat(entities)
        m_kind, e_kind = (np.array(t.column("kind").to_pylist(), dtype=object) for t in (mentions, entities))
        m_id, e_id = mentions.column("query_id").combine_chunks(), entities.column("id").combine_chunks()
        out = []
        for kind in dict.fromkeys(m_kind):
            rows, own = np.flatnonzero(m_kind == kind), np.flatnonzero(e_kind == kind)
            if not len(own):
                continue
            m_at, e_at = np.full(len(m_n), -1), np.full(len(e_n), -1)
            m_at[rows], e_at[own] = np.arange(len(rows)), np.arange(len(own))
            m_has, e_has = m_at[m_row] >= 0, e_at[e_row] >= 0
            both = shared_counts(m_at[m_row[m_has]], m_gram[m_has], len(rows), e_at[e_row[e_has]], e_gram[e_has], len(own))
            # a pair's similarity follows from the sizes and what is shared, so entities are sorted by these two numbers as one
            sizes, size = np.unique(e_n[own], return_inverse=True)
            most = int(both.max()) + 1
            levels = len(sizes) * most
            size = (size * most).astype(np.min_scalar_type(levels))
            level_shared, level_size = np.arange(levels) % most, np.repeat(sizes, most)
            step = max(1, min(64, LEVEL_CELLS // levels))
            for at in range(0, len(rows), step):
                level = both[at : at + step] + size
                order = np.argsort(level, axis=1, kind="stable")
                n = np.bincount((level + levels * np.arange(len(level))[:, None]).ravel(), minlength=levels * len(level)).reshape(-1, levels)
                similarity = level_shared / np.maximum(m_n[rows[at : at + step]][:, None] + level_size - level_shared.astype(np.float64), 1)
                kept = (level_shared > 0) & (similarity >= floor)
                x, y = np.nonzero(kept & (n > 0))
                of = own[order.ravel()[np.repeat(kept.ravel(), n.ravel())]]
                out.append((rows[at + x], similarity[x, y], n[x, y], of))
        x, similarity, n, y = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        return pa.table({"m_id": m_id.take(pa.array(x)), "similarity": similarity, "e_ids": pa.ListArray.from_arrays(ends, e_id.take(pa.array(y)))})

    return alike


def alike_by_products(mentions: DataFrame, entities: DataFrame, floor: float, digits: int | None = None) -> DataFrame:
    """Rows (id, tenant_id, entity_type, grams) of either side, all pairs of a kind compared within bounded groups: m_id, e_id, similarity, rounded before lists are spread."""
    code = F.transform("grams", lambda g: (F.ascii(F.substr(g, F.lit(1), F.lit(1))) * 128 + F.ascii(F.substr(g, F.lit(2), F.lit(1)))) * 128 + F.ascii(F.substr(g, F.lit(3), F.lit(1))))
    kind = F.concat(F.length("tenant_id").cast("string"), F.lit(":"), F.col("tenant_id"), F.col("entity_type"))
    m, e = (df.select("id", kind.alias("kind"), code.alias("grams")).filter("kind IS NOT NULL") for df in (mentions, entities))
    types = [df.schema["id"].dataType.simpleString() for df in (m, e)]
    met = met_in_blocks(e, m.withColumnRenamed("id", "query_id"), "id", "query_id", MENTION_ROWS)
    lists = met.applyInArrow(alike_in_block(floor), f"m_id {types[0]}, similarity double, e_ids array<{types[1]}>")
    return rounded_similarity(lists, digits).select("m_id", F.explode("e_ids").alias("e_id"), "similarity")


def rounded_similarity(rows: DataFrame, digits: int | None) -> DataFrame:
    return rows if digits is None else rows.withColumn("similarity", F.round("similarity", digits))


def alike_by_prefixes(m: DataFrame, e: DataFrame, m_prefixes: DataFrame, e_prefixes: DataFrame, floor: float) -> DataFrame:
    """Pairs of forms that share a trigram of their prefixes, verified: m_form, e_form, similarity."""
    met = m_prefixes.join(e_prefixes, ["tenant_id", "entity_type", "gram"])
    shared = F.least("m_place", "e_place") + F.least(F.col("m_n") - F.col("m_place"), F.col("e_n") - F.col("e_place"))  # at most
    reach = (F.col("m_n") >= F.col("e_n") * floor) & (F.col("e_n") >= F.col("m_n") * floor) & (shared >= (F.col("m_n") + F.col("e_n") - shared) * floor)
    pairs = met.filter(reach).select("m_form", "e_form").distinct()
    pairs = pairs.join(m.select(F.col("form").alias("m_form"), F.col("grams").alias("mg")), "m_form").join(e.select(F.col("form").alias("e_form"), F.col("grams").alias("eg")), "e_form")
    both = F.size(F.array_intersect("mg", "eg"))
    return pairs.select("m_form", "e_form", (both / (F.size("mg") + F.size("eg") - both)).alias("similarity")).filter(F.col("similarity") >= floor)


def trigram_block(mentions: DataFrame, entities: DataFrame, floor: float = TRIGRAM_FLOOR, digits: int | None = None) -> DataFrame:
    """Pairs of the same type whose names' trigram sets have a Jaccard similarity of at least `floor`, by an entity's name or the best of its aliases (if entities have
    `aliases`): mention_id, entity_id, similarity, rounded to `digits` if they are given, before pairs are spread.

    Distinct names are compared. Prefix filter: trigrams are ordered by how rare they are among entities' names, and only the first n - ceil(floor n) + 1 of each
    side are joined, as two sets that similar share one of those; a join row holds ids, sizes and places only, and goes if the sizes or what is left behind the places can't reach
    the floor. Trigram sets are fetched for the distinct pairs that remain. Where that join would have more than SPARSE rows for each pair of names (names that are all
    alike, or a low floor), all pairs are compared in bounded groups instead, which give lists of entities by mention and similarity. Either way is exact. Pairs are spread over equal names, and
    over entities of the same set of names, only at the end, so that nothing is grouped by pairs of ids.
    """
    aliased = "aliases" in entities.columns
    kinds = stored(mentions.select("tenant_id", "entity_type").distinct(), "mention-kinds")
    entities = entities.join(kinds, ["tenant_id", "entity_type"], "left_semi")
    m, m_ids = name_forms(mentions, "mention_id", F.array("surface"))
    e, e_ids = name_forms(entities, "entity_id", F.array_union(F.array("name"), F.coalesce("aliases", F.array())) if aliased else F.array("name"))
    m, e = stored(m, "mention-names"), stored(e, "entity-names")
    rare = stored(e.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")), "grams")

    def prefixes(df: DataFrame, side: str) -> DataFrame:
        each = df.select("form", "tenant_id", "entity_type", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(rare, "gram", "left")
        order = Window.partitionBy("form").orderBy(F.coalesce("df", F.lit(0)), "gram")
        placed = each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(floor)) + 1)
        return stored(placed.select("tenant_id", "entity_type", "gram", F.col("form").alias(f"{side}_form"), F.col("n").alias(f"{side}_n"), F.col("place").alias(f"{side}_place")), "prefixes")

    def meetings(a: DataFrame, b: DataFrame, *keys: str) -> float:
        a, b = (df.groupBy(*keys).agg(F.count("*").cast("double").alias(n)) for df, n in ((a, "a"), (b, "b")))
        return a.join(b, [*keys]).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0

    m_prefixes, e_prefixes = prefixes(m, "m"), prefixes(e, "e")
    if meetings(m_prefixes, e_prefixes, "tenant_id", "entity_type", "gram") <= SPARSE * meetings(m, e, "tenant_id", "entity_type"):
        alike = alike_by_prefixes(m, e, m_prefixes, e_prefixes, floor)
    elif not aliased and m_ids.count() <= COPIES * m.count() and e_ids.count() <= COPIES * e.count():
        # names that have few copies: no pair of names has to be spread
        found = alike_by_products(m_ids.join(m, "form"), e_ids.join(e, "form"), floor, digits)
        return found.select(F.col("m_id").alias("mention_id"), F.col("e_id").alias("entity_id"), "similarity")
    else:
        found = alike_by_products(m.withColumnRenamed("form", "id"), e.withColumnRenamed("form", "id"), floor)
        alike = found.select(F.col("m_id").alias("m_form"), F.col("e_id").alias("e_form"), "similarity")
    members = e_ids.select("id", F.col("form").alias("e_class"))
    if aliased:
        members = e_ids.groupBy("id").agg(F.array_sort(F.collect_set("form")).alias("forms")).withColumn("e_class", F.xxhash64("forms"))
        classes = members.groupBy("e_class").agg(F.first("forms").alias("forms")).select("e_class", F.explode("forms").alias("e_form"))
        alike = alike.join(classes, "e_form").groupBy("m_form", "e_class").agg(F.max("similarity").alias("similarity"))
    else:
        alike = alike.withColumnRenamed("e_form", "e_class")
    found = stored(rounded_similarity(alike, digits), "alike").join(m_ids.select(F.col("id").alias("mention_id"), F.col("form").alias("m_form")), "m_form")
    return found.join(members.select(F.col("id").alias("entity_id"), "e_class"), "e_class").select("mention_id", "entity_id", "similarity")


def ann_block(mentions: DataFrame, entities: DataFrame, k: int = ANN_K, max_mentions: int = 20_000) -> DataFrame:
    """The k entities of the same type nearest to each mention: mention_id, entity_id, cosine, rank. A mention or entity without a cosine has none."""
    items = entities.select(F.col("entity_id").alias("id"), F.col("entity_type").alias("kind"), "embedding")
    queries = mentions.select(F.col("mention_id").alias("query_id"), F.col("entity_type").alias("kind"), F.col("embedding").alias("v"))
    found = nearest(items, queries, k, True, max_mentions).filter("score IS NOT NULL")
    return found.select(F.col("query_id").alias("mention_id"), F.col("id").alias("entity_id"), F.col("score").alias("cosine"), "rank")


def blocked(key: DataFrame, ann: DataFrame, name: DataFrame, cap: int = CANDIDATE_CAP) -> DataFrame:
    """Union of the three paths: mention_id, entity_id, blocks, cosine. Keyed candidates always stay; the others are cut to the cap by
    cosine, where an unknown cosine counts as 0."""
    none = F.lit(None).cast("double")
    rows = key.select("mention_id", "entity_id", F.lit(0).alias("b"), none.alias("cosine"))
    rows = rows.unionByName(ann.select("mention_id", "entity_id", F.lit(1).alias("b"), "cosine"))
    rows = rows.unionByName(name.select("mention_id", "entity_id", F.lit(2).alias("b"), none.alias("cosine")))
    paths = F.transform(F.array_sort(F.collect_set("b")), lambda b: F.element_at(F.array(F.lit("key"), F.lit("ann"), F.lit("name")), b + 1))
    found = rows.groupBy("mention_id", "entity_id").agg(paths.alias("blocks"), F.max("cosine").alias("cosine"))
    keyed = F.array_contains("blocks", "key")
    order = Window.partitionBy("mention_id").orderBy(F.desc(keyed), F.desc(F.coalesce("cosine", F.lit(0.0))), F.element_at("blocks", 1) != "ann", "entity_id")
    return found.withColumn("n", F.row_number().over(order)).filter(keyed | (F.col("n") <= cap)).drop("n")


def deterministic_keys(mentions: DataFrame, entities: DataFrame, policy: DataFrame) -> DataFrame:
    """Tier 0: mention_id, hits, entity_id, outcome by the distinct entities whose strong key equals a mention's, whatever the case.

    None: fallthrough, or a new entity where keys are authoritative; one: resolved; more: review. A domain is strong for
    organisations only.
    """
    strong = (F.col("key_name") != "domain") | (F.col("entity_type") == "Organization")
    m = mentions.filter("key_value IS NOT NULL").filter(strong).select("mention_id", "tenant_id", "entity_type", "key_name", F.lower("key_value").alias("value"))
    e = entities.select("entity_id", "tenant_id", "entity_type", "key_name", F.lower("key_value").alias("value"))
    hits = m.join(e, ["tenant_id", "entity_type", "key_name", "value"]).groupBy("mention_id").agg(F.count_distinct("entity_id").alias("hits"), F.min("entity_id").alias("entity_id"))
    rows = with_policy(mentions.select("mention_id", "entity_type", "key_value"), policy).join(hits, "mention_id", "left")
    n = F.coalesce("hits", F.lit(0))
    none = F.when(F.col("keys_authoritative") & F.col("key_value").isNotNull(), "new_entity").otherwise("fallthrough")
    return rows.select(
        "mention_id", n.cast("long").alias("hits"), F.when(n == 1, F.col("entity_id")).alias("entity_id"),
        F.when(n == 0, none).when(n == 1, "resolved").otherwise("review").alias("outcome"),
    )


def bayes_weight(left_name: Column, right_name: Column, keys: dict[str, tuple[Column, Column]]) -> Column:
    """Tier 1: match probability from name and key comparisons; a null side says nothing. Names are compared as written, keys casefolded."""
    bits = lambda level: math.log2(level[0] / level[1])
    jw = jaro_winkler(left_name, right_name)
    weight = F.lit(math.log2(PRIOR / (1 - PRIOR))) + F.coalesce(
        F.when(left_name == right_name, bits(NAME_LEVELS[0])).when(jw >= 0.92, bits(NAME_LEVELS[1])).when(jw >= 0.80, bits(NAME_LEVELS[2])).when(jw.isNotNull(), bits(NAME_LEVELS[3])),
        F.lit(0.0),
    )
    for name, (a, b) in keys.items():
        same, other = KEY_LEVELS[name]
        weight = weight + F.when(a.isNull() | b.isNull(), 0.0).when(F.lower(a) == F.lower(b), bits(same)).otherwise(bits(other))
    return F.pow(F.lit(2.0), weight) / (1 + F.pow(F.lit(2.0), weight))


def blended_score(name_similarity: Column, cos: Column) -> Column:
    """Tier 1b: half name similarity, half cosine, which counts from 0."""
    return (1 - COSINE_WEIGHT) * name_similarity + COSINE_WEIGHT * F.greatest(F.coalesce(cos, F.lit(0.0)), F.lit(0.0))


def adjudicated_score(match: Column, confidence: Column) -> Column:
    return F.when(match, 0.5 + confidence / 2).otherwise(0.5 - confidence / 2)


def to_adjudicate(scored: DataFrame, most: int = MAX_ADJUDICATED) -> DataFrame:
    """The best gray candidates of each mention."""
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
    return scored.filter("band = 'gray'").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def corroboration(mentions: DataFrame, facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Tier 1c: per candidate the distinct other entities of the mention's document that have a fact with it, and the score's
    boost: mention_id, entity_id, n, boost."""
    # mentions of a document are never paired: its entities are gathered once, with the least and greatest mention that names each
    others = mentions.filter("resolved_entity_id IS NOT NULL").groupBy("document_id", F.col("resolved_entity_id").alias("neighbour")).agg(F.min("mention_id").alias("low"), F.max("mention_id").alias("high"))
    sides = facts.filter("object_id IS NOT NULL").select(F.col("subject_id").alias("entity_id"), F.col("object_id").alias("neighbour"))
    sides = sides.unionByName(sides.select(F.col("neighbour").alias("entity_id"), F.col("entity_id").alias("neighbour"))).distinct()
    asked = candidates.select("mention_id", "entity_id").distinct().join(mentions.select("mention_id", "document_id"), "mention_id")
    near = asked.select("document_id", "entity_id").distinct().join(sides, "entity_id").join(others, ["document_id", "neighbour"])
    # a neighbour that only the mention itself names counts for all other mentions of the document
    sums = near.groupBy("document_id", "entity_id").agg(F.count("*").alias("all"))
    alone = near.filter("low = high").select("document_id", "entity_id", F.col("low").alias("mention_id")).groupBy("document_id", "entity_id", "mention_id").agg(F.count("*").alias("own"))
    n = asked.join(sums, ["document_id", "entity_id"]).join(alone, ["document_id", "entity_id", "mention_id"], "left")
    n = n.select("mention_id", "entity_id", (F.col("all") - F.coalesce("own", F.lit(0))).alias("n"))
    rows = candidates.select("mention_id", "entity_id").join(n, ["mention_id", "entity_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("boost", F.least(F.lit(BOOST_CAP), BOOST * F.col("n")))


def band(score: Column, t_high: Column, t_low: Column) -> Column:
    return F.when(score >= t_high, "high").when(score <= t_low, "low").otherwise("gray")


def decided(scored: DataFrame) -> DataFrame:
    """One decision per mention from scored candidates (mention_id, entity_id, score, corroborated and policy columns)."""
    rows = scored.withColumn("band", band(F.col("score"), F.col("t_high"), F.col("t_low")))
    best = rows.groupBy("mention_id").agg(
        F.max(F.struct(F.col("score"), (-F.col("entity_id")).alias("least_id"), "band", "corroborated", "requires_corroboration", "auto_merge")).alias("top"),
        F.count_if(F.col("band") == "high").alias("high"),
    )
    top = lambda c: F.col(f"top.{c}")
    cautious = ~top("auto_merge") | (F.col("high") > 1) | (top("requires_corroboration") & ~F.coalesce(top("corroborated"), F.lit(False)))
    decision = F.when(top("band") == "low", "new_entity").when(top("band") == "gray", "review").when(cautious, "review").otherwise("resolved")
    return best.select("mention_id", (-top("least_id")).alias("entity_id"), top("score").alias("score"), top("band").alias("band"), decision.alias("decision"))


def applied(mentions: DataFrame, decisions: DataFrame, first_new_id: int) -> DataFrame:
    """Mentions after decisions: status, resolved entity, and for new entities ids in order of mention from first_new_id."""
    new = decisions.filter("decision = 'new_entity'").select("mention_id")
    # ids are positions in a total order, counted per range partition so that no task sorts them all
    placed = new.repartitionByRange("mention_id").withColumn("part", F.spark_partition_id()).withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("mention_id")))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("base"))
    ids = placed.join(before, "part").select("mention_id", (F.col("k") + F.col("base") + first_new_id - 1).alias("new_id"))
    rows = mentions.join(decisions.select("mention_id", "entity_id", "decision"), "mention_id", "left").join(ids, "mention_id", "left")
    status = F.when(F.col("decision").isin("resolved", "new_entity"), "resolved").when(F.col("decision") == "review", "review").otherwise(F.col("status"))
    return rows.withColumns({"status": status, "resolved_entity_id": F.coalesce("new_id", F.when(F.col("decision") == "resolved", F.col("entity_id")), "resolved_entity_id")}).drop("entity_id", "decision", "new_id")


def rooted(merges: DataFrame) -> DataFrame:
    """Merges (merged_id, survivor_id) led to the survivor that stays in the end, with the number of merges on the way: merged_id, survivor_id, hops.

    By pointer jumping: a round joins the merges to themselves and halves the chains that are left, so rounds grow with the logarithm of the longest
    chain. An entity merged into several others, into itself or in a circle is refused.
    """
    rows = stored(merges.select("merged_id", "survivor_id").distinct().withColumn("hops", F.lit(1).cast("long")), "merges")
    if rows.groupBy("merged_id").count().filter("count > 1").limit(1).count():
        raise ValueError("an entity is merged into several others")
    most = rows.count()
    for _ in range(most.bit_length() + 2):
        on = rows.select(F.col("merged_id").alias("survivor_id"), F.col("survivor_id").alias("next"), F.col("hops").alias("more"))
        joined = rows.join(on, "survivor_id", "left")
        if not joined.filter("next IS NOT NULL").limit(1).count():
            return rows
        before, rows = rows, stored(joined.select("merged_id", F.coalesce("next", "survivor_id").alias("survivor_id"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "merges")
        discard(before)
    raise ValueError("merges go in a circle")


def remapped(df: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """df with ids of merged entities (merged_id, survivor_id) replaced by their survivors'."""
    m = merges.select(F.col("merged_id").alias(column), "survivor_id")
    return df.join(m, column, "left").withColumn(column, F.coalesce("survivor_id", column)).drop("survivor_id").select(*df.columns)


def merged(entities: DataFrame, facts: DataFrame, mentions: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Merge entities into survivors: (entities, facts, mentions, snapshot). The snapshot has what a reversal needs. Chains of merges lead to their ends."""
    merges = rooted(merges)
    gone = merges.select(F.col("merged_id").alias("entity_id"), "survivor_id")
    touched = mentions.join(gone.withColumnRenamed("entity_id", "resolved_entity_id"), "resolved_entity_id").groupBy(F.col("resolved_entity_id").alias("entity_id")).agg(F.array_sort(F.collect_list("mention_id")).alias("mention_ids"))
    sides = facts.select("fact_id", F.col("subject_id").alias("entity_id"), F.lit("subject").alias("side")).unionByName(facts.filter("object_id IS NOT NULL").select("fact_id", F.col("object_id").alias("entity_id"), F.lit("object").alias("side")))
    ends = sides.join(gone.select("entity_id"), "entity_id").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", "side"))).alias("fact_sides"))
    snapshot = entities.join(gone, "entity_id").join(touched, "entity_id", "left").join(ends, "entity_id", "left")
    left = entities.join(gone.select("entity_id"), "entity_id", "left_anti").select(*entities.columns)
    return left, remapped(remapped(facts, merges, "subject_id"), merges, "object_id"), remapped(mentions, merges, "resolved_entity_id"), snapshot


def unmerged(entities: DataFrame, facts: DataFrame, mentions: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reverse a merge from its snapshot: entities and facts as before, mentions back to pending, and non-match labels."""
    back = snapshot.select(*entities.columns)
    ends = snapshot.select("entity_id", F.explode("fact_sides").alias("x")).select("entity_id", "x.fact_id", "x.side")
    side = lambda name: ends.filter(F.col("side") == name).select("fact_id", F.col("entity_id").alias(f"old_{name}"))
    rows = facts.join(side("subject"), "fact_id", "left").join(side("object"), "fact_id", "left")
    rows = rows.withColumns({f"{s}_id": F.coalesce(f"old_{s}", f"{s}_id") for s in ("subject", "object")}).select(*facts.columns)
    ids = snapshot.select(F.explode("mention_ids").alias("mention_id"), F.lit(True).alias("reset"))
    again = mentions.join(ids, "mention_id", "left")
    again = again.withColumns({"status": F.when(F.col("reset"), "pending").otherwise(F.col("status")), "resolved_entity_id": F.when(F.col("reset"), F.lit(None)).otherwise(F.col("resolved_entity_id"))}).select(*mentions.columns)
    labels = snapshot.select(F.col("entity_id").alias("left_id"), F.col("survivor_id").alias("right_id"), F.lit("er_nonmatch").alias("label"), F.lit(0.95).alias("authority"))
    return entities.unionByName(back), rows, again, labels


def repointed(pending: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged facts still pending with references to merged entities led to the survivors, and what a reversal needs: pending_id, side, merged_id, survivor_id."""
    merges, rows, moved = rooted(merges), pending, []
    for side in ("subject_ref", "object_ref"):
        m = merges.select(F.concat(F.lit("entity:"), F.col("merged_id").cast("string")).alias(side), "merged_id", "survivor_id")
        joined = rows.join(m, side, "left")
        here = F.col("survivor_id").isNotNull() & (F.col("status") == "pending")
        moved.append(joined.filter(here).select("pending_id", F.lit(side).alias("side"), "merged_id", "survivor_id"))
        rows = joined.withColumn(side, F.when(here, F.concat(F.lit("entity:"), F.col("survivor_id").cast("string"))).otherwise(F.col(side))).select(*pending.columns)
    return rows, moved[0].unionByName(moved[1])


def repointed_back(pending: DataFrame, moved: DataFrame) -> DataFrame:
    """Reverse `repointed` where the staged fact is still pending and still refers to the survivor."""
    rows = pending
    for side in ("subject_ref", "object_ref"):
        rows = rows.join(moved.filter(F.col("side") == side).select("pending_id", "merged_id", "survivor_id"), "pending_id", "left")
        here = (F.col("status") == "pending") & (F.col(side) == F.concat(F.lit("entity:"), F.col("survivor_id").cast("string")))
        rows = rows.withColumn(side, F.when(here, F.concat(F.lit("entity:"), F.col("merged_id").cast("string"))).otherwise(F.col(side))).select(*pending.columns)
    return rows


def rerooted(earlier: DataFrame, merges: DataFrame) -> DataFrame:
    """Earlier merges (merged_id, survivor_id) whose survivor is merged now, led to the new survivor."""
    now = rooted(merges).select(F.col("merged_id").alias("was"), F.col("survivor_id").alias("becomes"))
    rows = earlier.join(now, F.col("survivor_id") == F.col("was"), "left")
    return rows.withColumn("survivor_id", F.coalesce("becomes", "survivor_id")).select(*earlier.columns)


def absorbed(entities: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (entity_id, name, aliases, attributes) after merges, and what the survivors gained: entity_id, new_aliases, new_attributes.

    A survivor gets the names and aliases it lacks and the attributes whose key it lacks, of several merged ones the nearest in the chain of merges, then the first by id.
    """
    merges = rooted(merges)
    gone = merges.select(F.col("merged_id").alias("entity_id"), "survivor_id", "hops").join(entities, "entity_id")
    names = gone.groupBy(F.col("survivor_id").alias("entity_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_union("aliases", F.array("name")))))).alias("offered"))
    values = gone.select(F.col("survivor_id").alias("entity_id"), F.struct("hops", "entity_id").alias("of"), F.explode("attributes").alias("key", "value"))
    values = values.groupBy("entity_id", "key").agg(F.min_by("value", "of").alias("value")).groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("values"))
    left = entities.join(merges.select(F.col("merged_id").alias("entity_id")), "entity_id", "left_anti").join(names, "entity_id", "left").join(values, "entity_id", "left")
    new_aliases = F.coalesce(F.array_except("offered", F.array_union("aliases", F.array("name"))), F.array().cast("array<string>"))
    new_attributes = F.coalesce(F.map_filter("values", lambda k, _: ~F.map_contains_key("attributes", k)), F.create_map().cast("map<string,string>"))
    rows = left.withColumns({"new_aliases": new_aliases, "new_attributes": new_attributes})
    gained = rows.filter("offered IS NOT NULL").select("entity_id", "new_aliases", "new_attributes")
    after = rows.withColumns({"aliases": F.concat("aliases", "new_aliases"), "attributes": F.map_concat("new_attributes", "attributes")})
    return after.select(*entities.columns), gained


def released(entities: DataFrame, gained: DataFrame, back: DataFrame) -> DataFrame:
    """Reverse `absorbed`: survivors without what they gained, and the merged entities (back)."""
    rows = entities.join(gained, "entity_id", "left")
    lost = {"aliases": F.when(F.col("new_aliases").isNull(), F.col("aliases")).otherwise(F.array_except("aliases", "new_aliases"))}
    lost["attributes"] = F.when(F.col("new_attributes").isNull(), F.col("attributes")).otherwise(F.map_filter("attributes", lambda k, _: ~F.map_contains_key("new_attributes", k)))
    return rows.withColumns(lost).select(*entities.columns).unionByName(back.select(*entities.columns))
