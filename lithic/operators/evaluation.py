"""Retrieval and resolution evaluation."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.storage import stored
from lithic.functions.text import corrupted_name, token_jaccard

CUTS = (3, 5, 10, 20)
MAX_LEAKAGE = 0.6


def relevant_ranks(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """gold: query_id, id; ranking: query_id, id, rank. Every gold item with its rank, null if it isn't ranked."""
    return gold.join(ranking, ["query_id", "id"], "left").select("query_id", "id", "rank")


def item_metrics(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query: whether any and all gold items are in the first k, reciprocal rank, nDCG at 10."""
    ranks = relevant_ranks(ranking, gold)
    discount = lambda r: 1 / F.log2(r + 1)
    per = ranks.groupBy("query_id").agg(
        *[F.max(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"any_{k}") for k in CUTS],
        *[F.min(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"all_{k}") for k in CUTS],
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("rank") <= 10, discount(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.count("*").alias("n"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(10)).cast("int")), F.lit(0.0), lambda a, r: a + discount(r))
    return per.withColumn("ndcg", F.col("dcg") / ideal).drop("dcg")


def summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count("*").alias("queries"),
        *[F.avg(f"any_{k}").alias(f"recall_any_{k}") for k in CUTS],
        *[F.avg(f"all_{k}").alias(f"recall_all_{k}") for k in CUTS],
        F.avg("rr").alias("mrr"),
        F.avg("ndcg").alias("ndcg_10"),
    )


def drawn_below(n: int, rng: random.Random) -> Iterator[np.ndarray]:
    """What `rng.randrange(n)` draws, n at a time, n below 2**32: the top bits of the generator's words, those from n on being left out."""
    words = np.random.MT19937()
    _, state, _ = rng.getstate()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], dtype=np.uint32), "pos": state[-1]}}
    bits, left = n.bit_length(), np.zeros(0, np.int64)
    while True:
        while len(left) < n:
            got = (words.random_raw(max(n - len(left), 64)) >> np.uint64(32 - bits)).astype(np.int64)
            left = np.concatenate([left, got[got < n]])
        yield left[:n]
        left = left[n:]


def bootstrap_interval(values: list[float], resamples: int = 1000, seed: int = 42) -> tuple[float, float]:
    """95 % interval of the mean by resampling with a seeded generator, as elements of the sorted means.

    The draws are those of `random.Random(seed).randrange(n)`, one after the other, taken from the same generator's words many at a time.
    """
    rng, n = random.Random(seed), len(values)
    if hasattr(rng, "getstate"):
        each, draws = np.asarray(values, dtype=float), drawn_below(n, rng)
        sums = (sum(each[next(draws)].tolist()) for _ in range(resamples))
    else:  # another generator
        sums = (sum(values[rng.randrange(n)] for _ in range(n)) for _ in range(resamples))
    means = sorted(total / n for total in sums)
    return means[int(0.025 * resamples)], means[min(int(0.975 * resamples), resamples - 1)]


def bootstrap(outcomes: DataFrame, by: str = "run", item: str = "query_id", value: str = "value", max_items: int = 100_000, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Intervals per run over its outcomes in item order: run, mean, low, high.

    A run of up to max_items is resampled as `bootstrap_interval` does. A larger one is dealt over blocks: how many draws of each resample
    fall into each block is drawn first (multinomial in the blocks' sizes), then each block draws its own, which is resampling the whole run.
    """
    sizes = outcomes.groupBy(F.col(by).alias("of")).agg(F.count("*").alias("n"))
    rows = outcomes.select(by, item, value).join(sizes, F.col(by).eqNullSafe(F.col("of"))).drop("of")
    kind = outcomes.schema[by].dataType.simpleString()
    shape = f"{by} {kind}, mean double, low double, high double"

    def interval(f: pd.DataFrame) -> pd.DataFrame:
        values = f.sort_values(item)[value].astype(float).tolist()
        low, high = bootstrap_interval(values, resamples, seed)
        return pd.DataFrame([(f[by].iloc[0], sum(values) / len(values), low, high)], columns=[by, "mean", "low", "high"])

    def dealt(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        drawn = np.random.default_rng(seed).multinomial(f["size"].sum(), f["size"] / f["size"].sum(), size=resamples)
        return pd.DataFrame({by: f[by], "block": f["block"], "draws": list(drawn.T.astype(np.int64))})

    def sums(f: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        values = f.sort_values([item, value])[value].to_numpy(float)
        rng = np.random.default_rng([seed, int(f["block"].iloc[0])])
        drawn = [values[rng.integers(0, len(values), k)].sum() for k in draws["draws"].iloc[0]]
        return pd.DataFrame({by: [f[by].iloc[0]] * resamples, "resample": range(resamples), "total": drawn})

    small = rows.filter(F.col("n") <= max_items).groupBy(by).applyInPandas(interval, shape)
    blocks = F.ceil(2 * F.col("n") / max_items)  # by hash, so about half of max_items each
    large = rows.filter(F.col("n") > max_items).withColumn("block", F.pmod(F.xxhash64(item, value), blocks))
    counts = large.groupBy(by, "block").agg(F.count("*").alias("size"))
    draws = counts.groupBy(by).applyInPandas(dealt, f"{by} {kind}, block long, draws array<long>")  # one row per block
    drawn = large.groupBy(by, "block").cogroup(draws.groupBy(by, "block")).applyInPandas(sums, f"{by} {kind}, resample int, total double")
    totals = drawn.groupBy(by, "resample").agg(F.sum("total").alias("total")).groupBy(by).agg(F.array_sort(F.collect_list("total")).alias("totals"))
    means = large.groupBy(F.col(by).alias("of")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    at = lambda k: F.get("totals", F.lit(k)) / F.col("n")
    whole = totals.join(means, F.col(by).eqNullSafe(F.col("of"))).select(by, "mean", at(int(0.025 * resamples)).alias("low"), at(min(int(0.975 * resamples), resamples - 1)).alias("high"))
    return small.unionByName(whole)


def paired_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences b - a of two runs' outcomes (query_id, value) on the items that both have."""
    return a.select("query_id", F.col("value").alias("va")).join(b.select("query_id", F.col("value").alias("vb")), "query_id").select("query_id", (F.col("vb") - F.col("va")).alias("value"))


def displaces(margin: float, low: float, p95_ms: float, least_margin: float = 0.0, budget_ms: float = 300.0) -> bool:
    """Whether a challenger replaces the incumbent: better by the margin, interval above zero, latency within budget."""
    return margin > least_margin and low > 0 and p95_ms <= budget_ms


def ordered_hash(items: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Hash of a set as SHA-256 over the item hashes in order. A set is one row, so it has to fit a task."""
    rows = items.select(by, order, F.sha2(F.col(text).cast("binary"), 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), "")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("set_hash"))


def leaderboard(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """Runs with their gold set, best headline first within axis, gold set and pin, unknown headlines last, with rank."""
    rows = runs.join(gold, "gold_id")
    order = Window.partitionBy("axis", "gold_id").orderBy(F.desc_nulls_last("headline"), "run_id")
    return rows.withColumn("rank", F.row_number().over(order))


def leakage(pairs: DataFrame, query: str, passage: str, limit: float = MAX_LEAKAGE) -> DataFrame:
    """Pairs with their token Jaccard and whether it is below the leakage limit."""
    return pairs.withColumn("jaccard", token_jaccard(F.col(query), F.col(passage))).withColumn("clean", F.col("jaccard") < limit)


def numbered(rows: DataFrame, *order: str, bounds: int = 200) -> DataFrame:
    """Distinct rows with their place in a total order, from 1, so that no task sorts them all. They are dealt over some `bounds` ranges and written out once."""
    # the ranges follow a sample, so they are written down before anything is counted
    placed = stored(rows.repartitionByRange(max(bounds, 1), *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("range").agg(F.count("*").alias("size"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.range") < F.col("a.range"), "left").groupBy(F.col("a.range").alias("range")).agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("base"))
    placed = placed.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    return placed.join(F.broadcast(before), "range").withColumn("place", F.col("k") + F.col("base")).drop("range", "k", "base")  # one row per range


#: Names whose next ones are looked up in one window.
WINDOW_ROWS = 20_000


def match_pairs(entities: DataFrame, neighbours: int = 20) -> DataFrame:
    """Labelled name pairs over the distinct names of each type: each name with two corruptions of it (match), and with the names with the
    same first word that are among the `neighbours` next ones in order (hard non-match), so all pairs of up to neighbours + 1 names.

    Names go in windows of `WINDOW_ROWS` places, each with the first `neighbours` of the next, so a name is shuffled about once and not once for each pair.
    """
    first = F.lower(F.get(F.split(F.trim("name"), r"\s+"), F.lit(0)))
    names = stored(entities.filter("name IS NOT NULL AND entity_type IS NOT NULL").select("entity_type", first.alias("first"), "name").distinct(), "names")
    kind = F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.pmod(F.xxhash64("name") + i, F.lit(3))))
    positive = names.select("name", "entity_type", kind.alias("kind")).select(F.col("name").alias("left_name"), corrupted_name(F.col("name"), F.col("kind")).alias("right_name"), "entity_type", F.lit(True).alias("match"))
    size = max(WINDOW_ROWS, neighbours)
    block, at = F.floor((F.col("place") - 1) / size), F.pmod(F.col("place") - 1, F.lit(size))
    placed = numbered(names, "entity_type", "first", "name").withColumns({"block": F.array(block), "own": block})
    placed = placed.withColumn("block", F.explode(F.when((at < neighbours) & (F.col("own") > 0), F.array("own", F.col("own") - 1)).otherwise(F.col("block"))))
    after = Window.partitionBy("block").orderBy("place").rowsBetween(1, neighbours)
    alike = lambda x: (x["entity_type"] == F.col("entity_type")) & (x["first"] == F.col("first"))
    left = placed.withColumn("next", F.collect_list(F.struct("entity_type", "first", "name")).over(after)).filter("block = own")
    negative = left.select(F.col("name").alias("left_name"), F.explode(F.filter("next", alike)).alias("right"), "entity_type")
    return positive.unionByName(negative.select("left_name", F.col("right.name").alias("right_name"), "entity_type", F.lit(False).alias("match")))


def gold_sample(items: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A deterministic sample of n items: the first by seeded hash of the id."""
    return items.orderBy(F.xxhash64(F.lit(seed), "item_id"), "item_id").limit(n)


Questioner = Callable[[Column, Column], Column]
ATTEMPTS, TRIES = 3, 4


def asked(terms: Column, attempt: Column) -> Column:
    """A stand-in for a model that asks a question about a text: its terms of least hash, fewer with each attempt."""
    placed = F.array_sort(F.transform(F.array_distinct(terms), lambda t: F.struct(F.sha2(F.concat(attempt.cast("string"), F.lit(":"), t), 256).alias("h"), t.alias("t"))))
    return F.array_join(F.transform(F.slice(placed, F.lit(1), 7 - 2 * attempt), lambda p: p["t"]), " ")


def retrieval_gold(chunks: DataFrame, n: int, question: Questioner = asked, seed: int = 42) -> DataFrame:
    """A gold set of n questions from chunks (chunk_id, document_id, content): item_id, multi_hop, chunk_ids, question, leakage, attempts.

    A tenth of the items, 6 at least, are multi-hop: their question is about two chunks of one document. Chunks and documents are taken in order of a seeded hash. A question whose words are too like its text's
    (Jaccard at `MAX_LEAKAGE` or above) is asked anew up to three times, and the item is left out if all leak; four times as many documents as needed are tried for multi-hop items. Only ids are
    gathered by document, and only the chosen chunks' texts are read.
    """
    many = max(6, n // 10)
    mark = lambda c: F.sha2(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")), 256)
    ids = chunks.select("chunk_id", "document_id")
    single = ids.orderBy(mark("chunk_id"), "chunk_id").limit(max(n - many, 0)).select(F.lit(False).alias("multi_hop"), mark("chunk_id").alias("mark"), F.array("chunk_id").alias("chunk_ids"))
    pairs = ids.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(mark("chunk_id").alias("m"), "chunk_id"))).alias("all")).filter(F.size("all") > 1)
    two = F.transform(F.slice("all", 1, 2), lambda x: x["chunk_id"])
    multi = pairs.orderBy(mark("document_id"), "document_id").limit(many * TRIES).select(F.lit(True).alias("multi_hop"), mark("document_id").alias("mark"), two.alias("chunk_ids"))
    items = stored(single.unionByName(multi), "gold-items").withColumn("item_id", F.concat_ws(",", F.transform("chunk_ids", lambda c: c.cast("string"))))
    each = items.select("item_id", F.posexplode("chunk_ids").alias("at", "chunk_id"))
    texts = chunks.join(each, "chunk_id").groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), " ").alias("text"))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    tried = items.join(texts, "item_id").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS))))
    tried = tried.withColumn("question", question(words(F.col("text")), F.col("attempt")))
    tried = tried.withColumn("leakage", token_jaccard(F.col("question"), F.col("text"))).filter((F.col("question") != "") & (F.col("leakage") < MAX_LEAKAGE))
    best = tried.groupBy("item_id", "multi_hop", "mark", "chunk_ids").agg(F.min(F.struct(F.col("attempt").alias("attempts"), "question", "leakage")).alias("q")).select("item_id", "multi_hop", "mark", "chunk_ids", "q.*")
    kept = best.filter("multi_hop").orderBy("mark", "item_id").limit(many).unionByName(best.filter("NOT multi_hop"))
    return kept.select("item_id", "multi_hop", "chunk_ids", "question", "leakage", "attempts")


# Least number of items of a gold set by axis.
FLOORS = {"retrieval": 50, "er": 200, "extraction": 30}


def registered(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Gold sets (gold_id, axis) with item count, hash, and status: rejected below the axis's floor, else draft."""
    floor = F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv])
    hashes = ordered_hash(items, "gold_id", "seq", "text")
    return sets.join(hashes, "gold_id", "left").withColumn("status", F.when(F.coalesce("n", F.lit(0)) < F.try_element_at(floor, F.col("axis")), "rejected").otherwise("draft"))


def activated(sets: DataFrame, signed: DataFrame) -> DataFrame:
    """Gold sets after sign-off. signed: gold_id, reviewer. A draft with a named reviewer becomes active; nothing else changes."""
    rows = sets.join(signed.filter("trim(reviewer) <> ''").groupBy("gold_id").agg(F.min("reviewer").alias("activated_by")), "gold_id", "left")
    go = (F.col("status") == "draft") & F.col("activated_by").isNotNull()
    return rows.withColumns({"status": F.when(go, "active").otherwise(F.col("status")), "activated_by": F.when(go, F.col("activated_by"))})


# What a benchmark run may vary on each axis, and what it must state.
KNOBS = {
    "a_index": (("index",), ("index", "params", "label", "notes")),
    "b_er": (("scorer",), ("scorer", "params", "label", "notes")),
    "c_embedder": (
        ("embedder",),
        ("embedder", "mode", "dim", "chunk_tokens", "overlap_pct", "contextual_prefix", "reranker", "prompt_style", "prompt_style_detail", "engine", "fusion_method", "rrf_k", "sparse_weight", "label", "notes"),
    ),
    "d_extraction": (("model", "contract"), ("model", "contract", "params", "label", "notes")),
}


def knob_faults(requests: DataFrame) -> DataFrame:
    """requests: run_id, axis, config (map). Why a run is refused: run_id, fault, knob. Empty for one that may run."""
    names = lambda k: F.create_map(*[x for axis, sets in KNOBS.items() for x in (F.lit(axis), F.array(*map(F.lit, sets[k])))])
    required, allowed = (F.try_element_at(names(k), F.col("axis")) for k in (0, 1))
    given = F.map_keys("config")
    fault = lambda text, knobs: F.transform(F.coalesce(knobs, F.array().cast("array<string>")), lambda k: F.struct(F.lit(text).alias("fault"), k.alias("knob")))
    faults = F.when(required.isNull(), F.array(F.struct(F.lit("unknown axis").alias("fault"), F.col("axis").alias("knob")))).otherwise(
        F.concat(fault("missing", F.array_except(required, given)), fault("not of the axis", F.array_except(given, allowed)))
    )
    return requests.select("run_id", F.explode(faults).alias("x")).select("run_id", "x.*")


def new_runs(requests: DataFrame, done: DataFrame, sets: DataFrame) -> DataFrame:
    """Benchmark requests (axis, gold_id, pins, config) on active gold sets that haven't been run with the same settings."""
    key = ["axis", "gold_id", "pins", "config"]
    active = sets.filter("status = 'active'").select("gold_id")
    return requests.join(active, "gold_id", "left_semi").join(done.filter("status = 'ok'").select(*key), key, "left_anti").select(*requests.columns)
