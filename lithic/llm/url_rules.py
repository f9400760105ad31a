"""URL filtering by association rules.

Explicit rules (host suffix and path prefix, longest wins) judge what they fit. The URLs they judge are the labelled
transactions from which Spark's FP-growth mines combinations of URL tokens that go with a verdict; rules pruned by
support, confidence and redundancy (a rule goes if dropping one token gives one of the same action and no less confidence) then judge
the other URLs.

Templates would make FP-growth list all subsets of their tokens, so two kinds of tokens are settled before. A token that only ever goes with
one action is a rule by itself and makes all rules redundant that hold it, so it isn't mined. Tokens of exactly the same labelled URLs are
mined as one item; in a rule it stands for any of them, which is what the rules for each would say. What is left for
FP-growth are tokens of mixed actions that differ in some URL.

A mined rule is looked up by the tokens of its rarest item, an inverted index, and checked against the URL's whole token set. Distinct token
sets are judged once, so a host with very many pages costs one lookup, and only tokens that some rule is looked up by are posted.

Of several rules that fit, the one of greatest confidence decides, then the one with more items, then the greater action name
(block before allow). Null URLs or URLs without `://` have empty host and path, fit no explicit rule and, having no tokens, get `default`. Repeated
rows are judged each; an empty table gives an empty result. URLs of any length are judged in whole.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import ascii_lower, discard, stored

Rule = tuple[str, str]  # action, "host/path"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def explicit_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its action, or nulls. The rules become one expression: a list of at most some hundreds."""
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = F.endswith(F.concat(F.lit("."), host), F.lit("." + name)) & F.startswith(path, F.lit("/" + rest))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, registered domain, path words, file extension, query keys. Numbers are dropped."""
    url = F.coalesce(url, F.lit(""))
    tagged = lambda tag, parts: F.transform(parts, lambda p: F.concat(F.lit(tag), p))
    labels = F.split(host, r"\.")
    words = F.split(F.lower(path), r"[^\p{L}]+")
    keys = F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), F.lit(1))
    tokens = F.concat(
        tagged("scheme:", F.array(F.regexp_extract(url, r"^([a-z]+)://", 1))),
        tagged("host:", labels),
        tagged("domain:", F.array(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))),
        tagged("path:", words),
        tagged("key:", keys),
    )
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: ~F.endswith(t, F.lit(":")))))


def token_items(sets: DataFrame, least: int) -> DataFrame:
    """sets: token_set, tokens, action, n. Frequent tokens: token, n, only (the action that it always goes with, else null), item (its equals' name)."""
    each = sets.select(F.explode("tokens").alias("token"), "n", "action", F.xxhash64("token_set").alias("h"), F.crc32("token_set").alias("c"))
    cover = (F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.sum(F.col("c")).alias("t"), F.count("*").alias("k"))
    found = each.groupBy("token").agg(F.sum("n").alias("n"), F.min("action").alias("least"), F.max("action").alias("greatest"), *cover).filter(F.col("n") >= least)
    only = F.when(F.col("least") == F.col("greatest"), F.col("least"))
    return found.select("token", "n", only.alias("only"), F.sha2(F.concat_ws(" ", "s", "t", "k", "n"), 256).alias("item"))


def mined_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame | None:
    """labelled: token_set, tokens, action. Rules: antecedent (items, each an array of tokens any of which will do), action, confidence, support; None where there is nothing to learn from."""
    total = labelled.count()
    if not total:
        return None
    sets = stored(labelled.groupBy("token_set", "tokens", "action").agg(F.count("*").alias("n")), "url-labelled")
    tokens = stored(token_items(sets, math.ceil(min_support * total)), "url-items")
    pure = tokens.filter("only IS NOT NULL").select(F.array(F.array("token")).alias("antecedent"), F.col("only").alias("action"), F.lit(1.0).alias("confidence"), (F.col("n") / total).alias("support"))
    mixed = tokens.filter("only IS NULL").groupBy("item").agg(F.array_sort(F.collect_set("token")).alias("any_of"))
    mixed = stored(mixed, "url-mixed")
    members = mixed.select("item", F.explode("any_of").alias("token"))
    items = sets.select("token_set", F.explode("tokens").alias("token")).join(members, "token").groupBy("token_set").agg(F.collect_set("item").alias("items"))
    baskets = labelled.select("token_set", "action").join(items, "token_set", "left")
    baskets = baskets.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit("action="), "action"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit("action="))).select(
        F.array_sort("antecedent").alias("antecedent"),
        F.substring(F.col("consequent")[0], len("action=") + 1, 100).alias("action"),
        "confidence",
        "support",
    )
    rules = stored(rules.filter(~F.exists("antecedent", lambda t: F.startswith(t, F.lit("action=")))), "url-rules")
    shorter = rules.select(
        F.explode(F.transform("antecedent", lambda t: F.array_remove(F.col("antecedent"), t))).alias("less"),
        "antecedent", "action", "confidence",
    )
    simple = rules.select(F.col("antecedent").alias("less"), "action", F.col("confidence").alias("simple_confidence"))
    redundant = shorter.join(simple, ["less", "action"]).filter(F.col("simple_confidence") >= F.col("confidence") - 1e-9)
    left = rules.join(redundant.select("antecedent", "action").distinct(), ["antecedent", "action"], "left_anti").withColumn("rule", F.xxhash64("antecedent", "action"))
    spelt = left.select("rule", F.explode("antecedent").alias("item")).join(mixed, "item").groupBy("rule").agg(F.collect_list("any_of").alias("any_of"))
    mined = left.join(spelt, "rule").select(F.col("any_of").alias("antecedent"), "action", "confidence", "support")
    out = stored(pure.unionByName(mined), "url-rules")
    discard(sets, tokens, mixed, rules)
    return out


def judge(pages: DataFrame, rules: list[Rule], min_support: float = 0.005, min_confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """pages: page_id, url. One row per row: page_id, host, path, rule, verdict, confidence (null unless a mined rule decided)."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, action = explicit_rule(F.col("host"), F.col("path"), rules)
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    rows = stored(parsed.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), tokens.alias("tokens")), "url-tokens")
    rows = rows.withColumn("token_set", F.array_join("tokens", "\n"))
    open_rows = rows.filter("action IS NULL")
    learned = mined_rules(rows.filter("action IS NOT NULL").select("token_set", "tokens", "action"), min_support, min_confidence)
    if learned is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("confidence"))

    sets = stored(open_rows.select("token_set", "tokens").dropDuplicates(["token_set"]).withColumn("set_id", F.md5("token_set")).drop("token_set"), "url-token-sets")
    frequency = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    numbered = stored(learned.withColumn("rule_id", F.xxhash64("antecedent", "action")), "url-rules")
    # the item whose tokens are rarest together
    each = numbered.select("rule_id", F.posexplode("antecedent").alias("at", "any_of")).select("rule_id", "at", "any_of", F.explode("any_of").alias("token"))
    weighed = each.join(frequency, "token", "left").groupBy("rule_id", "at").agg(F.sum(F.coalesce("df", F.lit(0))).alias("df"), F.first("any_of").alias("any_of"))
    rarest = weighed.groupBy("rule_id").agg(F.min(F.struct("df", "at", "any_of")).alias("r")).select("rule_id", F.explode("r.any_of").alias("token"))
    rarest = stored(rarest, "url-rule-index")
    postings = sets.select("set_id", F.explode("tokens").alias("token")).join(rarest, "token").select("set_id", "rule_id").distinct()
    hits = postings.join(sets, "set_id").join(numbered.drop("support"), "rule_id").filter(F.forall("antecedent", lambda any_of: F.arrays_overlap(any_of, F.col("tokens"))))
    best = hits.groupBy("set_id").agg(F.max(F.struct("confidence", F.size("antecedent").alias("n"), "action")).alias("best"))
    best = stored(best.select("set_id", F.col("best.action").alias("mined"), F.col("best.confidence").alias("confidence")), "url-verdicts")
    discard(learned, sets, numbered, rarest)
    open_rows = open_rows.withColumn("set_id", F.md5("token_set"))
    judged = open_rows.join(best, "set_id", "left").select("page_id", "host", "path", "rule", F.coalesce("mined", F.lit(default)).alias("verdict"), "confidence")
    fixed = rows.filter("action IS NOT NULL").select("page_id", "host", "path", "rule", F.col("action").alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    return judged.unionByName(fixed)
