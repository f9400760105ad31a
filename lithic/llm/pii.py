r"""Personal data by weak supervision, in Spark expressions only.

Candidates are matches of strict patterns (the base spans) and of looser ones; secrets (tokens, keys) have looser ones only. Four labelers
vote on each candidate for (1), against (-1) or not at all (0): the pattern, a gazetteer (domain endings, country codes, card issuers, reserved
addresses, key prefixes), the words just before, and the candidate's shape. Expectation-maximisation over the counted vote patterns
estimates every labeler's reliability for each kind by itself, a domain ending being another matter than an address range; the
posteriors are soft labels for a logistic regression over votes, each kind's own, and
shape features of the looser candidates, on which it decides. Base spans always stay; an added span never overlaps a base span
or an earlier added one.

The data that reach the driver are one row of sums per EM round and the coefficients of the regression. Vote patterns and
feature vectors are finitely many, so the training tables have a fixed bound whatever the corpus.

Null texts are empty; a text without matches has no spans; repeated rows are scored each; other columns are ignored; an
empty table gives an empty result. Offsets are code points, end exclusive.

A start that the strict patterns would try in vain is ruled out by lookbehind, which leaves the matches as they are and
keeps long runs of letters or digits linear. A card is a whole run of digits with single separators, so its 12 to 19
digits are asked for directly.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{LOCAL})[A-Za-z0-9._%+-]{{1,64}}+ ?(?i:\(at\)|\[at\]) ?[A-Za-z0-9-]{{1,63}}+ ?(?i:\.|\(dot\)|\[dot\]) ?[A-Za-z]{{2,12}}",
    # eight groups, or fewer with one :: for the zeros
    "ip": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,39}[0-9])(?=[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{1,4}){0,6}::)(?![0-9A-Fa-f:]{0,39}:::)(?![0-9A-Fa-f:]{0,39}::[0-9A-Fa-f:]{0,39}::)"
    r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9]{4}(?:[ -][0-9]{4}){3}(?![ -]?[0-9])",
    "phone": r"(?<![0-9+().-])(?<![0-9] )(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{3,4}[ .-][0-9]{3,5}(?![ .-]?[0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+",
}
# Fixed values of the gazetteer: generic endings of domains (those of countries are the JVM's table of ISO 3166), the calling codes of E.164 by zone, addresses that
# RFC 1918, 3927, 4193 and 4291 reserve, and how public services begin their keys.
TLDS = ("aero", "app", "arpa", "asia", "biz", "cat", "cloud", "co", "com", "coop", "dev", "edu", "eu", "gov", "info", "int", "io", "jobs", "mil", "mobi", "museum", "name", "net", "online", "org", "pro", "shop", "site", "tel", "travel", "uk", "xyz")
COUNTRY_CODES = r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[0578]|9[679])[0-9])"
RESERVED_IP = r"(?i)^(?:(?:0|10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|255)\.|::1?$|fe80:|f[cd][0-9a-f]{2}:|ff[0-9a-f]{2}:)"
KEY_PREFIXES = r"^(?:AKIA|ASIA|AIza|SG\.|eyJ|dop_v1_|gh[opsu]_|github_pat_|glpat-|hf_|npm_|pk_live_|pypi-|rk_live_|shpat_|sk-|sk_live_|whsec_|xapp-|xox[abeprs]-|ya29)"
ISSUERS = r"^(?:3[47]|3[068]|4|5[1-5]|2[2-7]|6)"
NEAR = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|address|correo|adresse)\W*$|(?i)(?:mail|contact|write)",
    "ip": r"(?i)(?:\bip\b|host|server|address|login|client|serveur)",
    "card": r"(?i)(?:card|visa|credit|payment|pay|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|dial|contact|telefon)",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|credential|bearer|api.?key|access.?key|private.?key)\W*$",
}
FAR = {kind: r"(?i)(?:isbn|version|serial|order|invoice|token|secret|key|hash|sha|commit|build)\W*$" for kind in ("email", "ip", "card", "phone")}
FAR["secret"] = r"(?i)(?:isbn|version|serial|order|invoice|hash|sha-?[0-9]*|md5|commit|build|checksum|uuid)\W*$"
CONTEXT = 40
#: A longer run of letters and digits is encoded data rather than a key.
LONG_SECRET = 2000
VOTERS = ("pattern", "gazetteer", "context", "shape")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(number), "")
    values = F.transform(
        places,
        lambda p, i: F.when(i % 2 == 0, F.try_to_number(p, F.lit("9")).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(2 * v - 9 * (v > 4)) for v in range(10)]), F.try_to_number(p, F.lit("9")).cast("int") + 1)
        ),
    )
    total = F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)))
    return total % 10 == 0


def base_holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def votes(kind: str, base: bool, m: Column, before: Column, endings: list[str]) -> list[Column]:
    d, known_key = digits(m), m.rlike(KEY_PREFIXES)
    say = lambda yes, no=None: F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)
    gazetteer = {
        "email": say(F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).isin(*endings), F.regexp_extract(m, r"([A-Za-z]+)$", 1) == ""),
        "ip": say(~m.rlike(RESERVED_IP), m.rlike(RESERVED_IP)),
        "card": say(d.rlike(ISSUERS), ~d.rlike(ISSUERS)),
        "phone": say(m.rlike(COUNTRY_CODES), F.lit(False)),
        "secret": say(known_key, F.length(m) > LONG_SECRET),
    }[kind]
    shape = {
        "email": say(m.rlike(r"^[A-Za-z]") & (F.length(m) < 60), F.length(m) >= 100),
        "ip": say(F.length(m).between(7, 39), m.rlike(r"(?:^|\.)0[0-9]")),
        "card": say(F.length(d).isin(13, 15, 16) & m.rlike(r"^[0-9]+$|^[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2}$"), F.length(d) < 13),
        "phone": say(F.length(d).between(9, 13), F.length(d) < 8),
        "secret": say((F.length(d) >= 4) & (F.length(m) - F.length(d) >= 4) & (F.length(m) <= LONG_SECRET), ~known_key & ((F.length(d) < 2) | (F.length(m) > LONG_SECRET) | m.rlike(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$|[-_/]{2}|^[a-z]+(?:[-_/][a-z0-9]+)+$"))),
    }[kind]
    if kind == "secret":
        pattern = say(m.rlike("^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$"), ~known_key & ~m.rlike("[0-9][^0-9]+[0-9]"))
    else:
        pattern = F.lit(1) if base else F.when(luhn(d), 0).otherwise(-1) if kind == "card" else F.lit(0)
    return [pattern, gazetteer, say(before.rlike(NEAR[kind]), before.rlike(FAR[kind])), shape]


def matches(text: Column, pattern: str) -> tuple[Column, Callable[[Column], Column]]:
    """All matches of a pattern, and from them the array of (start, m, before)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pieces = F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda a, g: F.struct(a.alias("m"), F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("before")))
        out = "array<struct<start:int,m:string,before:string>>"
        walked = F.aggregate(
            pieces,
            F.struct(F.lit(0).alias("at"), F.array().cast(out).alias("out")),
            lambda a, p: F.struct(
                (a["at"] + p["gap"] + F.length(p["m"])).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), p["m"].alias("m"), p["before"].alias("before")))).alias("out"),
            ),
        )
        return F.when(F.size(m) > 0, walked["out"]).otherwise(F.array().cast(out))

    return found, placed


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (start, end, rank, base, votes v0..v3, features), base spans first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("text"))
    columns = {}
    # a text is searched for a kind only if it has the characters that every match needs
    has = {
        ("email", True): F.contains("text", F.lit("@")), ("phone", True): F.contains("text", F.lit("+")),
        ("email", False): F.col("text").rlike(r"(?i)\(at\)|\[at\]"), ("ip", False): F.col("text").rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:|::[0-9A-Fa-f]"), ("secret", False): F.col("text").rlike("[A-Za-z0-9+/_-]{20}"),
    }
    places = {}
    endings = sorted({*TLDS, *(c.lower() for c in docs.sparkSession._jvm.java.util.Locale.getISOCountries())})
    for kind in KINDS:
        for strict, patterns in ((True, BASE), (False, LOOSE)):
            if kind not in patterns:
                continue
            found, placed = matches(F.col("text"), patterns[kind])
            name = f"{kind}_{'base' if strict else 'loose'}"
            columns[name] = F.when(has.get((kind, strict), F.col("digit")), found).otherwise(F.array().cast("array<string>"))
            places[name] = (kind, strict, placed)
    rows = base.withColumn("digit", F.col("text").rlike("[0-9][^0-9]?[0-9]")).withColumns(columns)

    def described(name: str) -> Column:
        kind, strict, placed = places[name]
        spans = placed(F.col(name))
        if strict:
            spans = F.filter(spans, lambda s: base_holds(kind, s["m"]))

        def one(s: Column) -> Column:
            v = votes(kind, strict, s["m"], s["before"], endings)
            return F.struct(
                s["start"].alias("start"), (s["start"] + F.length(s["m"])).alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(strict).alias("base"),
                *[c.cast("int").alias(f"v{i}") for i, c in enumerate(v)],
                F.least(F.length(digits(s["m"])), F.lit(20)).alias("n_digits"), s["m"].rlike("[ ().-]").cast("int").alias("separated"),
            )

        return F.transform(spans, one)

    return rows.select("doc_id", F.concat(*[described(f"{k}_base") for k in BASE], *[described(f"{k}_loose") for k in LOOSE]).alias("spans"))


Chances = dict[tuple[int, int, int, int], float]


Priors = dict[tuple[int, bool], float]


def reliabilities(patterns: DataFrame, rounds: int = 8) -> tuple[Priors, Chances]:
    """EM over the counted vote patterns (rank, base, v0..v3, n): the share of true candidates per kind and pattern, strict or looser, and the chance of each
    vote given (kind, voter, truth), if there is a vote: not to vote says nothing. Starts from the votes' majority, so truth means what most labelers vote for."""
    kinds, voters = range(len(KINDS)), range(len(VOTERS))
    majority = sum(F.col(f"v{i}") for i in voters)
    posterior = 1 / (1 + F.exp(-majority.cast("double")))
    prior, chance = {}, {}
    for _ in range(rounds):
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("k")]
        for i in voters:
            for v in (-1, 1):
                is_v = (F.col(f"v{i}") == v).cast("int")
                sums += [F.sum(F.col("n") * F.col("p") * is_v).alias(f"t{i}_{v + 1}"), F.sum(F.col("n") * (1 - F.col("p")) * is_v).alias(f"f{i}_{v + 1}")]
        rows = {(r["rank"], r["base"]): r.asDict() for r in patterns.withColumn("p", posterior).groupBy("rank", "base").agg(*sums).collect()}  # two rows a kind
        total = lambda k, name: sum((rows.get((k, base), {}).get(name) or 0.0) for base in (True, False))
        for k in kinds:
            for base in (True, False):
                got = rows.get((k, base), {})
                prior[k, base] = ((got.get("k") or 0.0) + 1) / ((got.get("n") or 0.0) + 2)
            for i in voters:
                for truth, name, right in ((1, "t", 2), (0, "f", 0)):
                    # where there is little to go by, a labeler counts as better than chance
                    against, for_ = (total(k, f"{name}{i}_{v}") + (4.0 if v == right else 1.0) for v in (0, 2))
                    chance |= {(k, i, truth, v): x / (against + for_) for v, x in ((-1, against), (1, for_))}
        posterior = posterior_of(prior, chance)
    return prior, chance


def posterior_of(prior: Priors, chance: Chances) -> Column:
    odds = F.lit(0.0)
    for (k, base), p in prior.items():
        own = F.lit(math.log(p / (1 - p)))
        for i in range(len(VOTERS)):
            ratio = F.lit(0.0)
            for v in (-1, 1):
                ratio = F.when(F.col(f"v{i}") == v, math.log(chance[k, i, 1, v] / chance[k, i, 0, v])).otherwise(ratio)
            own = own + ratio
        odds = F.when((F.col("rank") == k) & (F.col("base") == base), own).otherwise(odds)
    return 1 / (1 + F.exp(-odds))


FEATURES = ["rank", "base", "v0", "v1", "v2", "v3", "n_digits", "separated"]


def feature_columns(get: Callable[[str], Column]) -> list[Column]:
    kinds = [(get("rank") == k).cast("double") for k in range(len(KINDS))]
    votes_ = [get(f"v{i}").cast("double") * k for k in kinds for i in range(len(VOTERS))]
    lengths = [get("n_digits").between(a, b).cast("double") for a, b in ((0, 8), (9, 12), (13, 16), (17, 20))]
    return kinds + votes_ + lengths + [get("separated").cast("double")]


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs: doc_id, text. One row per row: doc_id and spans, an array of (start, end, kind, base) in order."""
    rows = stored(candidates(docs), "pii-candidates")
    counted = rows.select(F.explode("spans").alias("s")).select("s.*").groupBy(*FEATURES).agg(F.count("*").alias("n"))
    counted = stored(counted.coalesce(1), "pii-patterns")  # a bounded number of distinct feature vectors
    kept = lambda s: s["base"]
    looser = counted.filter(~F.col("base"))  # what is to be decided
    if not looser.isEmpty():
        prior, chance = reliabilities(counted)
        soft = looser.withColumn("p", posterior_of(prior, chance))
        named = [c.alias(f"f{i}") for i, c in enumerate(feature_columns(F.col))]
        both = soft.select(*named, F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")).unionByName(
            soft.select(*named, F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight"))
        )
        vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(named))], outputCol="features").transform(both)
        model = LogisticRegression(weightCol="weight", maxIter=50, regParam=1e-4).fit(vectors)
        weights, bias = [float(w) for w in model.coefficients], float(model.intercept)

        def kept(s: Column) -> Column:
            raw = F.lit(bias)
            for w, c in zip(weights, feature_columns(lambda n: s[n]), strict=True):
                raw = raw + w * c
            return s["base"] | (raw >= math.log(threshold / (1 - threshold)))

    def added(taken: Column, s: Column) -> Column:
        return F.when(s["base"] | ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), F.concat(taken, F.array(s))).otherwise(taken)

    chosen = F.transform(
        F.filter("spans", kept),
        lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["base"].alias("base")),
    )
    kind = "array<struct<start:int,rank:int,end:int,base:boolean>>"
    base_spans = F.filter(chosen, lambda s: s["base"])
    loose = F.filter(chosen, lambda s: ~s["base"])
    walked = F.when(F.size(loose) == 0, base_spans).otherwise(F.aggregate(loose, base_spans.cast(kind), added))
    return rows.select("doc_id", F.array_sort(walked).alias("found")).select(
        "doc_id",
        F.transform(
            "found",
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind"), s["base"].alias("base")),
        ).alias("spans"),
    )


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
