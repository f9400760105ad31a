"""Text functions as column expressions; the few that need Python are Arrow UDFs."""

from __future__ import annotations

import difflib
import fnmatch

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))

    def of(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 when both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def token_jaccard(a: Column, b: Column) -> Column:
    return set_similarity(tokens(a), tokens(b))


def canonical_predicate(c: Column) -> Column:
    """Trimmed and lower-cased, with blanks and hyphens as one underscore."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


# Predicates of the baseline ontology, and aliases as (canonical predicate, whether sides are swapped).
PREDICATES = ("authored_by", "mentions", "part_of", "supersedes", "reports_to", "owns", "governs", "participated_in", "references", "derived_from")
ALIASES = {
    "owned_by": ("owns", True),
    "owner_of": ("owns", False),
    "authored": ("authored_by", True),
    "wrote": ("authored_by", True),
    "written_by": ("authored_by", False),
    "belongs_to": ("part_of", False),
    "member_of": ("part_of", False),
    "refers_to": ("references", False),
    "mentioned_in": ("mentions", True),
    "governed_by": ("governs", True),
    "replaces": ("supersedes", False),
    "superseded_by": ("supersedes", True),
    "replaced_by": ("supersedes", True),
    "derives_from": ("derived_from", False),
    "participates_in": ("participated_in", False),
}


def normalised_predicate(c: Column, predicates: tuple[str, ...] = PREDICATES, aliases: dict[str, tuple[str, bool]] = ALIASES) -> tuple[Column, Column]:
    """The canonical predicate, or null for an unknown one, and whether subject and object change places."""
    canon = canonical_predicate(c)
    names = F.create_map(*[F.lit(x) for p in predicates for x in (p, p)], *[F.lit(x) for a, (p, _) in aliases.items() for x in (a, p)])
    return F.try_element_at(names, canon), canon.isin([a for a, (_, swap) in aliases.items() if swap])


def email(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0)), F.lit(""))


def domain(c: Column) -> Column:
    """The domain of the email if there is one, else the first bare domain of six common endings."""
    bare = F.nullif(F.lower(F.regexp_extract(c, r"\b(?:[A-Za-z0-9-]+\.)+(?:com|org|net|io|gov|edu)\b", 0)), F.lit(""))
    return F.coalesce(F.nullif(F.substring_index(email(c), "@", -1), F.lit("")), bare)


def tax_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b\d{2}-\d{7}\b", 0), F.lit(""))


def identifiers(c: Column) -> Column:
    """Identifiers found in a text as a map; absent ones are left out."""
    pairs = [("email", email(c)), ("domain", domain(c)), ("tax_id", tax_id(c))]
    return F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def outline(c: Column) -> Column:
    """Markdown headings of a text as (level, title)."""
    heads = F.regexp_extract_all(c, F.lit(r"(?m)^#{1,6}[ \t]+\S.*$"), F.lit(0))
    return F.transform(
        heads,
        lambda h: F.struct(
            F.length(F.regexp_extract(h, "^#+", 0)).alias("level"), F.trim(F.regexp_replace(F.regexp_replace(h, r"^#+[ \t]+", ""), r"[ \t]*#*$", "")).alias("title")
        ),
    )


def context_prefix(title: Column, section: Column, doc_type: Column) -> Column:
    place = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", section '"), section, F.lit("'"))).otherwise(F.lit(""))
    return F.concat(F.lit("This passage is from the "), doc_type, F.lit(" '"), title, F.lit("'"), place, F.lit("."))


def embedding_text(prefix: Column, content: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(prefix, F.lit("")), content)


def chunk_identity(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; a null part is empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Whether a path or its last part matches one of the globs, whatever the case."""
    low = F.lower(path)
    hit = F.lit(False)
    for p in patterns:
        regex = fnmatch.translate(p.lower()).replace(r"\z", r"\Z")
        hit = hit | low.rlike(f"^{regex}") | F.substring_index(low, "/", -1).rlike(f"^{regex}")
    return hit


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of casefolded, trimmed names."""
    return pd.Series(
        [None if x is None or y is None else difflib.SequenceMatcher(None, x.casefold().strip(), y.casefold().strip()).ratio() for x, y in zip(a, b, strict=True)], dtype=float
    )


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler similarity with the usual prefix weight of 0.1 for up to four characters."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    common = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                common.append(x)
                break
    if not common:
        return 0.0
    other = [y for y, t in zip(b, taken, strict=True) if t]
    m, half = len(common), sum(x != y for x, y in zip(common, other, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def find_span(needle: Column | str, text: Column | str) -> Column:
    """Where a quote is in a text, as (start, end) in characters: as it is, else its words in any case with any white space between. Null if nowhere or blank."""
    needle, text = (F.col(c) if isinstance(c, str) else c for c in (needle, text))
    words = F.filter(F.split(needle, r"(?U)\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit("(?iuU)"), F.array_join(quoted, "\\s+"))
    exact = F.instr(text, needle)
    loose = F.regexp_substr(text, pattern)
    before = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
    span = lambda start, size: F.struct(start.cast("int").alias("start"), (start + size).cast("int").alias("end"))
    return F.when(F.size(words) > 0, F.when(exact > 0, span(exact - 1, F.length(needle))).when(F.length(loose) > 0, span(before, F.length(loose))))


# English stop words of the keyword index.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")


def search_terms(c: Column) -> Column:
    """Terms of a keyword index: lower-cased words without stop words, plural and verb endings cut."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    cut = lambda w: F.when(F.endswith(w, F.lit("s")), F.when(F.endswith(w, F.lit("es")), 2).otherwise(1)).when(F.endswith(w, F.lit("ed")), 2).when(F.endswith(w, F.lit("ing")), 3).otherwise(0)
    kept = F.filter(words, lambda w: (F.length(w) > 4) | ~w.isin(*STOP_WORDS))  # no stop word is longer
    return F.transform(kept, lambda w: F.when(F.length(w) > 4, F.substr(w, F.lit(1), F.length(w) - cut(w))).otherwise(w))


def plain_terms(c: Column) -> Column:
    """Terms of a keyword index that matches words as they are, but for their case."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def keyword_rank(terms: Column, query: Column) -> Column:
    """Rank of a document that has all query terms: mean over them of tf / (tf + 1); null if one is missing."""
    tf = F.transform(F.array_distinct(query), lambda q: F.size(F.filter(terms, lambda t: t == q)))
    total = F.aggregate(tf, F.lit(0.0), lambda a, n: a + n / (n + 1))
    return F.when((F.size(query) > 0) & F.forall(tf, lambda n: n > 0), total / F.size(tf))


def corrupted_name(name: Column, kind: Column) -> Column:
    """A noisy variant of a name, for evaluation sets: company suffix, abbreviation or swapped letters, by kind 0 to 2."""
    initials = F.array_join(F.transform(F.split(name, r"\s+"), lambda w: F.substring(w, 1, 1)), "")
    swapped = F.concat(F.substring(name, 1, 1), F.substring(name, 3, 1), F.substring(name, 2, 1), F.substr(name, F.lit(4), F.lit(2**31 - 1)))
    return F.when(kind == 0, F.concat(name, F.lit(" Inc."))).when((kind == 1) & (F.length(initials) > 1), initials).otherwise(swapped)
