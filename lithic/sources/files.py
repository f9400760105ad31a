"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.functions.text import glob_match

DELIMITERS = ",;\t|"


def scanned(spark: SparkSession, root: str, recurse: bool = True) -> DataFrame:
    """Files below a root: path, native_id (path below the root), size, modified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower()).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^file:/*", "/")
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select("path", F.replace(path, base, F.lit("")).alias("native_id"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def skipped_because(native_id: Column, include: list[str], exclude: list[str], extensions: list[str]) -> Column:
    """Why a file isn't taken, or null: hidden, excluded, not included, ending. Exclusion wins over inclusion."""
    hidden = native_id.rlike(r"(^|/)\.[^/]")
    ending = F.lower(F.regexp_extract(native_id, r"(\.[^./]+)$", 1))
    return (
        F.when(hidden, "hidden")
        .when(glob_match(native_id, exclude) if exclude else F.lit(False), "excluded")
        .when(~glob_match(native_id, include) if include else F.lit(False), "not_included")
        .when(~ending.isin([e.lower() for e in extensions]) if extensions else F.lit(False), "extension")
    )


def cursor(modified: Column, native_id: Column) -> Column:
    """Cursor token whose string order is the order of modification: twenty digits of nanoseconds, then the id."""
    return F.format_string("%020d:%s", F.unix_micros(modified) * 1000, native_id)


def since(files: DataFrame, token: str | None) -> DataFrame:
    rows = files.withColumn("cursor", cursor(F.col("modified"), F.col("native_id")))
    return rows if token is None else rows.filter(F.col("cursor") > token)


def mode_grants(mode: Column, owner: Column, group: Column) -> Column:
    """POSIX permission bits as grants (principal, right)."""
    grants = [(400, owner, "read"), (200, owner, "write"), (40, group, "read"), (20, group, "write"), (4, F.lit("everyone"), "read"), (2, F.lit("everyone"), "write")]
    found = F.array(*[F.when(mode.bitwiseAND(F.lit(int(str(bit), 8))) != 0, F.struct(who.alias("principal"), F.lit(right).alias("right"))) for bit, who, right in grants])
    return F.filter(found, lambda g: g.isNotNull())


def sniffed_delimiter(head: str) -> str:
    """The delimiter that the first lines agree on most; a comma if none occurs."""
    lines = [x for x in head[:4096].lstrip("﻿").splitlines() if x.strip()][:10]
    score = lambda d: (min((x.count(d) for x in lines), default=0), sum(x.count(d) for x in lines))
    best = max(DELIMITERS, key=score)
    return best if score(best)[1] else ","


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table with trimmed header, blank rows dropped; the delimiter is found in the first lines."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(10).collect())
    df = spark.read.csv(path, header=True, sep=sniffed_delimiter(head), encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.filter(F.greatest(*[F.length(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in df.columns], F.lit(0)) > 0)


class _Markdown(HTMLParser):
    """Headings, paragraphs and list items of HTML as Markdown lines."""

    def __init__(self) -> None:
        super().__init__()
        self.lines, self.hidden, self.prefix = [""], 0, ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.lines.append("#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "br", "tr", "ul", "ol", "table"):
            self.lines.append("")
        elif tag == "li":
            self.lines.append("- ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li"):
            self.lines.append("")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.lines[-1] += " ".join(data.split()) + (" " if data[-1:].isspace() else "")


def html_to_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    return "\n".join(x.rstrip() for x in parser.lines if x.strip("#- \n"))


@F.pandas_udf(T.StringType())
def markdown(html: pd.Series) -> pd.Series:
    return html.map(html_to_markdown)


PROVISIONS = "source string, identifier string, level string, num string, heading string, parent string, text string, refs array<string>"
LEVELS = ("title", "subtitle", "chapter", "subchapter", "part", "subpart", "section", "subsection", "paragraph", "subparagraph", "clause", "subclause")


def provisions_of(xml: str) -> Iterator[tuple[str, str, str | None, str | None, str | None, str, list[str]]]:
    """Provisions of a statute in document order: identifier, level, num, heading, parent's identifier, own text, references. Notes are left out."""

    def tag(e: ElementTree.Element) -> str:
        return e.tag.rpartition("}")[2]

    def plain(e: ElementTree.Element) -> str:
        return " ".join("".join(e.itertext()).split())

    def walk(e: ElementTree.Element, parent: str | None) -> Iterator[tuple]:
        ident = e.get("identifier")
        if tag(e) in LEVELS and ident:
            child = {tag(c): plain(c) for c in reversed(e)}
            own = [c for c in e if tag(c) in ("content", "chapeau", "continuation")]
            refs = [r.get("href") for c in own for r in c.iter() if tag(r) == "ref" and r.get("href")]
            yield ident, tag(e), child.get("num"), child.get("heading"), parent, " ".join(map(plain, own)), refs
            parent = ident
        for c in e:
            if tag(c) not in ("note", "notes"):
                yield from walk(c, parent)

    yield from walk(ElementTree.fromstring(xml), None)


def parsed_provisions(files: DataFrame) -> DataFrame:
    """files: native_id, content (XML). One row per provision."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(n, *p) for n, c in zip(f.native_id, f.content, strict=True) for p in provisions_of(bytes(c).decode("utf-8-sig"))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROVISIONS.split(", ")])

    return files.select("native_id", "content").mapInPandas(run, PROVISIONS)


# How structural levels of a statute are cited.
LEVEL_LABELS = {"st": "subtitle ", "ch": "ch. ", "sch": "subch. ", "pt": "pt. ", "spt": "subpt. ", "d": "div. "}
SEGMENT = r"^([a-z]+)([A-Za-z0-9.\u2013-]+)$"


def citation(identifier: Column) -> Column:
    """Citation of a statute identifier: /us/usc/t26/s501/c/3 is 26 U.S.C. § 501(c)(3), /us/usc/t26/ch1/schA is 26 U.S.C. ch. 1, subch. A.

    What stands after the section is the trail in brackets. An identifier that can't be read, or names several, or of which only the
    title can be read, stays as it is: a wrong citation is worse than an ugly one. Null gives an empty one.
    """
    whole = F.coalesce(identifier, F.lit(""))
    segments = F.filter(F.split(F.substring(whole, 9, 1 << 30), "/"), lambda x: x != "")
    level, number = (lambda x: F.regexp_extract(x, SEGMENT, 1)), (lambda x: F.regexp_extract(x, SEGMENT, 2))
    place = F.array_position(F.transform(segments, level), "s").cast("int")  # 0 without a section
    head = F.when(place > 0, F.slice(segments, F.lit(1), F.greatest(place - 1, F.lit(0)))).otherwise(segments)
    titles = F.filter(head, lambda x: level(x) == "t")
    stem = F.when(F.size(titles) > 0, F.concat(number(F.element_at(titles, -1)), F.lit(" U.S.C."))).otherwise("U.S.C.")
    labels = F.create_map(*[F.lit(x) for pair in LEVEL_LABELS.items() for x in pair])
    parts = F.transform(F.filter(head, lambda x: ~level(x).isin("", "t")), lambda x: F.concat(F.coalesce(F.element_at(labels, level(x)), F.concat(level(x), F.lit(" "))), number(x)))
    trail = F.concat(F.filter(head, lambda x: level(x) == ""), F.slice(segments, F.greatest(place + 1, F.lit(1)), F.size(segments)))
    cited = (
        F.when(place > 0, F.concat(stem, F.lit(" § "), number(F.get(segments, place - 1)), F.array_join(F.transform(trail, lambda x: F.concat(F.lit("("), x, F.lit(")"))), "")))
        .when(F.size(parts) > 0, F.concat(stem, F.lit(" "), F.array_join(parts, ", ")))
        .when(F.size(segments) == 1, stem)
    )
    readable = whole.startswith("/us/usc/") & ~whole.rlike(r"(?U)\s")
    return F.coalesce(F.when(readable, cited), whole)


ONTOLOGY = "version string, effective_from string, entity_types array<string>, predicates array<string>, predicate_aliases map<string, struct<predicate:string, swap:boolean>>"


def ontology(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ONTOLOGY).json(path, multiLine=True)


def ontology_faults(df: DataFrame) -> DataFrame:
    """Why an ontology can't be registered: version, fault. Empty if it can."""
    empty = lambda c: F.size(F.coalesce(c, F.array())) == 0
    unknown = F.filter(F.map_values(F.coalesce("predicate_aliases", F.create_map())), lambda a: ~F.coalesce(F.array_contains("predicates", a["predicate"]), F.lit(False)))
    checks = {
        "no version": F.coalesce("version", F.lit("")) == "", "no entity types": empty("entity_types"), "no predicates": empty("predicates"),
        "repeated predicate": F.size(F.array_distinct(F.coalesce("predicates", F.array()))) != F.size(F.coalesce("predicates", F.array())),
        "alias of an unknown predicate": F.size(unknown) > 0,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.select("version", F.explode(found).alias("fault"))


def blob_rows(items: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Content-addressed blobs to write: key tenant/first two/hash, once each, unless it exists. A declared hash that doesn't fit makes an error row (mismatch) beside them, once for
    each such hash; what is declared wrongly doesn't keep the same content from being written for others."""
    digest = F.sha2("content", 256)
    rows = items.withColumn("hash", digest).withColumn("key", F.concat_ws("/", "tenant_id", F.substring("hash", 1, 2), "hash"))
    rows = rows.withColumn("mismatch", F.coalesce(F.col("declared_hash") != F.col("hash"), F.lit(False)))
    good = rows.filter(~F.col("mismatch")).dropDuplicates(["key"])
    good = good if existing is None else good.join(existing.filter(~F.col("mismatch")).select("key") if "mismatch" in existing.columns else existing.select("key"), "key", "left_anti")
    return good.select(*rows.columns).unionByName(rows.filter("mismatch").dropDuplicates(["key", "declared_hash"]))


def usage_written(usage: DataFrame, path: str) -> None:
    """Append rows to the usage log."""
    usage.write.mode("append").json(path)


def report_written(sheets: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per sheet of a report."""
    for name, df in sheets.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)
