r"""Chat formatting with typed content parts.

A turn is an ordered list of parts. A visitor, one expression per part type, turns text into escaped text and every
image, audio or document part into a placeholder, and records the attachment's reference and the number of tokens that
the placeholder stands for. A turn becomes

    <|im_start|>ROLE<|im_sep|>BODY<|im_end|>\n

In roles and texts a backslash doubles and `<|` becomes `<\|`, so no control string can occur inside them and
`unescaped` restores them exactly.

Turns are ordered by turn, then role, then body (nulls first). Null texts, roles and part lists are empty; a part of unknown type
is taken as text. Repeated rows are turns of their own. An empty table gives no rows. A formatted conversation is one
string, so one conversation has to fit Spark's 2 GB limit for a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Tokens that one unit of a part stands for: image tiles, audio seconds, document pages.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"


def escaped(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A text as a part list of its own."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units")
        )
    ).cast(PARTS)


def part_tokens(part: Column) -> Column:
    per_unit = F.lit(None).cast("int")
    for kind, n in UNIT_TOKENS.items():
        per_unit = F.when(part["type"] == kind, F.lit(n)).otherwise(per_unit)
    return per_unit * F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1))


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*UNIT_TOKENS), F.lit(False))


def visited(part: Column) -> Column:
    placeholder = F.concat(F.lit("<|"), part["type"], F.lit(":"), part_tokens(part).cast("string"), F.lit("|>"))
    return F.when(is_attachment(part), placeholder).otherwise(escaped(part["text"]))


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, parts. One row per conversation: conv_id, formatted, loss_spans, attachments.

    loss_spans are the (start, length) of the assistant bodies in code points; attachments have turn, part, type, ref and
    tokens, in order.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    body = F.array_join(F.transform(parts, visited), "")
    found = F.transform(
        parts,
        lambda p, i: F.struct(
            F.col("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")
        ),
    )
    opened = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))
    flat = turns.select("conv_id", "turn", "role", opened.alias("opened"), body.alias("body"), F.filter(found, lambda a: a["tokens"].isNotNull()).alias("found"))
    flat = flat.withColumn("piece", F.concat("opened", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    placed = flat.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0).cast("long")))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.length("opened")).alias("start"), F.length("body").alias("length")))
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", span.alias("span"), "found"))).alias("rows"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: r["found"])).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns, array of (role, text) read from the formatted string, and loss_text, what the loss mask covers."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parsed(p: Column) -> Column:
        cut = F.split(F.substring(p, len(START) + 1, 2**31 - 1), r"<\|im_sep\|>", -1)
        return F.struct(unescaped(cut[0]).alias("role"), unescaped(cut[1]).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"])))
    return formatted.withColumns({"turns": F.transform(pieces, parsed), "loss_text": F.array_join(loss, "")})
