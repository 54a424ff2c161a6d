r"""Chat formatting with typed content parts, by DataFrame functions alone.

A message holds ordered parts of type text, image, audio or document. The visitor flattens them: text is escaped, each
other part becomes a placeholder and an attachment record (type, reference, expanded token count) in the order of the
placeholders. The template of a turn is

    <turn:ROLE>\n BODY </turn>\n

Inside texts every backslash is written \b and every < is written \l (in roles > is \g as well), so that a bare < only ever
starts a control string and the escaping is reversible.

How it scales: messages are shuffled once by conversation; a conversation's turns are ordered by a window on that
partitioning, and its formatted string is its one output row.

Defined results: null text or parts is an empty body; a null role is the empty role; turns sort by turn (null first), then
role, then body; repeated rows stay; a null conversation id is a conversation of its own; empty tables give empty results;
other columns are ignored. A part of an unknown type keeps its text, if it has one. As a conversation is one row, one
of more than 2 GB can't be represented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Expanded tokens of an attachment: a base and so many for each begun unit (image tiles, audio seconds, document pages).
TOKENS = {"image": (85, 170), "audio": (0, 25), "document": (0, 600)}

PARTS = "array<struct<type:string,text:string,ref:string,units:double>>"
END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as its one part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))
    return F.array(part).cast(PARTS)


def body(parts: Column) -> Column:
    """Escaped texts and placeholders in order."""
    placed = F.transform(parts, lambda p: F.when(p["type"].isin(*TOKENS), F.concat(F.lit("<"), p["type"], F.lit(">"))).otherwise(escape(F.coalesce(p["text"], F.lit("")))))
    return F.coalesce(F.array_join(placed, ""), F.lit(""))


def attachments(parts: Column) -> Column:
    """(type, ref, tokens) of the parts that became placeholders, in order."""
    tokens = lambda p: sum((F.when(p["type"] == k, base + each * F.ceil(F.coalesce(p["units"], F.lit(1.0)))).otherwise(0) for k, (base, each) in TOKENS.items()), F.lit(0)).cast("long")
    return F.transform(F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p["type"].isin(*TOKENS)), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))


def format_conversations(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens): spans are (start, length) in characters from 0."""
    rows = messages.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        body(F.col(parts_col)).alias("body"),
        attachments(F.col(parts_col)).alias("attached"),
    )
    head = F.concat(F.lit("<turn:"), F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\g")), F.lit(">\n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    placed = (
        rows.withColumn("head", head)
        .withColumn("size", (F.length("head") + F.length("body") + len(END)).cast("long"))
        .withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("k", F.row_number().over(order))
    )
    span = F.when(F.col("role").isin(*loss_roles), F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    turn = F.struct("k", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"), F.col("attached").alias("attached"))
    whole = placed.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns"))
    attached = F.flatten(F.col("turns.attached"))
    return whole.select(
        "conv_id",
        "n_turns",
        F.array_join("turns.piece", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def _read_back(body: Column) -> Column:
    """The text of a body, placeholders left out."""
    return unescape(F.regexp_replace(body, "<(" + "|".join(TOKENS) + ")>", ""))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation, placeholders left out."""
    pieces = F.filter(F.split(formatted, END), lambda x: x != "")
    cut = lambda x: F.locate(">\n", x)
    return F.transform(pieces, lambda x: F.struct(unescape(F.substring(x, F.lit(7), cut(x) - 7)).alias("role"), _read_back(F.substring(x, cut(x) + 2, F.length(x))).alias("text")))


def parse_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and without placeholders, as in parse_turns."""
    return F.array_join(F.transform(spans, lambda s: _read_back(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
