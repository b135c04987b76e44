"""Chat conversations with typed content parts to training text, in DataFrame functions only.

Template: ``<s>`` opens a conversation; a turn is ``[INST:role]body[/INST]``.
Inside roles and texts every ``<``, ``[``, ``]`` and backslash is followed by a
backslash, so no marker can occur in them, and taking these backslashes out gives
the text back.  A visitor walks the parts of a message in order: text is escaped,
an image, audio or document becomes a placeholder ``<image>``, ``<audio>`` or
``<document>``, and its reference and the tokens it will expand to are recorded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OPEN, CLOSE, START = "[INST:", "[/INST]", "<s>"


@dataclass(frozen=True)
class Expansion:
    """How many tokens an attachment stands for."""

    image_patch: int = 14
    audio_per_second: int = 25
    document_per_page: int = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\]\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\]\\])\\", r"$1")


def text_part(text: Column) -> Column:
    """A message's only part: its text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))).cast(f"array<{PART}>")


def _tokens(part: Column, by: Expansion) -> Column:
    def ceiling(value: Column, each: int) -> Column:
        return F.ceil(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)) / each)

    return (
        F.when(part["type"] == "image", ceiling(part["width"], by.image_patch) * ceiling(part["height"], by.image_patch))
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * by.audio_per_second))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)).cast("long") * by.document_per_page)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visited(messages: DataFrame, by: Expansion = Expansion()) -> DataFrame:
    """conv_id, turn, piece, body_at, body_chars, learned and attachments of every message.

    ``messages`` has conv_id, turn, role and parts (an array of ``PART``).  Null
    roles, parts and texts are empty.  A part of another type leaves its text, if any.
    """
    role = F.coalesce("role", F.lit(""))
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    rendered = F.transform(
        parts,
        lambda p: F.when(p["type"].isin("image", "audio", "document"), F.concat(F.lit("<"), p["type"], F.lit(">"))).otherwise(escape(F.coalesce(p["text"], F.lit("")))),
    )
    marked = F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p, by).alias("tokens")))
    attachments = F.filter(marked, lambda m: m["type"].isin("image", "audio", "document"))
    head = F.concat(F.lit(OPEN), escape(role), F.lit("]"))
    body = F.array_join(rendered, "")
    return messages.select("conv_id", "turn", role.alias("role"), head.alias("head"), body.alias("body"), attachments.alias("attachments")).select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
        F.char_length("head").alias("body_at"),
        F.char_length("body").alias("body_chars"),
        (F.col("role") == "assistant").alias("learned"),
        "attachments",
    )


def format_chats(messages: DataFrame, by: Expansion = Expansion()) -> DataFrame:
    """One row per conversation: formatted, loss, attachments, expanded_tokens.

    ``loss`` lists the spans to learn, (turn in order from 0, first code point
    within the turn, code points): the body of every assistant turn.
    ``attachments`` lists (turn in order, part, type, ref, tokens) in the order of
    the placeholders.  Turns are ordered by number, null first; messages that
    repeat a number follow each other by their formatted text, so every row stays.
    A null conv_id is a conversation.  No messages, no rows.

    One conversation is one string in the end, as its digest requires: the texts
    of a conversation must fit a row, 2 GB.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "piece", "body_at", "body_chars", "learned", "attachments")))
    grouped = visited(messages, by).groupBy("conv_id").agg(turns.alias("turns"))
    loss = F.filter(
        F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["body_at"].alias("start"), F.when(t["learned"], t["body_chars"]).alias("chars"))),
        lambda s: s["chars"].isNotNull(),
    )
    attachments = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))),
        )
    )
    return grouped.select(
        "conv_id",
        F.concat(F.lit(START), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
        loss.alias("loss"),
        attachments.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]))


def turn_pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation, each without its closing marker."""
    pieces = F.split(F.substr(formatted, F.lit(len(START) + 1)), r"\[/INST\]")
    return F.slice(pieces, 1, F.size(pieces) - 1)


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns``, (role, text) parsed from the formatted text, and ``learned``, the unescaped text under the loss spans.

    Placeholders stay in the texts as they are.
    """
    head = r"(?s)^\[INST:(.*?)\](?!\\)(.*)$"
    with_pieces = formatted.withColumn("_pieces", turn_pieces(F.col("formatted")))
    return with_pieces.select(
        *formatted.columns,
        F.transform(
            "_pieces", lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text"))
        ).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.get("_pieces", s["turn"]), s["start"] + 1, s["chars"]))), "").alias("learned"),
    )
