"""Chat formatting of typed content parts, in Spark column expressions only.

A message is a list of typed parts.  The visitor walks it in order and flattens it into text:
text parts are escaped and copied, other parts become numbered placeholders whose references and
expanded token counts are recorded beside the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template; escaped text holds neither ``<`` nor ``[``, so it holds none of them.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|body|>", "<|end|>\n"
#: Escapes, in the order in which they are applied; undone in reverse.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def expanded_tokens(part: Column, patch: int = 28, audio_per_second: int = 25, per_page: int = 256) -> Column:
    """Tokens that a part's placeholder stands for: patches of an image, frames of audio, pages of a document."""
    cells = lambda side: F.ceil(F.coalesce(side, F.lit(0)) / patch)
    return (F.when(part["kind"] == "image", F.greatest(cells(part["width"]) * cells(part["height"]), F.lit(1)))
            .when(part["kind"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_per_second), F.lit(1)))
            .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * per_page)
            .when(part["kind"] == "text", F.lit(0)).otherwise(F.lit(1)).cast("long"))


def flattened(parts: Column) -> Column:
    """Text of one message: parts in order, each non-text part as ``<|kind:index|>`` (index within the message)."""
    name = lambda p: F.coalesce(escaped(p["kind"]), F.lit("unknown"))
    return F.array_join(F.transform(parts, lambda p, i: F.when(p["kind"] == "text", escaped(F.coalesce(p["text"], F.lit(""))))
                                    .otherwise(F.concat(F.lit("<|"), name(p), F.lit(":"), i.cast("string"), F.lit("|>")))), "")


def format_chat(messages: DataFrame, loss_role: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (start and length of each
    learnt text, in code points from 0), attachments (turn, part, kind, ref, tokens), n_expanded_tokens.

    ``parts`` is an array of ``PART``; null is no part.  Messages are ordered by turn, then role and
    text (null first), so ties and repeated rows all stay, in a fixed order.  A null conversation id
    is one conversation; a null role is the empty role.  Unknown kinds count one token.  Other
    columns are not read; an empty table gives no rows."""
    part = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    flat = messages.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), flattened(part).alias("body"),
        F.filter(F.transform(part, lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))),
                 lambda a: ~a["kind"].eqNullSafe("text")).alias("refs"))
    flat = flat.withColumn("head", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE)))
    one = flat.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "head", "refs"))).alias("m"))
    sized = one.withColumn("formatted", F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), ""))
    walk = F.aggregate(
        F.col("m"), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)).cast("long").alias("at"),
            F.when(x["role"] == loss_role, F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(x["head"])).cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    refs = F.flatten(F.transform("m", lambda x, i: F.transform(x["refs"], lambda r: F.struct(
        i.alias("turn"), r["part"].alias("part"), r["kind"].alias("kind"), r["ref"].alias("ref"), r["tokens"].alias("tokens")))))
    return (sized.withColumn("loss_spans", walk).withColumn("attachments", refs)
            .select(F.col("conv").alias(conv_id), F.size("m").cast("long").alias("n_turns"), "formatted", "loss_spans", "attachments",
                    F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_expanded_tokens")))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), text parts unescaped."""
    return F.transform(F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30), lambda x: F.struct(
        unescaped(F.substring_index(x, MIDDLE, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(x, MIDDLE, -1), CLOSE, 1)).alias("text")))


def learnt_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, cut out of the formatted string by its spans and unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
