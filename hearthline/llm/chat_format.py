"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is an array of parts, each of a kind: text, image, audio or document. A visitor
walks the parts in order: text is escaped, every other part becomes one placeholder, its reference is
recorded as an attachment and its expanded token count is computed from its measures. Turns are laid out as

    <|turn|>ROLE<|body|>PART<|part|>PART...<|done|>

Control strings inside roles and texts are escaped reversibly: '^' is doubled, and a lone '^' is put
after the '<' or '[' of any control string. Control strings are '<|', '<s>', '</s>', '[INST]' and
'[/INST]'. `read_back` parses the output again.

Defined cases: null text is empty; null role is empty; a null or unknown part kind counts as text; null
measures count one unit; turns are ordered by turn (null first), then role, then content, and
repeated rows stay separate turns; rows of a null conversation id form one conversation; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, PART, DONE = "<|turn|>", "<|body|>", "<|part|>", "<|done|>"
PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH_PIXELS, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 14, 25, 512


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("^"), F.lit("^^"))
    return F.regexp_replace(doubled, r"<(?=\||/?s>)|\[(?=/?INST\])", "$0^")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"(?<=[<\[])\^(?!\^)", ""), F.lit("^^"), F.lit("^"))


def text_part(text: Column) -> Column:
    """One text part holding `text`."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in none.items())))


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder expands to; null for text, whose count its tokenizer decides."""
    patches = lambda n: F.ceil(F.coalesce(n, F.lit(1)) / PATCH_PIXELS)
    return (
        F.when(part["kind"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * TOKENS_PER_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(1)) * TOKENS_PER_PAGE)
        .cast("long")
    )


def is_media(part: Column) -> Column:
    return F.coalesce(part["kind"].isin("image", "audio", "document"), F.lit(False))


def visit(parts: Column) -> Column:
    """The formatted content of a message: parts in order, each as escaped text or placeholder."""
    one = lambda p: F.when(is_media(p), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(escaped(F.coalesce(p["text"], F.lit(""))))
    return F.array_join(F.transform(parts, one), PART)


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: str = "assistant") -> DataFrame:
    """One row per conversation: formatted, loss_spans (turn, start, length, at), attachments, media_tokens.

    A span's start and length are in code points of the turn's formatted string, `at` is the start in the
    whole; spans cover the contents of `learn` turns and nothing else."""
    one = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(f"array<{PART_TYPE}>")).alias("parts"))
    media = F.filter("parts", is_media)
    one = one.select(
        "conv_id", "turn", "role",
        F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY)).alias("head"),
        visit(F.col("parts")).alias("body"),
        F.transform(media, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))).alias("media"),
    )
    one = one.withColumns({"head_chars": F.char_length("head"), "body_chars": F.char_length("body")})
    # Where each turn begins: a running sum, so that long conversations cost no more a turn than short ones.
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("starts", F.coalesce(F.sum(F.col("head_chars") + F.col("body_chars") + len(DONE)).over(before), F.lit(0)).cast("long"))
    placed = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "starts", "head", "head_chars", "body_chars", "media"))).alias("turns"))
    span = lambda t, i: F.struct(i.alias("turn"), t["head_chars"].alias("start"), t["body_chars"].alias("length"), (t["starts"] + t["head_chars"]).alias("at"), t["role"].alias("role"))
    spans = F.transform(F.filter(F.transform("turns", span), lambda s: s["role"] == learn), lambda s: F.struct(s["turn"], s["start"], s["length"], s["at"]))
    return placed.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(DONE))), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["media"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("turns", lambda t: t["media"])), F.lit(0).cast("long"), lambda n, m: n + m["tokens"]).alias("media_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, parts: unescaped texts and placeholders), loss_texts: what lies under the mask."""
    # explode of a one-element array keeps the split turns from being computed once per span.
    pieces = F.filter(F.split("formatted", r"(?<=<\|done\|>)"), lambda s: s != "")
    cut = formatted.select("conv_id", "formatted", "loss_spans", F.explode(F.array(pieces)).alias("pieces"))
    content = lambda s: F.substring_index(F.substring_index(s, DONE, 1), BODY, -1)
    turn = lambda s: F.struct(
        unescaped(F.substring_index(F.substring_index(s, BODY, 1), TURN, -1)).alias("role"),
        F.transform(F.split(content(s), r"<\|part\|>"), unescaped).alias("parts"),
    )
    loss = F.transform("loss_spans", lambda x: unescaped(F.replace(F.substring(F.get("pieces", x["turn"]), x["start"] + 1, x["length"]), F.lit(PART), F.lit(""))))
    return cut.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), loss.alias("loss_texts"))
