r"""Chat formatting over typed content parts, in DataFrame functions only.

A visitor flattens the parts of every turn in order: text parts give their
escaped text; image, audio and document parts give a placeholder, an
attachment reference and an expanded token count. Turns become

    <|turn|>ROLE<|text|>CONTENT<|end|>

Control strings inside roles and texts are escaped reversibly: a backslash is
put after the opening character of anything that reads as a control string
once its own backslashes are left out (``<|end|>`` becomes ``<\|end|>``,
``<\|end|>`` becomes ``<\\|end|>``). Unescaping takes one backslash away
again, so the round trip is exact, and a formatted text holds no control
string but the template's own.

The loss mask lists, per assistant turn, the span of its content within the
turn's piece of the formatted text (code points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# What follows the opening character of each control string.
CONTROLS = r"(?:\|(?:turn|text|end|image|audio|document)\|>|/?s>|</?SYS>>|/?INST\])"
ESCAPE_AT = r"([<\[]\\*)(?=" + CONTROLS + ")"
UNESCAPE_AT = r"([<\[]\\*)\\(?=" + CONTROLS + ")"

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
IMAGE_PATCH, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25.0, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE_AT, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE_AT, "$1")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).cast("array<struct<type:string,text:string>>")


def _visit(part: Column, fields: set[str]) -> Column:
    """(piece, attachment, tokens) of one content part; unknown types give nothing, absent fields count as null."""
    of = lambda name, kind: part[name] if name in fields else F.lit(None).cast(kind)
    kind = of("type", "string")
    ceil_div = lambda n, d: F.ceil(F.coalesce(n, F.lit(0)) / F.lit(d))
    image = ceil_div(of("width", "int"), IMAGE_PATCH) * ceil_div(of("height", "int"), IMAGE_PATCH)
    tokens = F.when(kind == "image", image).when(kind == "audio", F.ceil(F.coalesce(of("seconds", "double"), F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND)).when(kind == "document", F.coalesce(of("pages", "int"), F.lit(0)) * F.lit(TOKENS_PER_PAGE))
    media = kind.isin("image", "audio", "document")
    piece = F.when(media, F.concat(F.lit("<|"), kind, F.lit("|>"))).when(kind == "text", escape(F.coalesce(of("text", "string"), F.lit("")))).otherwise(F.lit(""))
    return F.struct(F.coalesce(piece, F.lit("")).alias("piece"), F.when(media, F.coalesce(of("ref", "string"), F.lit(""))).alias("ref"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, content)``.

    Gives ``conv_id``, ``formatted``, ``n_turns``, ``loss_mask`` (array of turn,
    start, end) and ``attachments`` (array of turn, part, type, ref, tokens).
    ``content`` is an array of typed parts. Rows go by turn (null first), ties by role, then
    content, so repeated rows stay and reruns agree; null roles and texts count as empty, a null conv_id is
    a conversation of its own; no rows give no conversations.
    """
    fields = set(turns.schema["content"].dataType.elementType.fieldNames())
    role = F.coalesce(F.col("role"), F.lit(""))
    parts = F.coalesce(F.col("content"), F.array().cast(turns.schema["content"].dataType))
    seen = F.transform(parts, lambda p: _visit(p, fields))
    one = turns.select("conv_id", "turn", role.alias("role"), seen.alias("seen"), F.transform(parts, lambda p: p["type"] if "type" in fields else F.lit(None).cast("string")).alias("types"))
    one = one.select("conv_id", "turn", "role", F.array_join(F.col("seen.piece"), "").alias("body"), "seen", "types")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    media = F.filter(F.zip_with("seen", F.transform("types", lambda t, i: F.struct(t.alias("type"), i.alias("part"))), lambda s, t: F.struct(t["part"].alias("part"), t["type"].alias("type"), s["ref"].alias("ref"), s["tokens"].alias("tokens"))), lambda m: m["ref"].isNotNull())
    one = one.select("conv_id", F.struct("turn", "role", "body", F.char_length(head).alias("start"), F.concat(head, "body", F.lit(END)).alias("piece"), media.alias("media")).alias("t"))
    ordered = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    mask = F.filter(F.transform("ts", lambda t, i: F.when(t["role"] == "assistant", F.struct(i.alias("turn"), t["start"].alias("start"), (t["start"] + F.char_length(t["body"])).alias("end")))), lambda m: m.isNotNull())
    attachments = F.flatten(F.transform("ts", lambda t, i: F.transform(t["media"], lambda m: F.struct(i.alias("turn"), m["part"].alias("part"), m["type"].alias("type"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))))
    return ordered.select("conv_id", F.array_join(F.col("ts.piece"), "").alias("formatted"), F.size("ts").cast("long").alias("n_turns"), mask.alias("loss_mask"), attachments.alias("attachments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: ``turns`` (array of role, text) and ``loss_text``, both unescaped."""
    pieces = formatted.withColumn("_pieces", F.slice(F.split("formatted", r"<\|turn\|>"), F.lit(2), F.size(F.split("formatted", r"<\|turn\|>"))))
    parts = F.transform("_pieces", lambda p: F.split(p, r"<\|(?:text|end)\|>"))
    turns = F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    span = lambda m: F.substring(F.element_at("_pieces", m["turn"] + 1), m["start"] - len(TURN) + 1, m["end"] - m["start"])
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(span(m))), "")
    return pieces.withColumn("turns", turns).withColumn("loss_text", loss).drop("_pieces")
