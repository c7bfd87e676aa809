"""Chat formatting with typed content parts. SQL functions only.

A conversation becomes `<|role|>text<|end|>` for each turn, in order. Inside roles and texts a backslash is doubled,
`<|` is written `<\\|` and `|>` is written `|\\>`, so the marks never occur in them; a role `end`, one that begins with `>`, and a text's
`[image `, `[audio ` and `[document `, which would look like a mark or a placeholder, have a backslash before them. So the original can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "<|end|>"
#: Expanded tokens of a part: fixed per image, per second of audio, per page of a document; text counts its characters.
IMAGE_TOKENS, AUDIO_TOKENS_PER_SECOND, DOCUMENT_TOKENS_PER_PAGE = 576, 25, 1024
FILES = ("image", "audio", "document")


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def escape_role(c: Column) -> Column:
    own = escape(c)
    return F.when((c == "end") | c.startswith(">"), F.concat(F.lit("\\"), own)).otherwise(own)


def escape_text(c: Column) -> Column:
    return F.regexp_replace(escape(c), rf"\[({'|'.join(FILES)}) ", r"\\[$1 ")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def flatten_parts(parts: Column) -> Column:
    """Struct (text, attachments, tokens) of array<struct<type, text, ref, size>>.

    A text part is its text, escaped; an image, audio or document part is a numbered placeholder such as `[image 1]`, in the
    order of the parts; any other type, or null, is text. attachments has (n, type, ref, tokens) of each placeholder,
    tokens the sum of what all parts expand to (size: seconds or pages, at least 1). A null array has no parts.

    Each part is visited once: texts and marks are joined, and where marks begin the joined text is cut again to number them.
    """
    size = lambda p: F.greatest(F.coalesce(p["size"].cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))
    cost = lambda p: F.when(p["type"] == "image", F.lit(IMAGE_TOKENS).cast("long")).when(p["type"] == "audio", size(p) * AUDIO_TOKENS_PER_SECOND).otherwise(size(p) * DOCUMENT_TOKENS_PER_PAGE)
    is_file = lambda p: F.coalesce(p["type"].isin(*FILES), F.lit(False))
    text_of = lambda p: F.coalesce(p["text"], F.lit(""))
    some = F.coalesce(parts, F.array().cast("array<struct<type:string,text:string,ref:string,size:long>>"))
    # where text follows text, a backslash parts them, lest both sides make a mark or placeholder
    follows = lambda i: (i > 0) & ~is_file(F.get(some, i - 1))
    body = lambda p, i: F.when(follows(i), F.regexp_replace(escape_text(text_of(p)), r"(?s)^([^\\])", r"\\$1")).otherwise(escape_text(text_of(p)))
    joined = F.array_join(F.transform(some, lambda p, i: F.when(is_file(p), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(body(p, i))), "")
    numbered = lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("["), F.substring_index(x, "|>", 1), F.lit(" "), i.cast("string"), F.lit("]"), F.substr(x, F.locate("|>", x) + 2)))
    files = F.transform(F.filter(some, is_file), lambda p, i: F.struct((i + 1).alias("n"), p["type"].alias("type"), p["ref"].alias("ref"), cost(p).alias("tokens")))
    tokens = F.aggregate(some, F.lit(0).cast("long"), lambda acc, p: acc + F.when(is_file(p), cost(p)).otherwise(F.length(text_of(p)).cast("long")))
    return F.struct(F.array_join(F.transform(F.split(joined, r"<\|"), numbered), "").alias("text"), files.alias("attachments"), tokens.alias("tokens"))


def text_parts(text: Column) -> Column:
    """The parts of a message that is plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size")))


def format_chats(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in code points), attachments, tokens.

    turns: conv_id, turn, role, and either text or the column named by `parts`. Order is by turn (null first), then role
    and text, so equal turns have a fixed order. Nulls count as empty; rows without conv_id form one conversation.
    Assistant texts are under the loss, their marks are not. A conversation is one row by nature; its turns meet in
    one task, and conversations spread over all of them.
    """
    flat = flatten_parts(F.col(parts) if parts else text_parts(F.col("text")))
    one = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flat.alias("f"))
    one = one.select("conv_id", "turn", "role", "f.*", F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>")).alias("head"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "attachments", "tokens")
    upto = F.sum(F.length("head") + F.length("text") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    one = one.withColumn("n", F.row_number().over(order)).withColumn("start", upto - len(END) - F.length("text"))
    span = F.when(F.col("role") == "assistant", F.struct("start", F.length("text").cast("long").alias("length")))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", F.concat("head", "text", F.lit(END)).alias("block"), span.alias("span"), "attachments"))).alias("t"), F.sum("tokens").alias("tokens"))
    spans = F.filter(F.col("t.span"), lambda x: x.isNotNull())
    return whole.select("conv_id", F.array_join("t.block", "").alias("formatted"), spans.alias("loss_spans"), F.flatten("t.attachments").alias("attachments"), "tokens")


def read_chats(formatted: DataFrame) -> DataFrame:
    """Turns and loss text read back from format_chats()'s formatted and loss_spans: conv_id, turns (role, text), loss_text, formatted_chars."""
    blocks = F.split(F.col("formatted"), r"<\|end\|>")
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    turns = F.transform(blocks, lambda b: F.struct(unescape(F.substring_index(F.substr(b, F.lit(3)), "|>", 1)).alias("role"), unescape(F.substr(b, F.locate("|>", b, 3) + 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
