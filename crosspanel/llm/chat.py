"""Chat formatting: turns with typed content parts become one training string with a loss mask.

A visitor flattens the parts of a turn (text, image, audio, document) in order: texts are escaped, every other
part becomes a placeholder, and its reference and the number of tokens it expands to are recorded. Everything
on this path is a DataFrame or SQL function.

Escaping is reversible: ``&`` becomes ``&amp;`` and the first character of every control string becomes an
entity, so that no control string is left inside a text.

Defined cases: a null text or role counts as empty; a null part list too; turns sort by (turn, role, content)
with nulls first, so ties and repeated rows have one order; rows with a null conv_id form one conversation; an
empty table gives an empty table. A conversation is one row of the result, so it has to fit into one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are marked. `controls` are all strings that must not occur inside a text unescaped."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    entities: dict[str, str] = field(default_factory=lambda: {"<": "&lt;", "[": "&#91;"})
    image_patch: int = 14
    audio_tokens_per_second: int = 25
    document_tokens_per_page: int = 256


PARTS_TYPE = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENT_TYPE = "array<struct<kind:string,ref:string,n_tokens:bigint>>"


def escape(text: Column, template: ChatTemplate) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    for control in template.controls:
        out = F.replace(out, F.lit(control), F.lit(template.entities[control[0]] + control[1:]))
    return out


def unescape(text: Column, template: ChatTemplate) -> Column:
    for char, entity in template.entities.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column, template: ChatTemplate) -> Column:
    return F.replace(escape(role, template), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column, template: ChatTemplate) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")), template)


def _expanded(part: Column, template: ChatTemplate) -> Column:
    """Tokens that a part other than text stands for; unknown measures count as one unit."""
    one = F.lit(1)
    side = lambda c: F.ceil(F.greatest(F.coalesce(c, one), one) / template.image_patch)
    image = side(part["width"]) * side(part["height"])
    audio = F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * template.audio_tokens_per_second)
    pages = F.greatest(F.coalesce(part["pages"], one), one) * template.document_tokens_per_page
    return F.when(part["kind"] == "image", image).when(part["kind"] == "audio", audio).otherwise(pages).cast("bigint")


def text_part(text: Column) -> Column:
    """A text as parts: one of kind text."""
    values = {"kind": F.lit("text"), "text": text}
    names = [f.split(":")[0] for f in PARTS_TYPE.removeprefix("array<struct<").removesuffix(">>").split(",")]
    return F.array(F.struct(*[values.get(n, F.lit(None)).alias(n) for n in names])).cast(PARTS_TYPE)


def flatten_parts(parts: Column, template: ChatTemplate) -> tuple[Column, Column]:
    """(content, attachments) of an array of PARTS_TYPE. Unknown kinds count as text."""
    media = lambda p: F.coalesce(p["kind"].isin("image", "audio", "document"), F.lit(False))
    parts = F.coalesce(parts, F.array().cast(PARTS_TYPE))
    content = F.array_join(F.transform(parts, lambda p: F.when(media(p), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(escape(p["text"], template))), "")
    attachments = F.transform(F.filter(parts, media), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p, template).alias("n_tokens")))
    return content, attachments.cast(ATTACHMENT_TYPE)


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conv_id: formatted, loss_spans (array of start and length in bytes), attachments, n_media_tokens.

    `turns` has conv_id, turn, role and either parts (PARTS_TYPE) or text (a string, taken as one text part); further columns are ignored.
    One exchange by conv_id serves both the offsets and the gathering.
    """
    content, attachments = flatten_parts(F.col("parts") if "parts" in turns.columns else text_part(F.col("text")), template)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), attachments.alias("media"))
    head = F.concat(F.lit(template.open), escape_role(F.col("role"), template), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", "content", F.lit(template.close)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    before = F.coalesce(F.sum(F.octet_length("piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.struct((before + F.octet_length("head")).alias("start"), F.octet_length("content").cast("bigint").alias("length"))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("span", F.when(F.col("role").isin(*template.loss_roles), span))
    whole = F.sort_array(F.collect_list(F.struct("at", "piece", "span", "media")))
    out = rows.groupBy("conv_id").agg(whole.alias("whole"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("whole", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("whole", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("whole", lambda x: x["media"])).alias("attachments"),
    ).withColumn("n_media_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["n_tokens"]))


def read_formatted(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Read the strings back: adds turns (array of role and text, unescaped) and loss_text (all text under the mask, unescaped)."""
    close = "".join(f"\\{c}" if c in "|<>" else c for c in template.close)
    pieces = F.filter(F.split("formatted", close), lambda p: p != "")
    body = lambda p: F.substring(p, len(template.open) + 1, 2**31 - 1)
    turn = lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1), template).alias("role"), unescape(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2), template).alias("text"))
    masked = lambda s: unescape(F.decode(F.substr(F.col("formatted").cast("binary"), (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"), template)
    return formatted.withColumn("turns", F.transform(pieces, lambda p: turn(body(p)))).withColumn("loss_text", F.array_join(F.transform("loss_spans", masked), ""))
