r"""Chat formatting with Spark expressions only.

Template of a block, which holds adjacent turns of one role::

    <s>role[INST]text[/INST][INST]text[/INST]</s>

Control strings inside roles and texts are escaped: after the first character
goes one backslash more (``</s>`` becomes ``<\/s>``, ``<\/s>`` becomes
``<\\/s>``), so that reading back takes one away and is exact for every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ESCAPE = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_UNESCAPE = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _UNESCAPE, "$1$2$3")


def _blocks(t: Column, bounds: Column) -> Column:
    """Adjacent turns of one role as one block: role and texts.  bounds: where blocks begin and end."""

    def block(x: Column) -> Column:
        own = F.slice(t, x["from"] + 1, x["to"] - x["from"])
        return F.struct(F.get(t, x["from"])["role"].alias("role"), F.transform(own, lambda y: y["text"]).alias("texts"))

    return F.transform(bounds, block)


def format_chats(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conv_id: formatted text and its pieces with the loss mask.

    Rows: conv_id, turn, role, text; others are left out.  Turns go by turn (null
    first), then role, then text, so ties and repeated rows have one order; a null
    role or text is empty, a null conv_id is a conversation of its own.  A
    conversation's text is one value, so its turns must meet in one row.

    Returns conv_id, formatted string, pieces array<struct<piece string, loss
    boolean>>: the pieces in order make up formatted; loss marks the texts to
    learn from.
    """
    turns = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    t = df.groupBy(F.col("conv_id")).agg(F.sort_array(F.collect_list(turns)).alias("t"))

    # where a role differs from the one before; each block is then cut once, so the work is linear in the turns
    breaks = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get(F.col("t"), i)["role"] != F.get(F.col("t"), i - 1)["role"]))
    t = t.select("conv_id", "t", breaks.alias("breaks"))
    ends = F.concat(F.slice("breaks", F.lit(2), F.size("breaks")), F.array(F.size("t")))
    t = t.select("conv_id", "t", F.zip_with("breaks", ends, lambda a, b: F.struct(a.alias("from"), b.alias("to"))).alias("bounds"))
    blocks = _blocks(F.col("t"), F.col("bounds"))

    def pieces(block: Column) -> Column:
        n, no = F.size(block["texts"]), F.lit(False)

        def of(text: Column, i: Column) -> Column:
            head = F.concat(F.when(i == 0, F.concat(F.lit("<s>"), escape(block["role"]))).otherwise(""), F.lit("[INST]"))
            tail = F.when(i == n - 1, "[/INST]</s>").otherwise("[/INST]")
            return F.array(
                F.struct(head.alias("piece"), no.alias("loss")),
                F.struct(escape(text).alias("piece"), (block["role"] == loss_role).alias("loss")),
                F.struct(tail.alias("piece"), no.alias("loss")),
            )

        return F.flatten(F.transform(block["texts"], of))

    t = t.select("conv_id", F.flatten(F.transform(blocks, pieces)).alias("pieces"))
    return t.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "pieces")


def read_back(formatted: Column) -> Column:
    """The turns (array<struct<role, text>>) that a formatted text holds."""
    blocks = F.filter(F.split(formatted, "</s>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        cut = F.instr(b, "[INST]")
        role = unescape(b.substr(F.lit(4), cut - 4))
        body = b.substr(cut + 6, F.length(b) - cut - 12)
        return F.transform(F.split(body, r"\[/INST\]\[INST\]"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digest(chats: DataFrame) -> DataFrame:
    """What a formatted conversation holds, read back from the output."""
    each = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["piece"]))
    out = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(each, "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
