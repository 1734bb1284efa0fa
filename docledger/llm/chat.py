"""Conversations as one marked-up text each, with a loss mask over assistant turns.

Template, for each run of adjacent turns of one role::

    <|im_start|>ROLE \\n TEXT [<|im_next|> TEXT ...] <|im_end|> \\n

Control strings inside texts are escaped: a backslash becomes two, and `<|` becomes
`<\\|`. Nothing that a text says can therefore be taken for a marker, and
`unescaped` restores every text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, NEXT, END, BREAK = "<|im_start|>", "<|im_next|>", "<|im_end|>", "<|im_line|>"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    opened = F.replace(text, F.lit("<\\|"), F.lit("<|"))
    return F.replace(opened, F.lit("\\\\"), F.lit("\\"))


def formatted(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per `conv_id`: formatted, segments array<struct<text, loss>>.

    `formatted` is the concatenation of the segments' texts; `loss` marks those
    that a model is trained on, which are the texts of `loss_role`, escaped, without
    any marker. Rows count in order of (turn, role, text), nulls first; rows that
    repeat a turn, or a whole row, all stay. A null role or text is empty; rows with
    a null conv_id form one conversation. Other columns are ignored.
    """
    turns = conversations.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    in_order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    # A window per conversation finds run borders; the sort serves the collection too.
    bordered = turns.select(
        "conv_id", "role", "text", F.row_number().over(in_order).alias("place"),
        F.lag("role").over(in_order).alias("before"),
        F.lead("role").over(in_order).alias("after"),
    )
    heading = F.concat(
        F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    lead_in = F.when(F.col("before") == F.col("role"), F.lit(NEXT)).otherwise(heading)
    lead_out = F.when(F.col("after") == F.col("role"), F.lit("")).otherwise(F.lit(END + "\n"))
    collected = bordered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "place", "role", "text", lead_in.alias("lead_in"), lead_out.alias("lead_out"),
    ))).alias("rows"))
    segments = F.flatten(F.transform("rows", lambda r: F.array(
        F.struct(r["lead_in"].alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(r["text"]).alias("text"), (r["role"] == loss_role).alias("loss")),
        F.struct(r["lead_out"].alias("text"), F.lit(False).alias("loss")),
    )))
    return collected.select("conv_id", segments.alias("segments")).select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
    )


def read_back(formatted_rows: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text: from the output alone."""
    quoted = {m: f"\\Q{m}\\E" for m in (START, NEXT)}
    blocks = F.filter(F.split("formatted", quoted[START]), lambda _, i: i > 0)
    runs = F.transform(blocks, lambda b: F.struct(
        F.substring_index(b, "\n", 1).alias("role"),
        _body(b).alias("body"),
    ))
    turns = F.flatten(F.transform(runs, lambda r: F.transform(
        F.split(r["body"], quoted[NEXT]),
        lambda t: F.struct(
            unescaped(F.replace(r["role"], F.lit(BREAK), F.lit("\n"))).alias("role"),
            unescaped(t).alias("text"),
        ),
    )))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return formatted_rows.select(
        "conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _body(block: Column) -> Column:
    """What stands between the first line break and the closing marker."""
    role = F.char_length(F.substring_index(block, "\n", 1))
    return F.substring(block, role + 2, F.char_length(block) - role - len(END) - 2)


def digest(read: DataFrame) -> DataFrame:
    """The digest columns of `read_back` rows."""
    turns = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
