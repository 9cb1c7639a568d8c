"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

A conversation is rendered once. Each assistant turn then becomes its own example: the rendering up to and including that
turn, of which only the reply is trainable. One shuffle, by conversation, serves the running offsets, the rendering and
the examples; an example's text is cut from the rendering when it is used, so that unused context costs nothing.

Control strings inside texts and roles are escaped: ``<``, any backslashes and ``|`` get one more backslash between, so
``<|`` occurs in a rendering only where the template put it, and one backslash less restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Stands for a line feed inside a role, which ends at the first line feed.
_FEED = "<|n|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_in(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(_FEED))


def _role_out(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(_FEED), F.lit("\n")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and examples (array of turn_end, loss_start, loss_chars) of each conversation in ``turns``.

    Offsets are in code points of ``formatted``, from 0. Defined cases: rows go by turn, then role and text (nulls
    first); a null text or role is empty; a null conv_id is a conversation of its own; repeated rows are turns; a
    conversation without assistant turns has no examples; an empty table gives an empty result; other columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.select(
        "conv_id", "turn", "role", "text", F.concat(F.lit(START), _role_in(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), F.lit(f"{END}\n").alias("tail")
    )
    so_far = F.sum(F.length("head") + F.length("body") + F.length("tail")).over(W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = parts.select("conv_id", F.concat("head", "body", "tail").alias("whole"), F.length("body").cast("long").alias("loss_chars"), so_far.alias("end"), "tail", (F.col("role") == "assistant").alias("reply"))
    example = F.struct(F.col("end").alias("turn_end"), (F.col("end") - F.length("tail") - F.col("loss_chars")).alias("loss_start"), "loss_chars")
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("end", "whole"))), lambda x: x["whole"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("reply"), example))).alias("examples"),
    )


def expand(formatted: DataFrame, *keep: str) -> DataFrame:
    """One row per example of :func:`format_conversations`: conv_id, example (from 0), text, loss_start, loss_chars, and the columns ``keep``.

    ``text`` holds all turns before the reply as context and the reply; the loss mask covers ``loss_chars`` code points
    from ``loss_start``. A conversation without examples gives one row with nulls.
    """
    rows = formatted.select("conv_id", *keep, "formatted", F.posexplode_outer("examples").alias("example", "at"))
    text = F.substring(F.col("formatted"), F.lit(1), F.col("at.turn_end").cast("int"))
    return rows.select("conv_id", *keep, "example", text.alias("text"), F.col("at.loss_start").alias("loss_start"), F.col("at.loss_chars").alias("loss_chars"))


def masked(example_text: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(example_text, (loss_start + 1).cast("int"), loss_chars.cast("int")))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a rendering, unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.lit(2**30))
    return F.transform(
        pieces,
        lambda piece: F.struct(
            _role_out(F.substring_index(piece, "\n", 1)).alias("role"),
            unescape(F.substring(piece, F.instr(piece, "\n") + 1, F.length(piece) - F.instr(piece, "\n") - F.lit(len(END) + 1))).alias("text"),
        ),
    )


def digest(turns: DataFrame) -> DataFrame:
    """Counts and hashes of each conversation, read back from its rendering and its examples."""
    said = F.col("turns")
    read = format_conversations(turns).select("conv_id", "formatted", "examples", parse(F.col("formatted")).alias("turns"))
    facts = read.select(
        "conv_id", "formatted", "examples", F.size("turns").cast("long").alias("n_turns"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.sha2(F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
    )
    losses = expand(facts, "n_turns", "formatted_chars", "turns_sha256").select(
        "conv_id", "n_turns", "formatted_chars", "turns_sha256", F.when(F.col("example").isNotNull(), F.struct("example", masked(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss"))).alias("piece")
    )
    whole = losses.groupBy("conv_id").agg(
        F.first("n_turns").alias("n_turns"), F.first("formatted_chars").alias("formatted_chars"), F.first("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["loss"]), "").alias("loss"),
    )
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
