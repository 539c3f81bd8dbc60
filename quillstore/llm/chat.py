r"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A turn is ``<|turn|>role<|text|>text<|end|>``.  Inside roles and texts every
backslash is doubled, then one backslash is put after each ``<`` or ``[`` that
begins a control string (those of the template and those common in other chat
templates), so no text can forge a control string.  Taking the backslashes out
again, first those after ``<`` and ``[``, then one of each two, restores any
text: of k backslashes that follow such a character 2k are written, 2k - 1 are
left by the first step and k by the second.

Each assistant turn is an example: the prefix of the formatted conversation up
to its text is the context, the text itself the only trainable part.  Examples
of a conversation share its formatted text and are kept as spans of it until they
are exploded, so a long conversation takes no quadratic space before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"


def escape(column):
    doubled = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    angled = F.regexp_replace(doubled, r"<(?=\||/?s>)", "<\\\\")
    return F.regexp_replace(angled, r"\[(?=/?INST\]|/?SYS\])", "[\\\\")


def unescape(column):
    for c in "<[":
        column = F.replace(column, F.lit(c + "\\"), F.lit(c))
    return F.replace(column, F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, examples (example, turn, start, end: code points of ``formatted``,
    end excluded).

    Turns are ordered by turn number; ties, and rows without a number (they come first), by role, then text.  Null
    roles and texts are empty; rows with a null conversation id are one conversation; repeated rows are turns of their
    own; an empty table gives no conversations; other columns are not looked at.  A conversation is one row, so its text
    must fit a task.  One shuffle, on the conversation.
    """
    rows = turns.select(
        turns[conv_col].alias("conv_id"),
        turns[turn_col].alias("turn"),
        F.coalesce(turns[role_col], F.lit("")).alias("role"),
        F.coalesce(turns[text_col], F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    pieces = rows.select("conv_id", "turn", "role", "text", F.length(head).alias("h"), F.length(body).alias("b"), F.concat(head, body, F.lit(END)).alias("piece"))
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.select("conv_id", "role", "h", "b", "piece", F.row_number().over(order).alias("at"), before.alias("start"))
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "h", "b", "start", "piece"))).alias("t"))
    trained = F.filter("t", lambda x: x["role"] == TRAINED_ROLE)
    examples = F.transform(
        trained,
        lambda x, i: F.struct(i.alias("example"), (x["at"] - 1).alias("turn"), (x["start"] + x["h"]).alias("start"), (x["start"] + x["h"] + x["b"]).alias("end")),
    )
    return gathered.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), examples.alias("examples"))


def _span(e):
    return F.substring(F.col("formatted"), (e["start"] + 1).cast("int"), (e["end"] - e["start"]).cast("int"))


def explode_examples(formatted: DataFrame, keep: tuple = (), with_none: bool = False) -> DataFrame:
    """One row per assistant turn: conv_id, ``keep``, example, turn (the number of turns before it), context_chars,
    context and target (both still escaped; the context is all before the target, which alone is trainable).

    A conversation without an assistant turn has no example; with_none: one row without one.  The rows of a
    conversation stay in its task.  Contexts are only cut out of the conversation where they are read."""
    e = F.col("e")
    explode = F.explode_outer if with_none else F.explode
    return formatted.select("conv_id", *keep, "formatted", explode("examples").alias("e")).select(
        "conv_id", *keep, e["example"].alias("example"), e["turn"].alias("turn"), e["start"].alias("context_chars"), F.substring(F.col("formatted"), F.lit(1), e["start"].cast("int")).alias("context"), _span(e).alias("target")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The columns of ``formatted`` and turns (role, text), parsed from the formatted text."""
    parts = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, 1 << 30)

    def turn(p):
        halves = F.split(p, r"<\|text\|>", 2)
        return F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(F.substring_index(F.get(halves, F.lit(1)), END, 1)).alias("text"))

    return formatted.select("*", F.transform(parts, turn).alias("turns"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the contract asks for: turns read back from the formatted text, losses from the targets of the exploded
    examples, put together again per conversation; n_examples, and context_turns (turns before targets, in all).  One
    row per conversation; an empty table gives none."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    whole = ("n_turns", "turns_sha256", "formatted_chars")
    back = read_back(formatted).select(
        "conv_id", "formatted", "examples", F.size("turns").cast("long").alias("n_turns"), sha(told).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )
    each = explode_examples(back, whole, with_none=True).select("conv_id", *whole, "turn", F.when(F.col("example").isNotNull(), F.struct("example", unescape(F.col("target")).alias("text"))).alias("loss"))
    losses = F.sort_array(F.collect_list("loss")).alias("losses")  # nulls are left out
    again = each.groupBy("conv_id").agg(*(F.first(c).alias(c) for c in whole), losses, F.coalesce(F.sum("turn"), F.lit(0)).cast("long").alias("context_turns"))
    loss = F.array_join(F.transform("losses", lambda x: x["text"]), "")
    return again.select(
        "conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), "formatted_chars", F.size("losses").cast("long").alias("n_examples"), "context_turns"
    )
