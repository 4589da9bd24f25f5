r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all preceding turns as context, and only that
reply under the loss mask.  Built-in functions only.

A turn is written `<turn>role\n`, the text, `</turn>\n`.  Inside texts, `<turn>` and `</turn>`
(with any number of backslashes after `<`) get one more backslash after `<`, so the marks
never occur in an escaped text and unescaping takes one backslash off.  Roles write `%`, `<`
and line feeds as percent codes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
_TURN = "_turn"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<(\\*/?turn>)"), F.lit(r"<\\$1"))


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<\\(\\*/?turn>)"), F.lit("<$1"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")),
                     F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")),
                     F.lit("%25"), F.lit("%"))


def format_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text", assistant: str = "assistant") -> DataFrame:
    """Training examples of conversations given as rows by turn.

    Returns (conv, example, n_turns, text, loss_start, loss_end, whole): `text` is the formatted
    context and reply, code points [loss_start, loss_end) are trainable, `whole` marks the
    example that holds every turn of its conversation.  Turns after the last reply (or all, where
    no reply exists) make one last example with an empty mask, so no turn is lost.

    Null texts and roles are empty; null conversation ids are one conversation; turns of equal
    number are ordered by role, then text, and all are kept; other columns are ignored; an empty table gives no
    examples.  A conversation is one row while it is formatted: its last example holds all its
    text anyway.  The total length of the examples is quadratic in the turns of a conversation,
    as prefix expansion asks.
    """
    rows = turns.groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_list(F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("turns"))
    written = rows.select(
        "conv", F.size("turns").alias("n"),
        F.transform("turns", lambda t: F.struct(
            (t["role"] == assistant).alias("reply"),
            F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape_text(t["text"]).alias("body"))).alias("turns"))
    parts = written.select(
        "conv", "n", "turns",
        F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))).alias("parts"),
        F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("turns", i)["reply"]
                 | (i == F.col("n"))).alias("ends"))
    each = parts.select("conv", "n", "turns", "parts", F.posexplode("ends").alias("example", "end"))
    last = F.element_at("turns", F.col("end"))
    context = each.select(
        "conv", "example", F.col("end").alias("n_turns"), (F.col("end") == F.col("n")).alias("whole"),
        last.alias(_TURN), F.array_join(F.slice("parts", F.lit(1), F.col("end") - 1), "").alias("context"))
    start = (F.length("context") + F.length(f"{_TURN}.head")).cast("long")
    body = F.when(F.col(f"{_TURN}.reply"), F.length(f"{_TURN}.body")).otherwise(0)
    return context.select(
        F.col("conv").alias(conv), "example", F.col("n_turns").cast("long").alias("n_turns"),
        F.concat("context", f"{_TURN}.head", f"{_TURN}.body", F.lit(CLOSE)).alias("text"),
        start.alias("loss_start"), (start + body).alias("loss_end"), "whole")


def trained_text(text: Column, start: Column, end: Column) -> Column:
    """The unescaped text under the mask of an example."""
    return unescape_text(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def parse_turns(text: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    pieces = F.filter(F.split(text, CLOSE), lambda p: F.length(p) > 0)
    return F.transform(pieces, lambda p: F.struct(
        unescape_role(F.substring_index(F.substring(p, F.lit(len(OPEN) + 1), F.length(p)), "\n", 1)).alias("role"),
        unescape_text(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))


def conversation_digests(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars (all examples together)."""
    turns = parse_turns(F.col("text"))
    listing = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        F.col(conv).alias("conv"), "example", F.length("text").cast("long").alias("chars"),
        F.when(F.col("whole"), F.size(turns)).cast("long").alias("turns"),
        F.when(F.col("whole"), F.sha2(listing, 256)).alias("sha"),
        trained_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    replies = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))),
                                       lambda x: x["loss"]), "")
    return read.groupBy("conv").agg(
        F.max("turns").alias("n_turns"), F.max("sha").alias("turns_sha256"), replies.alias("loss"),
        F.sum("chars").alias("formatted_chars")).select(
        F.col("conv").alias(conv), "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
