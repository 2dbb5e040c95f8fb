"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and its text alone is trainable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
TAIL = CLOSE + END
#: A control string inside a text gives up its first character; the mark itself goes first and comes back last.
ESCAPES = [("~", "~0"), (BEGIN, "~1s>"), (END, "~1/s>"), (OPEN, "~2INST]"), (CLOSE, "~2/INST]")]
FIRSTS = [("~1", "<"), ("~2", "["), ("~0", "~")]


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column) -> Column:
    return _replaced(text, ESCAPES)


def unescaped(text: Column) -> Column:
    return _replaced(text, FIRSTS)


def expand(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as examples: conv_id, example, target, formatted, loss_start, loss_end.

    ``formatted`` holds the turns up to the target; ``[loss_start, loss_end)`` in its code points is the target's text.
    A conversation that does not end with an assistant gets one more example with all its turns and no loss (both null),
    so that every turn is in the output.  Null roles and texts are empty; turns of equal number are ordered by role and
    text; null turn numbers come first; rows without a conv_id form one conversation; repeated rows are repeated turns;
    other columns are ignored.  An example is one sequence, so it is one cell: output grows with the square of a
    conversation's turns, as the method says.
    """
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    pieces = F.transform("ts", lambda t: F.concat(
        F.lit(BEGIN), escaped(t["role"]), F.lit(OPEN), escaped(t["text"]), F.lit(TAIL)))
    targets = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda k: (F.get("ts", k - 1)["role"] == "assistant") | (k == F.size("ts")))
    each = whole.select("conv_id", "ts", pieces.alias("pieces"), F.posexplode(targets).alias("example", "target"))
    last = F.get("ts", F.col("target") - 1)
    each = each.select(
        "conv_id", "example", "target", F.array_join(F.slice("pieces", F.lit(1), F.col("target")), "").alias("formatted"),
        F.when(last["role"] == "assistant", F.length(escaped(last["text"]))).alias("n"))
    end = F.length("formatted") - len(TAIL)
    return each.select("conv_id", "example", "target", "formatted",
                       F.when(F.col("n").isNotNull(), end - F.col("n")).alias("loss_start"),
                       F.when(F.col("n").isNotNull(), end).alias("loss_end"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted example as an array of (role, text)."""
    parts = F.split(formatted, END, -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(len(BEGIN) + 1)), OPEN, 1)).alias("role"),
        unescaped(F.regexp_replace(F.substring_index(p, OPEN, -1), r"\[/INST\]$", "")).alias("text")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say: turns from the longest one, trained text from each one's loss span."""
    size = F.col("loss_end") - F.col("loss_start")
    target = F.when(size.isNotNull(), F.struct("example", unescaped(
        F.substr("formatted", F.col("loss_start") + 1, size)).alias("text")))
    per = examples.withColumn("loss", target).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"), F.array_sort(F.collect_list("loss")).alias("losses"),
        F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars"))
    per = per.select("conv_id", parsed(F.col("last")).alias("turns"), "formatted_chars",
                     F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
