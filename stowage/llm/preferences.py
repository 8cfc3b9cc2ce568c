"""Preference formatting: the common turns of two conversations as one prompt, what follows as paired completions.

Defined results: turns are ordered by number (null first), then role and text; a null role or text renders as empty; a
null conv_id is no conversation; a side that is missing or empty gives an empty completion; two equal sides give two
empty completions after the whole conversation as prompt; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conversations_of(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<role, text>>), one row a conversation: its own turns are all that meets in a group."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("conv_id"), one.alias("one"))
    ordered = F.transform(F.array_sort(F.collect_list("one")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns two arrays share. zip_with pads the shorter with null, which equals no turn."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def render_turn(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def loss_mask(turns: Column, learn_role: str) -> Column:
    """'length:flag' of each rendered turn in order, flag 1 where the loss counts: the turns of learn_role."""
    part = F.transform(turns, lambda t: F.concat(F.char_length(render_turn(t)).cast("string"), F.when(t["role"] == learn_role, ":1").otherwise(":0")))
    return F.array_join(part, " ")


def format_preferences(pairs: DataFrame, *, pair_id: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected", learn_role: str = "assistant") -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) from two arrays of turns in each row."""
    empty = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select(F.col(pair_id).alias("pair_id"), F.coalesce(F.col(chosen), empty).alias("a"), F.coalesce(F.col(rejected), empty).alias("b"))
    both = both.withColumn("n_common", common_turns(F.col("a"), F.col("b")))
    tail = lambda c: F.slice(F.col(c), F.col("n_common") + 1, F.size(c))
    return both.select(
        "pair_id",
        "n_common",
        rendered(F.slice(F.col("a"), F.lit(1), F.col("n_common"))).alias("prompt"),
        rendered(tail("a")).alias("chosen"),
        rendered(tail("b")).alias("rejected"),
        loss_mask(tail("a"), learn_role).alias("chosen_mask"),
        loss_mask(tail("b"), learn_role).alias("rejected_mask"),
    )


def contrast_pairs(turns: DataFrame, *, ring: int = 4096, **names: str) -> DataFrame:
    """(pair_id, chosen, rejected) for every conversation that has an assistant turn; without preference labels.

    A conversation up to its last assistant turn is chosen; the same with another conversation's last assistant turn in
    that place is rejected. Conversations lie in rings of about `ring` assistant turns by a hash of their id, in the order of their ids;
    the other is the next one around the ring whose answer differs. Where all answers of a ring are equal, no answer is
    rejected: the rejected side ends before it.
    """
    convs = conversations_of(turns, **names)
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"] == "assistant"), True) + 1
    convs = convs.withColumn("last", last.cast("int")).filter(F.exists("turns", lambda t: t["role"] == "assistant"))
    answers = turns.filter((F.col(names.get("role", "role")) == "assistant") & F.col(names.get("conv_id", "conv_id")).isNotNull()).count()
    rings = max(1, -(-answers // ring))
    digest = F.conv(F.substring(F.md5(F.col("conv_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    own = convs.select(F.col("conv_id").alias("pair_id"), F.slice("turns", F.lit(1), F.col("last")).alias("chosen"), "last", F.element_at("turns", F.col("last")).alias("answer"), (digest % rings).alias("ring"))
    onward = Window.partitionBy("ring").orderBy("pair_id")
    backward = Window.partitionBy("ring").orderBy(F.desc("pair_id"))
    begins = F.col("answer") != F.lag("answer").over(onward)  # a run of equal answers begins here; null at the ring's first
    changed = own.withColumn("begins", F.when(begins, F.col("answer")))
    following = F.last("begins", ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, -1))
    # past the ring's end: its first answer, or the first that differs from that
    lowest, second = F.last("answer").over(backward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("begins", ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    other = F.coalesce(following, F.when(lowest != F.col("answer"), lowest), F.when(second != F.col("answer"), second))
    before = F.slice("chosen", F.lit(1), F.col("last") - 1)
    return changed.withColumn("other", other).select("pair_id", "chosen", F.when(F.col("other").isNull(), before).otherwise(F.concat(before, F.array("other"))).alias("rejected"))
