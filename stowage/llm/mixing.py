"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets the exponential key -ln(u) / w, with u drawn from a hash of its id and w its quality weight. A
source whose target is e whole epochs and a rest gives each document e times, then the documents of lowest key until
the rest is filled. The order within a source is never sorted in one task: the bracket of keys in which a source's budget
ends is narrowed by sums over slices of it, prefix-summed, until few rows are left in it (or rows of one key), and only those
are sorted. However the weights lie, no task gets more than `few` rows of a source to sort but for equal keys, which are
those of one weight and id.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a null, non-finite or
non-positive quality counts as 1; rows alike in id and size share a key and are taken together; an empty table gives an
empty result; input columns that have the name of an added column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.bounds import small
from stowage.llm.common import cut, without

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[!-@\[-`{-~]"
ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """0.1 to 1: lower, the more of a text is ASCII digits and punctuation. Native, so that mixing needs no join."""
    share = F.regexp_count(text, F.lit(SYMBOL)) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(0.1 + 0.9 * (1 - F.least(F.lit(1.0), 4 * share)), F.lit(1.0))


def exponential_key(row_id: Column, weight: Column, seed: int = 0) -> Column:
    """-ln(u) / weight with u from the first 52 bits of md5(seed:id); lower keys come first."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    weight = F.when(weight.isNull() | F.isnan(weight) | (weight <= 0) | (weight == float("inf")), 1.0).otherwise(weight)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """From (source, source_size), the target of each source.

    weights repeat over the sources by code point, null last. The mix has share times all words; no target exceeds cap
    times its source, and what is above goes to the others by weight until none is above. That is a water level: with
    sources ordered by cap * size / weight, the full ones are a prefix. One row a source passes through one task.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    w = F.element_at(pick, ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("w", w)
        .withColumn("ratio", cap * F.col("source_size") / F.col("w"))
        .withColumn("budget", share * F.sum("source_size").over(whole))
        .withColumn("filled", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("filled")) / F.sum("w").over(onward))
        # the level is that of the first source which it doesn't fill; with none, all are full
        .withColumn("level", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "source", "level"))).over(whole)["level"])
    )
    full = cap * F.col("source_size")
    target = F.least(full, F.coalesce(F.col("level") * F.col("w"), full))
    return ranked.select("source", "source_size", F.round(target, 6).alias("target"))


def narrowed(rows: DataFrame, brackets: DataFrame, slices: int, few: int) -> DataFrame:
    """(t_source, rest, before, lo, hi): of each source the bracket of keys in which its running size reaches rest, with the size before it.

    brackets (t_source, rest, m rows, lo, hi, before) are cut into slices of equal width, and the one that holds the rest
    goes on, from its least to its greatest key, while it has more than `few` rows and two keys. A row a source; a round a job.
    """
    state = cut(brackets)
    while not (wide := state.filter((F.col("m") > few) & (F.col("lo") < F.col("hi")))).isEmpty():
        part = F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * slices), F.lit(slices - 1)).cast("int")
        inside = rows.join(small(wide), F.col("source").eqNullSafe(F.col("t_source")) & F.col("key").between(F.col("lo"), F.col("hi")))
        by_slice = inside.groupBy("t_source", "rest", "before", part.alias("slice")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("m"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        upto = F.col("before") + F.sum("size").over(Window.partitionBy("t_source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ends = by_slice.withColumn("upto", upto).filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")))
        ends = ends.select("t_source", "rest", "m", "lo", "hi", (F.col("upto") - F.col("size")).alias("before"))
        state = cut(state.filter((F.col("m") <= few) | (F.col("lo") >= F.col("hi"))).unionByName(ends))
    return state.select("t_source", "rest", "before", "lo", "hi")


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column,
    quality: Column,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    slices: int = 1024,
    few: int = 4096,
    seed: int = 0,
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_copies and mix_taken (copies times size).

    One pass writes (source, size, key) narrowly; sums over source and slice of a bracket combine before their shuffle; a
    second pass over docs compares each key with its source's last one, so texts are never shuffled.
    """
    key = exponential_key(F.col(id_col), quality.cast("double"), seed)
    tie = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    narrow = cut(docs.select(F.col(source_col).alias("source"), size.cast("long").alias("size"), key.alias("key"), tie.alias("tie")))
    sums = cut(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("m"), F.min("key").alias("lo"), F.max("key").alias("hi")))
    targets = source_targets(sums.select("source", "source_size"), weights, share, cap)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    targets = cut(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    t = targets.filter("rest > 0").select(F.col("source").alias("t_source"), "rest")
    start = sums.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select("t_source", "rest", "m", "lo", "hi", F.lit(0).cast("long").alias("before"))
    edges = cut(narrowed(narrow, start, slices, few))

    order = Window.partitionBy("source").orderBy("key", "tie", "size")
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    # a document that crosses the budget is taken if more than half of it fits
    last = (
        narrow.join(edges, F.col("source").eqNullSafe(F.col("t_source")) & F.col("key").between(F.col("lo"), F.col("hi")))
        .withColumn("running", running)
        .filter(2 * (F.col("running") - F.col("rest")) <= F.col("size"))
        .groupBy("source")
        .agg(F.max(F.struct("key", "tie", "size")).alias("last"))
    )
    first = edges.select("t_source", "lo")
    plan = (
        targets.join(last.withColumnRenamed("source", "l_source"), F.col("source").eqNullSafe(F.col("l_source")), "left")
        .join(first, F.col("source").eqNullSafe(F.col("t_source")), "left")
        .select(F.col("source").alias("p_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "epochs", "rest", "last", F.col("lo").alias("edge"))
    )
    plan = cut(plan)
    rows = without(docs, [*ADDED, "p_source", "epochs", "rest", "last", "edge", "m_key"])
    rows = rows.withColumns({"mix_size": size.cast("long"), "m_key": F.struct(key.alias("key"), tie.alias("tie"), size.cast("long").alias("size"))})
    more = (F.col("rest") > 0) & ((F.col("m_key.key") < F.col("edge")) | F.coalesce(F.col("m_key") <= F.col("last"), F.lit(False)))
    copies = (F.col("epochs") + F.coalesce(more, F.lit(False)).cast("int")).cast("int")
    out = rows.join(plan, rows[source_col].eqNullSafe(plan["p_source"])).withColumn("mix_copies", copies).withColumn("mix_taken", F.col("mix_copies") * F.col("mix_size"))
    return out.drop("p_source", "epochs", "rest", "last", "edge", "m_key")
