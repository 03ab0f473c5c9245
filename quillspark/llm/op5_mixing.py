"""Mixing sources to target weights: subset-sum fitting of word budgets."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, text_of, words, written


def fill(lengths: list[int], counts: list[int], budget: int, total: int, dp_words: int) -> list[int]:
    """How many documents of each length to take so that their words come to ``budget``.

    Each length first gives its even share, rounded down. What is left goes to one
    more document of the longest lengths that fit, until it is at most ``dp_words``;
    for that rest a bounded-knapsack programme over the documents left finds the
    nearest reachable sum. Bit s of ``reach`` says that s words can be had; a length
    with n documents goes in as the parts 1, 2, 4, ... of n.
    """
    if total <= 0 or budget <= 0:
        return [0] * len(lengths)
    take = [c * budget // total for c in counts]
    rest = budget - sum(n * x for n, x in zip(take, lengths, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if rest <= dp_words:
            break
        if lengths[i] and (n := min(counts[i] - take[i], (rest - dp_words // 2) // lengths[i])) > 0:
            take[i] += n
            rest -= n * lengths[i]
    rest = max(0, rest)
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for i in order:
        if reach >> rest & 1:
            break
        n, part = min(counts[i] - take[i], rest // lengths[i] if lengths[i] else 0), 1
        while n > 0:
            part = min(part, n)
            more = (reach | reach << (part * lengths[i])) & mask
            if more != reach:
                steps.append((i, part, reach))
                reach = more
            n, part = n - part, part * 2
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            at -= part * lengths[i]
            take[i] += part
    return take


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size), sources in
    code-point order with null last taking ``weights`` in turn.

    The whole budget is ``share`` of all words. A source that would get more than
    ``most`` times its words is held there and its excess reshared by weight. With
    level = budget a unit of weight, a source is held iff most*size/weight < level.
    Holding sources in the order of that bound lifts the level of the rest as long as
    they need holding and lowers it after, so the level is the largest over running
    sums, without a loop. Running sums go over one row per source.
    """
    by_name, by_bound = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("__bound", F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    s = (
        sizes.withColumn("__w", cycle)
        .withColumn("__cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("__bound", F.col("__cap") / F.col("__w"))
        .withColumn("__budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("__all", F.sum("__w").over(everything))
    )
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.col("__all") - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    s = s.withColumn("__level", level).withColumn("__level", F.max("__level").over(everything))
    held = F.col("__bound") < F.col("__level")
    return s.select("source", "source_size", F.when(held, F.col("__cap")).otherwise(F.col("__w") * F.col("__level")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0, dp_words: int = 1 << 16, size: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often each document enters a mix: one row per row of ``docs``.

    Returns doc_id, source, size (words of the whole text), source_size, target (its
    source's), repeats (0 to ``most``) and taken = repeats * size.

    A source's target is whole passes over its documents and a rest; ``fill`` fits
    the rest to the counts of documents by exact length, one group per source whose
    rows are its distinct lengths, never its documents. Which documents of a length
    are taken is the order of a seeded hash of doc_id: the rank in a hashed bucket
    plus the counts of the buckets before, so a source, or a length in it, that holds
    a third of all rows is spread over all buckets. ``dp_words`` bounds the bitsets.

    Cases: a null text is empty and has size 0, such documents are taken at no cost
    only in whole passes; a null source is a source, the last; ``doc_id`` may be null
    or repeat (each row counts); an empty table gives an empty result.
    """
    n = partitions(docs.sparkSession)
    size = words(text_of()) if size is None else size
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # never null, so that joins and windows share it
    slim = docs.select(F.col("doc_id"), F.col("source"), key.alias("__s"), size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("__h"))
    slim = written(slim.withColumn("__b", F.pmod("__h", F.lit(n))))
    counts = slim.groupBy("__s", "source", "size", "__b").agg(F.count(F.lit(1)).alias("__n"))
    lengths = written(counts.groupBy("__s", "source", "size").agg(F.sum("__n").alias("n")))
    goal = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    goal = goal.select(key.alias("__s"), "source_size", "target")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = min(most, int(target // total)) if total else 0
        budget = 0 if whole >= most else round(target) - whole * total
        group["__extra"] = fill([int(x) for x in group["size"]], [int(x) for x in group["n"]], budget, total, dp_words)
        group["__whole"] = whole
        return group[["__s", "size", "source_size", "target", "__whole", "__extra"]]

    quota = lengths.select("__s", "size", "n").join(goal, "__s").groupBy("__s").applyInPandas(fit, "__s string, size long, source_size long, target double, __whole int, __extra long")
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__s", "size").orderBy("__b")) - F.col("__n")).drop("source")
    part = before.join(quota, ["__s", "size"]).withColumn("__take", F.least(F.greatest(F.col("__extra") - F.col("__before"), F.lit(0)), F.col("__n"))).drop("__n", "__before", "__extra")
    rows = slim
    if carry:
        carried = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
        rows = docs.select(carried.alias("__carried"), F.col("doc_id"), F.col("source"), key.alias("__s"), size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("__h")).withColumn("__b", F.pmod("__h", F.lit(n)))
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("__s", "size", "__b").orderBy("__h", "doc_id")))
    repeats = F.col("__whole") + (F.col("__rn") <= F.col("__take")).cast("int")
    return ranked.join(part, ["__s", "size", "__b"]).select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"), *(["__carried"] if carry else [])
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    cols = tuple(docs.columns)
    out = mix(docs, carry=cols, **options).where("repeats > 0").select(F.explode(F.sequence(F.lit(1), "repeats")), "__carried")
    return out.select(*[F.col(f"__carried.c{i}").alias(c) for i, c in enumerate(cols)])
