"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.llm.rows import WORD, attach, running_sums
from quotelens.plans.checkpoints import written

WEIGHTS = (5, 2, 1)
PASSES = 3
COPIES = 4096


def _ordered_sources(units: DataFrame) -> DataFrame:
    """source, source_size, and the size and number of sources before it; null is the last source."""
    sizes = units.groupBy("source").agg(F.sum("unit_size").alias("source_size")).withColumn("one", F.lit(1))
    order = [F.col("source").isNull(), F.col("source")]
    return running_sums(sizes, order, {"start": "source_size", "place": "one"})


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """source, source_size, start, target: weights share the total, capped at `passes` source sizes.

    Sources in order of cap per weight: the first k are capped, the rest share what is left by
    weight. k is the first place where the next source takes its share without reaching its cap.
    """
    lcm = math.lcm(*weights)
    # Wide: a weight times the words of the corpus leaves 32 bits before those words do.
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("bigint")
    sources = _ordered_sources(units).withColumn("weight", weight).withColumn("cap", F.col("source_size") * passes)
    ranked = written(running_sums(
        sources, [F.col("cap") * (F.lit(lcm) / F.col("weight")).cast("bigint"), F.col("place")],
        {"caps_before": "cap", "weights_before": "weight"},
    ), "sources")
    total, weight_sum = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    room = F.lit(total or 0) - F.col("caps_before")
    rest = F.lit(weight_sum or 0) - F.col("weights_before")
    wide = "decimal(19,0)"
    free = F.col("cap").cast(wide) * rest.cast(wide) >= F.col("weight").cast(wide) * room.cast(wide)
    level = ranked.where(free).agg(F.min(F.struct("weights_before", "caps_before")).alias("at")).select("at.*").first()
    wb, cb = (level["weights_before"], level["caps_before"]) if level["caps_before"] is not None else (-1, 0)
    share = (F.col("weight") * F.lit((total or 0) - cb)).cast("double") / F.lit(float((weight_sum or 0) - wb))
    target = F.when(F.col("weights_before") < wb, F.col("cap").cast("double")).otherwise(share)
    return ranked.select("source", "source_size", "start", target.alias("target"))


def _numbered_copies(units: DataFrame) -> DataFrame:
    """One row per copy of a unit, with its number `copy` from 0.

    A unit of many copies is cut into blocks that are dealt over tasks before they are unfolded.
    """
    last = F.col("rows") - 1
    blocks = units.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / COPIES))).alias("block"))
    dealt = blocks.repartition("row_key", "block")
    start = F.col("block") * COPIES
    copies = F.sequence(start, F.least(last, start + COPIES - 1))
    return dealt.select(*units.columns, F.explode(copies).alias("copy"))


def served_units(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """doc_id, row_key, source, size, rows, source_size, target, served: one row per id, text and source.

    `rows` counts the rows that repeat the three, `served` how often the mix takes one of them.
    """
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    units = written(
        sized.groupBy("doc_id", "row_key", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("unit_size", F.col("size") * F.col("rows"))
        .withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "units",
    )
    targets = written(source_targets(units, weights, passes), "targets")
    queue = [F.col("source").isNull(), F.col("source"), F.col("turn"), F.col("doc_id"), F.col("row_key"), F.col("copy")]
    lined = running_sums(_numbered_copies(units.where("size > 0")), queue, {"before": "size"})
    priced = lined.join(targets, lined["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    items = priced.where("target > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("lap")
    ).withColumn(
        "finish",
        (F.col("lap") * F.col("source_size") + F.col("before") - F.col("start") + F.col("size")).cast("double")
        / F.col("target"),
    ).select("doc_id", "row_key", "source", "turn", "copy", "lap", "finish", "size")
    total = units.agg(F.sum("unit_size")).first()[0] or 0
    clock = [F.col("finish"), *queue, F.col("lap")]
    taken = running_sums(items, clock, {"used": "size"}).where(F.col("used") + F.col("size") <= total)
    laps = written(taken.groupBy("doc_id", "row_key", "source").agg(F.count(F.lit(1)).alias("served")), "laps")
    out = units.join(
        laps, (units["row_key"] == laps["row_key"]) & _same(units, laps, ["doc_id", "source"]), "left"
    ).select(units["*"], F.coalesce("served", F.lit(0)).alias("served"))
    return out.join(targets, out["source"].eqNullSafe(targets["source"]), "left").select(
        "doc_id", "row_key", out["source"], "size", "rows", "source_size", "target", "served",
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, source, size, source_size, target, passes, taken.

    Size is the number of words; null text has none. Each source is shuffled by a digest of the
    doc_id and queued at most `passes` times over. A queued document finishes at virtual time
    (words of its source up to its end) / target; all are sorted by it and taken until the words
    of the whole corpus are used up, so every source is served in proportion to its target and
    ends within one document of it. Reruns agree, as nothing depends on partitions. Rows that
    repeat id, text and source queue one by one; as they are the same, the first of them are
    those taken once more. Documents without words are taken 0 times.
    """
    copies = _numbered_copies(served_units(docs, weights, passes))
    return copies.withColumn("passes", _passes(F.col("copy"))).select(
        "doc_id", "row_key", "source", "size", "source_size", "target", "passes",
        (F.col("size") * F.col("passes")).alias("taken"),
    )


def _passes(number: Column) -> Column:
    """How often the copy of that number (from 0) is taken, as `served` is dealt to `rows` copies in turn."""
    once_more = (number < F.col("served") % F.col("rows")).cast("bigint")
    return F.floor(F.col("served") / F.col("rows")) + once_more


def _same(left: DataFrame, right: DataFrame, names: list[str]):
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """The mix itself: rows of `docs` with all their columns, each as many times as it is taken.

    Rows that repeat id, text and source are numbered only where some are taken once more than others.
    """
    units = written(served_units(docs, weights, passes).where("served > 0").select(
        "doc_id", "row_key", F.struct("source").alias("of"), "rows", "served"
    ), "served")
    rows = attach(docs, units).where(F.col("row.source").eqNullSafe(F.col("of.source")))
    uneven = F.col("served") % F.col("rows") > 0
    even = rows.where(~uneven).withColumn("passes", _passes(F.lit(0)))
    if units.where(uneven).isEmpty():
        return _repeated(even)
    key = [F.col("row.doc_id"), F.xxhash64("row.doc_id", "row.text"), F.col("row.source")]
    # Stored with its mark, so equal rows are told apart in the same way by every later job.
    marked = written(rows.where(uneven).withColumn("mark", F.monotonically_increasing_id()).withColumn("one", F.lit(1)), "uneven")
    first = units.where(uneven).select(
        "doc_id", "row_key", F.col("of.source").alias("source"), F.col("rows").alias("one"))
    starts = running_sums(first, [F.col("doc_id"), F.col("row_key"), F.col("source")], {"start": "one"}).drop("one")
    lined = running_sums(marked, [*key, F.col("mark")], {"place": "one"})
    same = key[0].eqNullSafe(starts["doc_id"]) & (key[1] == starts["row_key"]) & key[2].eqNullSafe(starts["source"])
    numbered = lined.join(starts, same).withColumn("passes", _passes(F.col("place") - F.col("start")))
    return _repeated(even.select("row", "passes").unionByName(numbered.select("row", "passes")))


def _repeated(rows: DataFrame) -> DataFrame:
    times = F.expr("if(passes > 0, sequence(1, cast(passes as int)), array())")
    return rows.select("row", F.explode(times)).select("row.*")
