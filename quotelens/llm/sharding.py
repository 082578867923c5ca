"""Contiguous shards of near equal byte size from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.rows import running_sums
from quotelens.plans.checkpoints import written

SHARDS = 16


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, text_sha256, shard, slot.

    Size is the text's UTF-8 bytes plus 1; null counts as empty. Rows are laid out by group of
    equal texts, large groups first; the prefix sum of sizes gives every group its place, and a
    row belongs to the shard in whose equal share of the bytes the middle of its group lies. So
    equal texts stay together, the shards are contiguous in that order, and they differ by less
    than a group that is small where they end. A group larger than a whole share is cut like
    single rows. slot numbers the rows of a shard in the same order from 0. Rows that repeat id
    and text are rows of their own. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    sized = written(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.sha2(text, 256).alias("text_sha256"),
    ), "sized")
    repeated = written(sized.groupBy("text_sha256").agg(
        F.sum("size").alias("group_bytes"), F.count(F.lit(1)).alias("group_rows")
    ).where("group_rows > 1").drop("group_rows"), "repeated")
    rows = sized.join(repeated, "text_sha256", "left").select(
        *sized.columns, F.col("group_bytes").isNotNull().alias("grouped"),
        F.coalesce("group_bytes", "size").alias("group_bytes"),
    ).withColumn("one", F.lit(1))
    layout = written(running_sums(
        rows, [-F.col("group_bytes"), F.col("text_sha256"), F.col("doc_id")], {"before": "size", "place": "one"}
    ), "layout")
    total = sized.agg(F.sum("size")).first()[0] or 0
    whole = F.col("grouped") & (F.col("group_bytes") * shards <= total)
    starts = written(
        layout.where(whole).groupBy("text_sha256").agg(F.min("before").alias("group_start")), "group-starts"
    )
    middle = F.coalesce(2 * F.col("group_start") + F.col("group_bytes"), 2 * F.col("before") + F.col("size"))
    placed = written(layout.join(starts, "text_sha256", "left").withColumn(
        "shard", F.floor(middle * shards / F.lit(2 * max(total, 1))).cast("int")
    ), "placed")
    # One row per shard: bounded by the shard count.
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "text_sha256", "shard", (F.col("place") - F.col("first_place")).alias("slot")
    )
