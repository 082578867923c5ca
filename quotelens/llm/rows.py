"""What the corpus operators share: row keys, whole texts, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens.plans.checkpoints import written

# Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, text): a null text counts as empty.

    Rows that repeat id and text share a key and get the same result; two rows with the same
    id and different texts are told apart. A null id is an id of its own.
    """
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on the key of `keyed`."""
    return (left["row_key"] == right["row_key"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def attach(docs: DataFrame, results: DataFrame, how: str = "inner") -> DataFrame:
    """Whole rows of `docs` as the struct `row`, beside the columns of `results` (one row per key).

    Packing the row keeps result names apart from whatever columns `docs` has.
    """
    left = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"),
        F.struct("*").alias("row"),
    )
    rest = [c for c in results.columns if c not in ("doc_id", "row_key")]
    return left.join(results, same_row(left, results), how).select(left["row"], *[results[c] for c in rest])


def attach_once(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of `docs` per key of `kept` (doc_id, row_key, copies); only repeated rows meet again.

    Copies of a row are dropped in the map tasks first, so a repeated one arrives as a few rows.
    """
    rows = attach(docs, kept)
    single = rows.where("copies = 1").select("row.*")
    if kept.where("copies > 1").isEmpty():
        return single
    key = F.struct(F.col("row.doc_id"), F.xxhash64("row.doc_id", "row.text"))
    repeated = rows.where("copies > 1").withColumn("key", key).dropDuplicates(["key"])
    return single.unionByName(repeated.select("row.*"))


def running_sums(df: DataFrame, order: list[Column], values: dict[str, str]) -> DataFrame:
    """Add, for each (name, column) of `values`, the sum of the column over all earlier rows.

    Rows are range-partitioned by `order` and stored, which fixes the partitions; each partition
    then needs only the totals of those before it, one row per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"__o{i}": c for i, c in enumerate(order)}
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    fixed = written(ranged, "running")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = fixed.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in values.items()]).select(
        "__part",
        *[F.coalesce(F.sum(f"__t_{n}").over(before.orderBy("__part")), F.lit(0)).alias(f"__t_{n}") for n in values],
    )
    inside = before.partitionBy("__part").orderBy(*keys)
    sums = fixed.withColumns(dict(zip(keys, order, strict=True))).withColumns(
        {n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in values.items()}
    )
    # One row per shuffle partition: bounded whatever the input.
    return sums.join(F.broadcast(totals), "__part").withColumns(
        {n: (F.col(n) + F.col(f"__t_{n}")).cast("bigint") for n in values}
    ).drop("__part", *keys, *[f"__t_{n}" for n in values])
