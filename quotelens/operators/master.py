"""Standard-price master: protected upsert, ids, reviewed additions, status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import fixed_values as V
from quotelens.functions.text import padded_id
from quotelens.plans.checkpoints import written
from quotelens.plans.ranking import first_per_key, with_running_number

KEYS = ["item_name", "spec", "unit"]
PRICES = [
    "category", "price_min", "price_avg", "price_max", "data_count",
    "main_maker", "latest_quote_date", "source_vendors",
]
MASTER_COLUMNS = ["item_id", *KEYS, *PRICES, "manually_reviewed", "review_note", "created_at", "updated_at"]


def sync_actions(source: DataFrame, master: DataFrame) -> DataFrame:
    """What a synchronisation does with every aggregated key: insert, update or skip."""
    known = master.select(*KEYS, F.col("manually_reviewed").alias("__reviewed"))
    return source.join(known, KEYS, "left").withColumn(
        "action",
        F.when(F.col("__reviewed").isNull(), F.lit("inserted"))
        .when(F.col("__reviewed"), F.lit("skipped"))
        .otherwise(F.lit("updated")),
    ).drop("__reviewed")


def sync_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def next_id_start(master: DataFrame) -> int:
    """First free numeric suffix of the SP ids (a one-row aggregate)."""
    suffix = F.when(F.col("item_id").rlike(r"^SP-\d+$"), F.substring("item_id", 4, 20).try_cast("bigint"))
    return (master.agg(F.max(suffix)).head()[0] or 0) + 1


def issue_ids(new_rows: DataFrame, start: int, prefix: str, width: int, order: list[str]) -> DataFrame:
    """Ids prefix + zero-padded running number in the given total order."""
    numbered = with_running_number(new_rows, [F.col(c) for c in order], "__no", start)
    return numbered.withColumn("item_id", padded_id(prefix, width, F.col("__no"))).drop("__no")


def sync_master(source: DataFrame, master: DataFrame, now: Column | None = None, start: int | None = None) -> DataFrame:
    """New master snapshot: insert unknown keys, refresh unreviewed ones, protect reviewed ones.

    Kept rows keep item_id and created_at; rows without fresh aggregates stay as they are. New ids
    go on from `start`, or from the largest id of `master`.
    """
    now = F.current_timestamp() if now is None else now
    fresh = source.select(*KEYS, F.lit(True).alias("__fresh"), *[F.col(c).alias(f"__{c}") for c in PRICES])
    # Source and master are each evaluated once; both branches read what is stored here.
    joined = written(master.withColumn("__stored", F.lit(True)).join(fresh, KEYS, "full"), "sync")
    merged = joined.filter("__stored")
    take = F.col("__fresh").isNotNull() & ~F.col("manually_reviewed")
    kept = merged.withColumns({
        **{c: F.when(take, F.col(f"__{c}")).otherwise(F.col(c)) for c in PRICES},
        "updated_at": F.when(take, now).otherwise(F.col("updated_at")),
    }).select(*MASTER_COLUMNS)

    unknown = joined.filter("__stored IS NULL").select(*KEYS, *[F.col(f"__{c}").alias(c) for c in PRICES])
    added = issue_ids(unknown, next_id_start(merged) if start is None else start, "SP-", 5, KEYS).select(
        "item_id", *KEYS, *PRICES,
        F.lit(False).alias("manually_reviewed"), F.lit("").alias("review_note"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    return kept.unionByName(added)


def standard_ids(master: DataFrame) -> DataFrame:
    """STD ids in order of first appearance."""
    return issue_ids(master, 1, "STD-", 4, ["first_seen", *KEYS])


def reviewed_additions(review: DataFrame, master: DataFrame, seq: str, source_file: str, today: Column) -> DataFrame:
    """Reviewed lines without a standard price whose item and spec the master lacks.

    The first line of a batch wins; minimum, mean and maximum all equal the final price.
    """
    candidates = review.filter(
        (F.coalesce("standard_price", F.lit(0)) == 0) & (F.col("final_price") > 0)
    ).select(seq, "item_name", "spec", "unit", "final_price")
    keys = ["item_name", "spec"]
    new = first_per_key(candidates.join(master.select(*keys), keys, "left_anti"), keys, [seq, "unit", "final_price"])
    start = master.agg(F.count(F.lit(1))).head()[0] + 1
    price = F.col("final_price")
    return issue_ids(new, start, "STD-", 4, [seq, *keys]).select(
        "item_id", *KEYS,
        F.lit(V.DEFAULT_CATEGORY).alias("category"),
        price.alias("price_min"), price.alias("price_avg"), price.alias("price_max"),
        F.lit(1).cast("bigint").alias("data_count"), F.lit("").alias("main_maker"),
        today.alias("latest_quote_date"), F.lit(V.REVIEW_SOURCE % source_file).alias("source_vendors"),
    )


def append_reviewed(review: DataFrame, master: DataFrame, seq: str, source_file: str, today: Column) -> DataFrame:
    """The master with the reviewed additions appended."""
    added = reviewed_additions(review, master, seq, source_file, today)
    return master.select(*added.columns).unionByName(added)


def load_master(raw: DataFrame) -> DataFrame:
    """Master read from text columns: bad numbers become 0, rows need a name and a positive mean."""
    trimmed = raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns])
    whole = ["price_min", "price_avg", "price_max", "data_count"]
    numeric = {
        c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) for c in whole if c in trimmed.columns
    }
    return trimmed.withColumns(numeric).filter(
        F.col("item_name").isNotNull() & (F.col("item_name") != "") & (F.col("price_avg") > 0)
    )


def search_names(master: DataFrame, pattern: str, literal: bool = False) -> DataFrame:
    """Case-insensitive name search; the pattern is a regular expression unless literal."""
    name = F.col("item_name")
    if literal:
        hit = F.lower(name).contains(pattern.lower())
    else:
        hit = name.rlike("(?iu)" + pattern)
    return master.filter(F.coalesce(hit, F.lit(False))) if pattern else master


def status(headers: DataFrame, items: DataFrame, prices: DataFrame, master: DataFrame) -> DataFrame:
    """One row per headline count."""
    def one(df: DataFrame, name: str, n: Column) -> DataFrame:
        return df.agg(n.alias("n")).select(F.lit(name).alias("metric"), "n")

    every = F.count(F.lit(1))
    return (
        one(headers, "headers_ok", F.count_if("parse_ok"))
        .unionByName(one(items, "items", every))
        .unionByName(one(prices, "standard_prices", every))
        .unionByName(one(master, "master_items", every))
        .unionByName(one(master, "master_reviewed", F.count_if("manually_reviewed")))
    )


def log_counts(log: DataFrame) -> DataFrame:
    """Parse-log rows per status, in status order."""
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status")


def quality_profile(master: DataFrame) -> DataFrame:
    """Shares of single-sample items, missing spec, missing maker and one-won prices."""
    n = F.count(F.lit(1))

    def share(condition: Column) -> Column:
        return F.when(n > 0, F.count_if(condition) / n)

    return master.agg(
        n.alias("items"),
        share(F.col("data_count") == 1).alias("single_sample_share"),
        share(F.coalesce("spec", F.lit("")) == "").alias("missing_spec_share"),
        share(F.coalesce("main_maker", F.lit("")) == "").alias("missing_maker_share"),
        share(F.col("price_avg") == 1).alias("one_won_share"),
    )
