"""Standard-price aggregation and over-price detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens import fixed_values as V
from quotelens.functions.text import half_even_mean, half_up_mean


def items_with_header(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Item lines with the header columns the price operators read."""
    heads = headers.select(
        F.col("id").alias("header_id"), "vendor", "quote_no", "quote_date", "project", "parse_ok"
    )
    return items.join(heads, "header_id")


def trusted(lines: DataFrame, min_confidence: float = V.MIN_CONFIDENCE) -> DataFrame:
    """Lines good enough to build prices from."""
    return lines.filter(
        (F.col("unit_price") > 0)
        & (F.col("confidence") >= F.lit(f"{min_confidence:.2f}").cast("decimal(3,2)"))
        & ~F.col("flagged")
        & F.col("parse_ok")
    )


def _reduced(lines: DataFrame, key: list[Column]) -> DataFrame:
    """Totals per key x vendor x maker x category.

    All buffers are fixed-width, so this is a hash aggregate with map-side combine: a hot
    item leaves each map task as a handful of rows, spread over the reducers by vendor.
    """
    price = F.col("unit_price")
    return lines.groupBy(
        *key,
        F.coalesce("vendor", F.lit("")).alias("vendor"),
        F.coalesce("maker", F.lit("")).alias("maker"),
        F.coalesce("category", F.lit("")).alias("category"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(price).alias("total"),
        F.min(price).alias("low"),
        F.max(price).alias("high"),
        F.max("quote_date").alias("latest"),
    )


def standard_price(
    lines: DataFrame,
    min_samples: int = 2,
    null_safe: bool = True,
    with_maker: bool = False,
    blank_vendors: bool = True,
) -> DataFrame:
    """Minimum, mean, maximum, count, latest date and vendors per (item, spec, unit).

    null_safe folds a missing spec or unit into ''; otherwise nulls form their own group.
    with_maker adds the most frequent non-blank maker (lowest name on ties).
    blank_vendors=False leaves blank vendors out of the vendor list.
    """
    def key_part(name: str) -> Column:
        return F.coalesce(name, F.lit("")) if null_safe else F.col(name)

    reduced = _reduced(
        lines,
        [F.col("item_name"), key_part("spec").alias("spec"), key_part("unit_norm").alias("unit")],
    )
    return priced(reduced, min_samples, with_maker, blank_vendors)


def priced(reduced: DataFrame, min_samples: int, with_maker: bool, blank_vendors: bool) -> DataFrame:
    """Standard prices of totals per key x vendor x maker x category."""
    keys = ["item_name", "spec", "unit"]
    aggregates = [
        F.max("category").alias("category"),
        F.sum("n").alias("sample_count"),
        F.min("low").alias("price_min"),
        F.sum("total").alias("total"),
        F.max("high").alias("price_max"),
        F.max("latest").alias("latest_quote_date"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(F.lit(blank_vendors) | (F.col("vendor") != ""), F.col("vendor")))),
            ", ",
        ).alias("source_vendors"),
    ]
    if with_maker:
        # Clustering by key alone serves both the maker totals and the final aggregate.
        per_maker = Window.partitionBy(*keys, "maker")
        reduced = reduced.repartition(*keys).withColumn("maker_n", F.sum("n").over(per_maker))
        named = F.when(F.col("maker") != "", F.struct(-F.col("maker_n"), F.col("maker")))
        aggregates.append(F.coalesce(F.min(named)["maker"], F.lit("")).alias("main_maker"))
    out = (
        reduced.groupBy(*keys)
        .agg(*aggregates)
        .filter(F.col("sample_count") >= min_samples)
        .withColumn("price_avg", half_up_mean("total", "sample_count"))
    )
    return out.select(
        *keys, "category", "sample_count", "price_min", "price_avg", "price_max",
        "latest_quote_date", "source_vendors", *(["main_maker"] if with_maker else []),
    )


def master_source(lines: DataFrame, min_samples: int = 2) -> DataFrame:
    """The aggregate the master is synchronised from."""
    return standard_price(lines, min_samples, with_maker=True, blank_vendors=False)


def legacy_master(items: DataFrame, seq: str, entry_dates: DataFrame | None = None) -> DataFrame:
    """First-generation master: no minimum count, first row's category and maker, half-even mean.

    `seq` is the running item number (ties, if any, fall to the lowest maker). It is kept as
    `first_seen` so that ids can be issued in order of first appearance.
    """
    keys = ["item_name", "spec", "unit"]
    priced = F.when(F.col("unit_price") > 0, F.col("unit_price"))
    # Fixed-width buffers only: a hash aggregate with map-side combine, spread by vendor.
    reduced = items.groupBy(*keys, F.coalesce("vendor", F.lit("")).alias("vendor"), "maker", "category").agg(
        F.count(priced).alias("n"),
        F.sum(priced).alias("total"),
        F.min(priced).alias("low"),
        F.max(priced).alias("high"),
        F.max("quote_date").alias("latest"),
        F.min(seq).alias("seq"),
    )
    out = (
        reduced.groupBy(*keys)
        .agg(
            F.sum("n").alias("data_count"),
            F.sum("total").alias("total"),
            F.min("low").alias("price_min"),
            F.max("high").alias("price_max"),
            F.max("latest").alias("latest_quote_date"),
            F.array_join(F.array_sort(F.collect_set("vendor")), ", ").alias("source_vendors"),
            F.min(F.struct("seq", "maker", "category")).alias("head"),
        )
        .filter(F.col("data_count") > 0)
        .select(
            *keys,
            F.col("head.category").alias("category"),
            "price_min",
            half_even_mean("total", "data_count").alias("price_avg"),
            "price_max", "data_count",
            F.col("head.maker").alias("main_maker"),
            "latest_quote_date", "source_vendors",
            F.col("head.seq").alias("first_seen"),
        )
    )
    return out if entry_dates is None else keep_entry_dates(out, entry_dates)


def keep_entry_dates(master: DataFrame, entry_dates: DataFrame, today: Column | None = None) -> DataFrame:
    """Carry over the earlier entry date of every known (item, spec, unit); today otherwise."""
    known = entry_dates.groupBy("item_name", "spec", "unit").agg(F.max("entry_date").alias("entry_date"))
    return master.join(known, ["item_name", "spec", "unit"], "left").withColumn(
        "entry_date", F.coalesce("entry_date", today if today is not None else F.current_date())
    )


def deviation_percent(price: Column, average: Column) -> Column:
    """Percent above the average, one decimal, in exact decimal arithmetic."""
    diff = ((price - average) * 1000).cast("decimal(38,6)") / F.nullif(average, F.lit(0)).cast("decimal(20,0)")
    return (F.round(diff, 0) / 10).cast("decimal(20,1)")


def anomalies(
    lines: DataFrame, master: DataFrame, percent: int = V.ANOMALY_PERCENT, include_unit: bool = False
) -> DataFrame:
    """Lines priced more than `percent` above the master average of the same item and spec.

    The threshold is compared in whole numbers. A master unit is part of the key only on
    request, so by default one line may meet several master rows.
    """
    keys = ["item_name", "spec"] + (["unit"] if include_unit else [])
    left = lines.filter("parse_ok AND unit_price IS NOT NULL").withColumn("unit", F.col("unit_norm"))
    joined = left.drop(*([] if include_unit else ["unit"])).join(
        master.select(*keys, F.col("price_avg").alias("std_price_avg")), keys
    )
    return joined.filter(F.col("unit_price") * 100 > F.col("std_price_avg") * (100 + percent)).withColumn(
        "deviation_pct", deviation_percent(F.col("unit_price"), F.col("std_price_avg"))
    )
