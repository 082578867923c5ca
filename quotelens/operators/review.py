"""Comparison with standard prices, price recommendation and savings roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import fixed_values as V


def deviation(quote: Column, average: Column) -> Column:
    """Percent above the average rounded to one decimal; null without a positive average.

    Rounded half up on exact decimals, so results do not depend on the binary fraction.
    """
    ratio = ((quote - average) * 1000).cast("decimal(38,6)") / average.cast("decimal(20,0)")
    return F.when(average > 0, (F.round(ratio, 0) / 10).cast("double"))


def verdict(deviation_pct: Column, percent: float = V.ANOMALY_PERCENT) -> Column:
    return (
        F.when(deviation_pct.isNull(), F.lit(V.VERDICT_NONE))
        .when(deviation_pct > percent, F.format_string(V.VERDICT_ABNORMAL, deviation_pct))
        .when(deviation_pct < -percent, F.format_string(V.VERDICT_CHEAP, deviation_pct))
        .otherwise(F.format_string(V.VERDICT_FAIR, deviation_pct))
    )


def is_abnormal(deviation_pct: Column, percent: float = V.ANOMALY_PERCENT) -> Column:
    return F.coalesce(deviation_pct > percent, F.lit(False))


def compare(matched: DataFrame, percent: float = V.ANOMALY_PERCENT) -> DataFrame:
    """Deviation, verdict and abnormal flag for lines that carry std_price_avg."""
    return (
        matched.withColumn("deviation_pct", deviation(F.col("unit_price"), F.col("std_price_avg")))
        .withColumn("verdict", verdict(F.col("deviation_pct"), percent))
        .withColumn("is_abnormal", is_abnormal(F.col("deviation_pct"), percent))
    )


def abnormal_only(compared: DataFrame) -> DataFrame:
    return compared.filter("is_abnormal")


def unmatched(compared: DataFrame) -> DataFrame:
    """Lines without a usable standard price."""
    return compared.filter(
        F.col("std_price_avg").isNull()
        | (F.coalesce(F.col("similarity_pct"), F.lit(0.0)) < V.MIN_SIMILARITY_PERCENT)
    )


def negotiable(quote: Column, average: Column, quantity: Column) -> Column:
    """Whole-won amount above the standard price; a missing quantity counts as one."""
    gap = (quote - average) * F.coalesce(quantity.cast("double"), F.lit(1.0))
    return F.coalesce(gap.cast("bigint"), F.lit(0).cast("bigint"))


def discounted(quote: Column, discount: Column) -> Column:
    return (quote * (1 - discount / 100)).cast("bigint")


def final_price(basis: Column, quote: Column, standard: Column, market: Column, discount_price: Column) -> Column:
    return (
        F.when(basis == V.BASIS_QUOTE, quote)
        .when(basis == V.BASIS_STANDARD, F.when(standard != 0, standard).otherwise(quote))
        .when(basis == V.BASIS_MARKET, F.when(market != 0, market).otherwise(discount_price))
        .otherwise(discount_price)
    )


def has_standard(average: Column, similarity_pct: Column) -> Column:
    return average.isNotNull() & (F.coalesce(similarity_pct, F.lit(0.0)) >= V.MIN_SIMILARITY_PERCENT)


def direction(standard: Column, quote: Column) -> Column:
    return (
        F.when(standard <= 0, F.lit(V.DIRECTION_NONE))
        .when(standard < quote, F.lit(V.DIRECTION_LOWER))
        .otherwise(F.lit(V.DIRECTION_HIGHER))
    )


def recommend(quote: Column, standard: Column, market: Column, discount_price: Column) -> Column:
    """Basis proposed for a line; standard is 0 when there is none."""
    return (
        F.when(
            standard > 0,
            F.when(quote <= standard, F.lit(V.BASIS_QUOTE)).otherwise(F.lit(V.BASIS_STANDARD)),
        )
        .when((market > 0) & (market < discount_price), F.lit(V.BASIS_MARKET))
        .otherwise(F.lit(V.BASIS_DISCOUNT))
    )


def with_market_price(compared: DataFrame, market: DataFrame) -> DataFrame:
    """Attach the market price of the item name (0 when unknown)."""
    prices = market.select("item_name", "market_price")
    return compared.join(prices, "item_name", "left").withColumn(
        "market_price", F.coalesce("market_price", F.lit(0)).cast("bigint")
    )


def review_table(compared: DataFrame, discount: float = V.DEFAULT_DISCOUNT) -> DataFrame:
    """Decision table for compared lines that already carry market_price."""
    c = F.col
    out = compared.withColumns({
        "has_db": has_standard(c("std_price_avg"), c("similarity_pct")),
        "quantity": F.when(
            F.coalesce(c("quantity").cast("double"), F.lit(0.0)) == 0, F.lit(1.0)
        ).otherwise(c("quantity").cast("double")),
        "quote_price": c("unit_price").cast("bigint"),
        "discount": F.lit(float(discount)),
    })
    out = out.withColumns({
        "standard_price": F.when(c("has_db"), c("std_price_avg")).otherwise(F.lit(0)).cast("bigint"),
        "discount_price": discounted(c("quote_price"), c("discount")),
    })
    out = out.withColumns({
        "direction": direction(c("standard_price"), c("quote_price")),
        "recommended": recommend(c("quote_price"), c("standard_price"), c("market_price"), c("discount_price")),
    })
    return _with_final(out.withColumn("basis", c("recommended")))


def _with_final(review: DataFrame) -> DataFrame:
    c = F.col
    return review.withColumn(
        "final_price",
        final_price(c("basis"), c("quote_price"), c("standard_price"), c("market_price"), c("discount_price")),
    )


def apply_overrides(review: DataFrame, overrides: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Replace discount and basis where the user edited the row, then price again."""
    edits = overrides.select(
        row_id, F.col("discount").alias("new_discount"), F.col("basis").alias("new_basis")
    )
    c = F.col
    out = review.join(edits, row_id, "left").withColumns({
        "discount": F.coalesce(c("new_discount"), c("discount")),
        "basis": F.coalesce(c("new_basis"), c("basis")),
    })
    out = out.withColumn("discount_price", discounted(c("quote_price"), c("discount")))
    return _with_final(out.drop("new_discount", "new_basis"))


def mark_overrides(review: DataFrame) -> DataFrame:
    """Flag rows whose basis differs from the proposal, else rows that got cheaper."""
    changed = F.col("basis") != F.col("recommended")
    return review.withColumns({
        "basis_changed": changed,
        "is_saving": ~changed & (F.col("final_price") < F.col("quote_price")),
    })


def review_summary(review: DataFrame) -> DataFrame:
    """Totals before and after review with the saving in won and percent."""
    qty = F.coalesce(F.col("quantity"), F.lit(1.0))
    totals = review.agg(
        F.coalesce(F.sum(F.col("quote_price") * qty), F.lit(0.0)).alias("total_quote"),
        F.coalesce(F.sum(F.col("final_price") * qty), F.lit(0.0)).alias("total_final"),
    )
    saved = F.col("total_quote") - F.col("total_final")
    return totals.withColumns({
        "saved": saved,
        "saved_pct": F.when(F.col("total_quote") > 0, saved / F.col("total_quote") * 100).otherwise(F.lit(0.0)),
    })


def comparison_kpis(compared: DataFrame, percent: float = V.ANOMALY_PERCENT) -> DataFrame:
    """Headline counts and sums of a comparison."""
    total_std = F.coalesce(F.sum(F.coalesce("std_price_avg", "unit_price")), F.lit(0))
    return compared.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count("std_price_avg").alias("matched"),
        F.count_if(F.col("is_abnormal")).alias("abnormal"),
        F.coalesce(F.sum("unit_price"), F.lit(0)).alias("total_quote"),
        total_std.alias("total_std"),
        (F.greatest(total_std, F.lit(0)) * percent / 100).cast("double").alias("saving"),
    )


def market_coverage(unmatched_lines: DataFrame, market: DataFrame) -> DataFrame:
    """How many unmatched lines have a market price."""
    names = market.select("item_name").distinct().withColumn("hit", F.lit(True))
    return unmatched_lines.join(names, "item_name", "left").agg(
        F.count(F.lit(1)).alias("unmatched"), F.count_if(F.col("hit")).alias("with_market_price")
    )
