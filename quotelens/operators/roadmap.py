"""Planned reports: price trend, vendor comparison, discounts by category, name keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens import fixed_values as V
from quotelens.functions.text import half_up_mean
from quotelens.operators.review import discounted

_KEYS = ["item_name", "spec", "unit"]


def _keyed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"spec": F.coalesce("spec", F.lit("")), "unit": F.col("unit_norm")})


def price_trend(lines: DataFrame) -> DataFrame:
    """Mean price per item and month with the change to the item's previous month.

    The window runs over months, which are few per item however many lines it has.
    """
    month = F.trunc("quote_date", "month").alias("quote_month")
    monthly = (
        _keyed(lines).groupBy(*_KEYS, month)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("unit_price").alias("total"))
        .withColumn("price_avg", half_up_mean("total", "n"))
        .drop("total")
    )
    before = F.lag("price_avg").over(Window.partitionBy(*_KEYS).orderBy("quote_month"))
    return monthly.withColumn("change", F.col("price_avg") - before)


def vendor_compare(lines: DataFrame) -> DataFrame:
    """Each vendor's mean price of an item and its rank, cheapest first."""
    priced = (
        _keyed(lines).filter(F.col("vendor") != "").groupBy(*_KEYS, "vendor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("unit_price").alias("price_min"), F.sum("unit_price").alias("total"))
        .withColumn("price_avg", half_up_mean("total", "n"))
        .drop("total")
    )
    rank = F.rank().over(Window.partitionBy(*_KEYS).orderBy("price_avg"))
    return priced.withColumn("price_rank", rank.cast("bigint"))


def category_discount(lines: DataFrame, category: str, rates: Mapping[str, float]) -> DataFrame:
    """Discounted price with a rate per category; other categories take the default rate."""
    table = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    rate = F.coalesce(F.try_element_at(table, F.col(category)), F.lit(V.DEFAULT_DISCOUNT))
    return lines.withColumn("discount_price", discounted(F.col("unit_price"), rate))


def name_key(name: Column) -> Column:
    """Key that ignores case, blanks and symbols."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))
