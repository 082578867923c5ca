"""Unit normalisation and confidence scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import fixed_values as V
from quotelens.functions.text import lookup, strip


def normalize_unit(raw: Column) -> Column:
    trimmed = strip(F.coalesce(raw, F.lit("")))
    key = F.replace(F.lower(trimmed), F.lit(" "), F.lit(""))
    return F.coalesce(lookup(key, V.UNIT_NORMAL), F.upper(trimmed))


def _penalty(condition: Column, hundredths: int) -> Column:
    return F.when(condition, F.lit(hundredths)).otherwise(F.lit(0))


def _missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _as_score(hundredths: Column) -> Column:
    return (F.greatest(hundredths, F.lit(0)) / F.lit(100)).cast("decimal(3,2)")


def score_header(vendor: Column, quote_no: Column, quote_date: Column, project: Column) -> Column:
    lost = (
        _penalty(_missing(vendor), 15)
        + _penalty(_missing(quote_no), 10)
        + _penalty(quote_date.isNull(), 10)
        + _penalty(_missing(project), 10)
    )
    return _as_score(F.lit(100) - lost)


def amount_mismatch(quantity: Column, unit_price: Column, amount: Column) -> Column:
    """True when quantity x price is off by more than one won and more than one percent."""
    qty, price, total = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (quantity, unit_price, amount))
    expected = qty * price
    return (
        (qty != 0) & (price != 0) & (total != 0)
        & (F.abs(expected - total) > F.greatest(F.lit(1.0), expected * 0.01))
    )


def score_item(name: Column, unit: Column, quantity: Column, unit_price: Column, amount: Column) -> Column:
    text = F.coalesce(name, F.lit(""))
    total = F.coalesce(amount, F.lit(0))
    lost = (
        F.when(text == "", F.lit(40)).when(F.length(text) < 2, F.lit(30)).otherwise(F.lit(0))
        + _penalty(F.coalesce(unit_price, F.lit(0)) <= 0, 30)
        + _penalty(F.coalesce(quantity.cast("double"), F.lit(0.0)) <= 0, 15)
        + _penalty(_missing(unit), 5)
        + _penalty(amount_mismatch(quantity, unit_price, amount), 20)
        + _penalty((total != 0) & (total < V.MIN_AMOUNT), 15)
    )
    return _as_score(F.lit(100) - lost)


def enrich_items(items: DataFrame) -> DataFrame:
    """Add unit_norm and confidence to parsed items."""
    c = F.col
    return items.withColumns({
        "unit_norm": normalize_unit(c("unit")),
        "confidence": score_item(c("item_name"), c("unit"), c("quantity"), c("unit_price"), c("amount")),
    })
