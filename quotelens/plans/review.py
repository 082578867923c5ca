"""The review of quotations end to end: match, compare, market price, recommendation, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quotelens import fixed_values as V
from quotelens.operators.review import apply_overrides, compare, mark_overrides, review_table, with_market_price
from quotelens.operators.similarity import TextIndex, match_lines


def review_quotations(
    lines: DataFrame, master: DataFrame, market: DataFrame, edits: DataFrame | None = None, row_id: str = "row_id",
    discount: float = V.DEFAULT_DISCOUNT, index: TextIndex | None = None,
) -> DataFrame:
    """Every line with its most similar master item, verdict, proposal, the user's edits and final price.

    `lines` has item_name, spec, unit_price and quantity, and `row_id` if there are edits; `market`
    has one price per item_name, `edits` one row per row_id. Lines that no master item resembles
    stay, without a standard price.
    """
    priced = with_market_price(compare(match_lines(lines, master, index)), market)
    review = review_table(priced, discount)
    return mark_overrides(review if edits is None else apply_overrides(review, edits, row_id))
