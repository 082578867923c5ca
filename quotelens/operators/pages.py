"""Items and metadata from page text, page tables and HTML price tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import fixed_values as V
from quotelens.functions.text import any_of, contains_any, one_line, strip, to_double, to_long_strict
from quotelens.plans.segments import segmented

TABLE = ["file_id", "page", "table_idx"]


def page_units(page_text: DataFrame) -> DataFrame:
    """Equipment name per page; pages without one are left out."""
    name = strip(F.regexp_extract("text", V.PAGE_UNIT_NAME, 1))
    return page_text.select("file_id", "page", name.alias("unit_name")).filter(F.col("unit_name") != "")


def page_meta(page_text: DataFrame, addressee: str = r".+?") -> DataFrame:
    """Vendor, date, number and total from the first page of every file."""
    first = page_text.groupBy("file_id").agg(F.min_by("text", "page").alias("text"))

    def group(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))

    vendor = r"見\s*積\s*書\s+" + addressee + r"\s+貴下\s+(.+)"
    return first.select(
        "file_id",
        strip(group(vendor)).alias("vendor"),
        group(V.PAGE_META_DATE).alias("quote_date"),
        strip(group(V.PAGE_META_NUMBER)).alias("quote_no"),
        to_long_strict(group(V.PAGE_META_TOTAL)).alias("total_amount"),
    )


def table_bodies(page_table: DataFrame) -> DataFrame:
    """Rows below the first header row of price tables; a long table is latched range by range."""
    rows = page_table.withColumn("cells", F.transform("cells", one_line))
    text = F.concat_ws(" ", "cells")
    is_header = (F.size("cells") >= 7) & contains_any(text, V.PAGE_HEADER_WORDS)
    latched = segmented(rows, TABLE, {
        "header": F.when(is_header, F.lit(True)),
        "priced": F.when((F.col("row_idx") < 3) & contains_any(text, V.PAGE_TABLE_WORDS), F.lit(True)),
    })
    return latched.filter(
        (F.size("cells") >= 7) & ~is_header & F.col("priced") & (F.col("row_idx") > F.col("header_at"))
    ).select(*rows.columns)


def skip_item(name: Column) -> Column:
    return (
        (F.length(name) < 2)
        | contains_any(name, V.PAGE_SKIP_WORDS)
        | any_of(name.startswith(s) for s in V.PAGE_SKIP_STARTS)
        | name.rlike(r"(?U)^[\d,.\s]+$")
    )


def parse_page_tables(page_table: DataFrame, page_text: DataFrame) -> DataFrame:
    """Items of page tables; nine cells start at column 2, seven or eight at column 1."""
    start = F.when(F.size("cells") >= 9, F.lit(2)).otherwise(F.lit(1))

    def cell(i: int) -> Column:
        return F.coalesce(F.get("cells", start + i), F.lit(""))

    return (
        table_bodies(page_table)
        .withColumns({
            "item_name": cell(0), "spec": cell(1), "unit": cell(2), "quantity": to_double(cell(3)),
            "unit_price": to_long_strict(cell(4)), "amount": to_long_strict(cell(5)), "maker": cell(6),
        })
        .filter(~skip_item(F.col("item_name")) & (F.col("unit_price") > 0) & (F.col("amount") >= V.MIN_AMOUNT))
        .join(page_units(page_text), ["file_id", "page"])
        .select(*TABLE, "row_idx", "unit_name", "item_name", "spec", "unit", "quantity", "unit_price", "amount", "maker")
    )


_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def cell_text(html: Column) -> Column:
    """Text of a table cell: tags and the blanks around them removed."""
    out = F.regexp_replace(html, r"(?s)\s*<[^>]*>\s*", "")
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(out)


def price_cells(cells: Column) -> Column:
    """Whole prices of three to nine digits after the third cell."""
    plain = F.transform(
        F.slice(cells, 4, F.greatest(F.size(cells) - 3, F.lit(0))),
        lambda c: strip(F.regexp_replace(c, "[,원]", "")),
    )
    return F.transform(F.filter(plain, lambda c: c.rlike(V.HTML_PRICE)), lambda c: c.cast("bigint"))


def price_summary(prices: Column) -> Column:
    """Half-even mean, minimum and maximum of a price array."""
    total = F.aggregate(prices, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    n = F.size(prices)
    # Prices have at most nine digits, so the mean and its half are exact in a double.
    return F.struct(
        F.bround(total / n, 0).cast("bigint").alias("price"),
        F.array_min(prices).alias("price_min"),
        F.array_max(prices).alias("price_max"),
    )


def html_prices(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Price rows of every HTML table whose header names item, spec or unit."""
    tables = pages.filter(F.col(html).rlike("(?i)<table")).select(
        key, F.posexplode(_all(F.col(html), r"(?is)<table\b[^>]*>(.*?)</table>")).alias("table_idx", "table")
    )
    rows = tables.select(key, "table_idx", _all(F.col("table"), r"(?is)<tr\b[^>]*>(.*?)</tr>").alias("rows"))
    header = F.concat_ws(" ", F.transform(
        _all(F.get("rows", F.lit(0)), r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), cell_text
    ))
    body = (
        rows.filter((F.size("rows") >= 2) & contains_any(header, V.HTML_HEADER_WORDS))
        .select(key, "table_idx", F.posexplode("rows").alias("row_idx", "row"))
        .filter("row_idx > 0")
    )
    cells = body.withColumn("cells", F.transform(_all(F.col("row"), r"(?is)<td\b[^>]*>(.*?)</td>"), cell_text))
    return (
        cells.filter((F.size("cells") >= 3) & (F.length(F.get("cells", F.lit(0))) >= 2))
        .withColumn("prices", price_cells(F.col("cells")))
        .filter(F.size("prices") > 0)
        .withColumn("s", price_summary(F.col("prices")))
        .select(
            key, "table_idx", "row_idx",
            F.get("cells", F.lit(0)).alias("name"),
            F.get("cells", F.lit(1)).alias("spec"),
            F.get("cells", F.lit(2)).alias("unit"),
            "s.price", "s.price_min", "s.price_max",
        )
    )
