"""Line items from header-mapped sheets: standard and assembly layouts in one scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import fixed_values as V
from quotelens.functions.text import contains_any, from_end, inlined, is_number, named, numbers, to_double, to_long
from quotelens.operators.layout import SHEET, filled_rows, header_hits, skip_sheet_assembly, skip_sheet_standard
from quotelens.plans.segments import AT, segmented

FIELDS = ["item_name", "spec", "unit", "quantity", "unit_price", "amount", "maker"]
ITEM_COLUMNS = ["file_id", "sheet_idx", "row_idx", "unit_name", *FIELDS, "category"]


def _first_cell(cells: Column, keep: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(cells, keep), F.lit(0))


def _row_value(value: Column) -> Column:
    """Earliest non-null value of a sheet by row number, as an aggregate."""
    return F.min(F.when(value.isNotNull(), F.struct("row_idx", value.alias("v"))))["v"]


def unit_name_standard(cells: Column) -> Column:
    return _first_cell(
        cells, lambda c: (F.length(c) > 2) & ~c.contains(V.UNIT_TITLE_WORD) & (c != V.BOX_MARK)
    )


def unit_name_assembly(cells: Column) -> Column:
    return _first_cell(cells, lambda c: F.length(c) > 2)


def sheet_heads(rows: DataFrame, words: list[str], min_hits: int, title: Column, title_rows: int) -> DataFrame:
    """One row per sheet: unit name, header row number and header cells.

    Only top rows and header rows enter the aggregate, which is combined on the map side.
    """
    is_header = header_hits(F.col("cells"), words) >= min_hits
    header = F.min(F.when(is_header, F.struct("row_idx", "cells")))
    return (
        rows.filter((F.col("row_idx") < title_rows) | is_header)
        .groupBy(*SHEET)
        .agg(
            _row_value(F.when(F.col("row_idx") < title_rows, title)).alias("title"),
            F.max("sheet").alias("sheet"),
            header.alias("header"),
        )
        .filter("header IS NOT NULL")
        .select(
            *SHEET,
            F.coalesce("title", "sheet").alias("unit_name"),
            F.col("header.row_idx").alias("header_idx"),
            F.col("header.cells").alias("header_cells"),
        )
    )


def heads_standard(rows: DataFrame) -> DataFrame:
    return sheet_heads(
        rows.filter(~skip_sheet_standard(F.col("sheet"))),
        V.STANDARD_HEADER_WORDS, 3, unit_name_standard(F.col("cells")), 4,
    )


def heads_assembly(rows: DataFrame) -> DataFrame:
    return sheet_heads(
        rows.filter(~skip_sheet_assembly(F.col("sheet"))),
        V.ASSEMBLY_HEADER_WORDS, 2, unit_name_assembly(F.col("cells")), 1,
    )


# One letter for each field, so that the fields of a header row are a short text.
_CODES = dict(zip(FIELDS, "nsuqpam"))


def _coded(cells: Column, code: Callable[[Column], Column]) -> Column:
    """The letter of every header cell, `-` for a cell that names no field, as one text."""
    plain = F.transform(cells, lambda c: F.replace(c, F.lit(" "), F.lit("")))
    return F.array_join(F.transform(plain, lambda c: F.coalesce(code(c), F.lit("-"))), "")


def _letter(field: str) -> Column:
    return F.lit(_CODES[field])


def _field_standard(c: Column) -> Column:
    return (
        F.when(c.contains("품명"), _letter("item_name"))
        .when(c.contains("규격"), _letter("spec"))
        .when(c.contains("단위") & ~c.contains("단가"), _letter("unit"))
        .when(c.contains("수량"), _letter("quantity"))
        .when(c.contains("단가"), _letter("unit_price"))
        .when(c.contains("금액"), _letter("amount"))
        .when(contains_any(c, V.MAKER_HEADER_WORDS), _letter("maker"))
    )


def _field_assembly(c: Column) -> Column:
    return (
        F.when(contains_any(c, ["품명", "장치", "내용"]), _letter("item_name"))
        .when(c.contains("규격"), _letter("spec"))
        .when(c.contains("단위") & ~c.contains("단가"), _letter("unit"))
        .when(c.contains("수량"), _letter("quantity"))
        .when(c.contains("단가"), _letter("unit_price"))
        .when(c.contains("금액") | c.contains("견적"), _letter("amount"))
    )


def _first_at(letters: Column, letter: str) -> Column:
    """0-based position of the first such letter, null when absent."""
    return F.nullif(F.instr(letters, letter), F.lit(0)) - 1


def _last_at(letters: Column, letter: str) -> Column:
    return F.length(letters) - F.nullif(F.instr(F.reverse(letters), letter), F.lit(0))


def fields_standard(cells: Column) -> Column:
    return _coded(cells, _field_standard)


def fields_assembly(cells: Column) -> Column:
    """Fields of a header row; a cell that could stand in for a name cell is `N` in `usable`, else `-`."""
    usable = F.transform(cells, lambda c: F.when(
        (c != "") & ~contains_any(c, V.ASSEMBLY_NAME_FALLBACK_STOP), F.lit("N")).otherwise(F.lit("-")))
    return F.struct(_coded(cells, _field_assembly).alias("fields"), F.array_join(usable, "").alias("usable"))


def _positions_standard(found: Column) -> Column:
    return F.struct(*[_last_at(found, _CODES[f]).alias(f) for f in FIELDS])


def _positions_assembly(found: Column, usable: Column) -> Column:
    first = {"item_name", "amount"}
    at = {f: (_first_at if f in first else _last_at)(found, _CODES[f]) for f in FIELDS if f != "maker"}
    left = F.substring(usable, F.lit(1), F.coalesce(at["unit_price"], F.lit(0)))
    at |= {"item_name": F.coalesce(at["item_name"], _last_at(left, "N")), "maker": F.lit(None).cast("int")}
    return F.struct(*[at[f].alias(f) for f in FIELDS])


def positions_standard(cells: Column) -> Column:
    """Column position of every field in a header row; the last matching header cell wins."""
    return named(fields_standard(cells), _positions_standard)


def positions_assembly(cells: Column) -> Column:
    """As the standard map, but name and amount take the first cell and there is no maker.

    Without a name column the nearest usable cell left of the unit price stands in.
    """
    return named(fields_assembly(cells), lambda f: _positions_assembly(f["fields"], f["usable"]))


def _mapped(heads: DataFrame, positions: Callable[[Column], Column]) -> DataFrame:
    found = heads.withColumn("pos", positions(F.col("header_cells")))
    return found.select(*heads.columns, *[F.col(f"pos.{f}").alias(f"pos_{f}") for f in FIELDS])


def map_columns_standard(heads: DataFrame) -> DataFrame:
    return _mapped(heads, positions_standard)


def map_columns_assembly(heads: DataFrame) -> DataFrame:
    return _mapped(heads, positions_assembly)


LAYOUTS = ("standard", "assembly")


def _by_layout(standard: Column, assembly: Column) -> Column:
    """What the layout of a row's file asks for; null for any other layout."""
    return F.when(F.col("layout_group") == "standard", standard).when(F.col("layout_group") == "assembly", assembly)


def _with_heading(filled: DataFrame) -> DataFrame:
    """`filled` with `__heading`: true for a header row of its layout, else null."""
    joined = filled.withColumn("__text", F.concat_ws("\n", "cells"))
    cells, sheet, text = F.col("cells"), F.col("sheet"), F.col("__text")
    heading = _by_layout(
        ~skip_sheet_standard(sheet) & (header_hits(cells, V.STANDARD_HEADER_WORDS, text) >= 3),
        ~skip_sheet_assembly(sheet) & (header_hits(cells, V.ASSEMBLY_HEADER_WORDS, text) >= 2),
    )
    return joined.withColumn("__heading", F.when(heading, F.lit(True))).drop("__text")


def header_rows(sheet_rows: DataFrame) -> DataFrame:
    """file_id, sheet_idx, header_idx of every sheet with a header row; rows move without their cells."""
    offers = _with_heading(filled_rows(item_sheets(sheet_rows))).select(*SHEET, "row_idx", F.col("__heading").alias("heading"))
    latched = segmented(offers, SHEET, {"head": F.col("heading")}, renumber=True)
    return latched.filter("row_idx = head_at").select(*SHEET, F.col("head_at").cast("int").alias("header_idx"))


def latched_rows(sheet_rows: DataFrame, renumber: bool = True) -> DataFrame:
    """Filled rows of raw sheets with the unit name, header row number and column positions of their sheet.

    `sheet_rows` carries layout_group. Each row offers what its own layout would take from it, and
    the first offer of the sheet is latched, so both layouts share one scan and one exchange.
    Rows of sheets that a layout skips offer nothing. Positions are null without a header row.
    """
    cells, sheet = F.col("cells"), F.col("sheet")
    # Each step is a column: the next one reads it, compiled, instead of working it out again.
    headed = _with_heading(filled_rows(sheet_rows))
    headed = headed.withColumns({
        "__std": F.when(F.col("__heading") & (F.col("layout_group") == "standard"), fields_standard(cells)),
        "__asm": F.when(F.col("__heading") & (F.col("layout_group") == "assembly"), fields_assembly(cells)),
    })
    positions = F.when(F.col("__std").isNotNull(), _positions_standard(F.col("__std"))).when(
        F.col("__asm").isNotNull(), _positions_assembly(F.col("__asm.fields"), F.col("__asm.usable")))
    headed = headed.withColumn("__pos", positions)
    title = _by_layout(unit_name_standard(cells), unit_name_assembly(cells))
    top = _by_layout(F.lit(4), F.lit(1))
    latched = segmented(
        headed.drop("__heading", "__std", "__asm"), SHEET, {"pos": F.col("__pos"), "title": F.when(F.col(AT) < top, title)},
        renumber, dropped=("__pos",),
    )
    unit_name = F.coalesce(F.when(F.col("title_at") < top, F.col("title")), sheet)
    return latched.withColumn("unit_name", unit_name).withColumnRenamed("pos_at", "header_idx").drop("title", "title_at")


def _cell(name: str) -> Column:
    return F.coalesce(F.get("cells", F.col(f"pos.{name}")), F.lit(""))


def _usable_name(name: Column, skip_words: list[str]) -> Column:
    return (F.length(name) >= 2) & ~contains_any(name, skip_words) & ~is_number(name)


def _or_fallback(value: Column, fallback: Column) -> Column:
    """A missing or zero value is replaced."""
    return F.when(value.isNull() | (value == 0), fallback).otherwise(value)


def items_of(latched: DataFrame) -> DataFrame:
    """Items of latched rows, each by the rules of its layout and tagged with it.

    Standard: position 0 counts as unmapped for price and amount, and missing or zero numbers are
    taken from the row's last numbers. Assembly: a missing price takes all three from the row.
    """
    c = F.col
    mapped = _by_layout(
        (F.coalesce("pos.unit_price", F.lit(0)) > 0) | (F.coalesce("pos.amount", F.lit(0)) > 0), F.lit(True)
    )
    raw = F.struct(
        _cell("item_name").alias("item_name"), _cell("spec").alias("spec"), _cell("unit").alias("unit"),
        to_double(_cell("quantity")).alias("quantity"), to_long(_cell("unit_price")).alias("unit_price"),
        to_long(_cell("amount")).alias("amount"), _by_layout(_cell("maker"), F.lit("")).alias("maker"),
    )
    r, nums = c("__raw"), c("__nums")
    usable = _by_layout(
        _usable_name(r["item_name"], V.STANDARD_SKIP_ROW_WORDS) & ~r["item_name"].startswith("0")
        & (r["unit_price"].isNotNull() | r["amount"].isNotNull()),
        _usable_name(r["item_name"], V.ASSEMBLY_SKIP_ROW_WORDS),
    )
    missing = _by_layout(r["unit_price"].isNull() | r["amount"].isNull(), F.coalesce(r["unit_price"], F.lit(0)) <= 0)
    values = {
        "amount": from_end(nums, 1).try_cast("bigint"),
        "unit_price": from_end(nums, 2).try_cast("bigint"),
        "quantity": from_end(nums, 3),
    }
    # The numbers of a row are only looked at where its own cells leave a gap; fewer than two fill none.
    found = {n: F.when(F.size(nums) >= 2, _by_layout(_or_fallback(r[n], v), v)).otherwise(r[n]) for n, v in values.items()}
    completed = F.struct(*[found.get(f, r[f]).alias(f) for f in FIELDS])
    item = F.when(c("__usable"), F.when(nums.isNotNull(), completed).otherwise(r))

    # Step by step, each a column that the next reads: nested in lambdas all of it would be interpreted.
    below = latched.filter((c("row_idx") > c("header_idx")) & mapped).withColumn("__raw", raw)
    below = below.withColumn("__usable", F.coalesce(usable, F.lit(False)))
    below = below.withColumn("__nums", F.when(c("__usable") & missing, numbers(c("cells")))).withColumn("__item", item)
    priced = F.when(c("__item.unit_price") > 0, c("__item"))
    items = inlined(below, [*ITEM_COLUMNS[:4], "layout_group"], priced)
    return items.withColumn("category", F.lit(V.DEFAULT_CATEGORY)).select(*ITEM_COLUMNS, "layout_group")


def item_sheets(sheet_rows: DataFrame) -> DataFrame:
    """Rows of the sheets in which the layout of their file looks for items; no other sheet can hold one."""
    sheet = F.col("sheet")
    return sheet_rows.filter(_by_layout(~skip_sheet_standard(sheet), ~skip_sheet_assembly(sheet)))


def parse_items(sheet_rows: DataFrame) -> DataFrame:
    """Tagged items of raw sheet rows that carry layout_group; rows of other layouts give none."""
    return items_of(latched_rows(item_sheets(sheet_rows)))


def _parse_as(layout: str, rows: DataFrame) -> DataFrame:
    return parse_items(rows.withColumn("layout_group", F.lit(layout))).drop("layout_group")


def parse_standard(rows: DataFrame) -> DataFrame:
    return _parse_as("standard", rows)


def parse_assembly(rows: DataFrame) -> DataFrame:
    return _parse_as("assembly", rows)
