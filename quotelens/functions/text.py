"""Text, number and date expressions used by every operator.

All helpers take and return Columns, so they run inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import fixed_values as V

NUMBER = r"(?U)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
WHOLE_NUMBER = r"(?U)^\s*[+-]?[0-9]+\s*$"


# Every character that counts as white space, as trimmed from both ends of a cell.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    """Trim every Unicode space, not only ASCII blanks."""
    return F.btrim(c, F.lit(SPACES))


BLANK_CELL = r"(?U)^\s*(None|nan)?\s*$"


def is_blank_cell(c: Column) -> Column:
    """True when clean_cells leaves nothing of the cell."""
    return c.isNull() | c.rlike(BLANK_CELL)


def clean_cells(cells: Column) -> Column:
    """Trimmed cells; null, 'None' and 'nan' become empty."""
    trimmed = F.transform(cells, lambda c: strip(F.coalesce(c, F.lit(""))))
    return F.transform(trimmed, lambda c: F.when(c.isin("None", "nan"), F.lit("")).otherwise(c))


def one_line(c: Column) -> Column:
    """Trimmed text with line breaks as blanks; null becomes empty."""
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "\n", " ")


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def is_number(c: Column) -> Column:
    """True for plain decimal text; suffixed, hex and nan/inf text is not a number."""
    return F.coalesce(_plain(c).rlike(NUMBER), F.lit(False))


def to_double(c: Column) -> Column:
    return F.when(_plain(c).rlike(NUMBER), strip(_plain(c)).try_cast("double"))


def to_long(c: Column) -> Column:
    """Number text as a whole number, cut toward zero."""
    return to_double(c).try_cast("bigint")


def to_long_strict(c: Column) -> Column:
    """Whole-number text only; '12.5' gives null."""
    return F.when(_plain(c).rlike(WHOLE_NUMBER), strip(_plain(c)).try_cast("bigint"))


def numbers(cells: Column) -> Column:
    """All numeric cells of a row as doubles, in order."""
    return F.filter(F.transform(cells, to_double), lambda v: v.isNotNull())


def texts(cells: Column) -> Column:
    """All cells that are neither blank, 'None' nor numeric, in order."""
    return F.filter(cells, lambda c: (strip(c) != "") & (c != "None") & ~is_number(c))


def from_end(arr: Column, k: int) -> Column:
    """k-th element counted from the end, null when the array is shorter."""
    return F.get(arr, F.size(arr) - k)


def any_of(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` worked out once however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def inlined(df: DataFrame, columns: list[str], item: Column) -> DataFrame:
    """`columns` and the fields of `item`, rows without one left out.

    A generator, so filters on the fields are not pushed below it, where they would work `item` out again.
    """
    return df.select(*columns, F.inline(F.filter(F.array(item), lambda i: i.isNotNull())))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """One alternation of quoted words: a long list stays a single expression."""
    return c.rlike("|".join(rf"\Q{w}\E" for w in words))


def parse_date(c: Column) -> Column:
    """First year-month-day in the text; impossible dates give null."""
    y, m, d = (F.regexp_extract(c, V.DATE_TEXT, i) for i in (1, 2, 3))
    iso = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(y != "", iso.try_cast("date"))


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a small constant table, null when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def blank_to(c: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), default)


def signed_percent(c: Column, pattern: str) -> Column:
    return F.format_string(pattern, c)


def padded_id(prefix: str, width: int, n: Column) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n)


def search_text(name: Column, spec: Column, item_id: Column | None = None) -> Column:
    """name + spec as one search text; falls back to the item id."""
    t = strip(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(spec, F.lit(""))))
    if item_id is None:
        return t
    return F.when(t != "", t).otherwise(F.coalesce(item_id, F.lit("unknown")))


def half_up_mean(total: str, n: str) -> Column:
    """Exact half-up mean of the non-negative whole-number columns total / n."""
    return F.expr(f"(2 * {total} + {n}) div (2 * {n})")


def half_even_mean(total: str, n: str) -> Column:
    """Exact half-even mean of the non-negative whole-number columns total / n."""
    whole, twice_rest = f"({total} div {n})", f"(2 * ({total} % {n}))"
    return F.expr(
        f"{whole} + CASE WHEN {twice_rest} > {n} OR ({twice_rest} = {n} AND {whole} % 2 = 1)"
        " THEN 1L ELSE 0L END"
    )
