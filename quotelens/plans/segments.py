"""Row numbers and latched values of long sheets: row ranges scanned apart, joined by a carry.

A sheet is cut into ranges of SEGMENT_ROWS rows. One exchange brings every range together, so no
task has to hold more than a range; the range numbers its rows and keeps the first row at which
each latch has a value. The rows are stored with that, and only sheets of several ranges are looked
at again: one row per range, from which running totals and the earliest latch give the carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens.plans.checkpoints import written

SEGMENT_ROWS = 1 << 16
# Number of a row in its range; latch values may refer to it.
AT = "__at"
_SEGMENT, _ROWS, _OFFSET, _OFFER = "__segment", "__rows", "__offset", "__offer_"


def _ranges(rows: DataFrame, keys: list[str], values: dict[str, Column], renumber: bool, order: str, size: int) -> DataFrame:
    """Each row with its range, its number there and the first (at, value) of every latch of the range."""
    group = Window.partitionBy(*keys, _SEGMENT)
    cut = rows.withColumn(_SEGMENT, F.floor(F.col(order) / size))
    number = F.row_number().over(group.orderBy(order)) - 1 if renumber else F.col(order)
    numbered = cut.withColumn(AT, number.cast("bigint"))
    # Offers are columns of their own: inside a lambda they would be interpreted, not compiled.
    offered = numbered.withColumns({f"{_OFFER}{name}": value for name, value in values.items()})
    firsts = {
        name: F.min(F.when(F.col(_OFFER + name).isNotNull(), F.struct(F.col(AT).alias("at"), F.col(_OFFER + name).alias("v")))).over(group)
        for name in values
    }
    return offered.withColumns({**firsts, _ROWS: F.count(F.lit(1)).over(group)}).drop(*[_OFFER + name for name in values])


def _carries(stored: DataFrame, several: DataFrame, keys: list[str], names: list[str], renumber: bool) -> DataFrame:
    """Per range of a long sheet: rows before it, and the earliest latch of the whole sheet."""
    pieces = stored.join(several, keys, "left_semi").groupBy(*keys, _SEGMENT).agg(
        F.max(_ROWS).alias(_ROWS), *[F.min(n).alias(n) for n in names]
    )
    sheet = Window.partitionBy(*keys)
    before = sheet.orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(_ROWS).over(before), F.lit(0)) if renumber else F.lit(0)
    moved = pieces.withColumn(_OFFSET, offset.cast("bigint"))
    earliest = {
        f"__{n}": F.min(F.when(F.col(n).isNotNull(), F.struct(
            (F.col(f"{n}.at") + F.col(_OFFSET)).alias("at"), F.col(f"{n}.v").alias("v")))).over(sheet)
        for n in names
    }
    return moved.withColumns(earliest).select(*keys, _SEGMENT, _OFFSET, *earliest)


def segmented(
    rows: DataFrame, keys: list[str], values: dict[str, Column] | None = None, renumber: bool = False,
    order: str = "row_idx", size: int | None = None, dropped: tuple[str, ...] = (),
) -> DataFrame:
    """`rows` with, for every latch, its first value in the sheet and the number of the row that had it.

    `keys` name a sheet and `order` its rows. With `renumber`, `order` becomes a dense number from 0.
    Latch `x` gives the columns `x` and `x_at`, null where no row of the sheet has a value. Columns in
    `dropped` serve the latches alone and are not stored.
    """
    values = values or {}
    names = list(values)
    kept = [c for c in rows.columns if c != order and c not in dropped]
    stored = written(_ranges(rows, keys, values, renumber, order, size or SEGMENT_ROWS).drop(*dropped), "segments")
    later = stored.filter(F.col(_SEGMENT) > 0).select(*keys)
    if later.isEmpty():
        numbered, latch = stored.withColumn(_OFFSET, F.lit(0).cast("bigint")), {n: F.col(n) for n in names}
    else:
        carries = written(_carries(stored, later.distinct(), keys, names, renumber), "carries")
        numbered = stored.join(carries, [*keys, _SEGMENT], "left").withColumn(
            _OFFSET, F.coalesce(_OFFSET, F.lit(0).cast("bigint")))
        latch = {n: F.coalesce(f"__{n}", n) for n in names}
    columns = [c for n in names for c in (latch[n]["v"].alias(n), latch[n]["at"].alias(f"{n}_at"))]
    number = (F.col(AT) + F.col(_OFFSET)).cast("int") if renumber else F.col(order)
    return numbered.select(*kept, number.alias(order), *columns)
