"""Log of the reviewer's edits: append only, replayed as of any day, compacted."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.sources.sinks import append_table

FIELDS = ("row_id", "edited_on", "revision", "discount", "basis", "withdrawn")


def append_edits(edits: DataFrame, path: str) -> None:
    """Add edits to a stored log, one folder per month of `edited_on`.

    `edits` has FIELDS; `withdrawn` takes the row's earlier edits back.
    """
    month = F.date_format("edited_on", "yyyy-MM")
    append_table(edits.select(*FIELDS, month.alias("edit_month")), path, ["edit_month"])


def _latest() -> Column:
    """The last edit of a row; equal days and revisions are decided by the edit itself."""
    return F.max(F.struct("edited_on", "revision", "discount", "basis", "withdrawn")).alias("last")


def _until(log: DataFrame, day: date) -> DataFrame:
    """Edits up to `day`; months after it are pruned."""
    return log.filter((F.col("edit_month") <= f"{day:%Y-%m}") & (F.col("edited_on") <= F.lit(day)))


def edits_as_of(log: DataFrame, day: date) -> DataFrame:
    """row_id, discount, basis as they stood at the end of `day`; withdrawn rows are left out.

    One aggregate that combines in the map tasks, so a row with any number of edits reaches a
    reducer as a few.
    """
    last = _until(log, day).groupBy("row_id").agg(_latest())
    return last.filter(~F.coalesce("last.withdrawn", F.lit(False))).select("row_id", "last.discount", "last.basis")


def compacted(log: DataFrame, day: date) -> DataFrame:
    """The log without edits that no day from `day` on can see.

    Of the edits up to `day` the last of each row is kept, unless it is a withdrawal; later edits
    all stay. `edits_as_of` gives the same rows for `day` and every later day.
    """
    last = _until(log, day).groupBy("row_id").agg(_latest()).select("row_id", "last.*")
    later = log.filter((F.col("edit_month") >= f"{day:%Y-%m}") & (F.col("edited_on") > F.lit(day)))
    return last.filter(~F.coalesce("withdrawn", F.lit(False))).select(*FIELDS).unionByName(later.select(*FIELDS))
