"""Sheet cleaning, lock detection and layout detection over distributed sheet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import fixed_values as V
from quotelens.functions.text import any_of, clean_cells, contains_any, is_blank_cell, strip
from quotelens.plans.segments import segmented

SHEET = ["file_id", "sheet_idx"]


def filled_rows(sheet_rows: DataFrame) -> DataFrame:
    """Trimmed cells, no blank rows; rows keep their numbers."""
    # Tested on the raw cells: a filter on cleaned cells would clean every row twice.
    kept = sheet_rows.filter(F.exists("cells", lambda c: ~is_blank_cell(c)))
    return kept.withColumn("cells", clean_cells(F.col("cells")))


def clean_rows(sheet_rows: DataFrame) -> DataFrame:
    """Trimmed cells, no blank rows, rows numbered from 0 per sheet in `row_idx`; every row counts.

    A long sheet is numbered range by range, so no task holds a whole sheet.
    """
    return segmented(filled_rows(sheet_rows), SHEET, renumber=True).select(*sheet_rows.columns)


def locked_files(rows: DataFrame, marker: str = V.LOCK_MARKER) -> DataFrame:
    """Files whose first two rows of the first sheet carry the lock marker."""
    top = rows.filter((F.col("sheet_idx") == 0) & (F.col("row_idx") < 2))
    return top.filter(F.concat_ws(" ", "cells").contains(marker)).select("file_id").distinct()


def locked_in(sheet_rows: DataFrame, marker: str = V.LOCK_MARKER) -> DataFrame:
    """`locked_files` of raw or cleaned rows: files whose first two filled rows of the first sheet carry the marker.

    Rows are only counted before the earliest marked row of a file, so no sheet is numbered or stored.
    """
    first = sheet_rows.filter(F.col("sheet_idx") == 0)
    # Words have no blanks, so trimming cells cannot make one: few rows are cleaned to be looked at whole.
    words = marker.split()
    hopeful = first.filter(F.concat_ws("\n", "cells").contains(words[0])) if words else first
    marked = filled_rows(hopeful).filter(F.concat_ws(" ", "cells").contains(marker))
    earliest = marked.groupBy("file_id").agg(F.min("row_idx").alias("__at"))
    before = filled_rows(first).select("file_id", "row_idx").join(earliest, "file_id").filter("row_idx < __at")
    counts = before.groupBy("file_id").agg(F.count(F.lit(1)).alias("__before"))
    return earliest.join(counts, "file_id", "left").filter("coalesce(__before, 0) < 2").select("file_id")


def without_locked(rows: DataFrame, marker: str = V.LOCK_MARKER) -> DataFrame:
    return rows.join(locked_files(rows, marker), "file_id", "left_anti")


def detect_layout(sheets: DataFrame) -> DataFrame:
    """Layout group per file: assembly, standard or unknown.

    Only flags are aggregated, so a file with very many sheets costs one row per map task.
    Keyword hits across the joint of two neighbouring names need a blank in the keyword;
    no keyword has one, so names can be tested one by one.
    """
    name = F.col("sheet")
    flags = (
        sheets.select("file_id", "sheet_idx", "sheet").distinct()
        .groupBy("file_id")
        .agg(
            F.count_if(strip(name).rlike(V.NUMBERED_SHEET)).alias("numbered"),
            F.max(contains_any(name, V.ROLLUP_SHEET_WORDS)).alias("rollup"),
            F.max(contains_any(name, V.STANDARD_SHEET_WORDS)).alias("keyword"),
            F.max(name.contains(V.COVER_SHEET)).alias("cover"),
        )
    )
    group = (
        F.when((F.col("numbered") >= 2) | F.col("rollup"), F.lit("assembly"))
        .when(F.col("keyword") | F.col("cover"), F.lit("standard"))
        .otherwise(F.lit("unknown"))
    )
    return flags.select("file_id", group.alias("layout_group"))


def skip_sheet_standard(sheet: Column) -> Column:
    return sheet.isin(*V.STANDARD_SKIP_SHEETS) | contains_any(sheet, V.STANDARD_SKIP_SHEET_WORDS)


def skip_sheet_assembly(sheet: Column) -> Column:
    return sheet.isin(*V.ASSEMBLY_SKIP_SHEETS) | contains_any(sheet, V.ASSEMBLY_SKIP_SHEET_WORDS)


def header_hits(cells: Column, words: list[str], joined: Column | None = None) -> Column:
    """How many cells of a row contain a header word; most rows hold none, which the whole row tells first.

    `joined` is the row's cells by line, where that is a column already: each word would join them again.
    """
    row = F.concat_ws("\n", cells) if joined is None else joined
    some = any_of(row.contains(w) for w in words)
    return F.when(some, F.size(F.filter(cells, lambda c: contains_any(c, words)))).otherwise(F.lit(0))
