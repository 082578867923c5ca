"""Parsing jobs over sheet rows, page tables and HTML derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.functions.text import contains_any, parse_date
from quotelens import fixed_values as V
from quotelens.operators import headers as H
from quotelens.operators import items as I
from quotelens.operators import layout as L
from quotelens.operators import legacy as G
from quotelens.operators import pages as P
from workload import tables as T
from workload.registry import query
from workload.tables import CTE, NEEDS, sql


def _rows(spark, sf):
    """Numbered rows; the name of the file, which no query of them uses, is not stored with each."""
    return L.clean_rows(T.sheet_rows(spark, sf).drop("file_name"))


def _filled(spark, sf):
    """Rows for operators that number them with their own exchange."""
    return L.filled_rows(T.sheet_rows(spark, sf))


def _routed(spark, sf):
    """Raw rows of every workbook with its detected layout."""
    raw = T.sheet_rows(spark, sf)
    return raw.join(L.detect_layout(raw).hint("shuffle_hash"), "file_id")


def _only(layout, routed):
    return routed.filter(F.col("layout_group") == layout)


def _items(spark, sf, layout):
    return I.parse_items(_only(layout, _routed(spark, sf))).drop("layout_group")


@query("src_rows_clean", r"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS row_idx,
  array_to_string(cells, '|') AS cells FROM (
  SELECT doc_id, i, list_transform(string_split(line, ','), lambda c: CASE WHEN s(c) IN ('None', 'nan') THEN '' ELSE s(c) END) AS cells
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
WHERE len(list_filter(cells, lambda c: c <> '')) > 0""".replace(
    "s(c)", r"regexp_replace(c, '^[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]+$', '', 'g')"))
def src_rows_clean(spark, sf):
    """Documents as sheets: a line is a row, commas part the cells; whole texts, no row limit."""
    docs = T.load(spark, sf, "documents")
    rows = docs.select(
        F.col("doc_id").alias("file_id"), F.lit(0).alias("sheet_idx"),
        F.posexplode(F.split("text", "\n")).alias("row_idx", "line"),
    ).withColumn("cells", F.split("line", ","))
    cleaned = L.clean_rows(rows.drop("line"))
    return cleaned.select(F.col("file_id").alias("doc_id"), "row_idx", F.concat_ws("|", "cells").alias("cells"))


@query("src_locked_filter", sql("SELECT file_id FROM files WHERE NOT locked", "files"))
def src_locked_filter(spark, sf):
    return L.without_locked(_rows(spark, sf)).select("file_id").distinct()


@query("prs_detect_layout", sql("""
SELECT file_id, CASE WHEN kind < 2 THEN 'standard' WHEN kind = 2 THEN 'assembly' ELSE 'unknown' END AS layout_group FROM files""", "files"))
def prs_detect_layout(spark, sf):
    return L.detect_layout(T.sheet_rows(spark, sf))


@query("prs_skip_sheet_std", sql("""
SELECT file_id, 'ASSY-1' AS sheet FROM files WHERE kind < 2 UNION ALL
SELECT file_id, unnest(['10', '20']) FROM files WHERE kind = 2 UNION ALL SELECT file_id, 'Notes' FROM files WHERE kind = 3""", "files"))
def prs_skip_sheet_std(spark, sf):
    return T.sheet_rows(spark, sf).filter(~L.skip_sheet_standard(F.col("sheet"))).select("file_id", "sheet").distinct()


@query("prs_skip_sheet_asm", sql("""
SELECT file_id, unnest(['갑지', 'ASSY-1']) AS sheet FROM files WHERE kind < 2 UNION ALL
SELECT file_id, unnest(['10', '20']) FROM files WHERE kind = 2 UNION ALL SELECT file_id, 'Notes' FROM files WHERE kind = 3""", "files"))
def prs_skip_sheet_asm(spark, sf):
    return T.sheet_rows(spark, sf).filter(~L.skip_sheet_assembly(F.col("sheet"))).select("file_id", "sheet").distinct()


@query("prs_unit_name_std", sql("SELECT file_id, 'UNIT ' || project AS unit_name FROM files WHERE kind < 2", "files"))
def prs_unit_name_std(spark, sf):
    return I.heads_standard(L.clean_rows(I.item_sheets(_only("standard", _routed(spark, sf))))).select("file_id", "unit_name")


@query("prs_unit_name_asm", sql("SELECT file_id, unnest(['공정 10', '공정 20']) AS unit_name FROM files WHERE kind = 2", "files"))
def prs_unit_name_asm(spark, sf):
    return I.heads_assembly(L.clean_rows(I.item_sheets(_only("assembly", _routed(spark, sf))))).select("file_id", "unit_name")


@query("prs_header_row", sql("""
SELECT file_id, 1 AS sheet_idx, 1 AS header_idx FROM files WHERE kind < 2 UNION ALL
SELECT file_id, unnest([1, 2]), 1 FROM files WHERE kind = 2""", "files"))
def prs_header_row(spark, sf):
    """Header row of every sheet that has one, whatever the layout, from one scan."""
    return I.header_rows(_routed(spark, sf))


@query("prs_map_columns_std", sql("""
SELECT file_id, 1 AS pos_item_name, 2 AS pos_spec, 3 AS pos_unit, 4 AS pos_quantity, 5 AS pos_unit_price, 6 AS pos_amount, 7 AS pos_maker
FROM files WHERE kind < 2""", "files"))
def prs_map_columns_std(spark, sf):
    mapped = I.map_columns_standard(I.heads_standard(L.clean_rows(I.item_sheets(_only("standard", _routed(spark, sf))))))
    return mapped.select("file_id", *[f"pos_{f}" for f in I.FIELDS])


@query("prs_map_columns_asm", sql("""
SELECT file_id, unnest([1, 2]) AS sheet_idx, 1 AS pos_item_name, 2 AS pos_spec, 3 AS pos_unit, 4 AS pos_quantity, 5 AS pos_unit_price,
  6 AS pos_amount FROM files WHERE kind = 2""", "files"))
def prs_map_columns_asm(spark, sf):
    mapped = I.map_columns_assembly(I.heads_assembly(L.clean_rows(I.item_sheets(_only("assembly", _routed(spark, sf))))))
    return mapped.select("file_id", "sheet_idx", *[f"pos_{f}" for f in I.FIELDS if f != "maker"])


@query("prs_row_std", sql("SELECT * FROM std_items", "std_items"))
def prs_row_std(spark, sf):
    return _items(spark, sf, "standard")


@query("prs_row_asm", sql("SELECT * FROM asm_items", "asm_items"))
def prs_row_asm(spark, sf):
    return _items(spark, sf, "assembly")


@query("prs_header_std", sql("""
SELECT file_id, 'V' || customer AS vendor, 'Q-' || header_id AS quote_no, quote_date, project, total AS total_amount
FROM files WHERE kind < 2""", "files"))
def prs_header_std(spark, sf):
    return H.header_fields(L.clean_rows(_only("standard", _routed(spark, sf)))).drop("layout_group")


@query("prs_header_asm", sql("""
SELECT file_id, 'V' || lpad(CAST(customer AS VARCHAR), 6, '0') AS vendor, 'Q-' || header_id AS quote_no, quote_date,
  project, CAST(NULL AS BIGINT) AS total_amount FROM files WHERE kind = 2""", "files"))
def prs_header_asm(spark, sf):
    return H.header_fields(L.clean_rows(_only("assembly", _routed(spark, sf)))).drop("layout_group")


@query("win_first_hit", sql("""
SELECT file_id, quote_date, 'Q-' || header_id AS quote_no FROM files WHERE kind <= 2""", "files"))
def win_first_hit(spark, sf):
    """First date and first order number of every workbook, over all its rows."""
    rows = _rows(spark, sf)
    cells = F.col("cells")
    date = F.get(F.filter(F.transform(cells, parse_date), lambda d: d.isNotNull()), F.lit(0))
    number = F.get(F.filter(cells, lambda c: c.rlike(r"^Q-\d+$")), F.lit(0))
    # A workbook's own sheets are ordered before its rows.
    ordered = rows.withColumn("row_idx", F.struct("sheet_idx", "row_idx"))
    found = ordered.select("file_id", "row_idx", date.alias("d"), number.alias("q")).groupBy("file_id").agg(
        H.first_hit(F.col("d")).alias("quote_date"), H.first_hit(F.col("q")).alias("quote_no")
    )
    return found.filter("quote_date IS NOT NULL")


# Numbers and texts of a rendered standard row, from the typed columns.
CTE["std_cells"] = """
SELECT CAST(header_id AS VARCHAR) AS file_id, header_id, customer, rn, unit_name, category, CASE WHEN rn % 7 = 0 THEN '' ELSE item_name END AS item_name,
  list_filter([CAST(rn AS DOUBLE), CASE WHEN rn % 7 = 0 THEN 1234 END, quantity, CASE WHEN rn % 6 <> 0 THEN CAST(unit_price AS DOUBLE) END, CAST(amount AS DOUBLE)], lambda x: x IS NOT NULL) AS nums,
  list_filter([CASE WHEN rn % 7 = 0 THEN '' ELSE item_name END, coalesce(spec, ''), trim(unit), maker], lambda x: x <> '') AS words
FROM numbered WHERE header_id % 4 < 2"""
CTE["asm_cells"] = """
SELECT CAST(header_id AS VARCHAR) AS file_id, header_id, customer, rn, CASE WHEN rn % 2 = 1 THEN '10' ELSE '20' END AS unit_name, category,
  CAST(row_number() OVER (PARTITION BY header_id, rn % 2 ORDER BY rn) + 1 AS INTEGER) AS row_idx,
  CASE WHEN rn % 2 = 1 THEN 1 ELSE 2 END AS sheet_idx,
  list_filter([quantity, CASE WHEN rn % 5 <> 0 THEN CAST(unit_price AS DOUBLE) END, CAST(amount AS DOUBLE)], lambda x: x IS NOT NULL) AS nums,
  list_filter(['A-' || rn, item_name, coalesce(spec, ''), trim(unit)], lambda x: x <> '') AS words
FROM numbered WHERE header_id % 4 = 2"""
NEEDS["std_cells"] = NEEDS["asm_cells"] = ["numbered"]


def _positional(source: str, sheet: str, row: str, min_amount: int) -> str:
    return f"""
SELECT file_id, {sheet} AS sheet_idx, {row} AS row_idx, unit_name, words[1] AS item_name, coalesce(words[2], '') AS spec,
  coalesce(words[3], '') AS unit, nums[-3] AS quantity, CAST(trunc(nums[-2]) AS BIGINT) AS unit_price,
  CAST(trunc(nums[-1]) AS BIGINT) AS amount, CASE WHEN len(words) > 3 THEN words[-1] ELSE '' END AS maker, category
FROM {source} WHERE len(nums) >= 2 AND len(words) >= 1 AND nums[-2] > 0 AND nums[-1] >= {min_amount} AND length(words[1]) >= 2
  AND words[1] NOT LIKE '0%'"""


# Every rendered row that is no line: covers, titles, headings, subtotals and notes.
CTE["other_cells"] = """
SELECT file_id, 0 AS sheet_idx, 1 AS row_idx, [12.0::DOUBLE] AS nums, ['견적번호', 'Q-' || header_id] AS words FROM files WHERE kind < 2
UNION ALL SELECT file_id, 0, 0, [], [CASE WHEN locked THEN 'IRM protected' ELSE '見積' END] FROM files WHERE kind < 2
UNION ALL SELECT file_id, 0, 2, [], ['제출일', quote_date || ' 00:00:00'] FROM files WHERE kind < 2
UNION ALL SELECT file_id, 0, 3, [], ['공사명 : ' || project] FROM files WHERE kind < 2
UNION ALL SELECT file_id, 0, 4, [total::DOUBLE], ['견적금액'] FROM files WHERE kind < 2
UNION ALL SELECT file_id, 1, 0, [], ['단위공사명', 'UNIT ' || project] FROM files WHERE kind < 2
UNION ALL SELECT file_id, 1, 1, [], ['No', '품 명', '규격', '단위', '수량', '단 가', '금액', '메이커'] FROM files WHERE kind < 2
UNION ALL SELECT file_id, 1, coalesce(n, 0) + 2, [1.0, 5000.0], ['소 계']
FROM files LEFT JOIN (SELECT CAST(header_id AS VARCHAR) AS file_id, count(*) AS n FROM numbered GROUP BY 1) USING (file_id) WHERE kind < 2
UNION ALL SELECT file_id, 0, 0, [], ['견적번호', 'Q-' || header_id] FROM files WHERE kind = 2
UNION ALL SELECT file_id, 0, 1, [], ['견적일', quote_date || ' 00:00:00'] FROM files WHERE kind = 2
UNION ALL SELECT file_id, 0, 2, [], ['상호', 'V' || lpad(CAST(customer AS VARCHAR), 6, '0')] FROM files WHERE kind = 2
UNION ALL SELECT file_id, 0, 3, [], ['공사명', project] FROM files WHERE kind = 2
UNION ALL SELECT file_id, unnest([1, 2]), 0, [], [unnest(['공정 10', '공정 20'])] FROM files WHERE kind = 2
UNION ALL SELECT file_id, unnest([1, 2]), 1, [], ['위치', '품 명', '규격', '단위', '수량', '단가(원)', '금액(원)'] FROM files WHERE kind = 2
UNION ALL SELECT file_id, 0, 0, [], ['memo', project] FROM files WHERE kind = 3"""
NEEDS["other_cells"] = ["files", "numbered"]
CTE["all_cells"] = """
SELECT file_id, sheet_idx, row_idx, nums, words FROM other_cells
UNION ALL SELECT file_id, 1, rn + 1, nums, words FROM std_cells UNION ALL SELECT file_id, sheet_idx, row_idx, nums, words FROM asm_cells"""
NEEDS["all_cells"] = ["other_cells", "std_cells", "asm_cells"]


@query("prs_v1_split", sql("""
SELECT file_id, CAST(sheet_idx AS INTEGER) AS sheet_idx, CAST(row_idx AS INTEGER) AS row_idx, len(nums) AS n_nums,
  coalesce(list_sum(nums), 0) AS num_sum, array_to_string(words, '|') AS words FROM all_cells""", "all_cells"))
def prs_v1_split(spark, sf):
    """Numbers and texts of every row of every sheet."""
    split = G.split_cells(L.clean_rows(T.sheet_rows(spark, sf).drop("file_name", "sheet")))
    total = F.aggregate("nums", F.lit(0.0), lambda a, v: a + v)
    return split.select(
        "file_id", "sheet_idx", "row_idx", F.size("nums").cast("bigint").alias("n_nums"), total.alias("num_sum"),
        F.concat_ws("|", "words").alias("words"),
    )


_V1_ROWS = " UNION ALL ".join(
    _positional(source, sheet, row, 1000).replace("unit_name", name + " AS unit_name", 1)
    for source, sheet, row, name in (("std_cells", "1", "rn + 1", "'ASSY-1'"), ("asm_cells", "sheet_idx", "row_idx", "unit_name"))
)


@query("prs_v1_row", sql(_V1_ROWS, "std_cells", "asm_cells"))
def prs_v1_row(spark, sf):
    """Every row of every sheet read by position, the sheet's name as its unit."""
    rows = _rows(spark, sf).withColumn("unit_name", F.col("sheet"))
    return G.positional_items(rows, V.MIN_AMOUNT, V.LEGACY_SKIP_WORDS)


@query("prs_v1_standard", sql(_positional("std_cells", "1", "rn + 1", 1000), "std_cells"))
def prs_v1_standard(spark, sf):
    return G.parse_standard_positional(_filled(spark, sf), renumber=True)


@query("prs_v1_assembly", sql(_V1_ROWS, "std_cells", "asm_cells"))
def prs_v1_assembly(spark, sf):
    """All workbooks read as assemblies: every sheet is a unit."""
    return G.parse_assembly_positional(_filled(spark, sf), renumber=True)


@query("prs_v1_install", sql(_positional("std_cells", "1", "rn + 1", 100), "std_cells"))
def prs_v1_install(spark, sf):
    rows = _filled(spark, sf).withColumn(
        "sheet", F.when(F.col("sheet") == "ASSY-1", F.lit("1. 공사(라인)")).otherwise(F.col("sheet"))
    )
    return G.parse_installation(rows, renumber=True)


def _fixed_rows(spark, sf):
    """Lines in the fixed-column layout: marker row, heading row, then one row per line."""
    lines = T.numbered_lines(spark, sf)
    orders = T.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("header_id"), F.concat(F.lit("UNIT "), F.col("o_orderpriority")).alias("unit_name")
    )

    def rows(df, idx, cells):
        return df.select(
            F.col("header_id").cast("string").alias("file_id"), F.lit(0).alias("sheet_idx"), F.lit("S1").alias("sheet"),
            idx.cast("int").alias("row_idx"), F.array(*cells).alias("cells"),
        )

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bullet = F.when(F.col("rn") % 2 == 0, F.lit("■● ")).otherwise(F.lit(""))
    return (
        rows(orders, F.lit(0), [F.lit(""), F.lit("□ 단위공사명"), F.col("unit_name")])
        .unionByName(rows(orders, F.lit(1), [F.lit("No"), F.lit("구분")]))
        .unionByName(rows(lines, F.col("rn") + 1, [
            F.lit(""), text("rn"),
            F.when(F.col("rn") % 7 == 0, F.lit("1,234.5")).otherwise(F.concat(bullet, F.col("item_name"))),
            text("spec"), F.col("unit"), text("quantity"), F.format_number("unit_price", 0),
            F.when(F.col("rn") % 5 == 0, F.lit("-")).otherwise(text("amount")), F.col("maker"),
        ]))
    )


@query("prs_v1_fixed", sql("""
SELECT CAST(header_id AS VARCHAR) AS file_id, 0 AS sheet_idx, rn + 1 AS row_idx, unit_name, item_name, coalesce(spec, '') AS spec,
  trim(unit) AS unit, quantity, unit_price, amount, maker, category
FROM numbered WHERE rn % 7 <> 0 AND rn % 5 <> 0 AND unit_price > 0 AND amount >= 1000""", "numbered"))
def prs_v1_fixed(spark, sf):
    return G.parse_fixed(_fixed_rows(spark, sf))


def _file_meta(spark, sf):
    """Metadata per file name; unknown layouts have none. Files share a name with their customer's."""
    orders = T.load(spark, sf, "orders")
    kind = F.col("o_orderkey") % 4
    return orders.filter(kind < 3).select(
        F.concat(F.lit("견적서(V"), F.col("o_custkey").cast("string"), F.lit(").xlsx-"), F.col("o_orderkey").cast("string")).alias("file_name"),
        F.concat(F.lit("vendor "), F.col("o_custkey").cast("string")).alias("vendor"),
        F.col("o_orderpriority").alias("project"),
        F.concat(F.lit("Q-"), F.col("o_orderkey").cast("string")).alias("quote_no"),
        F.col("o_orderdate").cast("date").alias("quote_date"), F.lit("2024-06-01").cast("date").alias("entry_date"),
        F.when(kind < 2, F.lit("standard")).otherwise(F.lit("assembly")).alias("layout"),
    )


def _named(rows):
    """Distinct file names, one per order."""
    return rows.withColumn("file_name", F.concat_ws("-", "file_name", "file_id"))


_META_COLUMNS = "vendor, project, quote_no, quote_date, entry_date"
CTE["file_meta"] = """
SELECT '견적서(V' || customer || ').xlsx-' || header_id AS file_name, file_id, 'vendor ' || customer AS vendor, project, 'Q-' || header_id AS quote_no,
  quote_date, DATE '2024-06-01' AS entry_date FROM files WHERE kind < 3"""
NEEDS["file_meta"] = ["files"]


@query("src_file_meta", sql("SELECT file_id, file_name, " + _META_COLUMNS + " FROM file_meta", "file_meta"))
def src_file_meta(spark, sf):
    files = _named(T.sheet_rows(spark, sf)).select("file_id", "file_name").distinct()
    return G.with_file_meta(files, _file_meta(spark, sf))


@query("src_file_meta_dropped", sql("""
SELECT '견적서(V' || customer || ').xlsx-' || header_id AS file_name FROM files WHERE kind = 3""", "files"))
def src_file_meta_dropped(spark, sf):
    return G.files_without_meta(_named(T.sheet_rows(spark, sf)), _file_meta(spark, sf))


_BOTH = (f"({_positional('std_cells', '1', 'rn + 1', 1000)}) UNION ALL ({_positional('asm_cells', 'sheet_idx', 'row_idx', 1000)})")


@query("prs_v1_dispatch", sql(f"""
SELECT i.*, f.file_name, f.vendor, f.project, f.quote_no, f.quote_date, f.entry_date
FROM ({_BOTH}) i JOIN file_meta f USING (file_id)""", "std_cells", "asm_cells", "file_meta"))
def prs_v1_dispatch(spark, sf):
    return G.parse_by_layout(_named(_filled(spark, sf)), _file_meta(spark, sf), renumber=True)


@query("set_union_items", sql("SELECT * FROM std_items UNION ALL SELECT * FROM asm_items", "std_items", "asm_items"))
def set_union_items(spark, sf):
    return I.parse_items(_routed(spark, sf)).drop("layout_group")


_UPLOAD = _positional("std_cells", "1", "CASE WHEN rn IS NULL THEN 0 ELSE rn + 2 END", 1000).replace("length(words[1]) >= 2", "words[1] <> ''")


@query("prs_upload", sql(f"""
SELECT file_id, item_name, spec, unit_price, arg_min(struct_pack(a := amount, u := unit, q := quantity, m := maker), row_idx).a AS amount,
  arg_min(struct_pack(a := amount, u := unit, q := quantity, m := maker), row_idx).u AS unit, min(row_idx) AS row_idx
FROM ({_UPLOAD}) GROUP BY 1, 2, 3, 4
UNION ALL SELECT file_id, '소 계', '', 1, 5000, '', 500 FROM files WHERE kind < 2""", "std_cells", "files"))
def prs_upload(spark, sf):
    return G.parse_upload(T.sheet_rows(spark, sf)).select("file_id", "item_name", "spec", "unit_price", "amount", "unit", "row_idx")


@query("ded_items", sql("""
SELECT item_name, spec, unit_price, seq FROM (SELECT *, row_number() OVER (PARTITION BY item_name, spec, unit_price ORDER BY seq) AS n
  FROM (SELECT item_name, coalesce(spec, '') AS spec, unit_price, seq FROM lines)) WHERE n = 1""", "lines"))
def ded_items(spark, sf):
    from quotelens.plans.ranking import first_per_key

    lines = T.raw_lines(spark, sf).select("item_name", F.coalesce("spec", F.lit("")).alias("spec"), "unit_price", "seq")
    return first_per_key(lines, ["item_name", "spec", "unit_price"], ["seq"])


# Page text and page tables: an order is a document, its lines one table on page 2.
def _page_text(spark, sf):
    orders = T.load(spark, sf, "orders")
    c = F.col
    file_id = c("o_orderkey").cast("string").alias("file_id")
    number = F.concat(F.lit("Q-"), c("o_orderkey").cast("string"))
    first = F.concat(
        F.lit("見 積 書 한국 기계 貴下 공급사 "), c("o_custkey").cast("string"), F.lit("\n견적번호 "), number,
        F.lit("\n견적일자 "), c("o_orderdate").cast("date").cast("string"),
        F.lit("\n(\\"), F.format_number(F.floor("o_totalprice"), 0), F.lit(" )"),
    )
    label = F.when(c("o_orderkey") % 3 == 0, F.lit("□ 전기부문 ： ")).otherwise(F.lit("□ 단위공사명(전기제외): "))
    second = F.when(
        c("o_orderkey") % 5 == 0, F.lit("종합표")
    ).otherwise(F.concat(label, F.lit("UNIT "), c("o_orderpriority"), F.lit(" (첨부)\n합계")))
    return orders.select(file_id, F.lit(1).alias("page"), first.alias("text")).unionByName(
        orders.select(file_id, F.lit(2).alias("page"), second.alias("text"))
    )


def _page_table(spark, sf):
    c = F.col
    orders = T.load(spark, sf, "orders").select(c("o_orderkey").cast("string").alias("file_id"))

    def row(idx, cells):
        return F.struct(idx.cast("int").alias("row_idx"), cells.alias("cells"))

    def text(x):
        return F.coalesce(x.cast("string"), F.lit(""))

    name = F.when(c("rn") % 7 == 0, F.lit("■ 소제목")).otherwise(F.concat(F.lit(" "), c("item_name")))
    body = [name, text(c("spec")), c("unit"), text(c("quantity")),
            F.when(c("rn") % 5 == 0, F.concat(text(c("unit_price")), F.lit(".5"))).otherwise(F.format_number("unit_price", 0)),
            text(c("amount"))]
    nine = F.array(F.lit("a"), F.lit("b"), *body, c("maker"))
    seven = F.array(text(c("rn")), *body)
    head = F.array(*[F.lit(w) for w in ("구분", "", "품 명", "규격", "단위", "수량", "단가(원)", "금액(원)", "비고")])
    before = F.array(*[F.lit(w) for w in ("x", "y", "early", "", "EA", "1", "5000", "5000", "")])
    lines = T.with_numbered_lines(spark, sf, orders, ["item_name", "spec", "unit", "quantity", "unit_price", "amount", "maker"])
    per_order, own = F.array(row(F.lit(0), before), row(F.lit(1), head)), row(c("rn") + 1, F.when(c("rn") % 2 == 0, nine).otherwise(seven))
    return lines.select(
        "file_id", F.lit(2).alias("page"), F.lit(0).alias("table_idx"),
        F.inline(T.rendered(per_order, own, "array<struct<row_idx:int,cells:array<string>>>")),
    )


@query("prs_page_unit", sql("""
SELECT file_id, 2 AS page, 'UNIT ' || project AS unit_name FROM files WHERE header_id % 5 <> 0""", "files"))
def prs_page_unit(spark, sf):
    return P.page_units(_page_text(spark, sf))


@query("prs_page_meta", sql("""
SELECT file_id, '공급사 ' || customer AS vendor, CAST(quote_date AS VARCHAR) AS quote_date, 'Q-' || header_id AS quote_no, total AS total_amount
FROM files""", "files"))
def prs_page_meta(spark, sf):
    return P.page_meta(_page_text(spark, sf))


_PAGE = """
SELECT CAST(header_id AS VARCHAR) AS file_id, rn + 1 AS row_idx, unit_name, item_name, coalesce(spec, '') AS spec, trim(unit) AS unit,
  quantity, unit_price, amount, CASE WHEN rn % 2 = 0 THEN maker ELSE '' END AS maker
FROM numbered WHERE rn % 7 <> 0 AND rn % 5 <> 0 AND unit_price > 0 AND amount >= 1000"""


@query("prs_page_table", sql(_PAGE + " AND header_id % 5 <> 0", "numbered"))
def prs_page_table(spark, sf):
    return P.parse_page_tables(_page_table(spark, sf), _page_text(spark, sf)).drop("page", "table_idx")


@query("win_header_latch", sql("""
SELECT CAST(header_id AS VARCHAR) AS file_id, rn + 1 AS row_idx, trim(unit) AS unit FROM numbered""", "numbered"))
def win_header_latch(spark, sf):
    unit = F.when(F.size("cells") >= 9, F.get("cells", F.lit(4))).otherwise(F.get("cells", F.lit(3)))
    return P.table_bodies(_page_table(spark, sf)).select("file_id", "row_idx", unit.alias("unit"))


def _html_pages(spark, sf):
    """Crawled pages with the price table of the part of the same number appended."""
    c = F.col
    part = T.load(spark, sf, "part")
    price = F.format_number(F.floor("p_retailprice"), 0)
    table = F.concat(
        F.lit("<TABLE class='p'><tr><th>품명</th><th>규격</th><th>단위</th><th>A</th><th>B</th><th>비고</th></tr>\n<tr><td> <b>"),
        c("p_name"), F.lit("</b> </td><td>"), c("p_type"), F.lit("</td><td>EA</td><td>"), price,
        F.lit("원</td><td>"), (F.floor("p_retailprice") + c("p_size")).cast("string"),
        F.lit("</td><td>12</td></tr><tr><td>합</td><td></td><td></td><td>999</td></tr></table>"),
        F.lit("<table><tr><td>메뉴</td></tr><tr><td>a b</td><td>c</td><td>d</td><td>12345</td></tr></table>"),
    )
    tables = part.select(c("p_partkey").alias("page_id"), table.alias("tables"))
    crawled = T.load(spark, sf, "pages").select("page_id", "html")
    return crawled.join(tables, "page_id", "full").select(
        "page_id", F.concat(F.coalesce("html", F.lit("")), F.coalesce("tables", F.lit(""))).alias("html")
    )


_HTML = """
SELECT p_partkey AS page_id, p_name AS name, p_type AS spec, 'EA' AS unit,
  CAST(round_even((p0 + p0 + p_size) / 2, 0) AS BIGINT) AS price, p0 AS price_min, p0 + p_size AS price_max
FROM (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS p0 FROM part)"""


@query("prs_html_price", _HTML)
def prs_html_price(spark, sf):
    return P.html_prices(_html_pages(spark, sf)).drop("table_idx", "row_idx")


@query("agg_market_row", "SELECT page_id, price, price_min, price_max FROM (" + _HTML + ")")
def agg_market_row(spark, sf):
    """Mean, lowest and highest price over a row's price cells."""
    c = F.col
    p0 = F.floor("p_retailprice")
    cells = F.array(
        c("p_name"), c("p_type"), F.lit("EA"), F.format_number(p0, 0), (p0 + c("p_size")).cast("string"), F.lit("-")
    )
    parts = T.load(spark, sf, "part").select(c("p_partkey").alias("page_id"), P.price_summary(P.price_cells(cells)).alias("s"))
    return parts.select("page_id", "s.*")


@query("fn_contains_any", """
SELECT doc_id, contains(text, 'the') OR contains(text, 'eau') OR contains(text, 'sch') AS hit FROM documents""")
def fn_contains_any(spark, sf):
    return T.load(spark, sf, "documents").select(
        "doc_id", contains_any(F.col("text"), ["the", "eau", "sch"]).alias("hit")
    )
