
import pytest
from pyspark.sql import functions as F

from quotelens import schemas
from quotelens.operators import headers as H
from quotelens.operators import items as I
from quotelens.operators import layout as L
from quotelens.operators import legacy as G
from quotelens.operators import pages as P
from quotelens.plans import segments
from quotelens.plans.checkpoints import written


def _sheets(spark, sheets, file_name="견적서(화인상사).xlsx", file_id="f1"):
    rows = [
        (file_id, file_name, s, name, i, cells)
        for s, (name, body) in enumerate(sheets) for i, cells in enumerate(body)
    ]
    return spark.createDataFrame(rows, schemas.SHEET_ROWS)


COVER = ("갑지", [
    ["견적번호", "12", "", "AB-1"], ["견적번호", "CD-2"], ["제출일", "x", "2025-13-01"], ["작성일", "2025.9.5"],
    ["공사명 : 전동기 라인"], ["건명", "다른 이름"], ["견적금액", "1,000", "25,000"], ["총금액", "99"],
])
ASSY = ("HVAC ASSY", [
    ["단위공사명", "□", "조립 라인"], [None, "nan", " "], ["No", "품 명", "규격", "단위", "수량", "단 가", "금액", "메이커"],
    ["1", "볼트", "M3", "EA", "2", "1,000", "2,000", "THK"], ["2", "소계", "", "", "", "", "9,999", ""],
    ["3", "1,234", "x", "EA", "1", "5", "5", ""], ["4", "0번", "x", "EA", "1", "5", "5", ""],
    ["5", "너트", "", "EA", "3", "", "900", ""], ["6", "와셔", "", "", "", "7", "", ""], ["7", "a", "", "", "1", "1", "1", ""],
    ["8", "짧은행", "s"], ["9", "영원", "", "EA", "1", "0", "0", ""],
])


def test_standard_workbook(spark):
    rows = L.clean_rows(_sheets(spark, [COVER, ASSY, ("합계표", ASSY[1]), ("no header", [["a b c", "d"]])]))
    head = H.header_standard(rows).head()
    assert (head["vendor"], head["quote_no"], str(head["quote_date"]), head["project"], head["total_amount"]) == (
        "화인상사", "AB-1", "2025-09-05", "전동기 라인", 25000)
    got = {r["item_name"]: r for r in I.parse_standard(rows).collect()}
    assert set(got) == {"볼트", "너트", "와셔"}
    assert got["볼트"]["unit_name"] == "조립 라인" and got["볼트"]["maker"] == "THK" and got["볼트"]["unit_price"] == 1000
    assert (got["너트"]["unit_price"], got["너트"]["amount"], got["너트"]["quantity"]) == (3, 900, 3.0)
    # amount missing: the last number is the price itself, and the number before it the row number
    assert (got["와셔"]["unit_price"], got["와셔"]["amount"], got["와셔"]["quantity"]) == (7, 7, None)


def test_zero_total_gives_way_to_a_later_one(spark):
    for rows, want in (([["총금액", "0"]], 0), ([["총금액", "0"], ["총금액", "5"]], 5), ([["총금액", "-"]], None)):
        sheet = L.clean_rows(_sheets(spark, [("갑지", rows)]))
        assert H.header_standard(sheet).head()["total_amount"] == want


def test_price_in_first_column_counts_as_unmapped(spark):
    sheet = ("ASSY", [["단가", "품명", "규격"], ["100", "볼트", "x"]])
    assert I.parse_standard(L.clean_rows(_sheets(spark, [sheet]))).count() == 0


def test_last_header_cell_wins_and_first_for_assembly(spark):
    header = ["품명", "규격", "품명2", "금액", "단가", "금액(합)"]
    heads = spark.createDataFrame([("f", 0, header)], "file_id string, sheet_idx int, header_cells array<string>")
    std, asm = I.map_columns_standard(heads).head(), I.map_columns_assembly(heads).head()
    assert (std["pos_item_name"], std["pos_amount"], std["pos_unit_price"]) == (2, 5, 4)
    assert (asm["pos_item_name"], asm["pos_amount"], asm["pos_maker"]) == (0, 3, None)
    no_name = spark.createDataFrame([("f", 0, ["번호", "설명", "단위", "수량", "단가"])], heads.schema)
    assert I.map_columns_assembly(no_name).head()["pos_item_name"] == 1


def test_assembly_workbook(spark):
    quote = ("견적서", [["견적번호", "Q-1"], ["견적일", "2025-01-02"], ["상호", "주식회사 가나"], ["공사명", "메인 조립기"]])
    ten = ("10-1", [["로딩 공정"], ["장치", "규격", "수량", "단가", "금액"], ["모터", "750W", "2", "10", "20"],
                    ["감속기", "1/20", "3", "", "60"], ["기타", "x", "", "-1", "5"]])
    rows = L.clean_rows(_sheets(spark, [quote, ten, ("20", [["b"]]), ("단 위별_X", ten[1])]))
    head = H.header_assembly(rows).head()
    assert (head["vendor"], head["quote_no"], str(head["quote_date"]), head["project"]) == (
        "주식회사 가나", "Q-1", "2025-01-02", "메인 조립기")
    got = {r["item_name"]: (r["unit_price"], r["amount"], r["quantity"], r["unit_name"]) for r in I.parse_assembly(rows).collect()}
    # the third row's fallback price is the -1 before the amount, so it is dropped
    assert got == {"모터": (10, 20, 2.0, "로딩 공정"), "감속기": (3, 60, None, "로딩 공정")}


def test_layouts_and_lock(spark):
    cases = {
        "two": ["10-1", "20 "], "one": ["10-1", "x"], "roll": ["단위별 합"], "kw": ["U핀 공정"], "cover": ["01갑지"], "none": ["메모"],
    }
    rows = [(f, f, i, s, 0, ["IRM protected x"] if f == "kw" else ["a"]) for f, names in cases.items() for i, s in enumerate(names)]
    df = spark.createDataFrame(rows, schemas.SHEET_ROWS)
    got = {r["file_id"]: r["layout_group"] for r in L.detect_layout(df).collect()}
    assert got == {"two": "assembly", "one": "unknown", "roll": "assembly", "kw": "standard", "cover": "standard", "none": "unknown"}
    assert [r["file_id"] for r in L.locked_files(L.clean_rows(df)).collect()] == ["kw"]


def test_long_sheets_keep_every_row(spark):
    df = spark.range(700).selectExpr("'f' file_id", "'f' file_name", "0 sheet_idx", "'s' sheet", "int(id) row_idx", "array(string(id)) cells")
    assert L.clean_rows(df).count() == 700
    lines = [[f"볼트{i}", "M3", "EA", "2", "1000", "2000", "THK"] for i in range(1000)]
    sheet = ("ASSY", [["품명", "규격", "단위", "수량", "단가", "금액", "메이커"], *lines])
    assert I.parse_standard(L.clean_rows(_sheets(spark, [sheet]))).count() == 1000


def test_positional_layouts(spark):
    fixed = ("S", [["", "전기부문", " 라인A "], ["No"], ["", "1", "■● 볼트", "M3", "EA", "x", "10.9", "1,000", "THK"],
                   ["", "2", "너트", "", "EA", "1", "10", "bad"], ["", "3", "1.5", "", "", "1", "10", "2000"], ["", "short"]])
    got = [tuple(r[c] for c in ("unit_name", "item_name", "quantity", "unit_price", "amount", "maker"))
           for r in G.parse_fixed(_sheets(spark, [fixed])).collect()]
    assert got == [("라인A", "볼트", None, 10, 1000, "THK")]
    install = ("2. 공사(라인)", [["□ 배선"], ["케이블", "1", "50", "100"], ["케이블", "노무비", "1", "50", "500"], ["전선", "1", "50", "99"]])
    got = G.parse_installation(_sheets(spark, [install])).collect()
    assert [(r["item_name"], r["unit_name"], r["quantity"]) for r in got] == [("케이블", "□ 배선", 1.0)]
    upload = ("전기 라인", [["", ""], ["케이블", "A", "1", "50", "1000"], ["케이블", "A", "2", "50", "2000"], ["케이블", "A", "1", "60", "1000"]])
    got = sorted((r["unit_price"], r["amount"]) for r in G.parse_upload(_sheets(spark, [upload])).collect())
    assert got == [(50, 1000), (60, 1000)]


def test_page_tables(spark):
    text = spark.createDataFrame(
        [("f", 2, "□ 단위공사명(전기제외): 라인A (첨부)\n"), ("f", 3, "종합표")], "file_id string, page int, text string")
    head = ["구분", "", "품 명", "규격", "단위", "수량", "단가(원)", "금액(원)", "M"]
    rows = [
        ["x", "y", "먼저", "", "EA", "1", "5000", "5000", ""], head,
        ["", "", "볼트\n큰", "M3", "EA", "2", "1,000", "2,000", "THK"], ["1", "너트", "", "EA", "x", "500", "1000"],
        ["1", "소수", "", "EA", "1", "12.5", "1000"], ["1", "작은", "", "EA", "1", "10", "999"], ["1", "■ 제목", "", "", "1", "10", "5000"],
        head, ["1", "1,2 3", "", "", "1", "10", "5000"], ["1", "자재비", "", "", "1", "10", "5000"],
    ]
    data = [("f", p, 0, i, r) for p in (2, 3) for i, r in enumerate(rows)] + [("f", 2, 1, i, r) for i, r in enumerate([["a"] * 7] * 3 + [head, rows[2]])]
    table = spark.createDataFrame(data, "file_id string, page int, table_idx int, row_idx int, cells array<string>")
    got = sorted((r["item_name"], r["unit_price"], r["quantity"], r["maker"], r["unit_name"]) for r in P.parse_page_tables(table, text).collect())
    assert got == [("너트", 500, None, "", "라인A"), ("볼트 큰", 1000, 2.0, "THK", "라인A")]


def test_html_prices(spark):
    html = """<table><tr><th>품명</th><th>규격</th><th>단위</th><th>p</th></tr>
      <tr><td> <b>볼트</b> </td><td>M3&amp;M4</td><td>EA</td><td>1,000원</td><td>1,001</td><td>12</td><td>1234567890</td></tr>
      <tr><td>너</td><td></td><td></td><td>500</td></tr><tr><td>너트</td><td>a</td><td>b</td><td>-</td></tr></table>
      <table><tr><td>x</td></tr><tr><td>볼트</td><td>a</td><td>b</td><td>500</td></tr></table>"""
    df = spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string")
    got = [tuple(r[c] for c in ("name", "spec", "unit", "price", "price_min", "price_max")) for r in P.html_prices(df).collect()]
    assert got == [("볼트", "M3&M4", "EA", 1000, 1000, 1001)]


@pytest.mark.parametrize("size", [1, 3, 7])
def test_ranges_of_a_sheet_give_what_the_sheet_gives(spark, monkeypatch, size):
    """Numbers, headers, titles and items do not depend on where a sheet is cut."""
    lead = [["", None], ["x"], [""]] * size
    sheets = [("갑지", COVER[1]), ("A ASSY", ASSY[1]), ("B ASSY", [*lead, *ASSY[1] * 3]), ("C ASSY", [[""]] * 40 + ASSY[1])]
    raw = _sheets(spark, sheets).repartition(5)
    assembly = _sheets(spark, [("10", [["공정 10"], *ASSY[1]]), ("20", [[" "]] * 9 + [["이십"], *ASSY[1] * 2])], file_id="f2")
    tagged = raw.withColumn("layout_group", F.lit("standard")).unionByName(assembly.withColumn("layout_group", F.lit("assembly")))
    page = spark.createDataFrame(
        [("f", 1, t, i, r) for t in (0, 1) for i, r in enumerate([["x"] * 7, ["단가(원)"] + ["품 명"] * 7, *[["a", "b", "c"] * 3] * 30])],
        "file_id string, page int, table_idx int, row_idx int, cells array<string>")

    def everything():
        return [
            sorted(map(str, df.collect())) for df in (
                L.clean_rows(raw), I.parse_items(tagged), G.parse_upload(raw), G.parse_standard_positional(L.clean_rows(raw)),
                P.table_bodies(page), I.latched_rows(tagged),
            )
        ]

    whole = everything()
    monkeypatch.setattr(segments, "SEGMENT_ROWS", size)
    assert everything() == whole and all(whole[:5])


def test_a_sheet_of_a_million_rows_is_many_tasks(spark):
    rows = spark.range(0, 1_000_000, numPartitions=8).select(
        F.lit("f").alias("file_id"), F.lit("n.xlsx").alias("file_name"), F.lit(0).alias("sheet_idx"), F.lit("S").alias("sheet"),
        F.col("id").cast("int").alias("row_idx"),
        F.when(F.col("id") % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.col("id").cast("string"))).alias("cells"),
    )
    ranges = segments._ranges(L.filled_rows(rows), L.SHEET, {}, True, "row_idx", 1 << 16)
    plan = ranges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "hashpartitioning(file_id#" in plan and "__segment#" in plan.split("hashpartitioning", 1)[1].split(")")[0]
    ranged = ranges.groupBy("__segment").count().collect()
    assert len(ranged) == 16 and max(r["count"] for r in ranged) <= 1 << 16
    cleaned = L.clean_rows(rows)
    assert cleaned.agg(F.max("row_idx"), F.countDistinct("row_idx")).head() == (799_999, 800_000)
    odd = cleaned.filter(F.col("row_idx") != F.col("cells")[0].cast("int") - F.floor(F.col("cells")[0].cast("int") / 5) - 1)
    assert odd.isEmpty()


def test_both_layouts_share_one_scan_and_one_exchange(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    _sheets(spark, [COVER, ASSY]).withColumn("layout_group", F.lit("standard")).write.parquet(path)
    raw = spark.read.parquet(path)
    plans = []
    monkeypatch.setattr(segments, "written", lambda df, name: (
        plans.append((name, df._jdf.queryExecution().executedPlan().toString())), written(df, name))[1])
    items, tagged = I.parse_items(raw), G.parse_tagged(L.filled_rows(raw).withColumn("layout", F.lit("standard")))
    for plan in [p for name, p in plans if name == "segments"]:
        assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1
    for df in (items, tagged):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 0 and plan.count("Scan parquet") == 1
    assert items.count() == 3


def test_a_row_is_read_once_and_only_sheets_with_items_move(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    _sheets(spark, [COVER, ASSY]).withColumn("layout_group", F.lit("standard")).write.parquet(path)
    raw = spark.read.parquet(path)
    stored = []
    monkeypatch.setattr(segments, "written", lambda df, name: (stored.append(written(df, name)), stored[-1])[1])
    items = I.parse_items(raw)
    assert items.count() == 3 and {r["sheet"] for r in stored[0].select("sheet").distinct().collect()} == {ASSY[0]}
    for df in (items, items.filter("unit_price > 5 AND item_name <> 'x'")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("transform(cells") == 1
    positional = G.positional_items(raw.withColumn("unit_name", F.col("sheet")), 1000, [])
    assert positional._jdf.queryExecution().optimizedPlan().toString().count("transform(cells") == 1
    for positions in (I.positions_standard, I.positions_assembly):
        plan = raw.select(positions(F.col("cells")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("contains(replace(") <= 12


@pytest.mark.parametrize("size", [1, 2, 3, 1 << 16])
def test_positional_parsers_number_rows_in_their_own_exchange(spark, monkeypatch, size):
    line = ["1", "볼트", "M3", "EA", "2", "1,000", "2,000", "THK"]
    raw = _sheets(spark, [("A ASSY", [[" "], ["가", "나"], [" "], ["다"], ["x"], ["y"], ["늦은 제목"], line]), ("B ASSY", [[" "], ["단위 이름"], line]),
                          ("F", [["", "□ 단위공사명", "고정"], ["", ""], ["No"], ["", "1", "볼트", "M3", "EA", "2", "1,000", "2,000", "THK"]])])
    monkeypatch.setattr(segments, "SEGMENT_ROWS", size)
    for parse in (G.parse_standard_positional, G.parse_assembly_positional, G.parse_fixed):
        one, two = parse(L.clean_rows(raw)), parse(L.filled_rows(raw), renumber=True)
        assert sorted(map(str, two.collect())) == sorted(map(str, one.collect())) and not one.isEmpty()
    routed = raw.withColumn("layout_group", F.lit("standard"))
    stored = []
    monkeypatch.setattr(segments, "written", lambda df, name: (stored.append(written(df, name)), stored[-1])[1])
    want = I.latched_rows(routed).filter("row_idx = header_idx").select("file_id", "sheet_idx", F.col("header_idx").cast("int"))
    stored.clear()
    got = I.header_rows(routed.union(_sheets(spark, [ASSY], file_id="f2").withColumn("layout_group", F.lit("standard"))))
    assert got.filter("file_id = 'f2'").head()["header_idx"] == 1 and "cells" not in stored[0].columns
    assert got.filter("file_id <> 'f2'").exceptAll(want).isEmpty()


def test_a_row_is_joined_once_and_a_header_is_a_text(spark, tmp_path, monkeypatch):
    """Header words are looked for in one joined text, and positions are not worked out inside a lambda."""
    path = str(tmp_path / "rows")
    _sheets(spark, [COVER, ASSY]).withColumn("layout_group", F.lit("standard")).write.parquet(path)
    plans = []
    monkeypatch.setattr(segments, "written", lambda df, name: (
        plans.append(df._jdf.queryExecution().optimizedPlan().toString()), written(df, name))[1])
    assert I.parse_items(spark.read.parquet(path)).count() == 3
    assert plans[0].count("concat_ws(") == 1 and "array_position" not in plans[0]
    heads = spark.createDataFrame(
        [(["위치", "x", "규 격", "단가(원)", "단가", "금액", "견적", "단위"],), (["단가"],), (["품명", "품 명", "단위", "메이커", ""],)],
        "header_cells array<string>")
    fields = [f"pos_{f}" for f in I.FIELDS]
    assert [tuple(r) for r in I.map_columns_assembly(heads).select(*fields).collect()] == [
        (3, 2, 7, None, 4, 5, None), (None, None, None, None, 0, None, None), (0, None, 2, None, None, None, None)]
    assert [tuple(r) for r in I.map_columns_standard(heads).select(*fields).collect()] == [
        (None, 2, 7, None, 4, 5, None), (None, None, None, None, 0, None, None), (1, None, 2, None, None, None, 3)]


def test_a_cell_is_read_as_a_number_once(spark):
    rows = spark.createDataFrame([(["1,200", " ", "None", "볼트", "1e3", "12EA", ".5", "　7 "],)], "cells array<string>")
    split = G.split_cells(rows)
    assert split._jdf.queryExecution().optimizedPlan().toString().count("RLIKE(") <= 1
    assert split.select("nums", "words").head() == ([1200.0, 1000.0, 0.5, 7.0], ["볼트", "12EA"])


def test_rows_of_a_staged_file_are_numbered_where_they_lie(spark, monkeypatch):
    from workload import tables as T

    plans = []
    monkeypatch.setattr(segments, "written", lambda df, name: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df, name))[1])
    rows = T.sheet_rows(spark, "/root/testdata/sf0.001")
    numbered = L.clean_rows(rows)
    assert plans and "Exchange" not in plans[0] and "Window" in plans[0]
    assert numbered.count() == L.filled_rows(rows).count()


def test_page_rows_are_rendered_where_their_lines_lie(spark, monkeypatch):
    from quotelens.operators import pages as P
    from workload import parsing_queries as Q

    plans = []
    monkeypatch.setattr(segments, "written", lambda df, name: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df, name))[1])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        P.table_bodies(Q._page_table(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plans and "Exchange" not in plans[0].split("Generate")[0] and "Union" not in plans[0]


def test_dispatch_moves_rows_by_file_alone(spark, monkeypatch):
    line = ["1", "볼트", "M3", "EA", "2", "1,000", "2,000", "THK"]
    raw = _sheets(spark, [("A ASSY", [["가나다"], line])], file_id="f1").union(_sheets(spark, [("A ASSY", [["가나다"], line])], file_id="f2"))
    raw = raw.withColumn("file_name", F.concat("file_id", F.lit(".xlsx")))
    meta = spark.createDataFrame(
        [("f1.xlsx", "v", "p", "q", None, None, "standard"), ("f1.xlsx", "w", "p", "q", None, None, "standard"), ("f3.xlsx", "v", "p", "q", None, None, "standard")],
        "file_name string, vendor string, project string, quote_no string, quote_date date, entry_date date, layout string")
    stored = []
    monkeypatch.setattr(segments, "written", lambda df, name: (stored.append(written(df, name)), stored[-1])[1])
    one = G.parse_by_layout(L.clean_rows(raw), meta.limit(1))
    assert one.columns[:2] == ["file_name", "file_id"] and one.columns[-5:] == ["vendor", "project", "quote_no", "quote_date", "entry_date"]
    assert [(r["file_name"], r["item_name"], r["vendor"]) for r in one.collect()] == [("f1.xlsx", "볼트", "v")]
    assert "file_name" not in stored[-1].columns
    assert G.parse_by_layout(L.clean_rows(raw), meta).count() == 4  # as both entries route and describe the rows
