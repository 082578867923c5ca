from quotelens.operators import rules as R

COLUMNS = ["item_name", "spec", "unit", "maker", "unit_name"]
SCHEMA = "item_name string, spec string, unit string, maker string, unit_name string, unit_price bigint"


def _run(spark, *rows):
    df = spark.createDataFrame([(*r[:5], r[5] if len(r) > 5 else 10) for r in rows], SCHEMA)
    return [(tuple(r[c] for c in COLUMNS), list(r["changed_rules"])) for r in R.apply_rules(df).collect()]


def test_each_rule(spark):
    got = _run(
        spark,
        ("bolt", "SET", "ABC", "x", "u"), ("bolt", "s", "MD", "", "u"), ("bolt", "OMRON", "EA", "old", "u"),
        ("bolt", "old", "4G 1", "", "u"), ("구매품", "real", "M-1", "", "u"), ("(OP10, 한글)", "real", "EA", "", "u"),
        ("기계", "real", "EA", "note", "u"), ("기계", "", "EA", "note", "u"), ("기계", "", "EA", "THK", "u"),
        ("x", "y", "EA", "BED EQUIPMENT", "u"), ("서버 전송 프로그램", "", "EA", "BED EQUIPMENT", "u"),
    )
    want = [
        (("bolt", "ABC", "SET", "x", "u"), ["rule_01_unit"]),
        (("bolt", "s", "M/D", "", "u"), ["rule_01_unit"]),
        (("bolt", "old", "EA", "OMRON", "u"), ["rule_02_maker"]),
        (("bolt", "4G 1", "EA", "", "u"), ["rule_03_spec", "rule_07_infer"]),
        (("real", "M-1", "EA", "", "u"), ["rule_08_category"]),
        (("real", "", "EA", "", "u"), ["rule_08_category"]),
        (("real", "", "EA", "note", "u"), ["rule_04_invalid"]),
        (("", "note", "EA", "", "u"), ["rule_04_invalid"]),
        (("", "", "EA", "THK", "u"), ["rule_04_invalid"]),
        (("x", "BED EQUIPMENT", "EA", "", "u"), ["rule_05_manual"]),
        (("서버 전송 프로그램", "BED EQUIPMENT", "EA", "", "u"), ["rule_05_manual"]),
    ]
    assert got == want


def test_rules_in_sequence(spark):
    got = _run(
        spark,
        ("자재비", "철자재", "강판", "", "u", 2_000_000),          # 09 then 07
        ("(3set)", "dup", "dup", "", "u"),                        # 10, then 06 sees name = spec
        ("bolt", "", "", "", "u", 999_999), ("bolt", "", "", "", "u", 1_000_000), ("bolt", "", "", "", "u", 10_000_000),
    )
    assert got[0] == (("강판", "철자재", "SET", "", "u"), ["rule_09_material", "rule_07_infer"])
    assert got[1] == (("dup", "", "SET", "", "u"), ["rule_10_nset", "rule_06_dup"])
    assert [g[0][2] for g in got[2:]] == ["EA", "SET", "식"]


def test_chain_keeps_rows_and_filters_cheaply(spark):
    df = spark.range(500).selectExpr("'bolt' item_name", "'SET' spec", "concat('u', id) unit", "'' maker", "'n' unit_name", "id unit_price")
    out = R.apply_rules(df)
    assert out.count() == 500
    assert out.filter("item_name = 'bolt' AND unit = 'SET'").groupBy("spec").count().count() == 500


def test_corrections_of_a_table(spark):
    """Open fields match everything, the least priority wins, and the built-in table does what the built-in rule does."""
    lines = [("x", "y", "EA", "BED EQUIPMENT", "u", 1), (" 서버 전송 프로그램 ", "", "EA", "BED EQUIPMENT", "u", 1), (None, None, None, "M", "u", None),
             ("MBC ASS'Y", "s", "EA", "OIL JET VISION UNIT", "u", 5), ("bolt", "s", "EA", "M", "u", 5)]
    df = spark.createDataFrame(lines, SCHEMA)
    builtin = R.corrections_table(spark)
    key = lambda rows: sorted(map(str, rows))
    assert key(R.correct(df, builtin).collect()) == key(R.apply_rule(df, "rule_05_manual").collect())
    assert key(R.apply_rules(df, builtin).collect()) == key(R.apply_rules(df).collect())
    fields = ", ".join(f"{k}_{c} string" for k in ("match", "set") for c in COLUMNS)
    none = [None] * 5
    table = spark.createDataFrame([
        (9, *none, None, "any", None, None, None), (5, None, None, None, "M", None, None, "maker", None, None, None),
        (3, "bolt", None, None, "M", None, "both", None, None, "", None), (4, "bolt", None, None, "M", None, "later", None, None, None, None),
    ], "priority bigint, " + fields)
    got = {(r["item_name"], r["spec"], r["maker"]) for r in R.correct(df, table).collect()}
    assert got == {("x", "any", "BED EQUIPMENT"), (" 서버 전송 프로그램 ", "any", "BED EQUIPMENT"), ("", "maker", "M"),
                   ("MBC ASS'Y", "any", "OIL JET VISION UNIT"), ("both", "s", "")}
    assert R.correct(df, table.limit(0)).count() == 5
    assert "CartesianProduct" not in R.correct(df, table)._jdf.queryExecution().executedPlan().toString()


def test_corrections_of_equal_priority_fall_to_values_before_kept_fields(spark):
    df = spark.createDataFrame([("bolt", "s", "EA", "M", "u", 5), ("nut", "s", "EA", "M", "u", 5)], SCHEMA)
    fields = ", ".join(f"{k}_{c} string" for k in ("match", "set") for c in COLUMNS)
    table = spark.createDataFrame([
        (280, None, "s", None, "M", None, None, None, "TYPE", None, None),
        (280, "bolt", None, None, None, None, None, "by name 280", None, None, None),
        (280, "bolt", None, None, None, None, None, None, "A", None, None),
    ], "priority bigint, " + fields)
    got = {(r["item_name"], r["spec"], r["unit"]) for r in R.correct(df, table).collect()}
    assert got == {("bolt", "by name 280", "EA"), ("nut", "s", "TYPE")}
