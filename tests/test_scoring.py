from pyspark.sql import functions as F

from quotelens.operators import pricing as P
from quotelens.operators import review as R
from quotelens.operators.normalize import enrich_items


def test_item_scores(spark):
    rows = [
        ("bolt", "EA", 2.0, 1000, 2000, 1.00),
        ("", "EA", 2.0, 1000, 2000, 0.60),
        ("b", "EA", 2.0, 1000, 2000, 0.70),
        ("bolt", "EA", 2.0, 0, 2000, 0.70),
        ("bolt", "EA", None, 1000, 2000, 0.85),
        ("bolt", "", 2.0, 1000, 2000, 0.95),
        ("bolt", "EA", 2.0, 1000, 2020, 1.00),   # off by exactly one percent
        ("bolt", "EA", 2.0, 1000, 2021, 0.80),
        ("bolt", "EA", 1.0, 999, 999, 0.85),
        ("bolt", "EA", 1.0, 1000, 1000, 1.00),
        ("bolt", "", None, 999, 999, 0.65),      # no quantity, no unit, small amount
        ("bolt", "EA", 1.0, 500, 900, 0.65),     # mismatch and small amount
        (None, None, None, None, None, 0.10),
    ]
    df = spark.createDataFrame(rows, "item_name string, unit string, quantity double, unit_price bigint, amount bigint, want double")
    for r in enrich_items(df).collect():
        assert float(r["confidence"]) == r["want"], r


def _lines(spark, rows):
    schema = ("item_name string, spec string, unit_norm string, vendor string, maker string, unit_price bigint,"
              " confidence decimal(3,2), flagged boolean, parse_ok boolean")
    return spark.createDataFrame(rows, schema).withColumns({
        "confidence": F.col("confidence"), "category": F.lit("설비"), "quote_date": F.lit("2024-01-01").cast("date"),
        "header_id": F.lit(1), "unit": F.col("unit_norm"),
    })


def test_standard_price_boundaries(spark):
    from decimal import Decimal as D

    base = ("bolt", "M3", "EA")
    rows = [
        (*base, "B", "y", 100, D("0.70"), False, True), (*base, "A", "x", 101, D("1.00"), False, True),
        (*base, None, "", 900, D("0.69"), False, True), (*base, "C", "", 900, D("1.00"), True, True),
        (*base, "C", "", 900, D("1.00"), False, False), ("one", "", "EA", "A", "", 5, D("1.00"), False, True),
        ("nul", None, "EA", "A", "", 5, D("1.00"), False, True), ("nul", "", "EA", None, "", 6, D("1.00"), False, True),
    ]
    lines = P.trusted(_lines(spark, rows))
    got = {r["item_name"]: r for r in P.standard_price(lines, with_maker=True, blank_vendors=False).collect()}
    assert set(got) == {"bolt", "nul"}
    assert (got["bolt"]["price_avg"], got["bolt"]["sample_count"]) == (101, 2)   # 100.5 rounds up
    assert got["bolt"]["source_vendors"] == "A, B" and got["bolt"]["main_maker"] == "x"  # tie: lowest
    assert got["nul"]["source_vendors"] == "A" and got["nul"]["main_maker"] == ""
    assert P.standard_price(lines, null_safe=False).filter("item_name = 'nul'").count() == 0
    assert P.standard_price(lines, min_samples=1).count() == 3


def test_anomaly_threshold_and_fan_out(spark):
    from decimal import Decimal as D

    rows = [("bolt", "", "EA", "A", "", p, D("1.00"), False, True) for p in (115, 116)]
    master = spark.createDataFrame([("bolt", "", "EA", 100), ("bolt", "", "SET", 50)], "item_name string, spec string, unit string, price_avg bigint")
    found = P.anomalies(_lines(spark, rows), master)
    assert sorted((r["unit_price"], r["std_price_avg"]) for r in found.collect()) == [(115, 50), (116, 50), (116, 100)]
    assert P.anomalies(_lines(spark, rows), master, include_unit=True).count() == 1


def test_verdict_uses_rounded_percent(spark):
    df = spark.createDataFrame([(11504, 10000), (11505, 10000), (11500, 10000), (8490, 10000), (5, 0)], "unit_price bigint, std_price_avg bigint")
    got = [(r["deviation_pct"], r["verdict"]) for r in R.compare(df).collect()]
    assert got[0] == (15.0, "✅ 적정 (+15.0%)") and got[1] == (15.1, "⚠️ 이상가 (+15.1%)")
    assert got[2][1].startswith("✅") and got[3] == (-15.1, "✅ 적정 (저렴 -15.1%)") and got[4] == (None, "표준단가 없음")


def test_review_bases(spark):
    rows = [
        # price, standard, similarity, market -> recommendation, final
        (1000, 1200, 50.0, 0, "견적가 적용", 1000), (1000, 900, 20.0, 0, "표준단가 적용", 900),
        (1000, 900, 19.9, 700, "시장가 적용", 700), (1000, None, None, 800, "할인율 적용", 762),
        (1000, None, None, 0, "할인율 적용", 762),
    ]
    df = spark.createDataFrame(rows, "unit_price bigint, std_price_avg bigint, similarity_pct double, market_price bigint, want string, final bigint")
    review = R.review_table(df.withColumns({"quantity": F.lit(0.0), "row_id": F.monotonically_increasing_id()}))
    for r in review.collect():
        assert (r["recommended"], r["final_price"], r["quantity"]) == (r["want"], r["final"], 1.0)
    edits = review.select("row_id", F.lit(50.0).alias("discount"), F.lit("시장가 적용").alias("basis"))
    again = R.mark_overrides(R.apply_overrides(review, edits)).collect()
    assert [r["final_price"] for r in again] == [500, 500, 700, 800, 500]
    assert [r["basis_changed"] for r in again] == [True, True, False, True, True]
    s = R.review_summary(review).head()
    assert s["saved"] == 5000 - (1000 + 900 + 700 + 762 + 762) and R.review_summary(review.limit(0)).head()["saved_pct"] == 0.0
