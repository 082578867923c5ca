from pyspark.sql import functions as F

from quotelens.functions import text as X
from quotelens.functions.grams import char_grams
from quotelens.operators.normalize import normalize_unit


def _one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


def test_numbers(spark):
    values = ["1,234", "10d", "1_000", "nan", "　8", ".5", "", "-3.9", "1e3", None, "inf", "0x1p3", " 7 "]
    assert _one(spark, values, X.to_double) == [1234.0, None, None, None, 8.0, 0.5, None, -3.9, 1000.0, None, None, None, 7.0]
    assert _one(spark, values, X.to_long) == [1234, None, None, None, 8, 0, None, -3, 1000, None, None, None, 7]
    assert _one(spark, values, X.to_long_strict) == [1234, None, None, None, 8, None, None, None, None, None, None, None, 7]
    assert _one(spark, values, X.is_number)[:4] == [True, False, False, False]


def test_dates(spark):
    values = ["2025-09-29 00:00:00", "2025년9월5일", "2025년 9월 29일", "2025-13-01", "2024/2/29", "2023.2.29", "x"]
    got = [str(v) if v else None for v in _one(spark, values, X.parse_date)]
    assert got == ["2025-09-29", "2025-09-05", None, None, "2024-02-29", None, None]


def test_units(spark):
    values = ["ea", "개", " PCS ", "식", "㎡", "Box 1", "", None, "개 소"]
    assert _one(spark, values, normalize_unit) == ["EA", "EA", "EA", "SET", "M2", "BOX 1", "", "", "EA"]


def _model_grams(text):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in (2, 3, 4):
            out += [w[i:i + n] for i in range(max(len(w) - n + 1, 1))]
            if len(w) <= n:
                break
    return out


def test_grams(spark):
    values = ["Servo Motor", "가", "a bc  def", "", "LM 가이드 HGR20"]
    got = _one(spark, values, char_grams)
    assert [sorted(g) for g in got] == [sorted(_model_grams(v)) for v in values]


def test_exact_means(spark):
    df = spark.createDataFrame([(5, 2), (7, 2), (10, 4), (11, 4), (9, 3)], "t bigint, n bigint")
    rows = df.select(X.half_up_mean("t", "n"), X.half_even_mean("t", "n")).collect()
    assert [r[0] for r in rows] == [3, 4, 3, 3, 3]
    assert [r[1] for r in rows] == [round(t / n) for t, n in ((5, 2), (7, 2), (10, 4), (11, 4), (9, 3))]
