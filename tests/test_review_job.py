"""Edits as of a day and the review job on small hand-made tables."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from quotelens.operators import review_log as L
from quotelens.plans.review import review_quotations

EDITS = "row_id bigint, edited_on date, revision bigint, discount double, basis string, withdrawn boolean"


def _plain(edits, day):
    last = {}
    for e in sorted((e for e in edits if e[1] <= day), key=lambda e: (e[0], *e[1:])):
        last[e[0]] = e
    return sorted((e[0], e[3], e[4]) for e in last.values() if not e[5])


def test_edits_as_of_every_day_and_after_compaction(spark, tmp_path):
    first = date(2024, 1, 20)
    edits = [(k % 7, first + timedelta(days=k * 5 % 40), k, float(k % 30), f"b{k % 3}", k % 4 == 0) for k in range(200)]
    edits += [(1, first, 500, 1.0, "x", False), (1, first, 500, 1.0, "y", False)]
    log, short = str(tmp_path / "log"), str(tmp_path / "short")
    for part in (edits[:90], edits[90:]):
        L.append_edits(spark.createDataFrame(part, EDITS), log)
    cut = first + timedelta(days=15)
    L.append_edits(L.compacted(spark.read.parquet(log), cut), short)
    assert spark.read.parquet(short).count() < len(edits)
    for step in (-1, 0, 11, 12, 15, 16, 30, 60):
        day = first + timedelta(days=step)
        for path in [log, short] if day >= cut else [log]:
            got = sorted(tuple(r) for r in L.edits_as_of(spark.read.parquet(path), day).collect())
            assert got == _plain(edits, day), (step, path)


def test_months_after_the_day_are_not_read(spark, tmp_path):
    edits = [(1, date(2024, m, 3), m, 5.0, "b", False) for m in range(1, 7)]
    L.append_edits(spark.createDataFrame(edits, EDITS), str(tmp_path / "log"))
    frame = L.edits_as_of(spark.read.parquet(str(tmp_path / "log")), date(2024, 2, 10))
    assert {f.split("edit_month=")[1][:7] for f in spark.read.parquet(str(tmp_path / "log")).inputFiles()} == {f"2024-0{m}" for m in range(1, 7)}
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "edit_month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_review_of_similar_unknown_and_edited_lines(spark):
    master = spark.createDataFrame(
        [("SP-1", "steel bolt", "M10", 100, 90, 110), ("SP-2", "copper pipe", "20A", 1000, 900, 1100)],
        "item_id string, item_name string, spec string, price_avg bigint, price_min bigint, price_max bigint")
    lines = spark.createDataFrame(
        [(1, "steel bolt", "M10", 150, 2.0), (2, "copper pipes", "20A", 950, None), (3, "qqqq", None, 500, 0.0), (4, "steel bolt", "M10", 150, 1.0)],
        "row_id bigint, item_name string, spec string, unit_price bigint, quantity double")
    market = spark.createDataFrame([("qqqq", 300)], "item_name string, market_price bigint")
    edits = spark.createDataFrame([(4, 10.0, "할인율 적용")], "row_id bigint, discount double, basis string")
    got = {r["row_id"]: r for r in review_quotations(lines, master, market, edits).collect()}
    assert len(got) == 4
    assert (got[1]["matched_name"], got[1]["deviation_pct"], got[1]["final_price"]) == ("steel bolt", 50.0, 100)
    assert got[2]["matched_name"] == "copper pipe" and got[2]["final_price"] == 950 and got[2]["quantity"] == 1.0
    assert got[3]["matched_name"] is None and got[3]["final_price"] == 300 and got[3]["is_saving"]
    assert got[4]["final_price"] == 135 and got[4]["basis_changed"] and not got[1]["basis_changed"]
    plain = review_quotations(lines, master, market.filter(F.lit(False)))
    assert {r["row_id"]: r["final_price"] for r in plain.collect()}[3] == 381
