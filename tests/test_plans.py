import glob
import time

import pytest
from pyspark.sql import functions as F

from quotelens.operators import master as M
from quotelens.plans.checkpoints import shared_folder, written
from quotelens.plans.ranking import first_per_key, with_running_number


def test_running_number_is_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("hot"))
    got = with_running_number(df, [F.col("hot"), F.col("k")], "n", 10).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(10, 5010))
    assert [(r["hot"], r["k"]) for r in got] == sorted((r["hot"], r["k"]) for r in got)


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    assert sorted(tuple(r) for r in first_per_key(df, ["k"], ["o"]).collect()) == [("a", 1, "y"), ("b", 5, None)]


class _Session:
    """Stand-in session with a given checkpoint setting and master."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda _: None})()


def test_shared_folder_is_the_session_setting():
    assert shared_folder(_Session("hdfs://shared/x", "yarn")) == "hdfs://shared/x"
    with pytest.raises(RuntimeError):
        shared_folder(_Session(None, "yarn"))
    with pytest.raises(RuntimeError):
        shared_folder(_Session(None, "local[2]"))


def _source(spark, rows):
    df = spark.createDataFrame(rows, "item_name string, spec string, unit string, price_avg bigint")
    return df.withColumns({
        "category": F.lit("설비"), "price_min": F.col("price_avg"), "price_max": F.col("price_avg"),
        "data_count": F.lit(2).cast("bigint"), "main_maker": F.lit(""), "source_vendors": F.lit("A"),
        "latest_quote_date": F.lit("2024-01-01").cast("date"),
    })


def test_sync_twice_is_sync_once_and_protects_reviewed(spark):
    t1, t2 = (F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp") for d in (1, 2))

    empty = _source(spark, []).select(
        F.lit("").alias("item_id"), "*", F.lit(False).alias("manually_reviewed"), F.lit("").alias("review_note"),
        t1.alias("created_at"), t1.alias("updated_at"))
    first = M.sync_master(_source(spark, [("b", "", "EA", 10), ("a", "", "EA", 20), ("a", "", "SET", 30)]), empty, t1)
    assert [(r["item_id"], r["item_name"], r["unit"]) for r in first.orderBy("item_id").collect()] == [
        ("SP-00001", "a", "EA"), ("SP-00002", "a", "SET"), ("SP-00003", "b", "EA")]
    reviewed = first.withColumn("manually_reviewed", F.col("item_id") == "SP-00001")
    fresh = _source(spark, [("a", "", "EA", 99), ("a", "", "SET", 31), ("c", "", "EA", 40)])
    second = {r["item_id"]: r for r in M.sync_master(fresh, reviewed, t2).collect()}
    assert second["SP-00001"]["price_avg"] == 20 and second["SP-00002"]["price_avg"] == 31
    assert second["SP-00003"]["price_avg"] == 10 and second["SP-00004"]["item_name"] == "c"
    assert second["SP-00002"]["created_at"] == second["SP-00001"]["created_at"] != second["SP-00002"]["updated_at"]
    counts = {r["action"]: r["n"] for r in M.sync_counts(M.sync_actions(fresh, M.sync_master(fresh, reviewed, t2))).collect()}
    assert counts == {"updated": 2, "skipped": 1}


def test_name_search(spark):
    master = spark.createDataFrame([("Air Cylinder",), ("BALL (BUSH)",), (None,)], "item_name string")
    assert M.search_names(master, "air|ball").count() == 2
    assert M.search_names(master, "(bush)", literal=True).count() == 1 and M.search_names(master, "").count() == 3


def test_a_write_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffled():
        return {f for d in folders for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}

    before, was = shuffled(), spark.conf.get(setting)
    stored = written(spark.range(1000).repartition(7, "id"), "shuffled")
    assert spark.conf.get(setting) == was and len(stored.collect()) == 1000
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
