"""Comparison, verdicts, recommendation, overrides, summaries, review records and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens import fixed_values as V
from quotelens.operators import master as M
from quotelens.operators import review as R
from quotelens.plans.checkpoints import scratch_path, written
from quotelens.sources import sinks
from workload import tables as T
from workload.registry import query
from workload.tables import sql

TODAY = "2024-06-01"


def _today():
    return F.lit(TODAY).cast("date")


def _compared(spark, sf):
    return R.compare(T.compared_input(spark, sf))


def _with_market(spark, sf):
    return R.with_market_price(_compared(spark, sf), T.market_prices(spark, sf))


def _review(spark, sf):
    return R.review_table(_with_market(spark, sf))


@query("dec_deviation", sql("SELECT seq, unit_price, std_price_avg, deviation_pct FROM compared0", "compared0"))
def dec_deviation(spark, sf):
    return _compared(spark, sf).select("seq", "unit_price", "std_price_avg", "deviation_pct")


@query("dec_verdict", sql("SELECT seq, deviation_pct, verdict, is_abnormal FROM compared", "compared"))
def dec_verdict(spark, sf):
    return _compared(spark, sf).select("seq", "deviation_pct", "verdict", "is_abnormal")


@query("flt_abnormal", sql("SELECT seq, item_name, verdict FROM compared WHERE is_abnormal", "compared"))
def flt_abnormal(spark, sf):
    return R.abnormal_only(_compared(spark, sf)).select("seq", "item_name", "verdict")


_UNMATCHED = "std_price_avg IS NULL OR coalesce(similarity_pct, 0) < 20"


@query("flt_unmatched", sql(f"SELECT seq, item_name, similarity_pct FROM compared WHERE {_UNMATCHED}", "compared"))
def flt_unmatched(spark, sf):
    return R.unmatched(_compared(spark, sf)).select("seq", "item_name", "similarity_pct")


@query("dec_negotiable", sql("""
SELECT seq, item_name, CAST(trunc((unit_price - std_price_avg) * coalesce(quantity, 1)) AS BIGINT) AS negotiable
FROM compared WHERE is_abnormal""", "compared"))
def dec_negotiable(spark, sf):
    c = F.col
    gap = R.negotiable(c("unit_price"), c("std_price_avg"), c("quantity"))
    return R.abnormal_only(_compared(spark, sf)).select("seq", "item_name", gap.alias("negotiable"))


@query("dec_discount", sql("""
SELECT seq, unit_price, CAST(trunc(unit_price * (1 - CAST(p_size AS DOUBLE) / 100)) AS BIGINT) AS discount_price FROM lines""", "lines"))
def dec_discount(spark, sf):
    c = F.col
    return T.raw_lines(spark, sf).select(
        "seq", "unit_price", R.discounted(c("unit_price"), c("p_size").cast("double")).alias("discount_price")
    )


def _columns(name: str, columns: list[str]):
    @query(name, sql(f"SELECT {', '.join(columns)} FROM review", "review"))
    def run(spark, sf):
        return _review(spark, sf).select(*columns)


_columns("dec_has_db", ["seq", "std_price_avg", "similarity_pct", "has_db", "standard_price"])
_columns("dec_direction", ["seq", "quote_price", "standard_price", "direction"])
_columns("dec_recommend", ["seq", "quote_price", "standard_price", "market_price", "discount_price", "recommended"])
_columns("dec_final_price", ["seq", "basis", "quote_price", "standard_price", "market_price", "discount_price", "final_price"])
_columns("dec_review", [
    "unit_name", "item_name", "spec", "unit", "quantity", "quote_price", "has_db", "standard_price", "direction",
    "market_price", "discount", "discount_price", "recommended", "basis", "final_price"])


@query("jn_market", sql("""
SELECT seq, c.item_name, coalesce(m.market_price, 0) AS market_price FROM compared c LEFT JOIN market m ON m.item_name = c.item_name
""", "compared", "market"))
def jn_market(spark, sf):
    return _with_market(spark, sf).select("seq", "item_name", "market_price")


@query("agg_hits", sql(f"""
SELECT count(*) AS unmatched, count(m.item_name) AS with_market_price FROM compared c LEFT JOIN market m ON m.item_name = c.item_name
WHERE {_UNMATCHED}""", "compared", "market"))
def agg_hits(spark, sf):
    return R.market_coverage(R.unmatched(_compared(spark, sf)), T.market_prices(spark, sf))


@query("agg_kpis", sql("""
SELECT count(*) AS total_items, count(std_price_avg) AS matched, count(*) FILTER (WHERE is_abnormal) AS abnormal,
  CAST(sum(unit_price) AS BIGINT) AS total_quote, CAST(sum(coalesce(std_price_avg, unit_price)) AS BIGINT) AS total_std,
  CAST(sum(coalesce(std_price_avg, unit_price)) AS DOUBLE) * 15 / 100 AS saving FROM compared""", "compared"))
def agg_kpis(spark, sf):
    return R.comparison_kpis(_compared(spark, sf))


_SUMMARY = """
SELECT sum(quote_price * quantity) AS total_quote, sum(final_price * quantity) AS total_final,
  sum(quote_price * quantity) - sum(final_price * quantity) AS saved,
  (sum(quote_price * quantity) - sum(final_price * quantity)) / sum(quote_price * quantity) * 100 AS saved_pct FROM {}"""


@query("agg_review_summary", sql(_SUMMARY.format("review"), "review"))
def agg_review_summary(spark, sf):
    return R.review_summary(_review(spark, sf))


# Part prices reviewed row by row; the part number is the row id of user edits.
_PARTS = """
parts0 AS (SELECT p_partkey AS row_id, p_name AS item_name, CAST(floor(p_retailprice) AS BIGINT) AS quote_price,
    CASE WHEN p_size >= 10 THEN CAST(p_size * 40 AS BIGINT) ELSE 0 END AS standard_price, coalesce(m.market_price, 0) AS market_price,
    CAST(1 + p_size % 3 AS DOUBLE) AS quantity,
    CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS DOUBLE) ELSE 23.8::DOUBLE END AS discount
  FROM part LEFT JOIN market m ON m.item_name = p_name),
parts1 AS (SELECT *, CAST(trunc(quote_price * (1 - 23.8::DOUBLE / 100)) AS BIGINT) AS first_price,
    CAST(trunc(quote_price * (1 - discount / 100)) AS BIGINT) AS discount_price FROM parts0),
parts2 AS (SELECT *, CASE WHEN standard_price > 0 AND quote_price <= standard_price THEN '견적가 적용'
    WHEN standard_price > 0 THEN '표준단가 적용'
    WHEN market_price > 0 AND market_price < first_price THEN '시장가 적용' ELSE '할인율 적용' END AS recommended FROM parts1),
parts3 AS (SELECT *, CASE WHEN row_id % 6 = 0 THEN '시장가 적용' WHEN row_id % 6 = 1 THEN '표준단가 적용' ELSE recommended END AS basis FROM parts2),
parts AS (SELECT *, CASE basis WHEN '견적가 적용' THEN quote_price
    WHEN '표준단가 적용' THEN CASE WHEN standard_price <> 0 THEN standard_price ELSE quote_price END
    WHEN '시장가 적용' THEN CASE WHEN market_price <> 0 THEN market_price ELSE discount_price END
    ELSE discount_price END AS final_price FROM parts3)
"""


def _parts_sql(body: str) -> str:
    return sql("", "market").rstrip() + "," + _PARTS + body


def _edited_parts(spark, sf):
    c = F.col
    part = T.load(spark, sf, "part")
    lines = part.select(
        c("p_partkey").alias("row_id"), c("p_name").alias("item_name"), F.floor("p_retailprice").alias("unit_price"),
        F.when(c("p_size") >= 10, c("p_size") * 40).cast("bigint").alias("std_price_avg"),
        F.lit(100.0).alias("similarity_pct"), (1 + c("p_size") % 3).cast("double").alias("quantity"),
    )
    review = R.review_table(R.with_market_price(lines, T.market_prices(spark, sf)))
    edits = part.select(
        c("p_partkey").alias("row_id"),
        F.when(c("p_size") % 4 == 0, c("p_size").cast("double")).alias("discount"),
        F.when(c("p_partkey") % 6 == 0, F.lit(V.BASIS_MARKET))
        .when(c("p_partkey") % 6 == 1, F.lit(V.BASIS_STANDARD)).alias("basis"),
    ).filter("discount IS NOT NULL OR basis IS NOT NULL")
    return R.apply_overrides(review, edits)


@query("jn_overrides", _parts_sql("SELECT row_id, discount, basis, discount_price, final_price FROM parts"))
def jn_overrides(spark, sf):
    return _edited_parts(spark, sf).select("row_id", "discount", "basis", "discount_price", "final_price")


@query("dec_override_mark", _parts_sql("""
SELECT row_id, recommended, basis, basis <> recommended AS basis_changed,
  basis = recommended AND final_price < quote_price AS is_saving FROM parts"""))
def dec_override_mark(spark, sf):
    return R.mark_overrides(_edited_parts(spark, sf)).select(
        "row_id", "recommended", "basis", "basis_changed", "is_saving"
    )


def _reviewed_master(spark, sf):
    """Master keyed by item and spec that new reviewed items are checked against."""
    return T.old_master(spark, sf)


_ADDED = """
added AS (SELECT item_name, spec, arg_min(unit, (seq, unit, final_price)) AS unit,
    arg_min(final_price, (seq, unit, final_price)) AS final_price, min(seq) AS seq
  FROM (SELECT seq, item_name || '-' || maker AS item_name, coalesce(spec, '') AS spec, unit, final_price FROM review
    WHERE standard_price = 0 AND final_price > 0) n
  ANTI JOIN (SELECT item_name, spec FROM old_master) m USING (item_name, spec) GROUP BY 1, 2),
numbered_added AS (SELECT *, (SELECT count(*) FROM old_master) + row_number() OVER (ORDER BY seq, item_name, spec) AS no FROM added),
new_items AS (SELECT 'STD-' || CASE WHEN no < 10000 THEN lpad(CAST(no AS VARCHAR), 4, '0') ELSE CAST(no AS VARCHAR) END AS item_id,
  item_name, spec, unit, final_price FROM numbered_added)
"""


def _added_sql(body: str) -> str:
    return sql("", "review", "old_master").rstrip() + "," + _ADDED + body


def _new_names(spark, sf):
    """Reviewed lines named by item and maker, so that many are unknown to the master."""
    return _review(spark, sf).withColumns({
        "item_name": F.concat_ws("-", "item_name", "maker"), "spec": F.coalesce("spec", F.lit("")),
    })


def _additions(spark, sf):
    return M.reviewed_additions(_new_names(spark, sf), T.old_master(spark, sf), "seq", "upload.xlsx", _today())


@query("jn_new_master", _added_sql("SELECT item_name, spec, unit, final_price AS price_avg FROM new_items"))
def jn_new_master(spark, sf):
    return _additions(spark, sf).select("item_name", "spec", "unit", "price_avg")


@query("win_append_id", _added_sql("SELECT item_id, item_name, spec FROM new_items"))
def win_append_id(spark, sf):
    return _additions(spark, sf).select("item_id", "item_name", "spec")


@query("mst_append_reviewed", _added_sql("""
SELECT item_id, item_name, spec, unit, category, price_min, price_avg, price_max, data_count, main_maker, latest_quote_date, source_vendors
FROM old_master UNION ALL
SELECT item_id, item_name, spec, unit, '설비', final_price, final_price, final_price, 1, '', DATE '2024-06-01', '검토확정(upload.xlsx)'
FROM new_items"""))
def mst_append_reviewed(spark, sf):
    return M.append_reviewed(_new_names(spark, sf), T.old_master(spark, sf), "seq", "upload.xlsx", _today())


_RECORDS = """
SELECT DATE '2024-06-01' AS review_date, 'upload.xlsx' AS source_file, unit_name, item_name, coalesce(spec, '') AS spec, unit,
  quantity, quote_price, final_price, basis, standard_price, market_price, discount FROM review"""


@query("snk_review_append", sql(_RECORDS + " UNION ALL" + _RECORDS.replace("2024-06-01", "2024-05-01"), "review"))
def snk_review_append(spark, sf):
    """Two review batches appended to one stored log, read back whole."""
    # Worked out and stored once; both batches are written from there.
    review, path = written(_review(spark, sf).select(*sinks.REVIEW_INPUT), "review"), scratch_path(spark, "review-log")
    for day in ("2024-05-01", TODAY):
        sinks.append_table(sinks.review_records(review, "upload.xlsx", F.lit(day).cast("date")), path)
    return spark.read.parquet(path)


@query("set_append_review", sql(_RECORDS.replace("SELECT", "SELECT 'new' AS batch,", 1) + " UNION ALL"
                                + _RECORDS.replace("SELECT", "SELECT 'old' AS batch,", 1), "review"))
def set_append_review(spark, sf):
    records = sinks.review_records(_review(spark, sf), "upload.xlsx", _today())
    return records.withColumn("batch", F.lit("old")).unionByName(records.withColumn("batch", F.lit("new")))


def _as(headers: dict, swap: dict | None = None) -> str:
    swap = swap or {}
    return ", ".join(f'{swap.get(c, c)} AS "{h}"' for c, h in headers.items())


@query("snk_compare_export", sql(f"SELECT {_as(sinks.COMPARE_EXPORT)} FROM compared", "compared"))
def snk_compare_export(spark, sf):
    return sinks.export(_compared(spark, sf), sinks.COMPARE_EXPORT)


@query("snk_review_export", sql(
    f"SELECT {_as(sinks.REVIEW_EXPORT, {'db_mark': chr(39).join(['CASE WHEN has_db THEN ', '✅', ' ELSE ', '❌', ' END'])})} FROM review",
    "review"))
def snk_review_export(spark, sf):
    mark = F.when(F.col("has_db"), F.lit(V.MARK_YES)).otherwise(F.lit(V.MARK_NO))
    return sinks.export(_review(spark, sf).withColumn("db_mark", mark), sinks.REVIEW_EXPORT)


@query("snk_master_export", sql(
    f"SELECT {_as(sinks.MASTER_EXPORT, {'entry_date': 'DATE ' + repr(TODAY)})} FROM old_master", "old_master"))
def snk_master_export(spark, sf):
    return sinks.export(T.old_master(spark, sf).withColumn("entry_date", _today()), sinks.MASTER_EXPORT)


@query("snk_raw_export", sql(
    f"SELECT {_as(sinks.RAW_EXPORT, {'entry_date': 'DATE ' + repr(TODAY), 'id': 'seq'})} FROM lines", "lines"))
def snk_raw_export(spark, sf):
    lines = T.raw_lines(spark, sf).withColumns({"entry_date": _today(), "id": F.col("seq")})
    return sinks.export(lines, sinks.RAW_EXPORT)


@query("snk_json", sql("""
SELECT item_name, count(*) AS n, CAST(sum(unit_price) AS BIGINT) AS total FROM lines GROUP BY 1""", "lines"))
def snk_json(spark, sf):
    """Raw lines written as JSON and aggregated from what was read back."""
    path = scratch_path(spark, "raw-items")
    lines = T.raw_lines(spark, sf).select("item_name", "spec", "unit", "unit_price", "quote_date")
    sinks.write_json(lines, path)
    back = spark.read.schema(lines.schema).json(path)
    return back.groupBy("item_name").agg(F.count(F.lit(1)).alias("n"), F.sum("unit_price").alias("total"))


@query("src_json_load", sql("SELECT * FROM standard", "standard"))
def src_json_load(spark, sf):
    """Aggregated prices stored as JSON documents and loaded with their schema."""
    path = scratch_path(spark, "aggregate")
    prices = T.standard(spark, sf)
    sinks.write_json(prices, path)
    return spark.read.schema(prices.schema).json(path)
