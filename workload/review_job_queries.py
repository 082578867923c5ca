"""The review job over all quotation lines, and the log of edits it takes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quotelens import fixed_values as V
from quotelens.operators import review as R
from quotelens.operators import review_log as L
from quotelens.plans.checkpoints import scratch_path
from quotelens.plans.review import review_quotations
from workload import tables as T
from workload.registry import query
from workload.search_queries import _master
from workload.tables import CTE, NEEDS, sql

EARLY, LATE = date(1995, 6, 17), date(1997, 3, 1)
BASES = (V.BASIS_QUOTE, V.BASIS_STANDARD, V.BASIS_MARKET, V.BASIS_DISCOUNT)


def _edits(spark, sf):
    """Each line item as an edit of its part on the day it was shipped; returned ones withdraw."""
    c = F.col
    basis = F.element_at(F.array(*map(F.lit, BASES)), (c("l_quantity").cast("bigint") % 4 + 1).cast("int"))
    return T.load(spark, sf, "lineitem").select(
        c("l_partkey").alias("row_id"), c("l_shipdate").cast("date").alias("edited_on"),
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("revision"), (c("l_linenumber") + 10).cast("double").alias("discount"),
        basis.alias("basis"), (c("l_returnflag") == "R").alias("withdrawn"),
    )


def _log(spark, sf):
    path = scratch_path(spark, "edit-log")
    L.append_edits(_edits(spark, sf), path)
    return spark.read.parquet(path)


CTE["edits"] = f"""
SELECT l_partkey AS row_id, CAST(l_shipdate AS DATE) AS edited_on, l_orderkey * 10 + l_linenumber AS revision,
  CAST(l_linenumber + 10 AS DOUBLE) AS discount, {list(BASES)}[CAST(CAST(l_quantity AS BIGINT) % 4 + 1 AS INTEGER)] AS basis,
  l_returnflag = 'R' AS withdrawn FROM lineitem"""
NEEDS["edits"] = []
for _name, _day in (("edits_early", EARLY), ("edits_late", LATE)):
    CTE[_name] = f"""
SELECT row_id, discount, basis FROM (
  SELECT * FROM edits WHERE edited_on <= DATE '{_day}'
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY edited_on DESC, revision DESC, discount DESC, basis DESC, withdrawn DESC) = 1)
WHERE NOT withdrawn"""
    NEEDS[_name] = ["edits"]


@query("jn_overrides_as_of", sql(
    f"SELECT DATE '{EARLY}' AS as_of, * FROM edits_early UNION ALL SELECT DATE '{LATE}', * FROM edits_late",
    "edits_early", "edits_late"))
def jn_overrides_as_of(spark, sf):
    """Overrides of an early day from the whole log, of a late day from the log compacted between."""
    log, path = _log(spark, sf), scratch_path(spark, "edit-log")
    L.append_edits(L.compacted(log, date(1996, 1, 31)), path)
    early, late = L.edits_as_of(log, EARLY), L.edits_as_of(spark.read.parquet(path), LATE)
    return early.withColumn("as_of", F.lit(EARLY)).unionByName(late.withColumn("as_of", F.lit(LATE)))


# The review chain of the registered views, over lines matched by similarity.
CTE["job_compared0"] = """
SELECT l.* REPLACE (l.item_name || '-' || l.maker AS item_name), m.price_avg AS std_price_avg, m.item_name AS matched_name,
  round(f.similarity * 100, 1) AS similarity_pct,
  CASE WHEN m.price_avg > 0 THEN
    sign(l.unit_price - m.price_avg) * ((2 * abs(l.unit_price - m.price_avg) * 1000 + m.price_avg) // (2 * m.price_avg)) / 10.0::DOUBLE
  END AS deviation_pct
FROM lines l LEFT JOIN found_lines f ON f.query = trim(l.item_name || '-' || l.maker || ' ' || coalesce(l.spec, ''))
LEFT JOIN sim_master m ON m.item_id = f.item_id"""
CTE["job_market"] = """
SELECT p_name || '-' || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS item_name,
  CAST(floor(min(p_retailprice)) AS BIGINT) AS market_price FROM part WHERE p_name NOT LIKE 'blue%' GROUP BY 1"""
CTE["job_compared"] = CTE["compared"].replace("FROM compared0", "FROM job_compared0")
CTE["job_review0"] = CTE["review0"].replace("FROM compared c LEFT JOIN market m", "FROM job_compared c LEFT JOIN job_market m")
CTE["job_review1"] = CTE["review1"].replace("FROM review0", "FROM job_review0")
CTE["job_edited"] = """
SELECT r.* EXCLUDE (discount, discount_price), coalesce(e.discount, r.discount) AS discount, coalesce(e.basis, recommended) AS basis,
  CAST(trunc(quote_price * (1 - coalesce(e.discount, r.discount) / 100)) AS BIGINT) AS discount_price
FROM job_review1 r LEFT JOIN edits_late e ON e.row_id = r.part_id"""
CTE["job_review"] = CTE["review"].replace("recommended AS basis, CASE recommended", "CASE basis").replace("FROM review1", "FROM job_edited")
NEEDS.update({
    "job_compared0": ["lines", "found_lines", "sim_master"], "job_market": [], "job_compared": ["job_compared0"],
    "job_review0": ["job_compared", "job_market"], "job_review1": ["job_review0"],
    "job_edited": ["job_review1", "edits_late"], "job_review": ["job_edited"],
})
_COLUMNS = ["seq", "part_id", "item_name", "matched_name", "similarity_pct", "std_price_avg", "deviation_pct", "verdict",
            "quantity", "quote_price", "standard_price", "direction", "market_price", "recommended", "basis", "discount",
            "discount_price", "final_price"]


def _job(spark, sf):
    lines = T.raw_lines(spark, sf).withColumn("item_name", F.concat_ws("-", "item_name", "maker"))
    market = T.load(spark, sf, "part").filter(~F.col("p_name").startswith("blue")).groupBy(
        F.concat_ws("-", "p_name", F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.col("p_brand"))).alias("item_name")
    ).agg(F.floor(F.min("p_retailprice")).alias("market_price"))
    edits = L.edits_as_of(_log(spark, sf), LATE).withColumnRenamed("row_id", "part_id")
    return review_quotations(lines, _master(spark, sf), market, edits, "part_id")


@query("job_review", sql(f"""
SELECT {', '.join(_COLUMNS)}, basis <> recommended AS basis_changed, basis = recommended AND final_price < quote_price AS is_saving
FROM job_review""", "job_review"))
def job_review(spark, sf):
    return _job(spark, sf).select(*_COLUMNS, "basis_changed", "is_saving")


@query("job_review_summary", sql("""
SELECT sum(quote_price * quantity) AS total_quote, sum(final_price * quantity) AS total_final,
  sum(quote_price * quantity) - sum(final_price * quantity) AS saved,
  (sum(quote_price * quantity) - sum(final_price * quantity)) / sum(quote_price * quantity) * 100 AS saved_pct FROM job_review""",
    "job_review"))
def job_review_summary(spark, sf):
    return R.review_summary(_job(spark, sf))
