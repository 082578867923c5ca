"""Scores, trust filter, standard prices, anomalies, master and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.functions.text import search_text
from quotelens.operators import master as M
from quotelens.operators import pricing as P
from quotelens.operators.normalize import enrich_items, normalize_unit, score_header, score_item
from quotelens.plans.ranking import first_per_key, with_running_number
from workload import tables as T
from workload.registry import query
from workload.tables import sql

DATE = "2024-06-01"


@query("nrm_unit", sql("SELECT DISTINCT unit, unit_norm FROM scored", "scored"))
def nrm_unit(spark, sf):
    lines = T.raw_lines(spark, sf)
    return lines.select("unit", normalize_unit(F.col("unit")).alias("unit_norm")).distinct()


@query("scr_header", """
SELECT o_orderkey AS header_id, CAST(100 - CASE WHEN o_custkey % 3 = 0 THEN 15 ELSE 0 END
  - CASE WHEN o_orderkey % 5 = 0 THEN 10 ELSE 0 END - CASE WHEN o_orderstatus = 'P' THEN 10 ELSE 0 END
  - CASE WHEN o_orderpriority = '5-LOW' THEN 10 ELSE 0 END AS DOUBLE) / 100 AS confidence FROM orders""")
def scr_header(spark, sf):
    c = F.col
    return T.load(spark, sf, "orders").select(
        c("o_orderkey").alias("header_id"),
        score_header(
            F.when(c("o_custkey") % 3 != 0, F.lit("vendor")),
            F.when(c("o_orderkey") % 5 == 0, F.lit("")).otherwise(c("o_orderkey").cast("string")),
            F.when(c("o_orderstatus") != "P", c("o_orderdate").cast("date")),
            F.when(c("o_orderpriority") != "5-LOW", c("o_orderpriority")),
        ).cast("double").alias("confidence"),
    )


@query("scr_item", sql("SELECT header_id, unit_price, amount, score / 100.0::DOUBLE AS confidence FROM scored", "scored"))
def scr_item(spark, sf):
    c = F.col
    score = score_item(c("item_name"), c("unit"), c("quantity"), c("unit_price"), c("amount"))
    return T.raw_lines(spark, sf).select(
        "header_id", "unit_price", "amount", score.cast("double").alias("confidence")
    )


@query("scr_enrich", sql("""
SELECT unit_norm, score / 100.0::DOUBLE AS confidence, count(*) AS n FROM scored GROUP BY 1, 2""", "scored"))
def scr_enrich(spark, sf):
    return (
        enrich_items(T.raw_lines(spark, sf))
        .groupBy("unit_norm", F.col("confidence").cast("double").alias("confidence"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("flt_trust", sql("SELECT seq, item_name, unit_price FROM trusted", "trusted"))
def flt_trust(spark, sf):
    return T.trusted_lines(spark, sf).select("seq", "item_name", "unit_price")


@query("flt_search", sql("SELECT * FROM standard WHERE regexp_matches(item_name, '(?i)B(OLT|lue)')", "standard"))
def flt_search(spark, sf):
    return M.search_names(T.standard(spark, sf), "B(OLT|lue)")


@query("prj_search_text", """
SELECT p_partkey, trim(p_name || ' ' || CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_type END) AS search_text FROM part""")
def prj_search_text(spark, sf):
    c = F.col
    spec = F.when(c("p_partkey") % 13 != 0, c("p_type"))
    return T.load(spark, sf, "part").select(
        "p_partkey", search_text(c("p_name"), spec, c("p_partkey").cast("string")).alias("search_text")
    )


def _items_and_headers(spark, sf):
    headers = T.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("vendor"),
        F.concat(F.lit("Q-"), F.col("o_orderkey").cast("string")).alias("quote_no"),
        F.col("o_orderdate").cast("date").alias("quote_date"), F.col("o_orderpriority").alias("project"),
        (F.col("o_orderstatus") != "P").alias("parse_ok"),
    )
    items = T.load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("header_id"), "l_linenumber", F.floor("l_extendedprice").alias("amount")
    )
    return items, headers


@query("jn_header_item", """
SELECT l_orderkey AS header_id, 'Q-' || o_orderkey AS quote_no, CAST(o_orderdate AS DATE) AS quote_date,
  o_orderpriority AS project, CAST(floor(l_extendedprice) AS BIGINT) AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'""")
def jn_header_item(spark, sf):
    items, headers = _items_and_headers(spark, sf)
    return P.items_with_header(items, headers).filter("parse_ok").select(
        "header_id", "quote_no", "quote_date", "project", "amount"
    )


@query("agg_standard_price", sql("SELECT * FROM standard", "standard"))
def agg_standard_price(spark, sf):
    return T.standard(spark, sf)


@query("agg_standard_price_nulls", sql("""
SELECT item_name, spec, unit_norm AS unit, max(category) AS category, count(*) AS sample_count,
  min(unit_price) AS price_min, CAST((2 * sum(unit_price)::HUGEINT + count(*)) // (2 * count(*)) AS BIGINT) AS price_avg,
  max(unit_price) AS price_max, max(quote_date) AS latest_quote_date,
  string_agg(DISTINCT coalesce(vendor, ''), ', ' ORDER BY coalesce(vendor, '')) AS source_vendors
FROM trusted GROUP BY 1, 2, 3""", "trusted"))
def agg_standard_price_nulls(spark, sf):
    return P.standard_price(T.trusted_lines(spark, sf), min_samples=1, null_safe=False)


@query("agg_master_source", sql("SELECT * FROM source", "source"))
def agg_master_source(spark, sf):
    return T.source(spark, sf)


_ANOMALY = """
SELECT s.header_id, s.vendor, s.quote_no, s.quote_date, s.project, s.item_name, coalesce(s.spec, '') AS spec,
  s.unit_price AS submitted_price, m.price_avg AS std_price_avg,
  ((2 * (s.unit_price - m.price_avg) * 1000 + m.price_avg) // (2 * m.price_avg)) / 10.0::DOUBLE AS deviation_pct
FROM scored s JOIN standard m ON m.item_name = s.item_name AND m.spec = coalesce(s.spec, ''){unit}
WHERE s.unit_price * 100 > m.price_avg * 115 AND s.parse_ok"""


def _anomaly_columns(found):
    return found.select(
        "header_id", "vendor", "quote_no", "quote_date", "project", "item_name", "spec",
        F.col("unit_price").alias("submitted_price"), "std_price_avg",
        F.col("deviation_pct").cast("double").alias("deviation_pct"),
    )


def _blank_spec(lines):
    return lines.withColumn("spec", F.coalesce("spec", F.lit("")))


def anomaly_report(spark, sf):
    """Over-priced lines against the standard price of item, spec and unit, worst first."""
    found = P.anomalies(_blank_spec(T.scored_lines(spark, sf)), T.standard(spark, sf), include_unit=True)
    return _anomaly_columns(found).orderBy(F.desc("deviation_pct"), "header_id", "item_name", "spec", "submitted_price")


@query("jn_anomaly", sql(_ANOMALY.format(unit=""), "scored", "standard"))
def jn_anomaly(spark, sf):
    found = P.anomalies(_blank_spec(T.scored_lines(spark, sf)), T.standard(spark, sf))
    return _anomaly_columns(found)


@query("srt_anomaly", sql(_ANOMALY.format(unit=" AND m.unit = s.unit_norm") + " ORDER BY deviation_pct DESC", "scored", "standard"))
def srt_anomaly(spark, sf):
    return anomaly_report(spark, sf)


@query("dec_deviation_sql", sql("""
SELECT s.seq, s.unit_price, CASE WHEN m.price_avg <> 0 THEN
    sign(s.unit_price - m.price_avg) * ((2 * abs(s.unit_price - m.price_avg) * 1000 + m.price_avg) // (2 * m.price_avg)) / 10.0::DOUBLE END AS deviation_pct
FROM scored s JOIN standard m ON m.item_name = s.item_name AND m.spec = coalesce(s.spec, '') AND m.unit = s.unit_norm
""", "scored", "standard"))
def dec_deviation_sql(spark, sf):
    c = F.col
    prices = T.standard(spark, sf).select("item_name", "spec", c("unit").alias("unit_norm"), "price_avg")
    lines = _blank_spec(T.scored_lines(spark, sf)).select("seq", "item_name", "spec", "unit_norm", "unit_price")
    return lines.join(prices, ["item_name", "spec", "unit_norm"]).select(
        "seq", "unit_price", P.deviation_percent(c("unit_price"), c("price_avg")).cast("double").alias("deviation_pct")
    )


_LEGACY = """
SELECT item_name, coalesce(spec, '') AS spec, unit, arg_min(category, (seq, maker, category)) AS category,
  min(unit_price) AS price_min, CAST(CASE
    WHEN 2 * (sum(unit_price) % count(*)) > count(*) OR (2 * (sum(unit_price) % count(*)) = count(*) AND (sum(unit_price) // count(*)) % 2 = 1)
    THEN sum(unit_price) // count(*) + 1 ELSE sum(unit_price) // count(*) END AS BIGINT) AS price_avg,
  max(unit_price) AS price_max, count(*) AS data_count, arg_min(maker, (seq, maker, category)) AS main_maker,
  max(quote_date) AS latest_quote_date,
  string_agg(DISTINCT coalesce(vendor, ''), ', ' ORDER BY coalesce(vendor, '')) AS source_vendors, min(seq) AS first_seen
FROM lines WHERE unit_price > 0 GROUP BY 1, 2, 3"""


def _legacy(spark, sf):
    return P.legacy_master(_blank_spec(T.raw_lines(spark, sf)), "seq")


@query("agg_v1_master", sql(_LEGACY, "lines"))
def agg_v1_master(spark, sf):
    return _legacy(spark, sf)


@query("win_std_id", sql(f"""
SELECT 'STD-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS item_id, item_name, spec, unit
FROM (SELECT *, row_number() OVER (ORDER BY first_seen, item_name, spec, unit) AS n FROM ({_LEGACY}))""", "lines"))
def win_std_id(spark, sf):
    return M.standard_ids(_legacy(spark, sf)).select("item_id", "item_name", "spec", "unit")


@query("win_first_in_group", sql("""
SELECT item_name, spec, arg_min(maker, (seq, maker)) AS maker, min(seq) AS seq
FROM (SELECT item_name, coalesce(spec, '') AS spec, maker, seq FROM lines) GROUP BY 1, 2""", "lines"))
def win_first_in_group(spark, sf):
    lines = _blank_spec(T.raw_lines(spark, sf)).select("item_name", "spec", "maker", "seq")
    return first_per_key(lines, ["item_name", "spec"], ["seq", "maker"])


@query("jn_entry_date", sql(f"""
SELECT v.item_name, v.spec, v.unit, v.data_count, coalesce(d.entry_date, DATE '2024-06-01') AS entry_date FROM ({_LEGACY}) v
LEFT JOIN (SELECT item_name, coalesce(spec, '') AS spec, unit, max(quote_date) AS entry_date FROM lines
  WHERE project = '1-URGENT' AND maker = '' GROUP BY 1, 2, 3) d USING (item_name, spec, unit)""", "lines"))
def jn_entry_date(spark, sf):
    earlier = _blank_spec(T.raw_lines(spark, sf)).filter("project = '1-URGENT' AND maker = ''").select(
        "item_name", "spec", "unit", F.col("quote_date").alias("entry_date")
    )
    return P.keep_entry_dates(_legacy(spark, sf), earlier, F.lit(DATE).cast("date")).select(
        "item_name", "spec", "unit", "data_count", "entry_date"
    )


@query("srt_master", sql("SELECT item_name, spec, unit, price_avg FROM source ORDER BY item_name, spec, unit", "source"))
def srt_master(spark, sf):
    return T.source(spark, sf).select("item_name", "spec", "unit", "price_avg").orderBy("item_name", "spec", "unit")


_ACTION = """
SELECT s.item_name, s.spec, s.unit, CASE WHEN m.item_id IS NULL THEN 'inserted' WHEN m.manually_reviewed THEN 'skipped'
  ELSE 'updated' END AS action
FROM source s LEFT JOIN old_master m ON m.item_name = s.item_name AND m.spec = s.spec AND m.unit = s.unit"""


@query("jn_master_lookup", sql(_ACTION, "source", "old_master"))
def jn_master_lookup(spark, sf):
    return M.sync_actions(T.source(spark, sf), T.old_master(spark, sf)).select("item_name", "spec", "unit", "action")


@query("agg_sync_counts", sql(f"SELECT action, count(*) AS n FROM ({_ACTION}) GROUP BY 1", "source", "old_master"))
def agg_sync_counts(spark, sf):
    return M.sync_counts(M.sync_actions(T.source(spark, sf), T.old_master(spark, sf)))


_NEXT = """
SELECT 'SP-' || lpad(CAST(row_number() OVER (ORDER BY item_name, spec, unit)
    + (SELECT coalesce(max(CAST(substring(item_id, 4) AS BIGINT)), 0) FROM old_master) AS VARCHAR), 5, '0') AS item_id, s.*
FROM source s ANTI JOIN old_master USING (item_name, spec, unit)"""


@query("win_next_id", sql(f"SELECT item_id, item_name, spec, unit FROM ({_NEXT})", "source", "old_master"))
def win_next_id(spark, sf):
    master = T.old_master(spark, sf)
    unknown = T.source(spark, sf).join(master.select(*M.KEYS), M.KEYS, "left_anti")
    return M.issue_ids(unknown, M.next_id_start(master), "SP-", 5, M.KEYS).select("item_id", *M.KEYS)


@query("mst_sync", sql(f"""
SELECT m.item_id, m.item_name, m.spec, m.unit, CASE WHEN t.take THEN s.category ELSE m.category END AS category,
  CASE WHEN t.take THEN s.price_min ELSE m.price_min END AS price_min, CASE WHEN t.take THEN s.price_avg ELSE m.price_avg END AS price_avg,
  CASE WHEN t.take THEN s.price_max ELSE m.price_max END AS price_max, CASE WHEN t.take THEN s.data_count ELSE m.data_count END AS data_count,
  CASE WHEN t.take THEN s.main_maker ELSE m.main_maker END AS main_maker,
  CASE WHEN t.take THEN s.latest_quote_date ELSE m.latest_quote_date END AS latest_quote_date,
  CASE WHEN t.take THEN s.source_vendors ELSE m.source_vendors END AS source_vendors, m.manually_reviewed,
  t.take AS refreshed
FROM old_master m LEFT JOIN source s ON m.item_name = s.item_name AND m.spec = s.spec AND m.unit = s.unit,
  LATERAL (SELECT s.item_name IS NOT NULL AND NOT m.manually_reviewed AS take) t
UNION ALL SELECT item_id, item_name, spec, unit, category, price_min, price_avg, price_max, data_count, main_maker,
  latest_quote_date, source_vendors, false, true FROM ({_NEXT})""", "source", "old_master"))
def mst_sync(spark, sf):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    merged = M.sync_master(T.source(spark, sf), T.old_master(spark, sf), now)
    return merged.select(
        "item_id", *M.KEYS, *M.PRICES, "manually_reviewed", (F.col("updated_at") == now).alias("refreshed")
    )


@query("agg_status", sql("""
SELECT 'headers_ok' AS metric, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS n
UNION ALL SELECT 'items', (SELECT count(*) FROM scored) UNION ALL SELECT 'standard_prices', (SELECT count(*) FROM standard)
UNION ALL SELECT 'master_items', (SELECT count(*) FROM old_master)
UNION ALL SELECT 'master_reviewed', (SELECT count(*) FROM old_master WHERE manually_reviewed)""", "scored", "standard", "old_master"))
def agg_status(spark, sf):
    _, headers = _items_and_headers(spark, sf)
    return M.status(headers, T.scored_lines(spark, sf), T.standard(spark, sf), T.old_master(spark, sf))


_MASTER_TEXT = """
SELECT p_partkey AS item_id, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS item_name,
  coalesce(TRY_CAST(CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE), 0) AS price_avg,
  CAST(p_size AS DOUBLE) AS data_count FROM part"""


@query("src_master_load", f"SELECT * FROM ({_MASTER_TEXT}) WHERE item_name <> '' AND price_avg > 0")
def src_master_load(spark, sf):
    c = F.col
    raw = T.load(spark, sf, "part").select(
        c("p_partkey").alias("item_id"),
        F.when(c("p_partkey") % 17 == 0, "").otherwise(c("p_name")).alias(" item_name "),
        F.when(c("p_partkey") % 7 == 0, "n/a").otherwise(c("p_retailprice").cast("string")).alias("price_avg"),
        c("p_size").cast("string").alias("data_count "),
    )
    return M.load_master(raw)


@query("set_vendor_distinct", sql("""
SELECT item_name, string_agg(DISTINCT vendor, ', ' ORDER BY vendor) AS vendors FROM lines WHERE vendor <> '' GROUP BY 1""", "lines"))
def set_vendor_distinct(spark, sf):
    pairs = T.raw_lines(spark, sf).filter(F.col("vendor") != "").select("item_name", "vendor").distinct()
    return pairs.groupBy("item_name").agg(F.array_join(F.array_sort(F.collect_list("vendor")), ", ").alias("vendors"))


@query("set_append_master", sql("""
SELECT item_id, item_name, spec, unit, price_avg FROM old_master
UNION ALL SELECT item_id, item_name, spec, unit, price_avg FROM (""" + _NEXT + ")", "source", "old_master"))
def set_append_master(spark, sf):
    master = T.old_master(spark, sf)
    unknown = T.source(spark, sf).join(master.select(*M.KEYS), M.KEYS, "left_anti")
    added = M.issue_ids(unknown, M.next_id_start(master), "SP-", 5, M.KEYS)
    columns = ["item_id", *M.KEYS, "price_avg"]
    return master.select(columns).unionByName(added.select(columns))


@query("win_item_seq", sql("""
SELECT row_number() OVER (ORDER BY file_name, header_id, rn) AS item_seq, header_id, rn, item_name
FROM (SELECT '견적서(V' || customer || ').xlsx' AS file_name, * FROM numbered)""", "numbered"))
def win_item_seq(spark, sf):
    customers = T.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("header_id"),
        F.concat(F.lit("견적서(V"), F.col("o_custkey").cast("string"), F.lit(").xlsx")).alias("file_name"),
    )
    lines = T.numbered_lines(spark, sf).select("header_id", "rn", "item_name").join(customers, "header_id")
    order = [F.col("file_name"), F.col("header_id"), F.col("rn")]
    return with_running_number(lines, order, "item_seq").select("item_seq", "header_id", "rn", "item_name")


@query("agg_file_stats", """
SELECT l_orderkey AS header_id, count(*) AS items FROM lineitem GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM lineitem""")
def agg_file_stats(spark, sf):
    per_file = T.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("header_id")).agg(
        F.count(F.lit(1)).alias("items")
    )
    total = per_file.agg(F.sum("items").alias("items")).select(F.lit(None).cast("bigint").alias("header_id"), "items")
    return per_file.unionByName(total)


@query("opt_price_trend", sql("""
SELECT *, price_avg - lag(price_avg) OVER (PARTITION BY item_name, spec, unit ORDER BY quote_month) AS change FROM (
  SELECT item_name, coalesce(spec, '') AS spec, unit_norm AS unit, CAST(date_trunc('month', quote_date) AS DATE) AS quote_month,
    count(*) AS n, CAST((2 * sum(unit_price)::HUGEINT + count(*)) // (2 * count(*)) AS BIGINT) AS price_avg
  FROM trusted GROUP BY 1, 2, 3, 4)""", "trusted"))
def opt_price_trend(spark, sf):
    from quotelens.operators.roadmap import price_trend

    return price_trend(T.trusted_lines(spark, sf))


@query("opt_vendor_compare", sql("""
SELECT *, rank() OVER (PARTITION BY item_name, spec, unit ORDER BY price_avg) AS price_rank FROM (
  SELECT item_name, coalesce(spec, '') AS spec, unit_norm AS unit, vendor, count(*) AS n, min(unit_price) AS price_min,
    CAST((2 * sum(unit_price)::HUGEINT + count(*)) // (2 * count(*)) AS BIGINT) AS price_avg
  FROM trusted WHERE vendor <> '' GROUP BY 1, 2, 3, 4)""", "trusted"))
def opt_vendor_compare(spark, sf):
    from quotelens.operators.roadmap import vendor_compare

    return vendor_compare(T.trusted_lines(spark, sf))


@query("opt_category_discount", sql("""
SELECT seq, spec, unit_price, CAST(trunc(unit_price * (1 - coalesce(CASE spec WHEN 'ECONOMY' THEN 30.0::DOUBLE WHEN 'SMALL' THEN 12.5::DOUBLE END, 23.8::DOUBLE) / 100)) AS BIGINT) AS discount_price
FROM lines""", "lines"))
def opt_category_discount(spark, sf):
    from quotelens.operators.roadmap import category_discount

    lines = T.raw_lines(spark, sf).select("seq", "spec", "unit_price")
    return category_discount(lines, "spec", {"ECONOMY": 30.0, "SMALL": 12.5})


@query("opt_quality_profile", sql("""
SELECT count(*) AS items, count(*) FILTER (WHERE data_count = 1) / count(*) AS single_sample_share,
  count(*) FILTER (WHERE spec = '') / count(*) AS missing_spec_share,
  count(*) FILTER (WHERE main_maker = '') / count(*) AS missing_maker_share,
  count(*) FILTER (WHERE price_avg = 1) / count(*) AS one_won_share FROM (
  SELECT item_name, coalesce(spec, '') AS spec, unit_norm AS unit, count(*) AS data_count,
    CAST((2 * sum(unit_price)::HUGEINT + count(*)) // (2 * count(*)) AS BIGINT) AS price_avg,
    coalesce(max(maker) FILTER (WHERE maker <> ''), '') AS main_maker FROM trusted GROUP BY 1, 2, 3)""", "trusted"))
def opt_quality_profile(spark, sf):
    prices = P.master_source(T.trusted_lines(spark, sf), min_samples=1).withColumnRenamed("sample_count", "data_count")
    return M.quality_profile(prices)


@query("opt_name_normalise", sql(r"""
SELECT lower(regexp_replace(item_name || '-' || maker, '[^\p{L}\p{N}]', '', 'g')) AS name_key, count(*) AS n,
  min(item_name) AS item_name FROM lines GROUP BY 1""", "lines"))
def opt_name_normalise(spark, sf):
    from quotelens.operators.roadmap import name_key

    lines = T.raw_lines(spark, sf)
    key = name_key(F.concat_ws("-", "item_name", "maker"))
    return lines.groupBy(key.alias("name_key"), "item_name").agg(F.count(F.lit(1)).alias("n")).groupBy("name_key").agg(
        F.sum("n").alias("n"), F.min("item_name").alias("item_name")
    )
