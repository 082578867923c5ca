"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens import fixed_values as V
from quotelens.functions import text as X
from workload import tables as T
from workload.registry import query

_NUMBER_TEXT = """
SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN CAST(p_partkey AS VARCHAR) || ',000' WHEN 1 THEN ' ' || p_partkey || '.75 ' WHEN 2 THEN p_partkey || 'd'
  WHEN 3 THEN '-' || p_partkey WHEN 4 THEN '1_' || p_partkey WHEN 5 THEN 'nan' WHEN 6 THEN '' ELSE '　' || p_partkey || 'e1' END AS raw, p_size % 8 AS k FROM part"""


@query("fn_num", f"""
SELECT p_partkey, raw, k IN (0, 1, 3, 7) AS is_number,
  CASE k WHEN 0 THEN p_partkey * 1000.0::DOUBLE WHEN 1 THEN p_partkey + 0.75::DOUBLE WHEN 3 THEN -1.0::DOUBLE * p_partkey WHEN 7 THEN p_partkey * 10.0::DOUBLE END AS as_double,
  CASE k WHEN 0 THEN p_partkey * 1000 WHEN 1 THEN p_partkey WHEN 3 THEN -p_partkey WHEN 7 THEN p_partkey * 10 END AS as_long,
  CASE k WHEN 0 THEN p_partkey * 1000 WHEN 3 THEN -p_partkey END AS as_strict FROM ({_NUMBER_TEXT})""")
def fn_num(spark, sf):
    c = F.col
    key = c("p_partkey").cast("string")
    choice = F
    forms = [
        F.concat(key, F.lit(",000")), F.concat(F.lit(" "), key, F.lit(".75 ")), F.concat(key, F.lit("d")),
        F.concat(F.lit("-"), key), F.concat(F.lit("1_"), key), F.lit("nan"), F.lit(""),
    ]
    for k, form in enumerate(forms):
        choice = choice.when(c("p_size") % 8 == k, form)
    raw = choice.otherwise(F.concat(F.lit("　"), key, F.lit("e1")))
    return T.load(spark, sf, "part").select("p_partkey", raw.alias("raw")).select(
        "p_partkey", "raw", X.is_number(c("raw")).alias("is_number"), X.to_double(c("raw")).alias("as_double"),
        X.to_long(c("raw")).alias("as_long"), X.to_long_strict(c("raw")).alias("as_strict"),
    )


@query("fn_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 3) THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def fn_date(spark, sf):
    c = F.col
    d = c("o_orderdate")
    k = c("o_orderkey") % 6
    raw = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 1, F.concat(F.lit("제출일: "), F.date_format(d, "yyyy.M.d")))
        .when(k == 2, F.date_format(d, "yyyy'년'M'월'd'일'"))
        .when(k == 3, F.date_format(d, "yyyy/MM/dd"))
        .when(k == 4, F.date_format(d, "yyyy'년' M'월' d'일'"))
        .otherwise(F.concat(F.date_format(d, "yyyy"), F.lit("-02-30")))
    )
    return T.load(spark, sf, "orders").select("o_orderkey", X.parse_date(raw).alias("parsed"))


@query("fn_clean", r"""
SELECT doc_id, md5(replace(regexp_replace(text, '^[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]+$', '', 'g'), chr(10), ' ')) AS cleaned FROM documents""")
def fn_clean(spark, sf):
    return T.load(spark, sf, "documents").select("doc_id", F.md5(X.one_line(F.col("text"))).alias("cleaned"))


@query("fn_prefix_strip", """
SELECT p_partkey, p_name AS stripped, p_size % 3 = 0 AS zero_start FROM part""")
def fn_prefix_strip(spark, sf):
    c = F.col
    raw = F.concat(F.when(c("p_size") % 2 == 0, F.lit("■□ ")).otherwise(F.lit("●○")), c("p_name"))
    stripped = X.strip(F.ltrim(raw, F.lit(V.BULLETS)))
    code = F.concat((c("p_size") % 3).cast("string"), c("p_name"))
    return T.load(spark, sf, "part").select("p_partkey", stripped.alias("stripped"), code.startswith("0").alias("zero_start"))


@query("fn_case", r"""
SELECT doc_id, md5(lower(text)) AS lowered, md5(upper(lang)) AS uppered, regexp_matches(text, '(?i)THE') AS hit FROM documents""")
def fn_case(spark, sf):
    return T.load(spark, sf, "documents").select(
        "doc_id", F.md5(F.lower("text")).alias("lowered"), F.md5(F.upper("lang")).alias("uppered"),
        F.col("text").rlike("(?i)THE").alias("hit"),
    )


@query("fn_regex", r"""
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_matches(url, '\d{3}') AS has_number,
  len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def fn_regex(spark, sf):
    return T.load(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.col("url").rlike(r"\d{3}").alias("has_number"),
        F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("bigint").alias("paragraphs"),
    )


@query("fn_format", """
SELECT o_orderkey, 'SP-' || CASE WHEN o_orderkey < 100000 THEN lpad(CAST(o_orderkey AS VARCHAR), 5, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS id,
  format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS thousands, printf('%+.1f%%', (o_custkey % 100 - 50) / 10.0::DOUBLE) AS percent
FROM orders""")
def fn_format(spark, sf):
    c = F.col
    return T.load(spark, sf, "orders").select(
        "o_orderkey", X.padded_id("SP-", 5, c("o_orderkey")).alias("id"),
        F.format_number(F.floor("o_totalprice"), 0).alias("thousands"),
        X.signed_percent((c("o_custkey") % 100 - 50) / F.lit(10.0), "%+.1f%%").alias("percent"),
    )


@query("fn_null", """
SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END, ''), 'none') AS brand,
  p_retailprice / nullif(p_size % 4, 0) AS ratio FROM part""")
def fn_null(spark, sf):
    c = F.col
    brand = F.when(c("p_size") % 3 == 0, F.lit("")).otherwise(c("p_brand"))
    return T.load(spark, sf, "part").select(
        "p_partkey", X.blank_to(brand, F.lit("none")).alias("brand"),
        (c("p_retailprice") / F.nullif(c("p_size") % 4, F.lit(0))).alias("ratio"),
    )


@query("fn_math", """
SELECT s_suppkey, abs(s_acctbal) AS magnitude, sqrt(abs(s_acctbal)) AS root, CAST(trunc(s_acctbal) AS BIGINT) AS whole,
  greatest(1.0::DOUBLE, s_acctbal) AS at_least_one, round_even(s_suppkey / 2.0::DOUBLE, 0) AS half_even FROM supplier""")
def fn_math(spark, sf):
    c = F.col
    return T.load(spark, sf, "supplier").select(
        "s_suppkey", F.abs("s_acctbal").alias("magnitude"), F.sqrt(F.abs("s_acctbal")).alias("root"),
        c("s_acctbal").cast("bigint").alias("whole"), F.greatest(F.lit(1.0), c("s_acctbal")).alias("at_least_one"),
        F.bround(c("s_suppkey") / F.lit(2.0), 0).alias("half_even"),
    )


@query("fn_array", """
SELECT vec_id, round(CAST(embedding[-3] AS DOUBLE), 6) AS third_last, len(list_filter(embedding, lambda x: x > 0)) AS positive,
  len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS any_big, len(list_filter(embedding, lambda x: x < 1)) = len(embedding) AS all_small,
  round(list_sum(list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE))), 6) AS head FROM embeddings""")
def fn_array(spark, sf):
    e = F.col("embedding")
    return T.load(spark, sf, "embeddings").select(
        "vec_id", F.round(X.from_end(e, 3).cast("double"), 6).alias("third_last"),
        F.size(F.filter(e, lambda v: v > 0)).cast("bigint").alias("positive"),
        F.exists(e, lambda v: v > 0.3).alias("any_big"), F.forall(e, lambda v: v < 1).alias("all_small"),
        F.round(F.aggregate(F.slice(e, 1, 4), F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("head"),
    )


@query("fn_hash", "SELECT item_id, sha256(text) AS hash FROM benchmark")
def fn_hash(spark, sf):
    return T.load(spark, sf, "benchmark").select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("fn_now", """
SELECT event_id, strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS utc_text, CAST(ts AS DATE) AS day FROM events""")
def fn_now(spark, sf):
    ts = F.col("ts")
    return T.load(spark, sf, "events").select(
        "event_id", F.date_format(F.to_utc_timestamp(ts, "Asia/Seoul"), "yyyy-MM-dd HH:mm:ss").alias("utc_text"),
        ts.cast("date").alias("day"),
    )
