"""The registered query of every corpus operator, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm.bpe import encode
from quotelens.llm.exact import exact_groups
from quotelens.llm.fim import fill_in_middle, restored
from quotelens.llm.language import held_out, identify
from quotelens.llm.mixing import mix
from quotelens.llm.negatives import hard_negatives
from quotelens.llm.packing import pack
from quotelens.llm.secrets import find_secrets
from quotelens.llm.sharding import byte_shards
from quotelens.llm.simhash import near_groups
from quotelens.llm.substrings import remove_shared_words
from quotelens.llm.suffixes import remove_repeated_bytes
from quotelens.llm.topk import top_inner_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)
_KINDS = (
    ("assign", _ASSIGN, "hit"), ("access", "AKIA[A-Z0-9]{16,}", "hit"), ("hex", "[0-9a-f]{24,}", "hit"),
    ("owned", "[A-Za-z0-9+/_=-]{20,}", "hit"),
)


def _kind_sql(number: int) -> str:
    _, pattern, _ = _KINDS[number]
    value = f"regexp_extract(hit, '{pattern}', 2)" if number == 0 else "hit"
    return f"""
    SELECT rid, {number} AS kind, start, start + length(hit) AS stop, {value} AS val FROM (
      SELECT rid, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) - length(hit) AS start FROM (
        SELECT rid, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM (
          SELECT rid, regexp_extract_all(body, '{pattern}') AS hits, string_split_regex(body, '{pattern}') AS gaps
          FROM docs)))"""


_SECRETS_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body, coalesce(source, '') AS owner,
         coalesce(lang, '') AS lang FROM documents),
loose AS ({' UNION ALL '.join(_kind_sql(k) for k in range(4))}),
base AS (SELECT * FROM loose WHERE kind IN (1, 2) OR (kind = 0 AND length(val) >= 6)),
other AS (
  SELECT * FROM loose o WHERE kind = 3 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.start < o.stop AND o.start < b.stop)),
every AS (SELECT s.*, d.owner, d.lang FROM (SELECT * FROM base UNION ALL SELECT * FROM other) s JOIN docs d USING (rid)),
spread AS (
  SELECT val, count(DISTINCT owner) < 3 AND count(DISTINCT (owner, lang)) < 3 AS live FROM every GROUP BY val),
judged AS (
  SELECT rid, kind, start, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS span,
         live
  FROM every JOIN spread USING (val) WHERE kind < 3 OR live),
gathered AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
         string_agg(span, ',' ORDER BY start, kind) AS spans, count(*) FILTER (kind = 3) AS n_owned,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN gathered USING (rid)"""


@_query("op1_secret_spans", _SECRETS_SQL)
def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


@_query("op2_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents")).drop("row_key")


@_query("op3_shared_words")
def shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_shared_words(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256"
    )


@_query("op4_source_mix", r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR) AS turn FROM documents),
sources AS (
  SELECT source, sum(size)::HUGEINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM docs GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weights_left,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0) AS words_left
  FROM sources WINDOW earlier AS (
    ORDER BY 3 * source_size * (10 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max(weights_left) AS weights_left, arg_max(words_left, weights_left) AS words_left
  FROM ranked WHERE cap * weights_left >= weight * words_left),
targets AS (
  SELECT source, source_size, total,
         CASE WHEN r.weights_left > l.weights_left THEN cap::DOUBLE
              ELSE (weight * l.words_left)::DOUBLE / l.weights_left::DOUBLE END AS target
  FROM ranked r, level l),
queued AS (
  SELECT d.*, t.source_size, t.target, t.total,
         sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id ROWS UNBOUNDED PRECEDING) AS through
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT doc_id, source, turn, size, total, lap, (lap * source_size + through)::DOUBLE / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS lap) WHERE size > 0 AND target > 0),
served AS (
  SELECT doc_id, total, sum(size) OVER (ORDER BY finish, source NULLS LAST, turn, doc_id, lap ROWS UNBOUNDED PRECEDING) AS used
  FROM items),
laps AS (SELECT doc_id, count(*) AS passes FROM served WHERE used <= total GROUP BY doc_id)
SELECT doc_id, source, size, source_size::BIGINT AS source_size, target, coalesce(passes, 0) AS passes,
       size * coalesce(passes, 0) AS taken
FROM queued LEFT JOIN laps USING (doc_id)""")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).drop("row_key")


@_query("op5_byte_shards", r"""
WITH RECURSIVE steps AS (
  SELECT n, 0 AS k, n AS c FROM range(256) t(n)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, sha256(coalesce(text, '')) AS text_sha256,
         xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
             lambda b: ('0x' || b)::BIGINT)),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM documents, tab),
laid AS (
  SELECT *, sum(size) OVER same AS group_bytes, count(*) OVER same > 1 AS grouped, sum(size) OVER () AS total
  FROM docs WINDOW same AS (PARTITION BY text_sha256)),
placed AS (
  SELECT *, sum(size) OVER line - size AS before, row_number() OVER line AS place
  FROM laid WINDOW line AS (ORDER BY group_bytes DESC, text_sha256, doc_id ROWS UNBOUNDED PRECEDING)),
cut AS (
  SELECT *, (CASE WHEN grouped AND group_bytes * 16 <= total
                  THEN 2 * min(before) OVER (PARTITION BY text_sha256) + group_bytes
                  ELSE 2 * before + size END * 16 // (2 * total))::INT AS shard
  FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, text_sha256, 'bytes' AS law, shard,
       place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard
FROM cut""")
def shards_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "text_sha256", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query("op6_top_inner_products", """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
  FROM scored) WHERE rank <= 5""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query("op7_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@_query("op8_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@_query("op9_length_buckets")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


@_query("op10_repeated_bytes")
def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256"
    )


@_query("op11_fill_in_middle", r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t FROM documents),
drawn AS (
  SELECT doc_id, body, t, len(t)::BIGINT AS n, ('0x' || d[1:8])::BIGINT % (len(t) + 1) AS a,
         ('0x' || d[9:16])::BIGINT % (len(t) + 1) AS b, ('0x' || d[17:24])::BIGINT % 100 AS h3,
         ('0x' || d[25:32])::BIGINT % 100 AS h4 FROM docs),
parts AS (
  SELECT doc_id, body, n, array_to_string(t[1:least(a, b)], '') AS p,
         array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(t[greatest(a, b) + 1:n], '') AS s,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 >= 90
              THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(body) AS restored_sha256
FROM parts""")
def fim_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(_table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@_query("op13_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    coded = encode(_table(spark, sf_dir, "documents"), path, decoded_into="decoded")
    return coded.select(
        "doc_id", (F.length("tokens") / 4).cast("bigint").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query("op12_hard_negatives", """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_dot_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM good a JOIN good c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER best)::INT AS rank, n.vec_id AS negative_id, positive_score,
       n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER best <= 3""")
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)
