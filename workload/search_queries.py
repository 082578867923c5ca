"""Text similarity, vector similarity and market search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.functions.text import padded_id
from quotelens.operators import market as K
from quotelens.operators import review as R
from quotelens.operators import similarity as S
from quotelens import fixed_values as V
from quotelens.sources.vectors import VectorIndex, build_vector_index, load_vectors, save_vectors, search_many
from quotelens.plans.checkpoints import scratch_path
from workload import tables as T
from workload.registry import query
from workload.tables import CTE, NEEDS, sql


def _master(spark, sf):
    """One master row per part name and type, numbered by its lowest part."""
    p = F.floor("p_retailprice")
    return T.load(spark, sf, "part").groupBy(F.col("p_name").alias("item_name"), F.col("p_type").alias("spec")).agg(
        F.min("p_partkey").alias("first"), F.min(p).alias("price_min"), F.max(p).alias("price_max"),
        F.min(p).alias("price_avg"),
    ).withColumn("item_id", padded_id("SP-", 9, F.col("first"))).drop("first")


def _queries(spark, sf):
    return T.load(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("query")).distinct()


def _gram_sql(text: str) -> str:
    return (
        f"flatten(list_transform(list_filter(string_split_regex(lower({text}), '[\\s\\x{{85}}\\p{{Z}}]+'), lambda w: w <> ''), lambda w: flatten("
        "list_transform(list_filter([2,3,4], lambda n: n = 2 or n - 1 < length(w)+2), lambda n: list_transform("
        "range(1, greatest(length(w)+2-n+1, 1)+1), lambda i: substring(' '||w||' ', i, n))))))"
    )


CTE["sim_master"] = """
SELECT 'SP-' || lpad(CAST(min(p_partkey) AS VARCHAR), 9, '0') AS item_id, p_name AS item_name, p_type AS spec,
  CAST(floor(min(p_retailprice)) AS BIGINT) AS price_min, CAST(floor(max(p_retailprice)) AS BIGINT) AS price_max,
  CAST(floor(min(p_retailprice)) AS BIGINT) AS price_avg FROM part GROUP BY p_name, p_type"""
CTE["m_tf"] = f"""
SELECT item_id, gram, count(*) AS tf FROM (SELECT item_id, unnest({_gram_sql("item_name || ' ' || spec")}) AS gram FROM sim_master) GROUP BY 1, 2"""
CTE["m_idf"] = """
SELECT gram, count(*) AS df, ln((1.0e0 + (SELECT count(*) FROM sim_master)) / (1.0e0 + count(*))) + 1.0e0 AS idf FROM m_tf GROUP BY 1"""
CTE["m_post"] = """
SELECT item_id, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS weight FROM m_tf JOIN m_idf USING (gram)"""
NEEDS.update({"sim_master": [], "m_tf": ["sim_master"], "m_idf": ["m_tf"], "m_post": ["m_idf"]})


def _search_sql(name: str, queries: str, n: int, minimum: str) -> None:
    """Brute-force TF-IDF search as SQL: every item sharing a gram is scored."""
    CTE[f"{name}_q"] = f"SELECT DISTINCT query FROM ({queries})"
    CTE[f"{name}_tf"] = f"""
SELECT query, gram, count(*) AS tf FROM (SELECT query, unnest({_gram_sql('query')}) AS gram FROM {name}_q) GROUP BY 1, 2"""
    CTE[f"{name}_w"] = f"""
SELECT query, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query)) AS wq FROM {name}_tf JOIN m_idf USING (gram)"""
    CTE[f"{name}_s"] = f"""
SELECT query, item_id, round(sum(wq * weight), 6) AS similarity FROM {name}_w JOIN m_post USING (gram) GROUP BY 1, 2"""
    CTE[name] = f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item_id) AS INTEGER) AS rank FROM {name}_s)
WHERE rank <= {n} AND similarity > {minimum}"""
    NEEDS.update({f"{name}_q": [], f"{name}_tf": [f"{name}_q"], f"{name}_w": [f"{name}_tf", "m_post"],
                  f"{name}_s": [f"{name}_w"], name: [f"{name}_s"]})


_search_sql("found_parts", "SELECT p_name || ' ' || p_brand AS query FROM part", 3, "0.05")
_search_sql("found_texts", "SELECT text AS query FROM benchmark", 5, "0.05")
_search_sql("found_one", "SELECT 'small bolts STANDARD' AS query", 5, "0.05")
_search_sql("found_lines", "SELECT trim(item_name || '-' || maker || ' ' || coalesce(spec, '')) AS query FROM lines", 1, "0.1")
NEEDS["found_lines_q"] = ["lines"]


@query("sim_index", sql("SELECT item_id, gram, round(weight, 6) AS weight FROM m_post", "m_post"))
def sim_index(spark, sf):
    index = S.build_index(_master(spark, sf))
    return index.postings.select("item_id", "gram", F.round("weight", 6).alias("weight"))


@query("jn_sim_text", sql("SELECT * FROM found_parts", "found_parts"))
def jn_sim_text(spark, sf):
    index = S.build_index(_master(spark, sf))
    return S.search_text_index(_queries(spark, sf), index, 3, V.MIN_SIMILARITY_LIST)


@query("topk_text", sql("SELECT * FROM found_texts", "found_texts"))
def topk_text(spark, sf):
    index = S.build_index(_master(spark, sf))
    texts = T.load(spark, sf, "benchmark").select(F.col("text").alias("query"))
    return S.search_text_index(texts, index, 5, V.MIN_SIMILARITY_LIST)


@query("sim_search", sql("""
SELECT item_id, item_name, spec, price_avg, similarity, rank FROM found_one JOIN sim_master USING (item_id)""", "found_one", "sim_master"))
def sim_search(spark, sf):
    master = _master(spark, sf)
    found = S.find_similar("  small bolts STANDARD ", S.build_index(master), master)
    return found.select("item_id", "item_name", "spec", "price_avg", "similarity", "rank")


@query("sim_match", sql("""
SELECT l.seq, l.item_name || '-' || l.maker AS item_name, l.spec, l.unit_price, m.price_avg AS std_price_avg, m.item_name AS matched_name,
  round(f.similarity * 100, 1) AS similarity_pct
FROM lines l LEFT JOIN found_lines f ON f.query = trim(l.item_name || '-' || l.maker || ' ' || coalesce(l.spec, ''))
LEFT JOIN sim_master m ON m.item_id = f.item_id""", "found_lines", "sim_master"))
def sim_match(spark, sf):
    lines = T.raw_lines(spark, sf).withColumn("item_name", F.concat_ws("-", "item_name", "maker"))
    master = _master(spark, sf)
    matched = S.match_lines(lines, master, S.build_index(master))
    return matched.select(
        "seq", "item_name", "spec", "unit_price", "std_price_avg", "matched_name", "similarity_pct"
    )


def _first_vector(spark, sf):
    first = T.load(spark, sf, "embeddings").agg(F.min_by("embedding", "vec_id")).head()
    return list(first[0])


_COSINE = """
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[],
  (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings"""


@query("sim_cosine", _COSINE)
def sim_cosine(spark, sf):
    scored = S.cosine_scores(T.load(spark, sf, "embeddings"), _first_vector(spark, sf))
    return scored.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("topk_vec", f"SELECT vec_id, score FROM ({_COSINE}) ORDER BY score DESC, vec_id LIMIT 10")
def topk_vec(spark, sf):
    found = S.search_vectors(T.load(spark, sf, "embeddings"), _first_vector(spark, sf), 10, "vec_id")
    return found.select("vec_id", "score")


@query("jn_sim_vec", """
SELECT q.vec_id AS query_id, v.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
  CAST(row_number() OVER best AS INTEGER) AS rank
FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.embedding IS NOT NULL AND v.embedding IS NOT NULL
WINDOW best AS (PARTITION BY q.vec_id
  ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id)
QUALIFY row_number() OVER best <= 5""")
def jn_sim_vec(spark, sf):
    """The five nearest rows of every twentieth vector, from an index that is saved and loaded."""
    vectors = T.load(spark, sf, "embeddings")
    path = scratch_path(spark, "vector-cells")
    build_vector_index(vectors, "vec_id").save(path)
    return search_many(vectors.filter("vec_id % 20 = 0"), VectorIndex.load(spark, path), 5, "vec_id")


@query("src_vector_index", """
SELECT vec_id AS item_id, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS head, label FROM embeddings""")
def src_vector_index(spark, sf):
    """Vectors and item columns saved as an index and loaded back."""
    path = scratch_path(spark, "vectors")
    save_vectors(T.load(spark, sf, "embeddings").withColumnRenamed("vec_id", "item_id"), path)
    return load_vectors(spark, path).select(
        "item_id", F.size("embedding").cast("bigint").alias("dims"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("head"), "label",
    )


def _quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _category_sql(keyword: str) -> str:
    arms = " ".join(
        f"WHEN len(list_filter({_quoted(words)}, lambda w: contains(lower({keyword}), w))) > 0 THEN {_quoted(codes)}"
        for words, codes in V.MARKET_CATEGORIES
    )
    return f"CASE {arms} ELSE {_quoted(V.MARKET_FALLBACK)} END"


_CODES = sorted({code for _, group in V.MARKET_CATEGORIES for code in group})
CTE["market_item"] = f"""
SELECT ({_quoted(_CODES)})[p_size % {len(_CODES)} + 1] AS cate_cd, p_partkey AS seq, p_name AS name, p_type AS spec,
  CAST(floor(p_retailprice) AS BIGINT) AS price FROM part"""
NEEDS["market_item"] = []


def _market_sql(name: str, keywords: str, n: int) -> None:
    """Market search as SQL over whole categories."""
    CTE[f"{name}_v"] = f"""
SELECT keyword, CAST(generate_subscripts({_category_sql('keyword')}, 1) - 1 AS INTEGER) AS cate_pos, unnest({_category_sql('keyword')}) AS cate_cd
FROM (SELECT DISTINCT keyword FROM ({keywords}))"""
    CTE[f"{name}_r"] = f"""
SELECT keyword, cate_pos, cate_cd, m.seq, m.name, m.spec, m.price,
  contains(lower(m.name), lower(keyword)) OR contains(lower(m.spec), lower(keyword)) AS hit FROM {name}_v JOIN market_item m USING (cate_cd)"""
    CTE[f"{name}_t"] = f"""
SELECT keyword, cate_pos, bool_or(hit) AS any_hit, CASE WHEN bool_or(hit) THEN count(*) FILTER (WHERE hit) ELSE count(*) END AS taken
FROM {name}_r GROUP BY 1, 2"""
    CTE[f"{name}_k"] = f"""
SELECT *, coalesce(sum(taken) OVER (PARTITION BY keyword ORDER BY cate_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM {name}_t"""
    CTE[f"{name}_u"] = f"""
SELECT r.*, row_number() OVER (PARTITION BY keyword, name, spec ORDER BY cate_pos, seq) AS dup FROM {name}_r r
JOIN {name}_k k USING (keyword, cate_pos) WHERE k.before < {n} AND (r.hit OR NOT k.any_hit)"""
    CTE[name] = f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY keyword ORDER BY cate_pos, seq) AS INTEGER) AS rank FROM {name}_u WHERE dup = 1)
WHERE rank <= {n}"""
    NEEDS.update({f"{name}_v": [], f"{name}_r": [f"{name}_v", "market_item"], f"{name}_t": [f"{name}_r"],
                  f"{name}_k": [f"{name}_t"], f"{name}_u": [f"{name}_k"], name: [f"{name}_u"]})


_KEYWORDS = "SELECT p_name AS keyword FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part"
_market_sql("market_hits", _KEYWORDS, 20)
_market_sql("market_few", "SELECT split_part(item_name, ' ', 1) AS keyword FROM compared WHERE std_price_avg IS NULL OR coalesce(similarity_pct, 0) < 20", 3)
NEEDS["market_few_v"] = ["compared"]


def _keywords(spark, sf):
    name = F.col("p_name")
    words = F.array(name, F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2)))
    return T.load(spark, sf, "part").select(F.explode(words).alias("keyword")).distinct()


def _found(spark, sf):
    return K.search(_keywords(spark, sf), T.market_items(spark, sf), 20)


@query("jn_category", sql("SELECT keyword, cate_pos, cate_cd FROM market_hits_v", "market_hits_v"))
def jn_category(spark, sf):
    codes = K.category_codes(F.col("keyword"))
    return _keywords(spark, sf).select("keyword", F.posexplode(codes).alias("cate_pos", "cate_cd"))


@query("mkt_category", f"SELECT DISTINCT p_name, array_to_string({_category_sql('p_name')}, ',') AS codes FROM part")
def mkt_category(spark, sf):
    names = T.load(spark, sf, "part").select("p_name").distinct()
    return names.select("p_name", F.array_join(K.category_codes(F.col("p_name")), ",").alias("codes"))


@query("mkt_search", sql("SELECT keyword, cate_cd, seq, name, spec, price, rank FROM market_hits", "market_hits"))
def mkt_search(spark, sf):
    return _found(spark, sf).select("keyword", "cate_cd", "seq", "name", "spec", "price", "rank")


@query("win_cumulative_stop", sql("""
SELECT keyword, max(cate_pos) AS last_pos, count(DISTINCT cate_cd) AS categories FROM market_hits GROUP BY 1""", "market_hits"))
def win_cumulative_stop(spark, sf):
    pairs = _found(spark, sf).groupBy("keyword", "cate_cd").agg(F.max("cate_pos").alias("cate_pos"))
    return pairs.groupBy("keyword").agg(F.max("cate_pos").alias("last_pos"), F.count(F.lit(1)).alias("categories"))


@query("lim_market", sql("SELECT keyword, price AS market_price FROM market_hits WHERE rank = 1", "market_hits"))
def lim_market(spark, sf):
    return _found(spark, sf).filter("rank = 1").select("keyword", F.col("price").alias("market_price"))


@query("ded_market", """
SELECT name, spec, arg_min(price, seq) AS price, min(seq) AS seq FROM (
  SELECT p_name AS name, p_type AS spec, CAST(floor(p_retailprice) AS BIGINT) AS price, p_partkey AS seq FROM part) GROUP BY 1, 2""")
def ded_market(spark, sf):
    from quotelens.plans.ranking import first_per_key

    rows = T.market_items(spark, sf).select("name", "spec", "price", "seq")
    return first_per_key(rows, ["name", "spec"], ["seq"])


@query("mkt_lookup", sql("""
SELECT DISTINCT c.item_name, f.price AS market_price FROM compared c JOIN market_few f ON f.keyword = split_part(c.item_name, ' ', 1)
WHERE f.rank = 1 AND (std_price_avg IS NULL OR coalesce(similarity_pct, 0) < 20)""", "compared", "market_few"))
def mkt_lookup(spark, sf):
    open_lines = R.unmatched(R.compare(T.compared_input(spark, sf)))
    return K.lookup(open_lines, T.market_items(spark, sf))
