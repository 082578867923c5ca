import math
import random
from collections import Counter

import pytest

from quotelens.operators import market as K
from quotelens.operators import similarity as S
from test_text import _model_grams

MASTER = "item_id string, item_name string, spec string, price_avg bigint, price_min bigint, price_max bigint"


def _model(items, query, n, minimum):
    """Brute-force TF-IDF: every item is scored over all its grams."""
    docs = {i: Counter(_model_grams(t)) for i, t in items}
    df = Counter(g for d in docs.values() for g in d)
    idf = {g: math.log((1 + len(items)) / (1 + c)) + 1 for g, c in df.items()}

    def unit(counts):
        w = {g: c * idf[g] for g, c in counts.items() if g in idf}
        length = math.sqrt(sum(v * v for v in w.values()))
        return {g: v / length for g, v in w.items()} if length else {}

    q = unit(Counter(_model_grams(query)))
    vectors = {i: unit(d) for i, d in docs.items()}
    scored = [(round(sum(v * vectors[i].get(g, 0) for g, v in q.items()), 6), i) for i in docs]
    return [(i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:n] if s > minimum]


@pytest.mark.parametrize("n", [1, 4])
def test_search_is_exact_with_a_hot_gram(spark, n):
    rnd = random.Random(7)
    words = ["servo", "motor", "모터", "reducer", "감속기", "guide", "valve", "bolt", "b", "M3", "750W"]
    # A third of all items share the same first word.
    texts = [("common " if i % 3 == 0 else "") + " ".join(rnd.choices(words, k=rnd.randint(1, 4))) for i in range(150)]
    items = [(f"I{i:04d}", t) for i, t in enumerate(texts)]
    master = spark.createDataFrame([(i, t, "", 1, 1, 1) for i, t in items], MASTER)
    queries = list(dict.fromkeys(texts[:40] + ["common", "zzz", "servo motor 750W common", "bolts", "x"]))
    df = spark.createDataFrame([(q,) for q in queries + [" ", "common"]], "query string")
    got = {}
    for r in S.search_text_index(df, S.build_index(master), n, 0.05).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["item_id"], r["similarity"]))
    want = {q: _model(items, q, n, 0.05) for q in queries}
    for q in queries:
        w, g = want[q], got.get(q, [])
        assert [i for i, _ in g] == [i for i, _ in w], (q, g, w)
        assert all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(g, w))


def test_small_index_ranks_the_right_item_first(spark):
    rows = [("S1", "서보모터", "750W", 500000, 1, 1), ("S2", "감속기", "1/20", 300000, 1, 1), ("S3", "LM 가이드", "HGR20", 80000, 1, 1)]
    master = spark.createDataFrame(rows, MASTER)
    index = S.build_index(master)
    found = S.find_similar("서보모터 750W", index, master, 3).collect()
    assert found[0]["item_id"] == "S1" and found[0]["similarity"] == 1.0
    assert S.find_similar("   ", index, master).count() == 0
    lines = spark.createDataFrame([("서보모터", "700W", 600000), ("무관", None, 1)], "item_name string, spec string, unit_price bigint")
    got = {r["item_name"]: r["std_price_avg"] for r in S.match_lines(lines, master, index).collect()}
    assert got == {"서보모터": 500000, "무관": None}


def test_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [-2.0, 0.0]), ("d", [3.0, 0.0]), ("e", [1.0, 1.0])]
    index = spark.createDataFrame(rows, "item_id string, embedding array<float>")
    got = [(r["item_id"], r["score"]) for r in S.search_vectors(index, [2.0, 0.0], 5).collect()]
    assert got == [("a", 1.0), ("d", 1.0), ("e", 0.707107), ("b", 0.0), ("c", -1.0)]
    with pytest.raises(ValueError):
        S.search_vectors(index, [], 1)


def _market_model(market, keyword, n, codes):
    found, out, seen = [], [], set()
    for code in dict.fromkeys(codes):
        rows = [m for m in market if m[0] == code]
        hits = [m for m in rows if keyword.lower() in m[2].lower() or keyword.lower() in m[3].lower()]
        found += hits or rows
        if len(found) >= n:
            break
    for m in found:
        if (m[2], m[3]) not in seen:
            seen.add((m[2], m[3]))
            out.append(m[1])
    return out[:n]


@pytest.mark.parametrize("n", [3, 20])
def test_market_search_against_brute_force(spark, n):
    from quotelens import fixed_values as V

    rnd = random.Random(3)
    codes = sorted({c for _, cs in V.MARKET_CATEGORIES for c in cs} | set(V.MARKET_FALLBACK))[:20]
    hot = V.MARKET_FALLBACK[0]
    words = ["air", "Air filter", "볼베어링", "gear", "x", "pump"]
    market = []
    for seq in range(400):
        code = hot if seq % 3 == 0 else rnd.choice(codes)  # one category holds a third of the rows
        market.append((code, seq, rnd.choice(words) + rnd.choice(["", " A", " B"]), rnd.choice(["", "M3", "air"]), "EA", 100, 90, 110))
    schema = "cate_cd string, seq bigint, name string, spec string, unit string, price bigint, price_min bigint, price_max bigint"
    keywords = ["air", "gear", "볼베어링", "unknown", "x", "AIR filter", "m"]
    df = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    got = {}
    for r in K.search(df, spark.createDataFrame(market, schema), n).orderBy("keyword", "rank").collect():
        got.setdefault(r["keyword"], []).append(r["seq"])
    for k in keywords:
        lowered = k.lower()
        visit = next((cs for ws, cs in V.MARKET_CATEGORIES if any(w in lowered for w in ws)), V.MARKET_FALLBACK)
        assert got.get(k, []) == _market_model(market, k, n, visit), k


def test_many_vectors_against_brute_force(spark, tmp_path):
    import numpy as np
    from quotelens.sources.vectors import VectorIndex, build_vector_index, search_many

    rng = np.random.default_rng(2)
    centers = rng.normal(size=(9, 12))
    data = [(i, (centers[i % 9] + rng.normal(size=12) * 0.1).tolist()) for i in range(400)]
    data += [(400 + i, data[5][1]) for i in range(6)] + [(500, [0.0] * 12), (501, None), (502, [1.0, 2.0])]
    table = spark.createDataFrame(data, "item_id bigint, embedding array<double>")
    build_vector_index(table, cells=16).save(str(tmp_path / "index"))
    index = VectorIndex.load(spark, str(tmp_path / "index"))
    queries = table.filter("item_id % 10 = 0 OR item_id = 500").withColumnRenamed("item_id", "query_id")
    good = [(i, np.array(v)) for i, v in data if v is not None and len(v) == 12]
    want = set()
    for q, v in good:
        if q % 10 == 0 or q == 500:
            def score(w):
                lengths = np.linalg.norm(v) * np.linalg.norm(w)
                return round(float(v @ w / lengths), 6) + 0.0 if lengths else 0.0

            ranked = sorted((-score(w), i) for i, w in good)[:4]
            want |= {(q, i, k + 1) for k, (_, i) in enumerate(ranked)}
    got = search_many(queries, index, 4)
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in got.collect()} == want
    assert search_many(queries, build_vector_index(table.limit(0)), 4).count() == 0


def test_many_vectors_with_copies_repeated_ids_and_cells_in_pieces(spark, tmp_path, monkeypatch):
    import numpy as np
    from quotelens.sources import vectors

    monkeypatch.setattr(vectors, "PIECE_NUMBERS", 8 * 30, raising=False)
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    # A cell of copies, ids that occur twice, a vector that is no number.
    data += [(300 + i, data[20][1]) for i in range(150)] + [(40, data[3][1]), (80, data[9][1]), (455, [math.nan] + [1.0] * 7)]
    # Vectors that hold a null take no part, neither as rows nor as queries.
    held = data + [(460, [None] + [1.0] * 7), (461, None)]
    table = spark.createDataFrame(held, "item_id bigint, embedding array<double>").repartition(5)
    vectors.build_vector_index(table, cells=4).save(str(tmp_path / "index"))
    index = vectors.VectorIndex.load(spark, str(tmp_path / "index"))
    assert index.rows.groupBy("cell", "piece").count().agg({"count": "max"}).head()[0] < 75
    queries = table.filter("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    want, asked = [], {}
    for q, v in data:
        if q % 20 == 0:
            scores = [(i, float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)))) for i, w in data]
            asked.setdefault(q, []).extend((-math.inf if math.isnan(s) else -round(s, 6), i) for i, s in scores)
    for q, scores in asked.items():
        want += [(q, i, k + 1) for k, (_, i) in enumerate(sorted(scores)[:5])]
    found = vectors.search_many(queries, index, 5)
    assert sorted((r["query_id"], r["item_id"], r["rank"]) for r in found.collect()) == sorted(want)
    # Pairs are scored as matrices inside tasks: no join makes a row of every pair.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
