"""Text similarity (TF-IDF over character n-grams) and vector similarity search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens import fixed_values as V
from quotelens.functions.grams import char_grams
from quotelens.functions.text import search_text, strip
from quotelens.functions.vectors import cosine
from quotelens.plans.checkpoints import written
from quotelens.plans.ranking import with_running_number

# Items a block holds, and blocks a region holds.
_BLOCK_ITEMS = 8
_REGION_BLOCKS = 64
# Bounds are compared with this slack, wider than the rounding of a similarity.
_SLACK = 2e-6
_DIGITS = 6


@dataclass(frozen=True)
class TextIndex:
    """Items of length one, kept block by block.

    postings(block, item_id, gram, weight); maxima(region, block, gram, top), the largest weight of a
    gram in a block; vocabulary(gram, df, idf).
    """

    postings: DataFrame
    maxima: DataFrame
    vocabulary: DataFrame


def _term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """tf per (key, gram). Texts are placed by key first, so the aggregate needs no shuffle of grams."""
    return (
        texts.select(key, text).repartition(key)
        .select(key, F.explode(char_grams(F.col(text))).alias("gram"))
        .groupBy(key, "gram")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def _unit_length(weighted: DataFrame, key: str) -> DataFrame:
    """Divide weights by the length of their text (a window over the grams of one text)."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return weighted.withColumn("weight", F.col("weight") / length)


def build_index(master: DataFrame) -> TextIndex:
    """Index of item_id, item_name, spec: idf = ln((1 + N) / (1 + df)) + 1, items of length one.

    Items stand in the order of their weightiest gram, then of their text, so that those which
    share what matters share a block and its maxima are close to their weights.
    """
    texts = master.select("item_id", search_text(F.col("item_name"), F.col("spec")).alias("text"))
    counts = written(_term_counts(texts, "item_id", "text"), "term-counts")
    n = master.agg(F.count(F.lit(1)).alias("n")).scalar()
    vocabulary = written(
        counts.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1),
        "vocabulary",
    )
    weighted = counts.join(vocabulary.select("gram", "idf"), "gram").select(
        "item_id", "gram", (F.col("tf") * F.col("idf")).alias("weight")
    )
    weights = written(_unit_length(weighted, "item_id"), "weights")
    heads = weights.groupBy("item_id").agg(F.min(F.struct(-F.col("weight"), "gram"))["gram"].alias("head"))
    order = [F.col("head"), F.col("text"), F.col("item_id")]
    placed = with_running_number(
        texts.groupBy("item_id").agg(F.min("text").alias("text")).join(heads, "item_id"), order, "place", 0
    ).select("item_id", F.floor(F.col("place") / _BLOCK_ITEMS).alias("block"))
    postings = written(weights.join(placed, "item_id").select("block", "item_id", "gram", "weight"), "postings")
    region = F.floor(F.col("block") / _REGION_BLOCKS).alias("region")
    maxima = postings.groupBy(region, "block", "gram").agg(F.max("weight").alias("top"))
    return TextIndex(postings, written(maxima, "maxima"), vocabulary)


def _query_grams(queries: DataFrame, index: TextIndex) -> DataFrame:
    """Weighted grams of the distinct queries, of length one."""
    counts = _term_counts(queries.select("query").distinct().filter(strip(F.col("query")) != ""), "query", "query")
    weighted = counts.join(index.vocabulary, "gram").select(
        "query", "gram", (F.col("tf") * F.col("idf")).alias("weight")
    )
    return _unit_length(weighted, "query").withColumnRenamed("weight", "wq")


def _reach(asked: DataFrame, maxima: DataFrame, on: list[str], *to: str) -> DataFrame:
    """The most that any item of a region or block can score: weights are positive, so maxima bound them all."""
    return asked.join(maxima, on).groupBy("query", *to).agg(F.sum(F.col("wq") * F.col("top")).alias("reach"))


def _full_scores(pairs: DataFrame, grams: DataFrame, index: TextIndex) -> DataFrame:
    """Similarity of every item of the given (query, block) pairs that shares a gram."""
    return (
        pairs.select("query", "block").join(grams, "query")
        .join(index.postings, ["block", "gram"])
        .groupBy("query", "item_id")
        .agg(F.round(F.sum(F.col("wq") * F.col("weight")), _DIGITS).alias("similarity"))
    )


def _blocks_in(regions: DataFrame, grams: DataFrame, index: TextIndex) -> DataFrame:
    """(query, block, reach) of the blocks of the given (query, region) pairs."""
    asked = regions.select("query", "region").join(grams, "query")
    return _reach(asked, index.maxima, ["region", "gram"], "block")


def reachable_blocks(grams: DataFrame, index: TextIndex, n: int, min_similarity: float) -> DataFrame:
    """(query, block): the blocks that can hold one of the query's n best items.

    A query meets the regions that share a gram as one bound each. The best blocks of its best
    region are scored in full, which gives a floor; regions, and then blocks of the regions left,
    whose bound stays below the floor are never looked into.
    """
    least = min_similarity - _SLACK
    regional = index.maxima.groupBy("region", "gram").agg(F.max("top").alias("top"))
    regions = written(_reach(grams, regional, ["gram"], "region").filter(F.col("reach") >= least), "region-bounds")
    best = regions.groupBy("query").agg(F.max_by("region", F.struct("reach", "region")).alias("region"))
    order = Window.partitionBy("query").orderBy(F.desc("reach"), "block")
    enough = -(-n // _BLOCK_ITEMS)
    first = _blocks_in(best, grams, index).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= enough)
    highest = Window.partitionBy("query").orderBy(F.desc("similarity"))
    reached = _full_scores(first, grams, index).withColumn("__n", F.row_number().over(highest)).filter(F.col("__n") == n)
    floors = written(reached.select("query", (F.col("similarity") - _SLACK).alias("floor")), "floors")
    floor = F.greatest(F.coalesce("floor", F.lit(least)), F.lit(least))
    open_regions = regions.join(floors, "query", "left").filter(F.col("reach") >= floor)
    return _blocks_in(open_regions, grams, index).join(floors, "query", "left").filter(
        F.col("reach") >= floor).select("query", "block")


def search_text_index(queries: DataFrame, index: TextIndex, n: int, min_similarity: float) -> DataFrame:
    """Top n items per query with similarity above min_similarity; exact, see `reachable_blocks`."""
    grams = written(_query_grams(queries, index), "query-grams")
    pairs = written(reachable_blocks(grams, index, n, min_similarity), "reachable")
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "item_id")
    return (
        _full_scores(pairs, grams, index)
        .withColumn("rank", F.row_number().over(best))
        .filter((F.col("rank") <= n) & (F.col("similarity") > min_similarity))
        .select("query", "item_id", "similarity", "rank")
    )


def find_similar(query: str, index: TextIndex, master: DataFrame, n: int = 5) -> DataFrame:
    """Master rows most similar to one text; a blank text gives no rows."""
    spark = master.sparkSession
    asked = spark.createDataFrame([(query.strip(),)], "query string")
    found = search_text_index(asked, index, n, V.MIN_SIMILARITY_LIST)
    return master.join(found.drop("query"), "item_id").orderBy("rank")


def match_lines(lines: DataFrame, master: DataFrame, index: TextIndex | None = None) -> DataFrame:
    """Every quotation line with its best master row, when that is similar enough.

    Equal texts are searched once; the line table is only touched by the last join.
    """
    index = build_index(master) if index is None else index
    asked = lines.withColumn("query", search_text(F.col("item_name"), F.col("spec")))
    best = search_text_index(asked.select("query"), index, 1, V.MIN_SIMILARITY_LIST).filter(
        F.col("similarity") > V.MIN_SIMILARITY_MATCH
    )
    standard = master.select(
        "item_id",
        F.col("price_avg").alias("std_price_avg"),
        F.col("price_min").alias("std_price_min"),
        F.col("price_max").alias("std_price_max"),
        F.col("item_name").alias("matched_name"),
    )
    matches = best.join(standard, "item_id").select(
        "query", "std_price_avg", "std_price_min", "std_price_max", "matched_name",
        F.round(F.col("similarity") * 100, 1).alias("similarity_pct"),
    )
    return asked.join(matches, "query", "left").drop("query")


def cosine_scores(index: DataFrame, query: list[float]) -> DataFrame:
    """Cosine of every stored vector with one query vector (a constant in the plan)."""
    asked = F.array(*[F.lit(float(v)) for v in query])
    return index.withColumn("score", cosine(F.col("embedding"), asked))


def search_vectors(index: DataFrame, query: list[float], n: int = 5, id_column: str = "item_id") -> DataFrame:
    """The n best-scoring rows; each task keeps its own n before they are merged."""
    if not query:
        raise ValueError("query vector is empty")
    scored = cosine_scores(index, query).withColumn("score", F.round("score", _DIGITS))
    return scored.orderBy(F.desc("score"), id_column).limit(n)
