"""Market prices: category choice, ordered search with early stop, lookup by first token."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens import fixed_values as V
from quotelens.functions.text import contains_any
from quotelens.plans.checkpoints import written
from quotelens.plans.ranking import first_per_key


def category_codes(
    keyword: Column,
    categories: list[tuple[list[str], list[str]]] = V.MARKET_CATEGORIES,
    fallback: list[str] = V.MARKET_FALLBACK,
) -> Column:
    """Category codes to visit for a keyword, in order; the first group with a hit wins."""
    lowered = F.lower(keyword)

    def codes(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    choice = F
    for words, values in categories:
        choice = choice.when(contains_any(lowered, words), codes(values))
    return choice.otherwise(codes(fallback))


# Grams of a market text have one to _GRAM characters; shorter ones serve shorter keywords.
_GRAM = 3


def _grams(c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    return F.flatten(F.transform(
        F.array(*[F.lit(n) for n in range(1, _GRAM + 1)]),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)
        ),
    ))


def _keyword_grams(keyword: Column) -> Column:
    """The longest grams of a keyword: all of _GRAM characters, or the keyword itself where it is shorter."""
    text = F.lower(keyword)
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - _GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, _GRAM)
    ))


@dataclass(frozen=True)
class MarketIndex:
    """Market rows stored for many searches.

    rows: cate_cd, seq, name, spec, unit, prices. grams(cate_cd, gram, seq): the characters of names and
    specs. frequencies(gram, rows): how many rows hold a gram. sizes(cate_cd, size).
    """

    rows: DataFrame
    grams: DataFrame
    frequencies: DataFrame
    sizes: DataFrame


def build_market_index(market: DataFrame) -> MarketIndex:
    rows = written(market.select(
        "cate_cd", "seq", "name", "spec", "unit", "price", "price_min", "price_max"), "market-rows")
    both = F.array_distinct(F.concat(_grams(F.col("name")), _grams(F.col("spec"))))
    grams = written(rows.select("cate_cd", F.explode(both).alias("gram"), "seq"), "market-grams")
    frequencies = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")), "gram-rows")
    sizes = written(rows.groupBy("cate_cd").agg(F.count(F.lit(1)).alias("size")), "category-sizes")
    return MarketIndex(rows, grams, frequencies, sizes)


def _visits(keywords: DataFrame, index: MarketIndex) -> DataFrame:
    """One row per keyword and category (a code listed twice is visited once), with the keyword's rarest gram."""
    asked = keywords.select("keyword").distinct()
    probes = asked.select("keyword", F.explode(_keyword_grams(F.col("keyword"))).alias("gram")).join(
        index.frequencies, "gram", "left"
    )
    # A gram that no row holds is the rarest of all: its keyword has no hit.
    rarest = probes.groupBy("keyword").agg(
        F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "gram"))["gram"].alias("gram")
    )
    codes = F.array_distinct(category_codes(F.col("keyword")))
    return rarest.select("keyword", "gram", F.posexplode(codes).alias("cate_pos", "cate_cd"))


def _hits(visits: DataFrame, index: MarketIndex) -> DataFrame:
    """Rows of a category whose name or spec contains the keyword: those with its rarest gram, checked again."""
    keyword = F.lower("keyword")
    contains = F.lower("name").contains(keyword) | F.lower(F.coalesce("spec", F.lit(""))).contains(keyword)
    probed = visits.filter(F.col("keyword") != "").join(index.grams, ["cate_cd", "gram"])
    return probed.join(index.rows, ["cate_cd", "seq"]).filter(contains).drop("gram")


def search(keywords: DataFrame, market: DataFrame | MarketIndex, max_results: int = 20) -> DataFrame:
    """Up to max_results market rows per keyword, in category order.

    A category contributes its rows that contain the keyword, or all rows when none does.
    Visiting stops after the category that fills max_results; duplicates of name and spec
    keep their first row. `market` columns: cate_cd, seq (row order in the category, unique there), name,
    spec, unit, price, price_min, price_max; an index of them serves many searches.

    Only the first max_results distinct rows of a category can matter, so they are worked out
    per category before keywords meet them: a keyword joins at most max_results
    rows per category, whatever the category holds. Visits and hits are stored once.
    """
    index = market if isinstance(market, MarketIndex) else build_market_index(market)
    visits = written(_visits(keywords, index), "visits")
    hits = written(_hits(visits, index), "hits")
    hit_counts = hits.groupBy("keyword", "cate_cd").agg(F.count(F.lit(1)).alias("hits"))
    planned = (
        visits.drop("gram").join(index.sizes, "cate_cd")
        .join(hit_counts, ["keyword", "cate_cd"], "left")
        .withColumn("taken", F.coalesce("hits", "size"))
    )
    # At most one row per category of the keyword, so the window is bounded by the category list.
    order = Window.partitionBy("keyword").orderBy("cate_pos").rowsBetween(Window.unboundedPreceding, -1)
    kept = written(planned.withColumn("before", F.coalesce(F.sum("taken").over(order), F.lit(0))).filter(
        F.col("before") < max_results
    ).select("keyword", "cate_cd", "cate_pos", "hits"), "visited")

    by_hit = kept.filter("hits IS NOT NULL").drop("cate_pos", "hits").join(
        _leading(hits, ["keyword", "cate_cd"], max_results), ["keyword", "cate_cd"]
    )
    by_all = kept.filter("hits IS NULL").join(_leading(index.rows, ["cate_cd"], max_results), "cate_cd")
    columns = ["keyword", "cate_pos", "cate_cd", "seq", "name", "spec", "unit", "price", "price_min", "price_max"]
    found = by_hit.select(columns).unionByName(by_all.select(columns))

    unique = first_per_key(found, ["keyword", "name", "spec"], ["cate_pos", "seq"])
    ranked = Window.partitionBy("keyword").orderBy("cate_pos", "seq")
    return unique.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= max_results)


def _leading(rows: DataFrame, group: list[str], n: int) -> DataFrame:
    """First n distinct (name, spec) rows of a group.

    A search result holds at most n distinct rows, so no later row of the group can enter it.
    Duplicates go in a map-side aggregate, and the rank filter is cut before the shuffle.
    """
    unique = first_per_key(rows, [*group, "name", "spec"], ["seq"])
    order = Window.partitionBy(*group).orderBy("seq")
    return unique.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")


def first_token(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), 1)


def lookup(unmatched: DataFrame, market: DataFrame | MarketIndex, max_results: int = 3) -> DataFrame:
    """Market price of every unmatched name: first result for its first token."""
    names = unmatched.select("item_name").distinct().withColumn("keyword", first_token(F.col("item_name")))
    names = written(names, "unmatched-names")  # both the search and its result meet them
    first = search(names, market, max_results).filter("rank = 1").select("keyword", F.col("price").alias("market_price"))
    return names.join(first, "keyword").select("item_name", "market_price")
