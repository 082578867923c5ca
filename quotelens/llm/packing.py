"""Optimal length buckets and token-budget batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.rows import WORD, running_sums
from quotelens.plans.checkpoints import written

BUCKETS = 8
BUDGET = 8192


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets of neighbouring lengths with the least padding.

    Dynamic program over the last length of a bucket. A bucket of lengths i..j-1 pads
    L * (rows[j] - rows[i]) - (words[j] - words[i]) words, L its largest length. For given j that is,
    but for a constant, the value at L of a line with slope -rows[i]: slopes fall and L grows, so
    the lower hull of the lines is walked once a bucket. Whole numbers throughout, so the bounds are exact.
    """
    n = len(lengths)
    rows, words = [0], [0]
    for length, count in zip(lengths, counts, strict=True):
        rows.append(rows[-1] + count)
        words.append(words[-1] + length * count)
    best: list[int | None] = [0] + [None] * n
    cuts = []
    for _ in range(min(buckets, n)):
        now: list[int | None] = [0] + [None] * n
        cut = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, value at 0, i)
        at = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                slope, start = -rows[j - 1], best[j - 1] + words[j - 1]
                while len(hull) > at + 1:
                    (s1, c1, _), (s2, c2, _) = hull[-2:]
                    if (start - c1) * (s1 - s2) > (c2 - c1) * (s1 - slope):
                        break
                    hull.pop()
                hull.append((slope, start, j - 1))
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            slope, start, cut[j] = hull[at]
            now[j] = slope * x + start + x * rows[j] - words[j]
        best, cuts = now, [*cuts, cut]
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = cut[j]
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per row of `docs`: doc_id, size, bucket, bucket_len, batch, slot, padding.

    Size is the number of words (null: 0). Bucket bounds minimise the padding of the whole
    corpus. Inside a bucket, documents in an order drawn from the id (ties by id) fill batches of
    max(1, budget // bucket_len) places, so a padded batch keeps to the budget unless one
    document alone exceeds it. batch counts from 0 inside its bucket and slot from 0 inside its
    batch. Rows that repeat an id are packed one by one. An empty table gives no rows.
    """
    sized = written(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    ), "sized")
    # One row a length. n different lengths add up to n * (n + 1) / 2 words or more, so n is at most
    # the square root of twice the words of the corpus.
    histogram = sized.groupBy("size").agg(F.count(F.lit(1)).alias("rows")).orderBy("size").collect()
    bounds = best_bounds([r["size"] for r in histogram], [r["rows"] for r in histogram], buckets)
    bounds = bounds or [0]
    places = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    # Buckets below the first bound that holds the size.
    bucket = F.size(F.filter(places, lambda b: b < F.col("size")))
    rows = sized.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(places, F.col("bucket") + 1))
    counts = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
    firsts, first = [], 0
    for i in range(len(bounds)):
        firsts.append(first)
        first += counts.get(i, 0)
    order = [F.col("bucket"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("doc_id"), F.col("size")]
    lined = running_sums(rows.withColumn("one", F.lit(1)), order, {"place": "one"})
    begin = F.element_at(F.array(*[F.lit(f).cast("bigint") for f in firsts]), F.col("bucket") + 1)
    inside = F.col("place") - begin
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return lined.select(
        "doc_id", "size", "bucket", "bucket_len", F.floor(inside / room).alias("batch"),
        F.pmod(inside, room).alias("slot"), (F.col("bucket_len") - F.col("size")).alias("padding"),
    )
