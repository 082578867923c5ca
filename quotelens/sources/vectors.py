"""Stored vectors: item columns next to an array<float> column, and an index of cells for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from quotelens.plans.checkpoints import written

CELLS = 64
# Numbers a piece of a cell holds (16,384 rows of 64), and scores a task holds at once.
PIECE_NUMBERS = 1 << 20
_SCORES = 1 << 20
_STEPS = 10.0 ** 6
# Wider than the rounding of a score and of an angle.
_SLACK = 2e-6


def save_vectors(index: DataFrame, path: str) -> None:
    index.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class VectorIndex:
    """rows(item_id, unit, cell, piece) with vectors of length one, and per cell its centre, its radius, an angle, and its pieces."""

    rows: DataFrame
    cells: DataFrame

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"))


def _rows_of(batch: pa.Array, dims: int) -> np.ndarray:
    return batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dims)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _unit(dims: int) -> Callable[[Column], Column]:
    """The vector at length one; a vector without length stays as it is."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            wide = _rows_of(batch, dims).astype(np.float64)
            with np.errstate(invalid="ignore"):
                lengths = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
                yield _lists(wide / np.where(lengths == 0, 1.0, lengths))

    return run


def _of_length(vectors: DataFrame, dims: int) -> DataFrame:
    return vectors.filter((F.size("embedding") == dims) & (F.size(F.array_compact("embedding")) == dims))


def _nearest_cell(numbers: np.ndarray, centers: np.ndarray) -> Callable[[Column], Column]:
    kind = StructType([StructField("cell", IntegerType()), StructField("cosine", DoubleType())])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # A vector with numbers that are not finite is as far as can be from every centre.
            cosines = np.nan_to_num(_rows_of(batch, centers.shape[1]) @ centers.T, nan=-1.0)
            yield pa.StructArray.from_arrays(
                [pa.array(numbers[cosines.argmax(axis=1)]), pa.array(cosines.max(axis=1))], kind.names)

    return run


def build_vector_index(vectors: DataFrame, id_column: str = "item_id", cells: int = CELLS) -> VectorIndex:
    """Every vector goes to the nearest of at most `cells` centres, vectors of the table drawn by hash of their id.

    The centres are all that reaches the driver. Null vectors, vectors holding a null and vectors of
    another length than the longest are left out. The rows of a cell are dealt into pieces of bounded size.
    """
    kept = vectors.filter(F.col("embedding").isNotNull())
    dims = kept.agg(F.max(F.size("embedding"))).head()[0] or 0
    units = written(_of_length(kept, dims).select(
        F.col(id_column).alias("item_id"), _unit(dims)("embedding").alias("unit")), "unit-vectors")
    length = F.aggregate("unit", F.lit(0.0), lambda acc, x: acc + x * x)
    drawn = units.filter(length.between(0.5, 2.0)).orderBy(F.xxhash64("item_id"), "item_id").limit(cells).collect()
    centers = np.array([r["unit"] for r in drawn] or [[0.0] * dims], np.float64).reshape(max(len(drawn), 1), dims)
    near = units.withColumn("near", _nearest_cell(np.arange(len(centers), dtype=np.int32), centers)("unit"))
    placed = written(near.select(
        "item_id", "unit", F.col("near.cell").alias("cell"), F.col("near.cosine").alias("cosine"),
        F.monotonically_increasing_id().alias("place")), "cells")
    held = placed.groupBy("cell").agg(
        F.acos(F.greatest(F.least(F.min("cosine"), F.lit(1.0)), F.lit(-1.0))).alias("radius"),
        F.ceil(F.count(F.lit(1)) * max(dims, 1) / PIECE_NUMBERS).cast("int").alias("pieces"))
    spark = vectors.sparkSession
    listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
    stored = written(listed.join(held, "cell"), "centres")
    # `place` is stored, so equal ids are dealt out too and a task that runs again deals as before.
    rows = placed.join(stored.select("cell", "pieces"), "cell").select(
        "item_id", "unit", "cell", F.pmod(F.xxhash64("place"), "pieces").cast("int").alias("piece"))
    return VectorIndex(rows, stored)


def _open_cells(numbers: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> Callable[[Column, Column, Column], Column]:
    """Cells that can hold a row that reaches the floor, the home cell apart.

    The largest cosine with a row of a cell is bounded by the angle to its centre less its radius.
    """

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for asked, home, floor in batches:
            floors = floor.to_numpy(zero_copy_only=False)
            angles = np.arccos(np.clip(_rows_of(asked, centers.shape[1]) @ centers.T, -1.0, 1.0))
            bounds = np.cos(np.clip(angles - radii, 0.0, np.pi)) + _SLACK
            # Without a floor, or without a bound, every cell is open.
            kept = ~(bounds < floors[:, None] - _SLACK) & (numbers != home.to_numpy(zero_copy_only=False)[:, None])
            ends = np.concatenate([[0], kept.sum(axis=1).cumsum()]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers[np.nonzero(kept)[1]]))

    return run


def _reaching(asked: np.ndarray, floors: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of at most n rows a query, none below its floor; rows stand in the order of ids, which decides ties.

    A cosine that is no number goes before all others, as when Spark sorts.
    """
    scores = asked @ rows.T
    hits = ~(scores < floors[:, None] - _SLACK)
    many = np.flatnonzero(np.count_nonzero(hits, axis=1) > n)

    def steps(found: np.ndarray) -> np.ndarray:
        return np.copysign(np.floor(np.abs(found) * _STEPS + 0.5), found)

    if len(many):
        order = np.nan_to_num(steps(scores[many]), nan=2 * _STEPS).astype(np.int64) * len(rows) - np.arange(len(rows))
        best = np.argpartition(order, len(rows) - n, axis=1)[:, len(rows) - n:]
        hits[many] = False
        hits[many[:, None], best] = True
    query, row = np.nonzero(hits)
    score = steps(scores[query, row]) / _STEPS + 0.0
    kept = ~(score < floors[query])
    return query[kept], row[kept], score[kept]


def _search_pieces(n: int, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads piece by piece first its rows, then those who ask, which are streamed; a task holds one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            number, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("number", "asks"))
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in pairwise([0, *cuts.tolist(), batch.num_rows]):
                part = batch.slice(start, end - start)
                vectors = _rows_of(part.column("vector"), dims)
                if not asks[start]:
                    if piece != number[start]:
                        piece, parts = number[start], []
                    parts.append((part.column("item_id"), vectors))
                    continue
                if piece != number[start]:
                    continue
                if len(parts) > 1:
                    parts = [(pa.concat_arrays([p for p, _ in parts]), np.concatenate([v for _, v in parts]))]
                ids, rows = parts[0]
                floors = part.column("floor").to_numpy(zero_copy_only=False)
                step = max(1, _SCORES // len(rows))
                for i in range(0, len(vectors), step):
                    query, row, score = _reaching(vectors[i:i + step], floors[i:i + step], rows, n)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("query_id").take(pa.array(query + i)), ids.take(pa.array(row)), pa.array(score)],
                        ["query_id", "item_id", "score"])

    return run


def search_many(queries: DataFrame, index: VectorIndex, n: int, id_column: str = "query_id") -> DataFrame:
    """query_id, item_id, score, rank: the n rows of largest cosine per query, ties to the smaller id.

    Exact. A query is first scored against the cell of its nearest centre; the n-th score found there is a
    floor, and only cells whose bound reaches it are looked into. A query without length scores 0 everywhere.
    Queries meet a piece of a cell as products of matrices, and only rows that reach the floor leave the task.
    """
    held = index.cells.orderBy("cell").collect()
    if not held:
        return queries.sparkSession.createDataFrame([], "query_id bigint, item_id bigint, score double, rank int")
    numbers = np.array([r["cell"] for r in held], np.int32)
    centers, radii = np.array([r["center"] for r in held]), np.array([r["radius"] for r in held])
    dims = centers.shape[1]
    units = _of_length(queries, dims).select(F.col(id_column).alias("query_id"), _unit(dims)("embedding").alias("asked"))
    asked = written(units.select("*", _nearest_cell(numbers, centers)("asked")["cell"].alias("home")), "asked")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("item_id"))
    query_type, item_type = asked.schema["query_id"].dataType, index.rows.schema["item_id"].dataType
    found = StructType([StructField("query_id", query_type), StructField("item_id", item_type), StructField("score", DoubleType())])
    number = F.shiftleft(F.col("cell").cast("bigint"), 32) + F.col("piece")
    rows = index.rows.select(
        number.alias("number"), F.lit(False).alias("asks"), F.lit(None).cast(query_type).alias("query_id"), "item_id",
        F.col("unit").alias("vector"), F.lit(None).cast("double").alias("floor"))

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(index.cells.select("cell", "pieces"), "cell").withColumn(
            "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        asking = met.select(
            number.alias("number"), F.lit(True).alias("asks"), "query_id", F.lit(None).cast(item_type).alias("item_id"),
            F.col("asked").alias("vector"), "floor")
        dealt = rows.unionByName(asking).repartition("number")
        return dealt.sortWithinPartitions("number", "asks", F.asc_nulls_last("item_id")).mapInArrow(_search_pieces(n, dims), found)

    def top(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)

    home = asked.select("query_id", "asked", F.col("home").alias("cell"), F.lit(None).cast("double").alias("floor"))
    first = written(top(scored(home)), "first-cell")
    floors = first.filter(F.col("rank") == n).select("query_id", F.col("score").alias("floor"))
    others = asked.join(floors, "query_id", "left").select(
        "query_id", "asked", "floor", F.explode(_open_cells(numbers, centers, radii)("asked", "home", "floor")).alias("cell"))
    return top(first.drop("rank").unionByName(scored(others)))
