"""Exact top-k inner-product search by ball trees per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens.plans.checkpoints import written

LEAF = 32
# Leaves that are scored at once.
LEAVES = 16
# Numbers of a shard (4,096 vectors of 64) and of a block of queries (512 of 64); blocks that a task streams past its shard.
SHARD_NUMBERS = 1 << 18
BLOCK_NUMBERS = 1 << 15
BLOCKS = 16
TOP = 5
_NO_FLOOR = -(1 << 63)


class BallTree:
    """Ball tree over integer vectors; leaves are row ranges, each with its centre and radius."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order: list[np.ndarray] = []
        open_nodes = [np.arange(len(ids))]
        while open_nodes:
            rows = open_nodes.pop()
            points = vectors[rows]
            spread = points.max(axis=0).astype(np.float64) - points.min(axis=0)
            axis = int(spread.argmax())
            if len(rows) <= LEAF or spread[axis] == 0:
                order += np.split(rows, range(LEAF, len(rows), LEAF))
                continue
            half = np.argsort(points[:, axis], kind="stable")
            open_nodes += [rows[half[len(rows) // 2:]], rows[half[: len(rows) // 2]]]
        placed = np.concatenate(order)
        self.ids, self.vectors = ids[placed], vectors[placed]
        self.starts = np.concatenate([[0], np.cumsum([len(leaf) for leaf in order])])
        centers, radii = [], []
        for start, end in zip(self.starts[:-1], self.starts[1:], strict=True):
            points = self.vectors[start:end].astype(np.float64)
            centers.append(points.mean(axis=0))
            radii.append(np.sqrt(((points - centers[-1]) ** 2).sum(axis=1).max()))
        self.centers, self.radii = np.array(centers), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product, queries x leaves, widened against rounding."""
        q = queries.astype(np.float64)
        norms = np.sqrt((q * q).sum(axis=1))[:, None]
        reach = np.sqrt((self.centers ** 2).sum(axis=1)) + self.radii
        return q @ self.centers.T + norms * self.radii + 1e-9 * norms * reach + 1e-6

    def best(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, top: int) -> np.ndarray:
        """Rows (query, vec_id, score) with the number of the query: at most `top` for each, none below its floor (a kth score).

        A query's own id is left out. Leaves are scored in groups as matrix products, the best score found
        so far raising the floors; a leaf that no query can use, and a query that can use no leaf of a
        group, take no part.
        """
        floors, bounds = floors.copy(), self.bounds(queries)
        found = np.empty((0, 3), np.int64)
        # Groups that promise most come first.
        groups = sorted(range(0, len(self.radii), LEAVES), key=lambda g: -float(bounds[:, g:g + LEAVES].max(axis=1).sum()))
        for first in groups:
            useful = bounds[:, first:first + LEAVES] >= floors[:, None]
            asking, leaves = np.flatnonzero(useful.any(axis=1)), first + np.flatnonzero(useful.any(axis=0))
            if not len(asking):
                continue
            rows = np.concatenate([np.arange(self.starts[leaf], self.starts[leaf + 1]) for leaf in leaves])
            scores = _products(queries[asking], self.vectors[rows])
            hits = (scores >= floors[asking, None]) & (query_ids[asking, None] != self.ids[rows])
            if len(rows) > top:
                least = np.partition(np.where(hits, scores, _NO_FLOOR), len(rows) - top, axis=1)[:, len(rows) - top]
                hits &= scores >= least[:, None]
            query, row = np.nonzero(hits)
            more = np.column_stack([asking[query], self.ids[rows[row]], scores[query, row]])
            found = np.concatenate([found, more])
            found = found[np.lexsort((found[:, 1], -found[:, 2], found[:, 0]))]
            place = np.arange(len(found)) - np.searchsorted(found[:, 0], found[:, 0])
            found, place = found[place < top], place[place < top]
            last = found[place == top - 1]
            floors[last[:, 0]] = np.maximum(floors[last[:, 0]], last[:, 2])
        return found


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, exact while they fit 63 bits: as doubles where those hold every sum."""
    def most(x: np.ndarray) -> int:
        return max(abs(int(x.max())), abs(int(x.min())))

    if most(queries) * most(rows) * rows.shape[1] < 1 << 53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries.astype(np.int64) @ rows.T.astype(np.int64)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector array<bigint>): floor(256 x) of each component x as double.

    Rows with a null id or vector, or with a null or non-finite component, take no part. Scores
    are exact while they fit 63 bits.
    """
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(F.size(vector_col) > 0, F.lit(False))).where(good).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * 256)).alias("vector")
    )


def _narrow(flat: np.ndarray) -> bytes:
    """The numbers in as few bytes each as all of them fit."""
    kind = next(k for k in ("<i2", "<i4", "<i8") if flat.min() >= np.iinfo(k).min and flat.max() <= np.iinfo(k).max)
    return flat.astype(kind).tobytes()


def _unpacked(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, "<i8")
    return numbers, np.frombuffer(data, f"<i{len(data) // (len(numbers) * dim)}").reshape(len(numbers), dim)


def _packed(rows: DataFrame, lengths: DataFrame, groups: str) -> DataFrame:
    """Rows of one length packed into the binary pieces that column `groups` of `lengths` counts: (dim, number, ids, data, floors)."""
    dealt = rows.join(F.broadcast(lengths), "dim").withColumn("number", F.pmod(F.xxhash64("place"), groups).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        flat = table.column("vector").combine_chunks().flatten().to_numpy()
        return pa.table({
            "dim": table.column("dim").slice(0, 1), "number": table.column("number").slice(0, 1),
            "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "data": pa.array([_narrow(flat)], pa.binary()),
            "floors": pa.array([table.column("floor").to_numpy().astype("<i8").tobytes()], pa.binary()),
        })

    schema = "dim int, number int, ids binary, data binary, floors binary"
    floor = F.coalesce("floor", F.lit(_NO_FLOOR)).alias("floor")
    return dealt.select("dim", "number", "vec_id", "vector", floor).groupBy("dim", "number").applyInArrow(run, schema)


def _search(dealt: DataFrame, top: int) -> DataFrame:
    """(query_id, vec_id, score): the best of every shard for every query of the blocks that follow it; a task holds one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        for batch in batches:
            dims, shards, asks, ids, data, floors = (batch.column(c) for c in ("dim", "shard", "asks", "ids", "data", "floors"))
            for i in range(batch.num_rows):
                key = (dims[i].as_py(), shards[i].as_py())
                if asks[i].as_py() and of != key:
                    continue
                numbers, vectors = _unpacked(ids[i].as_py(), data[i].as_py(), key[0])
                if not asks[i].as_py():
                    tree, of = BallTree(numbers, vectors), key
                    continue
                found = tree.best(numbers, vectors, np.frombuffer(floors[i].as_py(), "<i8"), top)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[found[:, 0]]), pa.array(found[:, 1]), pa.array(found[:, 2])], ["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _ranked(hits: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def top_inner_products(vectors: DataFrame, is_query: Column, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` other rows of largest inner product, ties to the smaller id.

    Vectors are dealt to shards of bounded size, each with a ball tree, and queries to blocks. A task
    holds one shard and streams blocks past it. Every block first meets about the square root of all
    shards; the kth scores found there are then floors in all others, where leaves whose bound does
    not reach the floor are left out. Only vectors of the same length are compared. A query with
    fewer candidates gets all. Rows that repeat an id are candidates of their own, but never of a
    query with that id. An empty table gives no rows.
    """
    rows = written(integer_vectors(vectors).select(
        "*", is_query.alias("asks"), F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("place")), "vectors")

    def pieces(count: Column, numbers: int) -> Column:
        return F.ceil(count * F.col("dim") / numbers).cast("int")

    lengths = written(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")).where("asking > 0").select(
        "dim", pieces(F.col("n"), SHARD_NUMBERS).alias("shards"), pieces(F.col("asking"), BLOCK_NUMBERS).alias("blocks"),
    ).withColumns({"stride": F.ceil(F.sqrt("shards")).cast("int"), "parts": F.ceil(F.col("blocks") / BLOCKS).cast("int")}), "lengths")
    shards = written(_packed(rows.withColumn("floor", F.lit(None).cast("bigint")), lengths, "shards"), "shards")
    asking = rows.where("asks")

    def scored(floors: DataFrame | None) -> DataFrame:
        """Blocks meet their first shards without floors, all others with floors."""
        queries = asking.withColumn("floor", F.lit(None).cast("bigint")) if floors is None else asking.join(
            floors, asking["vec_id"] == floors["query_id"], "left")
        near = F.pmod(F.col("shard") - F.col("block"), F.col("stride")) == 0
        met = _packed(queries, lengths, "blocks").withColumnRenamed("number", "block").join(F.broadcast(lengths), "dim").select(
            "*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).where(near if floors is None else ~near)
        blocks = met.select("dim", "shard", F.pmod("block", "parts").alias("part"), F.lit(True).alias("asks"), "ids", "data", "floors")
        held = shards.join(F.broadcast(lengths), "dim").select(
            "dim", F.col("number").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
            F.lit(False).alias("asks"), "ids", "data", "floors")
        dealt = held.unionByName(blocks).repartition("dim", "shard", "part")
        return _search(dealt.sortWithinPartitions("dim", "shard", "part", "asks"), top)

    first = written(_ranked(scored(None), top), "first-hits")
    floors = first.where(F.col("rank") == top).select("query_id", F.col("score").alias("floor"))
    return _ranked(first.drop("rank").union(scored(floors)), top).select("query_id", "rank", "vec_id", "score")
