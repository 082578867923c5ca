"""Hard-negative mining with multiway hyperplane trees that store ranges between siblings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens.plans.checkpoints import written

DEGREE = 8
LEAF = 48
SHARD_ROWS = 2048
BLOCK_ROWS = 512
POSITIVES = 5
NEGATIVES = 3
# Split points of the topmost level: this many for each of the commonest vector lengths, drawn from
# four times as many rows; together at most MAX_SPLIT_BYTES. Other lengths form one cell.
CELLS = 64
SPLIT_LENGTHS = 16
MAX_SPLIT_BYTES = 32 << 20
_FAR = 1 << 62


def _distances(queries: np.ndarray, points: np.ndarray, total: np.ndarray | float) -> np.ndarray:
    """Distances, queries x points, where the squared lengths of each pair add up to `total`."""
    return np.sqrt(np.maximum(total - 2 * (queries @ points.T), 0))


def _squared(vectors: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vectors, vectors)


class Lift:
    """Vectors raised to one common length: equal to points of a sphere of squared radius `reach`.

    One more coordinate makes all candidates equally long, so that the inner product with an anchor
    falls strictly with its distance, and a window of scores is a ring around the anchor.
    """

    def __init__(self, vectors: np.ndarray, reach: float | None = None) -> None:
        wide = vectors.astype(np.float64)
        lengths = _squared(wide)
        self.reach = float(lengths.max(initial=0.0)) if reach is None else reach
        self.points = np.hstack([wide, np.sqrt(np.maximum(self.reach - lengths, 0))[:, None]])

    def between(self, points: np.ndarray) -> np.ndarray:
        return _distances(self.points, points, 2 * self.reach)

    def asked(self, queries: np.ndarray, points: np.ndarray) -> np.ndarray:
        wide = queries.astype(np.float64)
        total = (_squared(wide) + self.reach)[:, None]
        return _distances(np.hstack([wide, np.zeros((len(wide), 1))]), points, total)


def split_points(points: np.ndarray, count: int) -> list[int]:
    """Up to `count` rows, each the farthest from those before it; fewer if the rest are equal to one."""
    chosen = [0]
    gaps = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and gaps.max() > 0:
        chosen.append(int(gaps.argmax()))
        gaps = np.minimum(gaps, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return chosen


@dataclass
class _Node:
    rows: np.ndarray
    points: np.ndarray | None = None
    low: np.ndarray | None = None  # low[i, j], high[i, j]: distances from split point i to subtree j
    high: np.ndarray | None = None
    children: list[_Node] | None = None


class Probes:
    """Windows of scores around anchors: number of the anchor in its block, key, least and largest score."""

    def __init__(self, rows: list[tuple[int, int, int, int]], top: int) -> None:
        table = np.array(rows, dtype=np.int64).reshape(-1, 4)
        self.anchor, self.key, self.low, self.high = table.T.copy()
        self.top = top
        self.found: list[list[tuple[int, int]]] = [[] for _ in rows]  # (-score, id), best first

    def add(self, p: int, scores: np.ndarray, ids: np.ndarray) -> None:
        best = sorted([*self.found[p], *zip((-scores).tolist(), ids.tolist(), strict=True)])[:self.top]
        self.found[p] = best
        if len(best) == self.top:
            self.low[p] = max(self.low[p], -best[-1][0])


class Gnat:
    """Tree over integer vectors: rows go to their nearest split point, siblings know each other's ranges."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.lift = Lift(vectors)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> _Node:
        node = _Node(rows)
        if len(rows) <= LEAF:
            return node
        points = self.lift.points[rows]
        drawn = points[:: max(1, len(rows) // (4 * DEGREE))]
        centers = drawn[split_points(drawn, DEGREE)]
        far = _distances(points, centers, 2 * self.lift.reach)
        nearest = far.argmin(axis=1)
        members = [np.flatnonzero(nearest == j) for j in range(len(centers))]
        kept = [j for j, m in enumerate(members) if len(m)]
        if len(kept) < 2:
            return node  # equal vectors
        node.points = centers[kept]
        node.low = np.array([[far[members[j], i].min() for j in kept] for i in kept])
        node.high = np.array([[far[members[j], i].max() for j in kept] for i in kept])
        node.children = [self._build(rows[members[j]]) for j in kept]
        return node

    def search(self, anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, probes: Probes, same: bool) -> None:
        """Fill `probes` with rows of the anchor's label (or of others), never with rows of its own id."""
        lengths = _squared(anchors.astype(np.float64))
        # Sums stay below 2 ** 52 where lengths allow it: then floating products are exact.
        exact = float(lengths.max(initial=0.0)) * self.lift.reach < 2.0 ** 104
        kind = np.float64 if exact else np.int64
        vectors, queries = self.vectors.astype(kind), anchors.astype(kind)
        self._visit(self.root, np.arange(len(probes.anchor)), anchors, queries, vectors, lengths, own, labels, probes, same)

    def _visit(self, node, active, anchors, queries, vectors, lengths, own, labels, probes, same) -> None:
        active = active[probes.low[active] <= probes.high[active]]
        if not len(active):
            return
        who, place = np.unique(probes.anchor[active], return_inverse=True)
        if node.children is None:
            scores = (queries[who] @ vectors[node.rows].T).astype(np.int64)
            ids, tags = self.ids[node.rows], self.labels[node.rows]
            fits = (tags == labels[who][:, None]) == same
            fits &= ids != own[who][:, None]
            # All windows of the leaf at once; only those with hits are looked at one by one.
            mine = scores[place]
            hits = fits[place] & (mine >= probes.low[active][:, None]) & (mine <= probes.high[active][:, None])
            for row in np.flatnonzero(hits.any(axis=1)).tolist():
                probes.add(int(active[row]), mine[row][hits[row]], ids[hits[row]])
            return
        far = self.lift.asked(anchors[who], node.points)
        most, least = reachable(far, node.low, node.high, lengths[who] + self.lift.reach)
        for j in np.argsort(-most.mean(axis=0), kind="stable"):
            # The floor may have risen while siblings were searched.
            kept = (most[place, j] >= probes.low[active]) & (least[place, j] <= probes.high[active])
            if kept.any():
                self._visit(node.children[j], active[kept], anchors, queries, vectors, lengths, own, labels, probes, same)


def reachable(far: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and least score an anchor can have with each sibling, from all split points together.

    An anchor at distance d of split point i is at least low - d, d - high, and at most d + high away
    from a row whose distance to i lies in [low, high]. Widened against rounding.
    """
    near = np.maximum(low[None] - far[:, :, None], far[:, :, None] - high[None]).max(axis=1)
    wide = (far[:, :, None] + high[None]).min(axis=1)
    slack = 1e-9 * total[:, None] + 1e-6
    return (total[:, None] - np.maximum(near, 0) ** 2) / 2 + slack, (total[:, None] - wide ** 2) / 2 - slack


def labelled_vectors(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dim, data, asks): floor(256 x) of each component x as double.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    """
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    present = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    return vectors.where(present & F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
        F.size(vector_col).alias("dim"), F.transform(wide, lambda x: F.floor(x * 256)).alias("data"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )


class Splits:
    """Topmost split points of one vector length, and after `ranges` the distances between cells."""

    def __init__(self, sample: np.ndarray, reach: float, count: int) -> None:
        self.reach = reach
        points = Lift(sample, reach).points
        self.points = points[split_points(points, count)]
        self.low = self.high = None


def _split_points(rows: DataFrame) -> dict[int, Splits]:
    """Split points of the commonest lengths, on the driver: a bounded sample, drawn by hash."""
    reach = F.max(F.aggregate("data", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    common = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), reach.alias("reach")).orderBy(F.desc("n"), "dim")
    budget = MAX_SPLIT_BYTES // SPLIT_LENGTHS
    out = {}
    for dim, _, reach in common.limit(SPLIT_LENGTHS).collect():
        count = min(CELLS, budget // (32 * (dim + 1)))
        if dim and count > 1:
            drawn = rows.where(F.col("dim") == dim).select("data", F.xxhash64("vec_id", "data").alias("turn")).distinct()
            sample = [r["data"] for r in drawn.orderBy("turn").limit(4 * count).collect()]
            out[dim] = Splits(np.array(sample, np.int64).reshape(-1, dim), float(reach), count)
    return out


_PLACED = "dim int, cell int, gap double, vec_id bigint, label bigint, data binary"


def _placed(rows: DataFrame, splits) -> DataFrame:
    """Each row with its nearest split point and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                flat = part.column("data").flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(part.num_rows, dim)
                cell, gap = np.zeros(len(flat), np.int32), np.zeros(len(flat))
                if dim in splits.value:
                    known = splits.value[dim]
                    far = Lift(flat, known.reach).between(known.points)
                    cell = far.argmin(axis=1).astype(np.int32)
                    gap = far[np.arange(len(flat)), cell]
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), pa.array(cell), pa.array(gap), part.column("vec_id"), part.column("label"),
                     pa.array([v.tobytes() for v in flat], pa.binary())],
                    names=["dim", "cell", "gap", "vec_id", "label", "data"],
                )

    return rows.select("dim", "vec_id", "label", "data").mapInArrow(run, _PLACED)


_PACKED = (
    "number bigint, dim int, cell int, low array<double>, high array<double>, ids binary, labels binary, data binary"
)


def _packed(placed: DataFrame, size: int, splits) -> DataFrame:
    """Rows in order of cell and distance, cut into blocks of at most `size` rows of one cell.

    A block is a shell around its split point. Ranges share a hot cell among tasks.
    """
    order = ["dim", "cell", "gap", "vec_id", "label"]
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def block(part: int, serial: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        dim, cell = table["dim"][0].as_py(), table["cell"][0].as_py()
        data = b"".join(table["data"].to_pylist())
        low, high = [0.0], [0.0]
        if dim in splits.value:
            known = splits.value[dim]
            far = Lift(np.frombuffer(data, "<i8").reshape(-1, dim), known.reach).between(known.points)
            low, high = far.min(axis=0).tolist(), far.max(axis=0).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | serial], pa.int64()), pa.array([dim], pa.int32()), pa.array([cell], pa.int32()),
             pa.array([low], pa.list_(pa.float64())), pa.array([high], pa.list_(pa.float64())),
             pa.array([table["vec_id"].to_numpy().astype("<i8").tobytes()]),
             pa.array([table["label"].to_numpy().astype("<i8").tobytes()]), pa.array([data], pa.binary())],
            names=["number", "dim", "cell", "low", "high", "ids", "labels", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, of, part, serial = [], 0, None, 0, 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            dims, cells = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            turns = np.flatnonzero((np.diff(dims) != 0) | (np.diff(cells) != 0)) + 1
            for a, b in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                while a < b:
                    key = (int(dims[a]), int(cells[a]))
                    if held and (key != of or count == size):
                        yield block(part, serial, held)
                        held, count, serial = [], 0, serial + 1
                    of, take = key, min(b - a, size - count)
                    held.append(batch.slice(a, take))
                    a, count = a + take, count + take
        if held:
            yield block(part, serial, held)

    return ranged.mapInArrow(run, _PACKED)


def _with_ranges(shards: DataFrame, known: dict[int, Splits]) -> dict[int, Splits]:
    """Ranges from every topmost split point to every cell: at most CELLS x CELLS numbers a length."""
    places = F.posexplode(F.arrays_zip("low", "high")).alias("i", "range")
    ends = shards.where(F.col("dim").isin(list(known))).select("dim", "cell", places).groupBy("dim", "cell", "i").agg(
        F.min("range.low").alias("low"), F.max("range.high").alias("high")
    ).groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("line"))
    for splits in known.values():
        n = len(splits.points)
        splits.low, splits.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
    for dim, cell, line in ends.collect():
        known[dim].low[:, cell] = [x["low"] for x in line]
        known[dim].high[:, cell] = [x["high"] for x in line]
    return known


_ASKED = "number bigint, dim int, ids binary, labels binary, data binary, probes array<struct<i:int,w:bigint,low:bigint,high:bigint>>"


def _routes(asked: DataFrame, splits, nearest: bool) -> DataFrame:
    """(number, dim, cell, inner, outer): the shell around a cell's split point where a block can have hits.

    The ring of a window, seen from a split point at distance d of the anchor, reaches from
    max(ring - d, d - ring, 0) to d + ring. With `nearest`, only the cell most anchors are nearest to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, float, float]] = []
            for row in batch.to_pylist():
                number, dim = row["number"], row["dim"]
                if dim not in splits.value:
                    out.append((number, dim, 0, 0.0, 0.0))
                    continue
                known = splits.value[dim]
                anchors = np.frombuffer(row["data"], "<i8").reshape(-1, dim)
                who = np.array([p["i"] for p in row["probes"]])
                low, high = (np.array([float(p[x]) for p in row["probes"]]) for x in ("low", "high"))
                far = Lift(anchors[:0], known.reach).asked(anchors, known.points)
                total = _squared(anchors.astype(np.float64)) + known.reach
                if nearest:
                    cell = int(np.bincount(far.argmin(axis=1)).argmax())
                    middle = float(np.median(far[:, cell]))
                    out.append((number, dim, cell, middle, middle))
                    continue
                held = np.flatnonzero(np.isfinite(known.low[0]))
                most, least = reachable(far, known.low[:, held], known.high[:, held], total)
                slack = 1e-9 * total[who] + 1e-6
                ring_in = np.sqrt(np.maximum(total[who] - 2 * (high + slack), 0))
                ring_out = np.sqrt(np.maximum(total[who] - 2 * (low - slack), 0))
                for at, cell in enumerate(held.tolist()):
                    ok = (most[who, at] >= low) & (least[who, at] <= high) & (low <= high)
                    if ok.any():
                        d, a, b = far[who[ok], cell], ring_in[ok], ring_out[ok]
                        inner = np.maximum(np.maximum(a - d, d - b), 0).min()
                        out.append((number, dim, cell, float(inner) * (1 - 1e-9) - 1e-6, float((d + b).max()) * (1 + 1e-9) + 1e-6))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["number", "dim", "cell", "inner", "outer"]
            )

    return asked.select("number", "dim", "data", "probes").mapInArrow(
        run, "number bigint, dim int, cell int, inner double, outer double"
    )


_HITS = "number bigint, i int, w bigint, anchor_id bigint, vec_id bigint, score bigint"


def _searched(pairs: DataFrame, shards: DataFrame, asked: DataFrame, top: int, same: bool) -> DataFrame:
    """Hits of every pair of block and shard; a shard's tree is built once where its pairs stand together."""
    blocks = asked.select("number", "probes", *[F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "data")])
    met = pairs.join(shards.select(F.col("number").alias("shard"), "dim", "ids", "labels", "data"), "shard").join(blocks, "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                dim = row["dim"]
                if of != row["shard"]:
                    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                    of, tree = row["shard"], Gnat(ids, labels, np.frombuffer(row["data"], "<i8").reshape(len(ids), dim))
                own, labels = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_labels"], "<i8")
                probes = Probes([(p["i"], p["w"], p["low"], p["high"]) for p in row["probes"]], top)
                tree.search(np.frombuffer(row["q_data"], "<i8").reshape(len(own), dim), own, labels, probes, same)
                flat = np.array([
                    (row["number"], i, w, own[i], vec_id, -minus)
                    for i, w, found in zip(probes.anchor, probes.key, probes.found, strict=True) for minus, vec_id in found
                ], np.int64).reshape(-1, 6)
                arrays = [pa.array(flat[:, c].astype(np.int32) if c == 1 else flat[:, c]) for c in range(6)]
                yield pa.RecordBatch.from_arrays(arrays, names=["number", "i", "w", "anchor_id", "vec_id", "score"])

    columns = ["shard", "dim", "ids", "labels", "data", "number", "probes", "q_ids", "q_labels", "q_data"]
    return met.repartition("shard", "number").sortWithinPartitions("shard", "number").select(*columns).mapInArrow(run, _HITS)


def _best(hits: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("number", "i", "w").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _nearest_rows(asked: DataFrame, shards: DataFrame, splits, top: int, same: bool, name: str) -> DataFrame:
    """The `top` hits of every window: first in one near shard, then, with the floors found there, wherever rings reach."""
    shells = shards.select(
        F.col("number").alias("shard"), "dim", "cell",
        F.coalesce(F.get("low", F.col("cell")), F.lit(0.0)).alias("low"), F.coalesce(F.get("high", F.col("cell")), F.lit(0.0)).alias("high"),
    )
    apart = F.greatest(F.col("low") - F.col("outer"), F.col("inner") - F.col("high"), F.lit(0.0))
    home = written(
        _routes(asked, splits, True).join(shells, ["dim", "cell"]).groupBy("number").agg(F.min_by("shard", F.struct(apart, "shard")).alias("shard")),
        f"{name}-home",
    )
    first = written(_searched(home, shards, asked, top, same), f"{name}-first")
    floors = first.groupBy("number", "i", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(
        F.col("n") == top).groupBy("number").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("i", "w"), "floor"))).alias("floors"))
    raised = written(asked.join(floors, "number", "left").withColumn("probes", F.transform("probes", lambda p: p.withField(
        "low", F.greatest(p["low"], F.coalesce(F.try_element_at("floors", F.struct(p["i"], p["w"])), p["low"]))
    ))).drop("floors"), f"{name}-raised")
    pairs = _routes(raised, splits, False).join(shells, ["dim", "cell"]).where(
        (F.col("low") <= F.col("outer")) & (F.col("high") >= F.col("inner"))).select("number", "shard")
    others = pairs.join(home, ["number", "shard"], "left_anti")
    return written(_best(first.union(_searched(others, shards, raised, top, same)), top), name)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of integer vectors; higher first, ties to the smaller id. An
    anchor's positives are its best other rows of the same label; its negatives for a positive are
    the best rows of other labels whose score lies between half and 95 percent of the positive's.

    Rows are dealt to the nearest of a bounded set of split points and, in order of their distance
    to it, cut into shards: shells of bounded size, whatever share of all rows a cell holds. The
    ranges between split points and cells, then the shells, tell which shards a block of anchors
    can have hits in; only those meet it, and in each a tree of the same kind is searched to exact
    leaves. Only vectors of the same length are compared. Rows of the anchor's own id are neither
    positives nor negatives; repeated rows are candidates of their own, repeated anchors ask once.
    Rows with a null id, label, vector or component, or a non-finite component, take no part; empty
    vectors score 0 with each other. A positive of negative score has no window. Other columns are
    not read. An empty table gives no rows. Scores are exact while they fit 63 bits.
    """
    rows = written(labelled_vectors(vectors, is_anchor, id_col, vector_col, label_col), "vectors")
    known = _split_points(rows)
    context = rows.sparkSession.sparkContext
    cells = context.broadcast(known)
    shards = written(_packed(_placed(rows, cells), SHARD_ROWS, cells), "shards")
    anchors = rows.where("asks").select("vec_id", "label", "dim", "data").distinct()
    blocks = written(_packed(_placed(anchors, cells), BLOCK_ROWS, cells), "blocks")
    ranged = context.broadcast(_with_ranges(shards, known))
    everything = F.transform(
        F.sequence(F.lit(0), (F.length("ids") / 8).cast("int") - 1),
        lambda i: F.struct(i.alias("i"), F.lit(0).cast("bigint").alias("w"), F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high")),
    )
    asked = blocks.select("number", "dim", "ids", "labels", "data", everything.alias("probes"))
    matched = _nearest_rows(asked, shards, ranged, positives, True, "positives").select(
        "number", "i", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    score = F.col("positive_score")
    windows = matched.where(score >= 0).select(
        "number", "i", score.alias("w"), F.expr("(positive_score + 1) div 2").alias("low"), F.expr("positive_score * 95 div 100").alias("high")
    ).where("low <= high").distinct().groupBy("number").agg(F.collect_list(F.struct("i", "w", "low", "high")).alias("probes"))
    again = written(blocks.select("number", "dim", "ids", "labels", "data").join(windows, "number"), "windows")
    found = _nearest_rows(again, shards, ranged, negatives, False, "negatives").select(
        "number", "i", F.col("w").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"
    )
    return matched.join(found, ["number", "i", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
