"""Windows that repeat in earlier documents: what the two operators on shared passages have in common.

A window is a run of W units (words or bytes) of one document. The smallest hash of the grams
inside a window depends on its content alone, so equal windows have the same smallest gram, the
anchor. Consecutive windows with one anchor form a segment. Then

1. anchors that occur once in the corpus rule out their windows; the rest are kept per document;
2. segments of equal content need one comparison of places: all but the first are covered;
3. only first segments whose anchor also has other contents are compared in detail, in shards
   by anchor (a `Judge`: a suffix automaton or a suffix array); an anchor with very many
   contents is dealt out window by window instead;
4. covered windows come back to their documents.

A hot passage never gathers: map tasks settle what repeats inside a batch and send one row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.rows import keyed
from quotelens.plans.checkpoints import written, written_by_key

PIECE = 1 << 20
PLACE = np.uint64((1 << 24) - 1)
# Segments of one anchor that one shard compares; beyond it, its windows are dealt out one by one.
SHARD_SEGMENTS = 4096
_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(16)], dtype=np.uint64)
_BASE = 0x9DDFEA08EB382D69

Judge = Callable[[list[tuple[int, int, int, bytes]]], list[np.ndarray]]


@dataclass(frozen=True)
class Scheme:
    """window: units a window; gram: units a gram; step: units between the hashed parts of a gram.

    units gives the tokens of a text, codes a number per token, parts the numbers that grams are
    hashed from; piece joins tokens again. by_place: an earlier place of the same document counts.
    """

    window: int
    gram: int
    step: int
    by_place: bool
    units: Callable[[bytes], object]
    codes: Callable[[object], np.ndarray]
    parts: Callable[[object, np.ndarray], np.ndarray]
    piece: Callable[[object], bytes]


@dataclass
class Found:
    """Segments of one document: first window, windows, anchor, content hash."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = PIECE + 4096
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        factors = np.full(n, base, dtype=np.uint64)
        factors[0] = 1
        out.append(np.multiply.accumulate(factors))
    return out[0], out[1]


def smallest_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbouring keys, by doubling."""
    now, span = keys, 1
    while span * 2 <= width:
        now = np.minimum(now[:-span], now[span:])
        span *= 2
    n = len(keys) - width + 1
    return np.minimum(now[:n], now[width - span:width - span + n])


def segments(scheme: Scheme, tokens: object, powers: tuple[np.ndarray, np.ndarray]) -> Found:
    """All segments of a document, in pieces of at most PIECE windows."""
    total = len(tokens)
    out = []
    for at in range(0, max(total - scheme.window + 1, 0), PIECE):
        part = tokens[at:at + PIECE + scheme.window - 1]
        codes = scheme.codes(part)
        parts = scheme.parts(part, codes)
        terms = scheme.gram // scheme.step
        n_grams = len(part) - scheme.gram + 1
        grams = np.zeros(n_grams, dtype=np.uint64)
        for i in range(terms):
            grams += parts[i * scheme.step:i * scheme.step + n_grams] * _ODD[i]
        grams ^= grams >> np.uint64(32)
        grams *= _ODD[-1]
        grams ^= grams >> np.uint64(29)
        keys = (grams & ~PLACE) | np.arange(n_grams, dtype=np.uint64)
        least = smallest_in_windows(keys, scheme.window - scheme.gram + 1)
        start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        count = np.diff(np.concatenate([start, [len(least)]]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[0][:len(codes)], dtype=np.uint64)])
        stop = start + count + scheme.window - 1
        content = (sums[stop] - sums[start]) * powers[1][start]
        content ^= content >> np.uint64(31)
        out.append((start + at, count, grams[(least[start] & PLACE).astype(np.int64)], content))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return Found(none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Found(*(np.concatenate([x[i] for x in out]) for i in range(4)))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def repeated_anchors(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(row_key, anchor): anchors of every document that occur again, in another document or place.

    Documents go by row_key, not by id: rows with a null or repeated id are documents of their own,
    and what is gathered for one never exceeds its windows. Copies of a row count once a batch.

    An anchor that repeats inside a batch is known at once and sent on straight to its documents,
    with one announcement; only the others travel to the task of their anchor.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers()
        for batch in batches:
            keys, fresh = np.unique(batch.column("row_key").to_numpy(), return_index=True)
            texts = _texts(batch)
            anchors, owners, twice = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for key, data in zip(keys, (texts[i] for i in fresh), strict=True):
                found = segments(scheme, scheme.units(data), powers)
                own, times = np.unique(found.anchor, return_counts=True)
                anchors.append(own)
                owners.append(np.full(len(own), key))
                twice.append(times > 1 if scheme.by_place else np.zeros(len(own), dtype=bool))
            anchor, owner = np.concatenate(anchors), np.concatenate(owners)
            values, inverse, times = np.unique(anchor, return_inverse=True, return_counts=True)
            known = (times > 1) | (np.bincount(inverse, np.concatenate(twice), len(values)) > 0)
            here = known[inverse]
            told = values[known]
            state = np.concatenate([here.astype(np.int8), np.full(len(told), 2, np.int8)])
            anchor = np.concatenate([anchor, told])
            owner = np.concatenate([owner, np.zeros(len(told), np.int64)])
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor), pa.array(owner), pa.array(state)], names=["anchor", "row_key", "state"]
            )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by anchor; the last anchor of a batch waits for the next batch."""

        def known(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            anchor, key, state = (np.concatenate([p[i] for p in parts]) for i in range(3))
            edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            sizes = np.diff(np.concatenate([edges, [len(anchor)]]))
            again = (sizes > 1) | (np.maximum.reduceat(state, edges) > 0) if len(edges) else np.zeros(0, bool)
            keep = np.repeat(again, sizes) & (state < 2)
            return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(anchor[keep])], names=["row_key", "anchor"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            now = tuple(batch.column(c).to_numpy() for c in ("anchor", "row_key", "state"))
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut or (held and held[0][0][0] != now[0][-1]):
                yield known([*held, tuple(x[:cut] for x in now)])
                held = []
            held.append(tuple(x[cut:] for x in now))
        if held:
            yield known(held)

    scanned = docs.select("row_key", "text").mapInArrow(scan, "anchor bigint, row_key bigint, state tinyint")
    # Worked out where rows are dealt, so it does not travel as a column.
    route = F.when(F.col("state") == 1, F.col("row_key")).otherwise(F.col("anchor"))
    dealt = scanned.repartition(route).sortWithinPartitions("anchor")
    return dealt.mapInArrow(settle, "row_key bigint, anchor bigint")


def joined_runs(rank: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rank, key, start, count) with neighbouring runs of windows of one row made one."""
    order = np.lexsort((start, key, rank))
    rank, key, start, count = (x[order] for x in (rank, key, start, count))
    follows = (rank[1:] == rank[:-1]) & (key[1:] == key[:-1]) & (start[1:] == start[:-1] + count[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~follows])[:len(rank)])
    return rank[head], key[head], start[head], np.add.reduceat(count, head) if len(head) else count


def anchor_marks(anchors: np.ndarray) -> np.ndarray:
    """Upper halves of anchors. Among those of one document two rarely agree, and then a segment too many is compared."""
    return (anchors.view(np.int64) >> 32).astype(np.int32)


def _kept_segments(pending: DataFrame, scheme: Scheme) -> DataFrame:
    """Segments of the kept anchors; `covered` where the batch itself holds an earlier equal one.

    Of covered windows only the place is asked for later: neighbouring ones are one row, without anchor and content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers()
        for batch in batches:
            ranks, keys = batch.column("rank").to_numpy(), batch.column("row_key").to_numpy()
            kept = batch.column("anchors").to_pylist()
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, data in enumerate(_texts(batch)):
                found = segments(scheme, scheme.units(data), powers)
                mask = np.isin(anchor_marks(found.anchor), np.array(kept[i], dtype=np.int32))
                n = int(mask.sum())
                for column, values in zip(columns, (
                    found.anchor[mask].view(np.int64), found.content[mask].view(np.int64), np.full(n, ranks[i]),
                    np.full(n, keys[i]), found.start[mask], found.count[mask],
                ), strict=True):
                    column.append(values)
            anchor, content, rank, key, start, count = (np.concatenate(c) for c in columns)
            order = np.lexsort((start, key, rank, content, anchor))
            anchor, content, rank, key, start, count = (x[order] for x in (anchor, content, rank, key, start, count))
            first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])[:len(anchor)]
            head = np.maximum.accumulate(np.where(first, np.arange(len(anchor)), 0)) if len(anchor) else order
            covered = rank > rank[head]
            if scheme.by_place:
                covered |= (rank == rank[head]) & ((key != key[head]) | (start != start[head]))
            gone = joined_runs(*(x[covered] for x in (rank, key, start, count)))
            none = np.zeros(len(gone[0]), dtype=np.int64)
            anchor, content, rank, key, start, count, covered = (
                np.concatenate([x[~covered], y])
                for x, y in zip((anchor, content, rank, key, start, count, covered), (none, none, *gone, none == 0), strict=True)
            )
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, (anchor, content, rank, key, start.astype(np.int64), count.astype(np.int32), covered))],
                names=["anchor", "content", "rank", "row_key", "start", "count", "covered"],
            )

    schema = "anchor bigint, content bigint, rank bigint, row_key bigint, start bigint, count int, covered boolean"
    return pending.select("rank", "row_key", "text", "anchors").mapInArrow(run, schema)


def _first_places(found: DataFrame) -> DataFrame:
    """(anchor, rank, row_key, start, count, covered): segments that an earlier rank holds too are covered.

    One pass over rows sorted by segment and rank: the first row of a segment is its earliest. A
    segment comes once from every batch that holds it, so a hot passage is some rows a batch, and
    a task keeps one rank. What a batch covered already is dealt out by place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        first_rank = 0
        for batch in batches:
            covered = batch.column("covered").to_numpy(zero_copy_only=False).copy()
            asked = ~covered
            anchor, content, rank = (batch.column(c).to_numpy()[asked] for c in ("anchor", "content", "rank"))
            if len(anchor):
                fresh = np.ones(len(anchor), dtype=bool)
                fresh[0] = last != (anchor[0], content[0])
                fresh[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
                head = np.maximum.accumulate(np.where(fresh, np.arange(len(anchor)), -1))
                first = np.where(head < 0, first_rank, rank[head])
                covered[asked] = rank > first
                last, first_rank = (anchor[-1], content[-1]), first[-1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("anchor", "rank", "row_key", "start", "count")], pa.array(covered)],
                names=["anchor", "rank", "row_key", "start", "count", "covered"],
            )

    route = F.when(F.col("covered"), F.xxhash64("row_key", "start")).otherwise(F.xxhash64("anchor", "content"))
    schema = "anchor bigint, rank bigint, row_key bigint, start bigint, count int, covered boolean"
    return found.repartition(route).sortWithinPartitions("anchor", "content", "rank").mapInArrow(run, schema)


def _shard_rows(pending: DataFrame, checks: DataFrame, scheme: Scheme) -> DataFrame:
    """Contents of the segments to compare, routed by anchor, or window by window where an anchor has too many.

    Windows dealt out singly are settled inside the batch first: equal ones go out once, and the
    others are covered at once (state 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = scheme.window
        for batch in batches:
            ranks, keys = batch.column("rank").to_pylist(), batch.column("row_key").to_pylist()
            rows: list[tuple[int, int, int, int, int, int, bytes | None]] = []
            single: dict[bytes, list[tuple[int, int, int]]] = {}
            for i, (data, wanted) in enumerate(zip(_texts(batch), batch.column("wanted").to_pylist(), strict=True)):
                tokens = scheme.units(data)
                for w in wanted:
                    start, count = w["start"], w["count"]
                    if not w["many"]:
                        rows.append((w["anchor"], ranks[i], keys[i], start, count, 0, scheme.piece(tokens[start:start + count + width - 1])))
                        continue
                    for at in range(start, start + count):
                        single.setdefault(scheme.piece(tokens[at:at + width]), []).append((ranks[i], keys[i], at))
            for content, places in single.items():
                places.sort()
                head = places[0]
                route = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)
                for place in places:
                    later = place[0] > head[0] or (scheme.by_place and place != head)
                    if later:
                        rows.append((place[1], *place, 1, 1, None))
                    else:
                        rows.append((route, *place, 1, 0, content))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.binary())
                )], names=["route", "rank", "row_key", "start", "count", "state", "content"],
            )

    wanted = checks.groupBy("rank", "row_key").agg(
        F.collect_list(F.struct("start", "count", "anchor", "many")).alias("wanted")
    )
    schema = "route bigint, rank bigint, row_key bigint, start bigint, count int, state tinyint, content binary"
    return _beside_texts(pending, wanted).mapInArrow(run, schema)


def _beside_texts(pending: DataFrame, found: DataFrame) -> DataFrame:
    """What was found in each row beside its text. Texts lie in buckets of row_key and stay where they are."""
    other = found.withColumnRenamed("rank", "found_rank")
    return pending.select("rank", "row_key", "text").join(other, "row_key").where("rank = found_rank").drop("found_rank")


def _judged(rows: DataFrame, scheme: Scheme, judge: Judge) -> DataFrame:
    """(rank, row_key, start, count) of covered windows found by `judge` in every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decided(group: list[dict]) -> list[tuple[int, int, int, int]]:
            out = [(r["rank"], r["row_key"], r["start"], r["count"]) for r in group if r["state"]]
            asked = [r for r in group if not r["state"]]
            for row, covered in zip(asked, judge([(r["rank"], r["row_key"], r["start"], r["content"]) for r in asked]), strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                out += [
                    (row["rank"], row["row_key"], row["start"] + int(a), int(b - a))
                    for a, b in zip(edges[::2], edges[1::2], strict=True)
                ]
            return out

        def packed(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))],
                names=["rank", "row_key", "start", "count"],
            )

        # Several anchors go to the judge together, never part of one; about SHARD_SEGMENTS rows at a time.
        block: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(block) >= SHARD_SEGMENTS and row["route"] != block[-1]["route"]:
                    yield packed(decided(block))
                    block = []
                block.append(row)
        if block:
            yield packed(decided(block))

    dealt = rows.repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(run, "rank bigint, row_key bigint, start bigint, count int")


def covered_windows(texts: DataFrame, scheme: Scheme, judge: Judge) -> tuple[DataFrame, DataFrame]:
    """(pending, covered): the documents with repeated anchors, one row each, and the covered windows of their rows."""
    ranked = texts.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rank"), "row_key", "text")
    # A row_key covers id and text; two documents that share one by chance would only keep each other's anchors.
    mark = F.shiftright("anchor", 32).cast("int")
    anchors = repeated_anchors(ranked, scheme).groupBy("row_key").agg(F.collect_set(mark).alias("anchors"))
    pending = written_by_key(
        ranked.join(anchors, "row_key").dropDuplicates(["row_key", "rank"]).select(*ranked.columns, "anchors"), "pending", "row_key"
    )
    marks = written(_first_places(_kept_segments(pending, scheme)), "marks")
    firsts = marks.where("not covered")
    several = written(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    checks = firsts.join(several, "anchor").select(
        "rank", "row_key", "start", "count", "anchor", (F.col("n") > SHARD_SEGMENTS).alias("many")
    )
    judged = _judged(_shard_rows(pending, checks, scheme), scheme, judge)
    covered = marks.where("covered").select("rank", "row_key", "start", "count").unionByName(judged)
    return pending, covered


def remove_covered(docs: DataFrame, scheme: Scheme, judge: Judge, empty: bytes = b"") -> DataFrame:
    """(doc_id, row_key, n_units, n_removed, n_spans, kept_sha256, removed) for every row of `docs`.

    removed lists the maximal removed runs as (start, stop) in units.
    """
    texts = keyed(docs)
    pending, covered = covered_windows(texts, scheme, judge)
    schema = (
        "rank bigint, row_key bigint, n_units bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "removed array<struct<start:bigint,stop:bigint>>"
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ranges = batch.column("ranges").to_pylist()
            for data, runs in zip(_texts(batch), ranges, strict=True):
                tokens = scheme.units(data)
                edges = np.zeros(len(tokens) + 1, dtype=np.int64)
                for r in runs or ():
                    edges[r["start"]] += 1
                    edges[r["start"] + r["count"] + scheme.window - 1] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                cuts = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = list(zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True))
                inner = [0, *[x for span in spans for x in span], len(tokens)]
                kept = [tokens[a:b] for a, b in zip(inner[::2], inner[1::2], strict=True) if b > a]
                joined = empty.join(scheme.piece(k) for k in kept)
                out.append((len(tokens), int(gone.sum()), len(spans), hashlib.sha256(joined).hexdigest(),
                            [{"start": a, "stop": b} for a, b in spans]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rank"), batch.column("row_key"), *[pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)]],
                names=["rank", "row_key", "n_units", "n_removed", "n_spans", "kept_sha256", "removed"],
            )

    # Rows that share a key are the same text, so one result serves them all.
    runs = covered.groupBy("rank", "row_key").agg(F.collect_set(F.struct("start", "count")).alias("ranges"))
    touched = _beside_texts(pending, runs).mapInArrow(finish, schema)
    touched = written(touched.dropDuplicates(["rank", "row_key"]), "touched")
    whole = texts.select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rank"), "row_key", "text",
        F.lit(None).cast("array<struct<start:bigint,count:int>>").alias("ranges"),
    ).mapInArrow(finish, schema)
    joined = whole.alias("w").join(touched.alias("t"), ["rank", "row_key"], "left")
    return joined.select(
        F.expr(f"nullif(rank, {-(1 << 63) + 1} - 1)").alias("doc_id"), "row_key", "w.n_units",
        F.coalesce("t.n_removed", "w.n_removed").alias("n_removed"), F.coalesce("t.n_spans", "w.n_spans").alias("n_spans"),
        F.coalesce("t.kept_sha256", "w.kept_sha256").alias("kept_sha256"), F.coalesce("t.removed", "w.removed").alias("removed"),
    )
