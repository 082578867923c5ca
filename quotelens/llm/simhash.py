"""SimHash near-dedup with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens.llm.components import components
from quotelens.llm.rows import attach_once, keyed
from quotelens.plans.checkpoints import written

SEGMENTS, WIDTH = 8, 8
MAX_BITS = 3
SHINGLE = 3
SEED = 42
# Fingerprints of a text in `drop_near_copies`.
FAMILIES = 12
# Near copies proper: five-word shingle sets with a Jaccard similarity of SIMILAR[0] / SIMILAR[1] or more.
SET_SHINGLE = 5
SIMILAR = (4, 5)
# MinHash keys of a text that also propose candidates: of 24 with 6 minima each, a pair at 0.8 misses all once in 1,400.
BANDS, MINIMA = 24, 6
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(SEED).integers(1 << 63, dtype=np.uint64, size=BANDS * MINIMA) * np.uint64(2) + np.uint64(1)
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
# Segments after the first two of a chain, of which the budgets of `chain_budgets` leave two equal.
_EQUAL = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4))
_KEYS = SEGMENTS * len(_EQUAL)


def chain_budgets(max_bits: int = MAX_BITS) -> list[int]:
    """Most differing bits of the first 1, 2, ... segments of a chain: its share of the bits, rounded down."""
    return [n * max_bits // SEGMENTS for n in range(1, SEGMENTS + 1)]


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; a shorter text is one shingle, none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=False)),
        dtype=np.uint64, count=len(words) - shingle + 1,
    )


def text_prints(text: bytes, shingle: int = SHINGLE, families: int = 1) -> np.ndarray:
    """Majority bits over the XXH64 of all word shingles, repeats included; 0 without words.

    The first value is the fingerprint proper. Further families count the bits of the same hashes
    after a mixing step of their own, so each is an independent draw over the same shingles.
    """
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return np.zeros(families, dtype=np.uint64)
    values = np.zeros(families, dtype=np.uint64)
    for family in range(families):
        octets = _mixed(hashes, family).view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BIT_OF_BYTE for i in range(8)])
        values[family] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return values


def _mixed(hashes: np.ndarray, family: int) -> np.ndarray:
    if not family:
        return hashes
    mixed = (hashes ^ np.uint64(family)) * _ODD
    mixed = (mixed ^ mixed >> np.uint64(32)) * _ODD
    return mixed ^ mixed >> np.uint64(29)


def text_set(text: bytes, shingle: int = SET_SHINGLE) -> np.ndarray:
    """Distinct shingle hashes; texts without words share the set of one zero."""
    found = np.unique(shingle_hashes(text, shingle))
    return found if len(found) else np.zeros(1, dtype=np.uint64)


def text_bands(text: bytes, shingle: int = SET_SHINGLE) -> np.ndarray:
    """BANDS keys, each of MINIMA smallest remixed hashes of the shingle set: equal with chance J ** MINIMA."""
    factors = _FACTORS[:, None]
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    hashes = text_set(text, shingle)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[None, at:at + 4096] * factors
        mixed ^= mixed >> np.uint64(32)
        mixed *= _ODD
        least = np.minimum(least, mixed.min(axis=1))
    bands = least.reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(bands)], dtype=np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, families: int = 1) -> DataFrame:
    """(doc_id, row_key, fps) of whole texts; bytes.lower and bytes.split are the ASCII rules asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = [text_prints(t, shingle, families).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(fps, pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "fps"],
            )

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, "doc_id bigint, row_key bigint, fps array<bigint>")


def _buckets(fp: Column, family: Column) -> Column:
    """All keys (family, start of chain, which of its segments are equal, their bits) of a fingerprint.

    With at most 3 bits over 8 segments on a ring, some chain keeps within its budgets 0, 0, 1,
    1, 1, ...: its first two segments are equal and so are two of the next three. So two linked
    fingerprints share one of these 24 keys of 32 bits.
    """
    keys = []
    for start in range(SEGMENTS):
        for kind, offsets in enumerate(_EQUAL):
            bits = (family * _KEYS + start * len(_EQUAL) + kind).cast("bigint")
            for offset in offsets:
                part = F.shiftrightunsigned(fp, (start + offset) % SEGMENTS * WIDTH).bitwiseAND(F.lit(255))
                bits = F.shiftleft(bits, 8).bitwiseOR(part)
            keys.append(bits)
    return F.array(*keys)


def within_chain(differing: np.ndarray, start: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """Which XORs keep every prefix of the chain from `start` within its budget."""
    octets = np.bitwise_count(differing.view(np.uint8).reshape(-1, SEGMENTS))
    ring = np.roll(octets, -start, axis=1).cumsum(axis=1)
    return (ring <= np.array(chain_budgets(max_bits))).all(axis=1)


def link_bucket(values: np.ndarray, start: int, max_bits: int = MAX_BITS) -> list[np.ndarray]:
    """Groups (places in `values`) of two or more that links connect inside one bucket of distinct fingerprints.

    A search from one value to the next compares only with values not reached yet, so a dense
    bucket costs about its size, not all its pairs.
    """
    groups, rest = [], np.arange(len(values))
    while len(rest) > 1:
        queue, group, rest = [rest[0]], [rest[:1]], rest[1:]
        while queue and len(rest):
            differing = values[rest] ^ values[queue.pop()]
            near = within_chain(differing, start, max_bits)
            near[near] = np.bitwise_count(differing[near]) <= max_bits
            if near.any():
                group.append(rest[near])
                queue += list(rest[near])
                rest = rest[~near]
        if len(group) > 1:
            groups.append(np.concatenate(group))
    return groups


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (least node of a group, another of it, their family); batches come sorted by bucket, the last bucket waits for more."""

    def linked(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        buckets, fps, nodes = (np.concatenate(x) for x in zip(*parts, strict=True))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]])
        heads, tails, families = ([np.empty(0, dtype=np.int64)] for _ in range(3))
        for i in np.flatnonzero(np.diff(edges) > 1):
            low, start = edges[i], int(buckets[edges[i]] >> 32) % _KEYS // len(_EQUAL)
            for group in link_bucket(fps[low:edges[i + 1]], start):
                members = np.sort(nodes[low + group])
                heads.append(np.repeat(members[0], len(members) - 1))
                tails.append(members[1:])
                families.append(np.full(len(members) - 1, int(buckets[low] >> 32) // _KEYS))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in (heads, tails, families)], names=["a", "b", "family"]
        )

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in ("bucket", "fp", "node")]
        columns[1] = columns[1].view(np.uint64)
        last = columns[0][-1]
        tail = int(np.searchsorted(columns[0], last))
        if held and (tail or held[0][0][0] != last):
            yield linked([*held, [c[:tail] for c in columns]])
            held = []
        elif tail:
            yield linked([[c[:tail] for c in columns]])
        held.append([c[tail:] for c in columns])
    if held:
        yield linked(held)


def _links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of the nodes of (family, fp, node), one row per family and fingerprint."""
    keys = F.explode(_buckets(F.col("fp"), F.col("family"))).alias("bucket")
    buckets = prints.select("fp", "node", keys).repartition("bucket")
    return buckets.sortWithinPartitions("bucket").mapInArrow(_link, "a bigint, b bigint, family bigint")


def _near_prints(prints: DataFrame) -> DataFrame:
    """(family, fp) of the fingerprints with a near partner in their family, of distinct (family, fp).

    A row travels as its fingerprint and the number of its key; both ends work out the bucket of
    `_buckets` from them, which halves what is shuffled.
    """
    start, kind = "(key % {0}) div {1}".format(_KEYS, len(_EQUAL)), "key % {0}".format(len(_EQUAL))
    bucket = "cast(key as bigint)"
    for offset in ("0", "1", f"(2 + int({kind} = 2))", f"(3 + int({kind} > 0))"):
        shift = f"cast(({start} + {offset}) % {SEGMENTS} * {WIDTH} as int)"
        bucket = f"(shiftleft({bucket}, 8) | (shiftrightunsigned(fp, {shift}) & 255L))"
    keys = F.explode(F.sequence(F.col("family") * _KEYS, F.col("family") * _KEYS + _KEYS - 1)).alias("key")
    dealt = prints.select("fp", keys).repartition(F.expr(bucket))
    buckets = dealt.select("fp", F.col("fp").alias("node"), F.expr(bucket).alias("bucket"))
    links = buckets.sortWithinPartitions("bucket").mapInArrow(_link, "a bigint, b bigint, family bigint")
    return links.select("family", F.explode(F.array("a", "b")).alias("fp")).distinct()


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, fp, component_id.

    Fingerprints at 3 or fewer differing bits are linked; component_id is the smallest doc_id
    reachable over links. Only distinct fingerprints are compared, so copies cost nothing. Null
    and wordless texts have fingerprint 0, which links like any other. A null id is passed over
    in the minimum unless a component has no other. An empty table gives no rows.
    """
    found = fingerprints(keyed(docs), shingle)
    prints = written(found.select("doc_id", "row_key", F.col("fps")[0].alias("fp")), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    links = _links(nodes.select(F.lit(0).alias("family"), "fp", F.col("fp").alias("node")))
    labels = written(components(links), "components")
    labelled = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_fp = written(labelled.join(least, "label").select("fp", "component_id"), "by-fingerprint")
    return prints.join(by_fp, "fp").select("doc_id", "row_key", "fp", "component_id")


def _arrays(docs: DataFrame, name: str, make: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(row_key, name) of whole texts: one array of hashes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(t).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), pa.array(made, pa.list_(pa.int64()))], names=["row_key", name]
            )

    return docs.select("row_key", "text").mapInArrow(run, f"row_key bigint, {name} array<bigint>")


def _candidates(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(row_key): rows with a partner at 3 or fewer differing bits in any family, or with an equal MinHash key."""
    each = prints.select("row_key", F.posexplode("fps").alias("family", "fp"))
    nodes = written(each.groupBy("family", "fp").agg((F.min("row_key") < F.max("row_key")).alias("shared")), "nodes")
    near = _near_prints(nodes).union(nodes.where("shared").select("family", "fp")).distinct()
    by_print = each.join(near, ["family", "fp"], "left_semi").select("row_key")
    bands = written(_arrays(texts, "bands", text_bands).select("row_key", F.explode("bands").alias("band")), "bands")
    several = bands.groupBy("band").agg((F.min("row_key") < F.max("row_key")).alias("shared")).where("shared")
    return by_print.union(bands.join(several, "band", "left_semi").select("row_key")).distinct()


def _postings(sets: DataFrame) -> DataFrame:
    """(token, row_key, size, left): the tokens by which two similar sets must meet.

    Tokens of a set are ordered by the number of sets that hold them. Two sets with a similarity
    of 0.8 share one of the first size - ceil(0.8 size) + 1 of each. `left` counts the tokens from
    there on, so the first token that two sets share bounds what they have in common; a set is
    left out where it has too few for even the smallest set at that token.
    """
    up, down = SIMILAR
    tokens = written(sets.select("row_key", F.size("tokens").alias("size"), F.explode("tokens").alias("token")), "tokens")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("holders"))
    place = F.row_number().over(Window.partitionBy("row_key").orderBy("holders", "token"))
    placed = tokens.join(counts, "token").withColumn("left", F.col("size") - place + 1)
    least = F.floor((F.col("size") * up + down - 1) / down)
    first = written(placed.where((F.col("left") >= least) & (F.col("holders") > 1)).select("token", "row_key", "size", "left"), "first")
    smallest = first.groupBy("token").agg(F.min("size").alias("smallest"))
    return first.join(smallest, "token").where(
        F.col("left") * (up + down) >= (F.col("size") + F.col("smallest")) * up
    ).drop("smallest")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of the pairs whose whole sets have a similarity of 0.8 or more."""
    up, down = SIMILAR
    one = sets.select(F.col("row_key").alias("a"), F.col("tokens").alias("one"))
    two = sets.select(F.col("row_key").alias("b"), F.col("tokens").alias("two"))
    common = F.size(F.array_intersect("one", "two")) * (up + down)
    return pairs.join(one, "a").join(two, "b").where(common >= (F.size("one") + F.size("two")) * up).select("a", "b")


def similar_components(sets: DataFrame) -> DataFrame:
    """(node, label) of the connected components of all pairs of sets (row_key, tokens) with a similarity of 0.8 or more.

    At every token all sets are compared with the one that has most tokens in common with others;
    afterwards only sets of different components are compared, all of them. So a large group of
    copies costs about its size, and no pair is passed over.
    """
    up, down = SIMILAR
    posted = written(_postings(sets), "postings")
    centre = posted.groupBy("token").agg(F.min_by("row_key", F.struct(-F.col("left"), F.col("row_key"))).alias("a"))
    star = posted.join(centre, "token").select("a", F.col("row_key").alias("b")).where("a <> b").distinct()
    links = written(_verified(star, sets), "star")
    labels = written(components(links), "components")
    labelled = posted.join(labels, posted["row_key"] == labels["node"], "left").select(
        "token", "row_key", "size", "left", F.coalesce("label", "row_key").alias("label")
    )
    labelled = written(labelled, "labelled")
    open_ones = labelled.groupBy("token").agg((F.min("label") < F.max("label")).alias("open")).where("open")
    rest = labelled.join(open_ones, "token", "left_semi")
    x, y = rest.alias("x"), rest.alias("y")
    cross = x.join(y, F.expr(
        "x.token = y.token and x.row_key < y.row_key and x.label <> y.label and "
        f"least(x.left, y.left) * {up + down} >= (x.size + y.size) * {up}"
    )).select(F.col("x.row_key").alias("a"), F.col("y.row_key").alias("b")).distinct()
    more = written(_verified(cross, sets), "cross")
    return labels if more.isEmpty() else written(components(links.union(more)), "components")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, families: int = FAMILIES) -> DataFrame:
    """One row of `docs` per component, that of the smallest id, with all its columns.

    Texts are linked when their whole sets of five-word shingles have a Jaccard similarity of 0.8
    or more. Fingerprints of several families and MinHash keys only propose the texts to compare.
    Null and wordless texts are equal. A null id stays only where a component has no other; rows
    that repeat id and text go but for one. An empty table gives no rows.
    """
    texts = keyed(docs)
    prints = written(fingerprints(texts, shingle, families), "prints")
    chosen = written(_candidates(texts, prints), "candidates")
    asked = texts.join(chosen, "row_key", "left_semi")
    sets = written(_arrays(asked, "tokens", text_set).dropDuplicates(["row_key"]), "sets")
    labels = similar_components(sets)
    members = prints.join(labels, prints["row_key"] == labels["node"]).select("doc_id", "row_key", "label")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))
    least = members.groupBy("label").agg(F.min_by("row_key", order).alias("stays"))
    later = members.join(least, "label").where("row_key <> stays").select("row_key").distinct()
    kept = prints.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("copies")).join(later, "row_key", "left_anti")
    return attach_once(docs, written(kept, "kept"))
