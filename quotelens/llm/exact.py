"""Exact dedup by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.rows import attach_once, keyed, same_row
from quotelens.plans.checkpoints import written

CHUNK = 1 << 16
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 69_069_069)


def combine(left: tuple[int, int], right: tuple[int, int], base: int, prime: int) -> tuple[int, int]:
    """(hash, length) of two adjoining pieces: the left hash shifted by the right length, plus the right."""
    return (left[0] * pow(base, right[1], prime) + right[0]) % prime, left[1] + right[1]


def _powers(base: int, prime: int) -> np.ndarray:
    """base ** (CHUNK - 1), ..., base, 1 modulo prime."""
    out = np.empty(CHUNK, dtype=np.int64)
    value = 1
    for i in range(CHUNK - 1, -1, -1):
        out[i] = value
        value = value * base % prime
    return out


def text_hash(data: bytes, powers: np.ndarray, base: int, prime: int) -> int:
    """Chunk hashes, each a dot product that stays below 2**63, folded by `combine`."""
    codes = np.frombuffer(data, dtype=np.uint8)
    total = (0, 0)
    for at in range(0, len(codes), CHUNK):
        piece = codes[at:at + CHUNK].astype(np.int64)
        total = combine(total, (int(piece @ powers[CHUNK - len(piece):]) % prime, len(piece)), base, prime)
    return total[0]


def fingerprints(docs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(doc_id, row_key, fp, n_bytes, text_sha256) of every text; fp holds one hash per prime."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_powers(b, p) for b, p in zip(BASES, primes, strict=True)]
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = []
            for data in texts:
                one, two = (text_hash(data, t, b, p) for t, b, p in zip(tables, BASES, primes, strict=True))
                fps.append(one << 31 | two)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(fps, pa.int64()),
                 pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                names=["doc_id", "row_key", "fp", "n_bytes", "text_sha256"],
            )

    schema = "doc_id bigint, row_key bigint, fp bigint, n_bytes bigint, text_sha256 string"
    return docs.select("doc_id", "row_key", "text").mapInArrow(run, schema)


def unequal_groups(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(fp, n_bytes) of groups whose texts are not all the same.

    The texts of groups are cut into chunks and only the smallest and largest chunk of each place
    is kept; they are the same exactly when all are. Map tasks combine first, so a group of any
    size reaches a reducer as a few chunks, and no task holds more than a chunk of a text.
    """
    joined = docs.join(members, same_row(docs, members)).select(
        members["fp"], members["n_bytes"], F.encode("text", "utf-8").alias("data")
    )
    places = F.explode(F.sequence(F.lit(0), (F.col("n_bytes") / CHUNK).cast("int"))).alias("place")
    chunks = joined.select("fp", "n_bytes", "data", places).select(
        "fp", "n_bytes", "place", F.substring("data", F.col("place") * CHUNK + 1, F.lit(CHUNK)).alias("chunk")
    )
    ends = chunks.groupBy("fp", "n_bytes", "place").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return ends.where("low <> high").select("fp", "n_bytes").distinct()


def exact_groups(docs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. The row with the largest doc_id
    stays (a null id is the smallest). Rows that repeat id and text stay or go together and all
    count in group_size. An empty table gives no rows.
    """
    texts = keyed(docs)
    prints = written(fingerprints(texts, primes), "prints")
    count = [F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")]
    groups = written(prints.groupBy("fp", "n_bytes").agg(*count), "groups")
    several = groups.where("group_size > 1").select("fp", "n_bytes")
    members = prints.join(several, ["fp", "n_bytes"]).select("doc_id", "row_key", "fp", "n_bytes").distinct()
    unequal = written(unequal_groups(texts, members), "unequal")
    if not unequal.isEmpty():
        return _split(texts, prints, groups, unequal)
    return _marked(prints.join(groups, ["fp", "n_bytes"]))


def _split(texts: DataFrame, prints: DataFrame, groups: DataFrame, unequal: DataFrame) -> DataFrame:
    """Fingerprints that different texts share: those groups are split by the texts themselves."""
    sure = prints.join(groups, ["fp", "n_bytes"]).join(unequal, ["fp", "n_bytes"], "left_anti")
    doubtful = prints.join(unequal, ["fp", "n_bytes"])
    rows = doubtful.join(texts.select("doc_id", "row_key", "text").distinct(), same_row(doubtful, texts)).select(
        doubtful["doc_id"], doubtful["row_key"], "text_sha256", "text"
    )
    by_text = written(rows.groupBy("text").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")
    ), "by-text")
    return _marked(sure).unionByName(_marked(rows.join(by_text, "text")))


def _marked(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "row_key", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of `docs` per text, with all its columns: rows that repeat its id and text go too.

    Of null and empty texts with one id, or without, one stays. Which of rows that differ in other
    columns only stays is not defined.
    """
    kept = exact_groups(docs).where("kept").groupBy("doc_id", "text_sha256").agg(
        F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("copies")
    )
    return attach_once(docs, written(kept.select("doc_id", "row_key", "copies"), "kept"))
