"""Language ID by blended-spectrum string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quotelens.llm.rows import keyed

ORDERS = (2, 3, 4)
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
TRAIN_ROWS = 1600
LANDMARKS = 128
RIDGE = 0.1
LEAST_SCORE = 0.05
# Texts scored at once: at most 64 x 65,536 slots, whatever their length.
BATCH = 64
UNKNOWN = "und"


def presence(text: bytes) -> np.ndarray:
    """Sorted slots of the distinct byte n-grams (2 to 4) of the lower-cased text."""
    codes = np.frombuffer(text.lower(), dtype=np.uint8).astype(np.uint32)
    seen = np.zeros(SLOTS, dtype=bool)
    gram = codes
    for order in range(2, max(ORDERS) + 1):
        if len(codes) < order:
            break
        gram = (gram[:-1] << np.uint32(8)) | codes[order - 1:]
        if order in ORDERS:
            # Multiplicative hash of the packed bytes, kept apart by length.
            seen[(gram * np.uint32(2654435761) + np.uint32(order * 40503)) >> np.uint32(32 - SLOT_BITS)] = True
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class LanguageModel:
    """labels, and per slot the weight it adds to each label (kernel rows times dual weights)."""

    labels: list[str]
    weights: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Kernel values against all landmarks times their weights, as sparse matrix products of BATCH texts."""
        parts = [self._product(texts[i:i + BATCH]) for i in range(0, len(texts), BATCH)]
        return np.concatenate([np.zeros((0, len(self.labels))), *parts])

    def _product(self, texts: list[bytes]) -> np.ndarray:
        slots = [presence(t) for t in texts]
        sizes = np.array([len(s) for s in slots])
        out = np.zeros((len(texts), len(self.labels)))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            sums = np.add.reduceat(self.weights[np.concatenate([slots[i] for i in full])], starts, axis=0)
            out[full] = sums / np.sqrt(sizes[full])[:, None]
        return out


def _unit_rows(packed: list[bytes]) -> np.ndarray:
    """Presence rows of length 1."""
    bits = np.unpackbits(np.frombuffer(b"".join(packed), dtype=np.uint8)).reshape(-1, SLOTS).astype(np.float32)
    return bits / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1))


def fit(packed: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Normalised presence kernels k(s, t) = |S & T| / sqrt(|S| |T|) of packed presence rows, ordered by chance.

    Landmarks are dealt from the labels in turn. Nyström features are k(x, landmarks) times the
    inverse root of the landmark kernel; a ridge regression per label maps them to 0 and 1.
    """
    labels = sorted(set(langs))
    turn: dict[str, int] = {}
    ranks = []
    for i, lang in enumerate(langs):
        turn[lang] = turn.get(lang, -1) + 1
        ranks.append((turn[lang], lang, i))
    chosen = [i for _, _, i in sorted(ranks)[:landmarks]]
    marks = _unit_rows([packed[i] for i in chosen])
    # Rows are unpacked a block at a time; the kernel against the landmarks is all that stays.
    kernel = np.concatenate([_unit_rows(packed[i:i + 128]) @ marks.T for i in range(0, len(packed), 128)])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    goal = np.array([[float(lang == label) for label in labels] for lang in langs])
    dual = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ goal)
    return LanguageModel(labels, (marks.T @ (root @ dual)).astype(np.float64))


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(row_key, doc_id, lang, turn): per language an equal share of at most `rows` rows, by digest of the id.

    Rows that repeat id, text and label count once. Rows of documents whose crc32 of the id modulo 3 is 1, with null labels or with null texts are not used.
    """
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "lang",
             F.md5(F.col("doc_id").cast("string")).alias("turn")).distinct()
    languages = known.agg(F.count_distinct("lang")).first()[0]
    share = max(2, rows // max(languages, 1))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "doc_id", "row_key"))
    return known.withColumn("rank", rank).where(F.col("rank") <= share).drop("rank")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Fit on at most `rows` labelled rows (two a language at least); None if there are none.

    Only presence bits of the sample reach the driver: 8 KB a row, however often a row is repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                bits = np.zeros(SLOTS, dtype=bool)
                bits[presence(text)] = True
                packed.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("turn"), pa.array(packed, pa.binary())],
                names=["lang", "turn", "bits"],
            )

    sample = training_rows(docs, rows)
    texts = keyed(docs)
    # At most `rows` narrow rows (two a language at least): a bounded broadcast.
    chosen = texts.join(F.broadcast(sample.withColumnRenamed("doc_id", "id")), "row_key").where(
        F.col("doc_id") == F.col("id")
    )
    # Copies of a row are dropped in the map tasks, so a repeated one arrives as a few rows.
    chosen = chosen.dropDuplicates(["id", "row_key", "lang"])
    found = chosen.select("text", "lang", "turn").mapInArrow(run, "lang string, turn string, bits binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["turn"], r["lang"], bytes(r["bits"])))
    return fit([bytes(r["bits"]) for r in found], [r["lang"] for r in found])


def predict(docs: DataFrame, model: LanguageModel | None, carry: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score (0 to 1), and the whole row as `row` if `carry`.

    lang_pred is `und` with score 0 where the text is null or has no letter, or nothing was
    learned. Ties go to the first label by code point. Rows stay where they are: no shuffle.
    """
    kept = ["doc_id", *(["row"] if carry else [])]
    row = F.struct("*") if carry else F.struct("text")
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    frame = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row.alias("row"), lettered.alias("lettered"))
    if model is None:
        return frame.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(pc.struct_field(batch.column("row"), "text"), "")
            scores = model.scores(texts.cast(pa.binary()).to_pylist())
            best = scores.argmax(axis=1)
            fits = np.clip(scores[np.arange(len(best)), best], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], batch.column("lettered"),
                 pa.array([model.labels[i] for i in best], pa.string()), pa.array(fits, pa.float64())],
                names=[*kept, "lettered", "label", "fit"],
            )

    schema = StructType(frame.select(*kept, "lettered").schema.fields).add("label", "string").add("fit", "double")
    known = F.col("lettered")
    return frame.mapInArrow(run, schema).select(
        *kept, F.when(known, F.col("label")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.col("fit")).otherwise(0.0).alias("score"),
    )


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Learn from the labelled rows of `docs` and predict every row; see `training_rows` and `predict`."""
    return predict(docs, train(docs, rows))


def accepted_documents(docs: DataFrame, least_score: float = LEAST_SCORE, rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows whose language is recognised with at least `least_score`, with all their columns."""
    found = predict(docs, train(docs, rows), carry=True)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
