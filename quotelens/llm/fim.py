"""Fill-in-middle transformation over content-defined chunks with memoized token counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

WINDOW = 32
CHUNK_BITS = 8  # a chunk holds 256 bytes on average
SLAB = 1 << 20
MEMO_ENTRIES = 1 << 15
MEMO_BYTES = 1 << 10

# A token is a run of ASCII letters or one other character; of a character only its first byte counts.
_TOKEN = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xbf]")
_LETTERS = frozenset(bytes([c]) for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)).astype(np.uint32)


def chunk_ends(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of the chunks of a text, its own end last.

    A chunk ends where the top bits of a rolling hash of the last 32 bytes are zero, so equal
    passages fall into equal chunks wherever they stand. The hash of 32 bytes is the sum of their
    gear values, each shifted by its age, built in five doublings.
    """
    codes = np.frombuffer(data, np.uint8)
    ends: list[int] = []
    for at in range(0, len(codes), SLAB):
        first = max(0, at - WINDOW + 1)
        rolled = _GEAR[codes[first:at + SLAB]]
        for age in (1, 2, 4, 8, 16):
            rolled[age:] = rolled[age:] + (rolled[:-age] << np.uint32(age))
        cuts = np.flatnonzero(rolled >> np.uint32(32 - bits) == 0) + first + 1
        ends += cuts[(cuts > max(at, WINDOW - 1)) & (cuts < len(codes))].tolist()
    return [*ends, len(data)]


def summary(chunk: bytes) -> tuple[int, bool, bool]:
    """Tokens that start in a chunk if no letter stands before it; whether it starts and ends with a letter."""
    return len(_TOKEN.findall(chunk)), chunk[:1] in _LETTERS, chunk[-1:] in _LETTERS


class Counter:
    """Token starts of texts, from summaries remembered by the content of a chunk."""

    def __init__(self, bits: int = CHUNK_BITS) -> None:
        self.bits = bits
        self.memo: dict[bytes, tuple[int, bool, bool]] = {}

    def _summary(self, chunk: bytes) -> tuple[int, bool, bool]:
        known = self.memo.get(chunk)
        if known is None:
            known = summary(chunk)
            if len(chunk) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[chunk] = known
        return known

    def locate(self, data: bytes, one: int, two: int) -> tuple[int, int, int]:
        """(n tokens, byte where the prefix ends, byte where the middle ends).

        Adjoining summaries combine by adding counts, less one where a run of letters goes on. A
        cut after k tokens is the start of token k: running counts name its chunk, and only that
        chunk is read again.
        """
        ends = chunk_ends(data, self.bits)
        running, starts, goes_on = [0], [0, *ends][:-1], []
        last_letter = False
        for a, b in zip(starts, ends, strict=True):
            count, first, last = self._summary(data[a:b])
            goes_on.append(first and last_letter)
            running.append(running[-1] + count - goes_on[-1])
            last_letter = last
        n = running[-1]
        places = []
        for k in sorted((one % (n + 1), two % (n + 1))):
            if k == n:
                places.append(len(data))
                continue
            c = int(np.searchsorted(running, k, side="right")) - 1
            inside = [m.start() for m in _TOKEN.finditer(data, starts[c], ends[c])][goes_on[c]:]
            places.append(inside[k - running[c]])
        return n, places[0], places[1]


_COUNTER = Counter()


_CUTS = StructType([StructField(name, LongType()) for name in ("n", "prefix_end", "middle_end")])


@F.arrow_udf(_CUTS)
def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, ones, twos in batches:
        found = [
            _COUNTER.locate(t.as_py(), one, two)
            for t, one, two in zip(texts, ones.to_pylist(), twos.to_pylist(), strict=True)
        ]
        flat = np.array(found, np.int64).reshape(-1, 3)
        yield pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], _CUTS.names)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 10, spm_percent: int = 20,
    seed: str = "1:",
) -> DataFrame:
    """Per row: `row` (all columns of `docs`), n, form, prefix_chars, middle_chars, output.

    The digest of seed and id draws two cuts, the form, and the order. A text that is empty or
    holds a marker stays plain. A null text is empty; a null id is drawn as an empty string.
    Repeated rows get the same result each, an empty table stays empty, and columns of `docs` cannot
    clash, since they are inside `row`. Nothing is shuffled: Python sees the bytes of a text and
    returns three numbers, chunks are remembered by their content for the life of a worker, and
    a text of any length is hashed slab by slab.
    """
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    text = F.coalesce(F.col(text_col), F.lit(""))
    drawn = docs.select(F.struct("*").alias("row"), text.alias("text"), *[
        F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)
    ])
    cut = drawn.withColumn("data", F.col("text").cast("binary")).withColumn("cut", _cuts("data", "h1", "h2"))
    a, b = F.col("cut.prefix_end").cast("int"), F.col("cut.middle_end").cast("int")
    parts = cut.select(
        "row", "text", "h3", "h4", F.col("cut.n").alias("n"),
        F.substring("data", F.lit(1), a).cast("string").alias("prefix"),
        F.substring("data", a + 1, b - a).cast("string").alias("middle"),
        F.substring("data", b + 1, F.length("data") - b).cast("string").alias("suffix"),
    )
    marked = F.col("text").contains("<P>") | F.col("text").contains("<S>") | F.col("text").contains("<M>")
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain_percent), "plain").when(
        F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    psm = F.concat(F.lit("<P>"), "prefix", F.lit("<S>"), "suffix", F.lit("<M>"), "middle")
    spm = F.concat(F.lit("<S>"), "suffix", F.lit("<P>"), "prefix", F.lit("<M>"), "middle")
    whole = F.col("form") == "plain"
    return parts.withColumn("form", form).select(
        "row", "n", "form", F.when(~whole, F.char_length("prefix").cast("bigint")).alias("prefix_chars"),
        F.when(~whole, F.char_length("middle").cast("bigint")).alias("middle_chars"),
        F.when(whole, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The parts hold no marker, so each is found by its first place."""
    body = F.substring(output, F.lit(4), F.char_length(output))
    sign = F.when(form == "psm", "<S>").otherwise("<P>")
    one, rest = F.split_part(body, sign, F.lit(1)), F.split_part(body, sign, F.lit(2))
    two, middle = F.split_part(rest, F.lit("<M>"), F.lit(1)), F.split_part(rest, F.lit("<M>"), F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(
        F.concat(two, middle, one)
    )
