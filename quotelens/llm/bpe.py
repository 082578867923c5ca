"""Byte-level BPE by forced boundaries: fragments are encoded apart, many at once, then joined."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType
from tokenizers import pre_tokenizers

BLOCK_CHARS = 1 << 16
# Pieces that are learnt together, and the bounds of the memo between slabs.
SLAB_PIECES = 1 << 16
MEMO_ENTRIES = 1 << 17
MEMO_CHARS = 64
MAX_FILE_BYTES = 64 << 20
# Fragments of more bytes are merged one by one.
SHORT = 64
_NEVER = 1 << 62

# Fixed value: how the byte-level pre-tokenizer divides a text.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# No piece goes on from a letter or digit into a space, and what follows is divided as if it stood alone.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?= )")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others for the characters from U+0100 on.
    """
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _PairTable:
    """Merge ranks of token pairs, looked up for whole arrays: open addressing over a sparse table."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(16, int(4 * len(pairs)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NEVER, np.int64)
        at, left, self.probes = self._slots(pairs), np.arange(len(pairs)), 0
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = pairs[free]
            won = free[self.keys[at[free]] == pairs[free]]  # the last of several that want one slot
            self.values[at[won]] = ranks[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NEVER where they do not merge or one is missing (negative)."""
        pairs = left << 32 | right
        at = self._slots(pairs)
        out = np.where(self.keys[at] == pairs, self.values[at], _NEVER)
        for _ in range(self.probes - 1):
            at = (at + 1) & self.mask
            out = np.where(self.keys[at] == pairs, self.values[at], out)
        out[(left < 0) | (right < 0)] = _NEVER
        return out


class Codec:
    """Encoder of one vocabulary file; holds a memo of bounded size."""

    def __init__(self, file: str) -> None:
        spec = json.loads(file)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if (
            spec["normalizer"] or spec["post_processor"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
            or not pre.get("use_regex", True) or any(model.get(k) for k in (
                "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        ):
            raise ValueError("only plain byte-level BPE files are supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match their bare strings")
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        symbols = byte_symbols()
        code = {s: b for b, s in enumerate(symbols)}
        vocab: dict[str, int] = model["vocab"]
        self.id_of_byte = np.array([vocab[s] for s in symbols], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.merged_id = np.array([vocab[a + b] for a, b in merges], np.int64)
        pairs = np.array(list(self.merges), np.int64).reshape(-1, 2)
        self.table = _PairTable(pairs[:, 0] << 32 | pairs[:, 1], np.array(list(self.merges.values()), np.int64))
        # Bytes that stand side by side inside a token; between any other two a boundary is certain.
        self.inside = np.zeros((256, 256), bool)
        for token in vocab:
            for x, y in zip(token, token[1:], strict=False):
                self.inside[code[x], code[y]] = True
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_at = re.compile("|".join(map(re.escape, longest_first)) or r"(?!)")
        self.memo: dict[str, bytes] = dict(self.added)
        self.same_class: dict[str, bool] = {}

    def fragments(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ends of the fragments of adjoining pieces: piece ends, and every pair of bytes that no token holds."""
        cut = np.zeros(len(codes) + 1, bool)
        cut[ends] = True
        cut[1:-1] |= ~self.inside[codes[:-1], codes[1:]]
        return np.flatnonzero(cut)

    def merged(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all fragments one after another, ids per fragment): in each, the pair of least rank is merged first, leftmost first."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        sizes = ends - starts
        counts, found = np.zeros(len(ends), np.int64), []
        for low, high in zip((0, 4, 8, 16, 32), (4, 8, 16, 32, SHORT), strict=True):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                places = starts[rows, None] + np.arange(high)
                parts = self.id_of_byte[codes[np.minimum(places, len(codes) - 1)]]
                parts[places >= ends[rows, None]] = -1
                found.append((rows, self._merged_together(parts)))
        for row in np.flatnonzero(sizes > SHORT).tolist():
            ids = self._merged_long(self.id_of_byte[codes[starts[row]:ends[row]]].tolist())
            found.append((np.array([row]), np.array([ids], np.int64)))
        for rows, parts in found:
            counts[rows] = (parts >= 0).sum(axis=1)
        after = np.cumsum(counts)
        flat = np.empty(after[-1] if len(after) else 0, np.int64)
        for rows, parts in found:
            held = parts >= 0
            places = (after - counts)[rows, None] + np.arange(parts.shape[1])
            flat[places[held]] = parts[held]
        return flat, counts

    def _merged_together(self, parts: np.ndarray) -> np.ndarray:
        """Fragments as rows of ids, filled up with -1: each round makes one merge in every row that has one left."""
        done = np.full_like(parts, -1)
        at, columns = np.arange(len(parts)), np.arange(parts.shape[1])
        parts = np.hstack([parts, np.full((len(parts), 1), -1, np.int64)])
        ranks = self.table.ranks(parts[:, :-1], parts[:, 1:])
        while len(at):
            least = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), least]
            alive = best < _NEVER
            if not alive.all():
                done[at[~alive]] = parts[~alive, :-1]
                at, parts, ranks, least, best = at[alive], parts[alive], ranks[alive], least[alive], best[alive]
            row = np.arange(len(at))
            parts[row, least] = self.merged_id[best]
            later = columns > least[:, None]
            parts[:, :-1] = np.where(later, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(later[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NEVER
            ranks[row, least] = self.table.ranks(parts[row, least], parts[row, least + 1])
            kept = least > 0
            some, left = row[kept], least[kept] - 1
            ranks[some, left] = self.table.ranks(parts[some, left], parts[some, left + 1])
        return done

    def _merged_long(self, parts: list[int]) -> list[int]:
        """A fragment of many bytes: pairs wait in a queue by rank and place."""
        end, merges, merged_id = len(parts), self.merges, self.merged_id
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(merges[p], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
        heapq.heapify(queue)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            if parts[i] != left or (j := after[i]) == end or parts[j] != right:
                continue  # one of the two has been merged since
            parts[i], parts[j] = int(merged_id[rank]), -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < end and (pair := (parts[a], parts[b])) in merges:
                    heapq.heappush(queue, (merges[pair], a, *pair))
        return [p for p in parts if p >= 0]

    def learn(self, pieces: list[str]) -> None:
        """Put the packed ids of pieces into the memo: one array of bytes, cut into fragments, merged, joined again."""
        if not pieces:
            return
        data = [p.encode() for p in pieces]
        codes = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([len(d) for d in data])
        fragments = self.fragments(codes, ends)
        flat, counts = self.merged(codes, fragments)
        bounds = np.cumsum(counts)[np.searchsorted(fragments, ends)]
        packed = flat.astype("<u4").tobytes()
        start = 0
        for piece, stop in zip(pieces, (4 * bounds).tolist(), strict=True):
            self.memo[piece] = packed[start:stop]
            start = stop

    def _divided(self, block: str) -> list[str]:
        """Pieces of a block. Characters that the two libraries class apart are left to the tokenizer's own."""
        if not block.isascii():
            for c in set(block):
                if c > "\x7f" and c not in self.same_class:
                    probe = f"a{c}1{c}{c}!"
                    theirs = [span for _, span in self.library.pre_tokenize_str(probe)]
                    self.same_class[c] = theirs == [m.span() for m in PIECE.finditer(probe)]
                if c > "\x7f" and not self.same_class[c]:
                    return [block[a:b] for _, (a, b) in self.library.pre_tokenize_str(block)]
        return PIECE.findall(block)

    def _blocks(self, text: str) -> Iterator[list[str]]:
        """Pieces of a text, block by block; an added token is a piece of its own."""
        at = 0
        for found in [*self.added_at.finditer(text), None]:
            end = found.start() if found else len(text)
            while at < end:
                safe = _SAFE.search(text, min(at + BLOCK_CHARS, end), end)
                stop = safe.start() if safe else end
                yield self._divided(text[at:stop])
                at = stop
            if found:
                yield [found.group()]
                at = found.end()

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers; new pieces are learnt slab by slab."""
        out: list[bytearray] = []
        slab: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo = dict(self.added)
            new = set().union(*(pieces for _, pieces in slab)) - self.memo.keys()
            self.learn(list(new))
            known = self.memo.__getitem__
            for i, pieces in slab:
                out[i] += b"".join(map(known, pieces))
            for piece in new:
                if len(piece) > MEMO_CHARS:
                    del self.memo[piece]
            slab.clear()

        for i, text in enumerate(texts):
            out.append(bytearray())
            for pieces in self._blocks(text):
                slab.append((i, pieces))
                held += len(pieces)
                if held >= SLAB_PIECES:
                    flush()
                    held = 0
        flush()
        return list(map(bytes, out))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class Decoder:
    """The bytes of every token of one vocabulary file."""

    def __init__(self, file: str) -> None:
        spec = json.loads(file)
        code = {s: b for b, s in enumerate(byte_symbols())}
        every = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.bytes_of = [b""] * (1 + max(every.values()))
        for token, number in every.items():
            known = all(c in code for c in token)
            self.bytes_of[number] = bytes(code[c] for c in token) if known else token.encode()

    def decode(self, tokens: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD. An unknown id is an error."""
        ids = np.frombuffer(tokens, "<u4")
        table = self.bytes_of
        spans = (ids[i:i + BLOCK_CHARS].tolist() for i in range(0, len(ids), BLOCK_CHARS))
        return b"".join(b"".join(map(table.__getitem__, span)) for span in spans).decode("utf-8", "replace")


_MADE: dict[type, tuple[int, Codec | Decoder]] = {}


def _made(kind: type, shared) -> Codec | Decoder:
    """One codec or decoder a Python worker and file."""
    number, file = shared.value
    if kind not in _MADE or _MADE[kind][0] != number:
        _MADE[kind] = (number, kind(file))
    return _MADE[kind][1]


def _shared(docs: DataFrame, path: str):
    """The vocabulary file as a broadcast variable: it is read by the driver and refused over MAX_FILE_BYTES."""
    with open(path, encoding="utf-8") as file:
        text = file.read(MAX_FILE_BYTES + 1)
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} holds more than {MAX_FILE_BYTES} characters")
    return docs.sparkSession.sparkContext.broadcast((hash(text), text))


def encode(
    docs: DataFrame, path: str, text: Column | str = "text", into: str = "tokens", decoded_into: str | None = None
) -> DataFrame:
    """`docs` with the column `into`: packed little-endian unsigned 32-bit ids of the whole text.

    The text is divided as the file's pre-tokenizer does, each piece is cut wherever two bytes
    meet that stand side by side in no token (no merge can cross there), and the fragments are
    encoded apart. An added token of the file is one id where its string stands in the text. A
    null text is empty and an empty text has no ids; repeated rows each get theirs; an empty table
    stays empty; a column that is already called `into` is replaced. It is a map without a
    shuffle: a worker holds one Arrow batch, one text, and a memo of bounded size. Bytes that are no UTF-8
    count as U+FFFD. With `decoded_into`, the ids are decoded again in the same pass, as by `decode`, for a
    check of the round trip.
    """
    shared = _shared(docs, path)
    again = decoded_into is not None
    kind = StructType([StructField("tokens", BinaryType()), StructField("decoded", StringType())])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _made(Codec, shared)
        decode_one = _made(Decoder, shared).decode if again else None
        for batch in batches:
            packed = codec.encode_all(x.as_py().decode("utf-8", "replace") for x in batch)
            texts = pa.array(map(decode_one, packed), pa.string()) if again else pa.nulls(len(packed), pa.string())
            yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), texts], kind.names)

    column = F.col(text) if isinstance(text, str) else text
    coded = docs.withColumn("__coded", run(F.coalesce(column, F.lit("")).cast("binary")))
    made = {into: F.col("__coded.tokens")} | ({decoded_into: F.col("__coded.decoded")} if again else {})
    return coded.withColumns(made).drop("__coded")


def decode(rows: DataFrame, path: str, tokens: Column | str = "tokens", into: str = "decoded") -> DataFrame:
    """`rows` with the column `into`: the text of packed ids, special tokens kept; null ids are none."""
    shared = _shared(rows, path)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _made(Decoder, shared)
        for batch in batches:
            yield pa.array((decoder.decode(x.as_py()) for x in batch), pa.string())

    column = F.col(tokens) if isinstance(tokens, str) else tokens
    return rows.withColumn(into, run(F.coalesce(column, F.lit(b""))))
