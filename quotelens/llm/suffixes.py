"""Suffix-array dedup on bytes: longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quotelens.llm.windows import Scheme, remove_covered

WINDOW = 100
GRAM = 40
STEP = 8
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def suffix_order(codes: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at `at`, sorted by their first `depth` codes, and the common prefix with the one before.

    Every suffix asked for must be `depth` codes long. Prefix doubling: classes by 1, 2, 4, ...
    codes, each from pairs of the classes before; two overlapping classes give the last order.
    The same classes then give common prefixes of neighbours by halving steps.
    """
    n = len(codes)
    levels = [np.concatenate([codes, np.zeros(depth, dtype=np.int64)])]
    span = 1
    while span * 2 <= depth:
        now = levels[-1]
        after = np.concatenate([now[span:], np.zeros(span, dtype=np.int64)])
        pairs = now * (int(now.max()) + 1) + after
        # Classes of two codes still fit; longer ones are numbered in order.
        levels.append(pairs if span == 1 and int(codes.max()) < 1 << 15 else np.unique(pairs, return_inverse=True)[1])
        span *= 2
    order = at[np.lexsort((levels[-1][at + depth - span], levels[-1][at]))]
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(order), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = np.maximum(left, right) < n
        step = (levels[level][np.minimum(left, n)] == levels[level][np.minimum(right, n)]) * inside * (1 << level)
        common[1:] += step
        left += step
        right += step
    return order, common


def longest_previous_factor(common: np.ndarray, place: np.ndarray, least: int = 1) -> np.ndarray:
    """Per suffix in suffix order, the longest prefix it shares with one of a smaller place, 0 if below `least`.

    The candidates are the nearest smaller places before and after it in suffix order; a stack
    finds them, carrying the least common prefix passed on the way. Suffixes that share less than
    `least` with both neighbours are passed over.
    """
    out = np.zeros(len(common), dtype=np.int64)
    joined = common >= least
    taken = np.flatnonzero(joined | np.concatenate([joined[1:], [False]]))
    shared_up = np.where(joined, common, 0)[taken]
    shared_down = np.concatenate([shared_up[1:], np.zeros(min(len(taken), 1), dtype=np.int64)])
    for rows, shared in ((taken, shared_up), (taken[::-1], shared_down[::-1])):
        stack: list[tuple[int, int]] = []  # (place, least common prefix with the entry below)
        best = []
        for now, at in zip(shared.tolist(), place[rows].tolist(), strict=True):
            if not now:
                stack.clear()
            while stack and stack[-1][0] >= at:
                now = min(now, stack.pop()[1])
            best.append(now if stack else 0)
            stack.append((at, now))
        out[rows] = np.maximum(out[rows], best)
    return out


def judge(rows: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    """Windows of each row that also start at an earlier place: smaller (rank, row key, start)."""
    lengths = np.array([len(content) for *_, content in rows], dtype=np.int64)
    if not len(lengths):
        return []
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    # A code of its own ends every row.
    codes = np.empty(int(ends[-1]), dtype=np.int64)
    inside = np.ones(len(codes), dtype=bool)
    inside[ends - 1] = False
    codes[inside] = np.frombuffer(b"".join(content for *_, content in rows), dtype=np.uint8)
    codes[ends - 1] = 256 + np.arange(len(rows))
    documents = {d: i for i, d in enumerate(sorted({(rank, key) for rank, key, *_ in rows}))}
    shift = np.array([(documents[rank, key] << 32) + start for rank, key, start, _ in rows], dtype=np.int64) - starts
    windows = lengths - WINDOW + 1
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    place = np.zeros(len(codes), dtype=np.int64)
    place[at] = at + np.repeat(shift, windows)
    order, common = suffix_order(codes, at, WINDOW)
    longest = np.zeros(len(codes), dtype=np.int64)
    longest[order] = longest_previous_factor(common, place[order], WINDOW)
    return [longest[a:a + n] >= WINDOW for a, n in zip(starts, windows, strict=True)]


def _parts(data: bytes, codes: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one number."""
    now = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    for span in (1, 2, 4):
        now = now[:-span] | now[span:] << np.uint64(8 * span)
    return now


SCHEME = Scheme(
    window=WINDOW, gram=GRAM, step=STEP, by_place=True, units=lambda data: data,
    codes=lambda data: _TABLE[np.frombuffer(data, dtype=np.uint8)], parts=_parts, piece=lambda data: data,
)


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, n_units (bytes), n_removed, n_spans, kept_sha256, removed.

    A byte of the UTF-8 text goes if a string of 100 bytes over it also starts earlier: in a
    document with a smaller doc_id, or before it in the same document; overlaps count, matches
    never cross documents, and strings are judged on the input. A null text is empty; a null id
    is the smallest; rows that share an id with different texts are ordered by a hash of the
    text, and rows that repeat id and text do not cover each other. An empty table gives no rows.
    """
    return remove_covered(docs, SCHEME, judge)
