"""Fill-in-middle, hard negatives and BPE against brute force on small hand-made tables."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotelens.llm import bpe, fim, negatives

BPE_PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, tokens string, output string, n int, row int"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    signs = [32, 32, 9, 10, 13, 39, 0x2019, 0xE9, 0x4E2D, 0x1F600, 65, 97, 115, 0x31, 0xA0, 0x85, 0x558, 33, 0x200B, 0x1C, 60]
    mixed = ["".join(chr(int(c)) for c in rng.choice(signs, 300)) for _ in range(60)]
    passage = "the same passage is in many texts and its chunks are counted once. " * 40
    return [
        None, "", " ", "a", "A b", "<P>a<S>", "x <M> y", "a<", "<S", "!'s 're'RE ''s <|endoftext|>a <|endoftext|><|endoftext",
        "日本語テキスト 😀😀 déjà-vu", "z" * 5000, "=-" * 4000, "ab" * 3000 + " " * 700 + "x", passage, f"one {passage} two", "é" * 999,
        "\n".join(f"line {i} of a very long text, {i * i} {'abc' * (i % 7)}" for i in range(60_000)), *mixed,
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", "clash", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[15], rows[15], (None, "no id at all", None, None, None, None)], SCHEMA).repartition(8)


def _middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs, texts):
    out = fim.fill_in_middle(docs).withColumn("again", fim.restored(F.col("output"), F.col("form")))
    rows = out.collect()
    assert len(rows) == len(texts) + 3 and set(rows[0]["row"].asDict()) == set(docs.columns)
    for r in rows:
        row = r["row"]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == _middle(row["doc_id"], row["text"])
        assert r["again"] == (row["text"] or "")
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_chunks_follow_content_and_summaries_combine(texts):
    passage = texts[14].encode()
    ends = set(fim.chunk_ends(passage))
    shifted = {e - 1000 for e in fim.chunk_ends(b"q" * 1000 + passage)}
    # Past the first window, cuts depend on content alone.
    assert {e for e in ends if e > 64} == {e for e in shifted if e > 64} and len(ends) > 3
    counter = fim.Counter(bits=3)
    for text in texts:
        data = (text or "").encode()
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
        for one, two in ((0, 0), (len(units), 1), (len(units) // 2, len(units) // 3), (123_456_789, 987_654_321)):
            a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
            want = (len(units), *(len("".join(units[:k]).encode()) for k in (a, b)))
            assert counter.locate(data, one, two) == want
    assert len(counter.memo) > 100


def test_memos_stay_bounded(monkeypatch, texts):
    monkeypatch.setattr(fim, "MEMO_ENTRIES", 4)
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 1)
    monkeypatch.setattr(bpe, "SLAB_PIECES", 50)
    counter, codec = fim.Counter(), bpe.Codec(open(BPE_PATH).read())
    library = Tokenizer.from_file(BPE_PATH)
    for text in texts[9:17]:
        counter.locate(text.encode(), 5, 9)
        codec.memo |= {"left from before": b""}
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(counter.memo) <= 4 and max(map(len, codec.memo)) <= bpe.MEMO_CHARS
    assert len(codec.memo) < 200


def test_bpe_is_the_tokenizer(docs, texts):
    library = Tokenizer.from_file(BPE_PATH)
    coded = bpe.decode(bpe.encode(docs, BPE_PATH, decoded_into="same_pass"), BPE_PATH)
    assert coded.columns == [*docs.columns, "same_pass", "decoded"]
    rows = coded.collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["tokens"], "<u4").tolist() == ids
        assert r["same_pass"] == r["decoded"] == library.decode(ids, skip_special_tokens=False) == (r["text"] or "")


def test_forced_boundaries_cut_inside_pieces():
    codec, whole = bpe.Codec(open(BPE_PATH).read()), bpe.Codec(open(BPE_PATH).read())
    whole.inside[:] = True  # cuts nothing
    data = ("q" * 3 + "xzqj" * 30).encode()
    codes = np.frombuffer(data, np.uint8)
    ends = codec.fragments(codes, np.array([len(data)]))
    starts = [0, *ends[:-1].tolist()]
    assert len(ends) > 10 and all(codec.inside[data[i], data[i + 1]] for a, b in zip(starts, ends, strict=True) for i in range(a, b - 1))
    for text in ("xzqj" * 30, "Ünïcödé ßtring", "a" * 100, "\x00\x01\x02", "internationalisation", "é" * 65 + "zq" * 40):
        assert codec.encode(text) == whole.encode(text)
        ids = codec.id_of_byte[np.frombuffer(text.encode(), np.uint8)]
        together = codec._merged_together(ids[None])[0]
        assert together[together >= 0].tolist() == codec._merged_long(ids.tolist())


def test_every_merge_is_in_the_table():
    codec = bpe.Codec(open(BPE_PATH).read())
    pairs = np.array(list(codec.merges), np.int64)
    assert codec.table.ranks(pairs[:, 0], pairs[:, 1]).tolist() == list(codec.merges.values())
    assert (codec.table.ranks(pairs[:, 1] + 70_000, pairs[:, 0]) == bpe._NEVER).all()
    assert (codec.table.ranks(np.array([-1, 5]), np.array([5, -1])) == bpe._NEVER).all()


def test_other_files_are_refused(spark, docs):
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Codec(open(public_tokenizers.path("word_bpe_49k.json")).read())


VECTORS = "vec_id bigint, embedding array<float>, label int, data string, dim int, score bigint"


def _mined(rows, top, negs):
    good = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        good.append((vec_id, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in vector)))
    out = []
    for a, tag, v in {g for g in good if g[0] % 50 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, t) for i, t, w in good if i != a and len(w) == len(v))
        for minus, i, _ in [s for s in scored if s[2] == tag][:top]:
            fit = [s for s in scored if s[2] != tag and 50 * -minus <= 100 * -s[0] <= 95 * -minus]
            out += [(a, i, k + 1, s[1], -minus, -s[0]) for k, s in enumerate(fit[:negs])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(12, 8))
    rows = []
    for i in range(900):
        v = (centers[i % 12] * (1 + i % 3) + rng.normal(size=8) * 0.2).astype(np.float32).tolist()
        rows.append([i, v, int(rng.integers(4)), "clash", 0, 9])
    for i in range(300, 420):
        rows[i][1] = rows[300][1]  # ties: one vector many times
    rows[7][1], rows[8][2], rows[9][1], rows[10][1], rows[11][0] = None, None, [float("nan")] * 8, [1.0, None] * 4, None
    rows[150][1], rows[151][1], rows[152][1] = [1.0, 2.0], [1.5, 1.0], [1.0, 1.5]
    rows[200][1], rows[201][1], rows[202][1] = [], [], []
    rows[201][2], rows[200][2], rows[202][2] = 1, 1, 2
    return [tuple(r) for r in rows] + [tuple(rows[60])] * 3 + [tuple(rows[100])] * 2


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, vectors, small, monkeypatch):
    if small:  # many shards, blocks, cells and tree levels
        for name, value in (("SHARD_ROWS", 40), ("BLOCK_ROWS", 3), ("CELLS", 9), ("LEAF", 6), ("DEGREE", 3)):
            monkeypatch.setattr(negatives, name, value)
    table = spark.createDataFrame(vectors, VECTORS).repartition(5)
    got = negatives.hard_negatives(table, F.col("vec_id") % 50 == 0, 5, 3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _mined(vectors, 5, 3)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_hard_negatives_of_nothing(spark):
    table = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(table, F.col("vec_id") % 50 == 0).count() == 0


def test_tree_eliminates_siblings(vectors):
    rows = [(i, t, v) for i, v, t, *_ in vectors if i is not None and v and len(v) == 8 and t is not None and None not in v
            and np.isfinite(v).all()]
    data = np.array([[np.floor(256 * x) for x in v] for _, _, v in rows], np.int64)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    tree = negatives.Gnat(ids, labels, data)
    read = []

    class Counted(negatives.Probes):
        def add(self, p, scores, found):
            read.append(len(found))
            super().add(p, scores, found)

    scores = data @ data[5]
    high = int(np.sort(scores)[-40])
    probes = Counted([(0, 0, high - 500, high)], 3)
    tree.search(data[5:6], ids[5:6], labels[5:6], probes, False)
    fits = [(-int(s), int(i)) for s, i, t in zip(scores, ids, labels, strict=True) if t != labels[5] and i != ids[5] and high - 500 <= s <= high]
    assert probes.found[0] == sorted(fits)[:3] and len(read) < len(rows) // negatives.LEAF
