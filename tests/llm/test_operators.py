"""Corpus operators against brute force on small hand-made tables with nulls, ties, repeats and clashing names."""

import hashlib
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quotelens.llm import exact, language, mixing, packing, secrets, sharding, simhash, substrings, suffixes, topk, windows
from quotelens.llm.rows import keyed

SCHEMA = "doc_id bigint, text string, lang string, source string, row_key string, size int, kept boolean"
WORDS = [f"w{i}x" for i in range(400)]
LONG = " ".join(WORDS)


@pytest.fixture(scope="module")
def rows():
    passage = " ".join(WORDS[50:80])
    texts = [
        None, "", "  \t ", "one", "one", "One two three", LONG, LONG, LONG.replace("w7x", "zz"), f"a b {passage} c d",
        f"x {passage} y {passage}", "é" * 300, "token = AbC123def456 and AKIA" + "Z9" * 10, "ab" * 20 + " 9" + "f" * 30,
        "password:'abc' secret=Zz99Zz99Zz99Zz99Zz99Q", "z" * 250, "!!! ???",
    ]
    out = [(i, t, None if i % 5 == 0 else ("en", "de")[i % 2], None if i % 7 == 0 else f"s{i % 3}", "k", 1, True)
           for i, t in enumerate(texts)]
    return [*out, out[6], (None, "one", "en", "s1", "k", 1, True)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, rows):
    got = exact.exact_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [x for x in rows if hashlib.sha256((x[1] or "").encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(same) and r["keep_id"] == max(x[0] for x in same if x[0] is not None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact.drop_exact_copies(docs).columns == docs.columns


def test_fingerprints_compose_and_collisions_are_split(docs, rows):
    base, prime = exact.BASES[0], exact.PRIMES[0]
    powers = exact._powers(base, prime)
    data = bytes(range(256)) * 600
    whole = exact.text_hash(data, powers, base, prime)
    a, b = (exact.text_hash(x, powers, base, prime) for x in (data[:70_000], data[70_000:]))
    assert exact.combine((a, 70_000), (b, len(data) - 70_000), base, prime) == (whole, len(data))
    weak = exact.exact_groups(docs, primes=(2, 3))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_sha256"])
    assert sorted(map(tuple, weak.collect()), key=str) == sorted(map(tuple, exact.exact_groups(docs).collect()), key=str)
    assert key(weak.first())


def _removed(rows, tokens, width, by_place):
    """Brute force: rows by id (a null id is the smallest), identical rows do not cover each other."""
    first, out = {}, {}
    for rank, text in sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows}):
        units = tokens(text)
        gone, own = [False] * len(units), {}
        for i in range(len(units) - width + 1):
            window = tuple(units[i:i + width])
            if first.get(window, rank) < rank or (by_place and window in own):
                gone[i:i + width] = [True] * width
            own.setdefault(window, rank)
        for window in own:
            first.setdefault(window, rank)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.array(gone, np.int8), [0]])))
        kept = [u for u, g in zip(units, gone, strict=True) if not g]
        joined = b" ".join(kept) if not by_place else bytes(kept)
        out[rank] = (len(units), sum(gone), len(edges) // 2, hashlib.sha256(joined).hexdigest())
    return out


@pytest.mark.parametrize("contents", [4096, 2])
def test_shared_words_and_repeated_bytes(docs, rows, contents, monkeypatch):
    """Whole rows; with 2, anchors of more contents are dealt out window by window."""
    monkeypatch.setattr(windows, "SHARD_SEGMENTS", contents)
    for run, tokens, width, by_place in (
        (substrings.remove_shared_words, lambda t: t.encode().split(), 13, False),
        (suffixes.remove_repeated_bytes, lambda t: t.encode(), 100, True),
    ):
        want = _removed(rows, tokens, width, by_place)
        got = run(docs).collect()
        assert len(got) == len(rows)
        columns = ("n_units", "n_removed", "n_spans", "kept_sha256")
        assert {(-1 if r["doc_id"] is None else r["doc_id"]): tuple(r[c] for c in columns) for r in got} == want
        assert all(sum(s["stop"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)


def test_repeats_are_found_across_arrow_batches(spark, docs, rows):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 2)
    try:
        for run, tokens, width, by_place in (
            (substrings.remove_shared_words, lambda t: t.encode().split(), 13, False),
            (suffixes.remove_repeated_bytes, lambda t: t.encode(), 100, True),
        ):
            got = run(docs).collect()
            assert {(-1 if r["doc_id"] is None else r["doc_id"]): r["n_removed"] for r in got} == _removed(
                rows, tokens, width, by_place
            )
    finally:
        spark.conf.set(size, before)


def test_suffix_array_and_automaton():
    text = np.frombuffer(b"banana$bandana#", dtype=np.uint8).astype(np.int64)
    at = np.arange(len(text) - 2)
    order, common = suffixes.suffix_order(text, at, 3)
    keys = [bytes(text[i:i + 3].astype(np.uint8)) for i in order]
    assert keys == sorted(keys)
    longest = np.zeros(len(text), int)
    longest[order] = suffixes.longest_previous_factor(np.minimum(common, 3), order, 1)
    for i in at:
        seen = [k for k in range(1, 4) for j in range(i) if list(text[j:j + k]) == list(text[i:i + k])]
        assert longest[i] == max(seen, default=0)
    automaton = substrings.SuffixAutomaton()
    automaton.add(list("abcbc"))
    automaton.add(list("bcd"))
    assert automaton.matching_statistics(list("abcdbcbz")) == [1, 2, 3, 3, 1, 2, 3, 0]


def test_mix_keeps_to_targets(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    largest = max(r["size"] for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert own[0]["target"] <= 3 * own[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * largest
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - sum(r["size"] for r in got)) < 1e-6
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_targets_of_a_corpus_of_a_billion_words(spark):
    units = spark.createDataFrame([("a", 300_000_000), ("b", 300_000_000), ("c", 400_000_000)], "source string, unit_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(units).collect()}
    assert got == {"a": 625_000_000.0, "b": 250_000_000.0, "c": 125_000_000.0}


def test_mixed_documents_depend_on_the_ratio_of_weights_alone(docs):
    # Weights of millions bring the products that a corpus of a billion words has.
    wide = mixing.mixed_documents(docs, tuple(10**7 * w for w in mixing.WEIGHTS))
    assert Counter(r["doc_id"] for r in wide.collect()) == Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())


def test_shards_are_gapless_and_keep_texts_together(docs, rows):
    got = sharding.byte_shards(docs, 4).collect()
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert len(got) == len(rows) and {r["shard"] for r in got} <= set(range(4))


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [1.0, 1.0]), (7, vectors[9][1])]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = topk.top_inner_products(frame, F.col("vec_id") % 50 == 0).collect()
    good = [(i, np.floor(np.array(v) * 256)) for i, v in vectors[:300] + vectors[-1:]]
    for query in range(0, 300, 50):
        scores = sorted((-int(good[query][1] @ v), i) for i, v in good if i != query)[:5]
        mine = sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == query)
        assert [(s, i) for _, s, i in mine] == scores


def test_topk_of_many_shards_and_blocks(spark, monkeypatch):
    """A shard travels once for many blocks, and a row that asks twice is ranked as SQL ranks it."""
    for name, value in (("SHARD_NUMBERS", 64), ("BLOCK_NUMBERS", 12), ("BLOCKS", 4), ("LEAF", 3), ("LEAVES", 2)):
        monkeypatch.setattr(topk, name, value)
    dealt, search = [], topk._search
    monkeypatch.setattr(topk, "_search", lambda pairs, top: (dealt.append(pairs), search(pairs, top))[1])
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(200)]
    vectors += [(i, [float(x) for x in rng.integers(-2**21, 2**21, 3)]) for i in range(200, 260)]
    vectors += [vectors[10], vectors[11], (20, vectors[30][1])]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = topk.top_inner_products(frame, F.col("vec_id") % 10 == 0).collect()
    whole = [(i, [int(x) * 256 for x in v]) for i, v in vectors]
    wanted = {}
    for i, q in whole:
        if i % 10 == 0:
            wanted.setdefault(i, []).extend((-sum(map(int.__mul__, q, v)), j) for j, v in whole if j != i and len(v) == len(q))
    assert {i: sorted(w)[:5] for i, w in wanted.items()} == {
        i: [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] for i in wanted}
    for pairs in dealt:
        held = Counter((r["dim"], r["shard"]) for r in pairs.where("NOT asks").collect())
        assert len(held) > 12 and max(held.values()) <= 3


def test_simhash_groups(docs, rows):
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {plain(r[1]) for r in rows}
    groups = {p: {p} for p in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 3 and groups[a] is not groups[b]:
                    groups[a] |= groups[b]
                    for x in groups[a]:
                        groups[x] = groups[a]
    for r in simhash.near_groups(docs).collect():
        mine = [x[0] for x in rows if plain(x[1]) in groups[r["fp"] & (1 << 64) - 1] and x[0] is not None]
        assert r["component_id"] == min(mine)


def test_buckets_hold_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    for value in base:
        flips = [1 << int(b) for b in rng.choice(64, 3, replace=False)]
        other = np.uint64(int(value) ^ flips[0] ^ flips[1] ^ flips[2])
        assert any(simhash.link_bucket(np.array([value, other]), start) for start in range(8))


def test_near_copies_keep_one_row_each(spark, docs, rows):
    edited = [(900 + i, LONG.replace(f" w{40 * i}x ", " new "), "en", "s", "k", 1, True) for i in range(1, 9)]
    far = (990, " ".join(WORDS[::-1]), "en", "s", "k", 1, True)
    table = spark.createDataFrame([*rows, *edited, far], SCHEMA)
    kept = simhash.drop_near_copies(table)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 6, 7 and 8 are the long text (6 is there twice, as one row repeats); the least id stays.
    assert not {7, 8, *range(901, 909)} & set(ids) and {0, 3, 5, 6, 9, 10, 11, 12, 13, 990} <= set(ids)
    assert not {1, 2, 4} & set(ids) and None not in ids


def test_first_family_is_the_fingerprint_and_families_differ():
    text = LONG.encode()
    values = simhash.text_prints(text, families=6)
    assert values[0] == simhash.text_prints(text)[0] and len(set(values.tolist())) == 6
    assert not simhash.text_prints(b" \t", families=6).any()


def test_language_learns_from_its_share_only(spark):
    texts = {"en": "the house and the garden of the old man", "de": "das haus und der garten des alten mannes"}
    table = [(i, f"{texts[k]} {i}", k, "s") for i in range(60) for k in [("en", "de")[i % 2]]]
    table += [(100, None, "en", "s"), (101, "12 34 !", "de", "s"), (None, "the garden", None, "s")]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(got) == len(table) and all(got[i]["lang_pred"] == ("en", "de")[i % 2] for i in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.accepted_documents(docs).columns == docs.columns


def _plain_pack(sizes, buckets, budget):
    """Sorted packed rows of (id, size) pairs; id -1 is null."""
    bounds = packing.best_bounds(*map(list, zip(*sorted(Counter(n for _, n in sizes).items()), strict=True)), buckets)
    out = []
    for k, bound in enumerate(bounds):
        inside = [(i, n) for i, n in sizes if n <= bound and (k == 0 or n > bounds[k - 1])]
        inside.sort(key=lambda x: (hashlib.md5(str(x[0] if x[0] >= 0 else "").encode()).hexdigest(), *x))
        room = max(1, budget // max(bound, 1))
        out += [(i, n, k, bound, p // room, p % room, bound - n) for p, (i, n) in enumerate(inside)]
    return sorted(out)


def test_bounds_are_optimal_and_batches_keep_the_budget(docs, rows):
    from itertools import combinations

    rng = np.random.default_rng(4)

    def padding(lengths, counts, bounds):
        return sum(c * (min(x for x in bounds if x >= n) - n) for n, c in zip(lengths, counts, strict=True))

    for _ in range(60):
        lengths = sorted(rng.choice(3000, rng.integers(1, 10), replace=False).tolist())
        counts = rng.integers(1, 9, len(lengths)).tolist()
        for buckets in (1, 2, 3, 12):
            bounds = packing.best_bounds(lengths, counts, buckets)
            inner = [c for k in range(buckets) for c in combinations(lengths[:-1], min(k, len(lengths) - 1))]
            assert len(bounds) <= buckets
            assert padding(lengths, counts, bounds) == min(padding(lengths, counts, [*c, lengths[-1]]) for c in inner)
    assert packing.best_bounds([], [], 3) == []
    got = packing.pack(docs, buckets=3, budget=450).collect()
    assert len(got) == len(rows)
    # Every row as a plain reading of the docstring gives it.
    want = _plain_pack([(-1 if i is None else i, len((t or "").encode().split())) for i, t, *_ in rows], 3, 450)
    columns = ("doc_id", "size", "bucket", "bucket_len", "batch", "slot", "padding")
    assert sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in got) == want
    for key in {(r["bucket"], r["batch"]) for r in got}:
        batch = [r for r in got if (r["bucket"], r["batch"]) == key]
        assert sorted(r["slot"] for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or len(batch) * batch[0]["bucket_len"] <= 450 or batch[0]["bucket_len"] == 0


def test_secret_spans(docs, rows):
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    assert len(got) == len(rows) - 1  # one row repeats an id
    assert got[12]["spans"] == "assign:0:20,access:25:49" and (got[12]["n_assign"], got[12]["n_access"]) == (1, 1)
    assert got[13]["n_hex"] == 2 and got[14]["n_assign"] == 1 and got[14]["spans"].startswith("assign:15:")
    assert got[0]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_tables_give_no_rows(empty):
    for run in (
        exact.exact_groups, simhash.drop_near_copies, mixing.mix, sharding.byte_shards, simhash.near_groups, language.identify, packing.pack,
        secrets.find_secrets, substrings.remove_shared_words, suffixes.remove_repeated_bytes,
    ):
        assert run(empty).count() == 0, run


def test_near_copies_are_those_at_similarity_080(spark):
    rng = np.random.default_rng(5)
    texts = {}
    for k in range(6):
        base = [f"b{k}x{i}" for i in range(150)]
        for edits in range(7):
            for draw in range(4):
                words = list(base)
                for n, i in enumerate(rng.choice(np.arange(3, 147), edits, replace=False)):
                    words[i] = f"e{k}x{edits}x{draw}x{n}"
                texts[len(texts)] = " ".join(words)
    sets = {i: {tuple(t.split()[j:j + 5]) for j in range(146)} for i, t in texts.items()}
    part = {i: i for i in texts}
    for i in texts:
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and part[i] != part[j]:
                low, high = sorted((part[i], part[j]))
                part = {x: low if p == high else p for x, p in part.items()}
    docs = spark.createDataFrame([(i, t, "en", "s", "k", 1, True) for i, t in texts.items()], SCHEMA)
    kept = {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()}
    assert kept == set(part.values()) and 6 < len(kept) < len(texts)


def test_repeated_rows_fill_the_training_sample_once(spark):
    table = [(0, "the house and the garden", "en", "s")] * 300 + [(1, "das haus und der garten", "de", "s")]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string")
    fitted = []
    seen = language.fit
    language.fit = lambda packed, langs, *a, **k: fitted.append(langs) or seen(packed, langs, *a, **k)
    try:
        assert {r["lang_pred"] for r in language.identify(docs, rows=8).collect()} == {"en", "de"}
    finally:
        language.fit = seen
    assert sorted(fitted[0]) == ["de", "en"]


def test_rows_without_an_id_gather_only_their_own_anchors(spark):
    passages = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(40)]
    rows = [(None, f"{p} a{k}", "en", "s", "k", 1, True) for k, p in enumerate(passages)]
    rows += [(k, f"b{k} {p}", "en", "s", "k", 1, True) for k, p in enumerate(passages)]
    docs = spark.createDataFrame([*rows, *rows[:1] * 20, *rows[40:41] * 20], SCHEMA)
    for run, module, name, width, lengths in (
        (substrings.remove_shared_words, substrings, "SCHEME", 13, lambda t: len(t.split())),
        (suffixes.remove_repeated_bytes, suffixes, "SCHEME", 100, len),
    ):
        pending, _ = windows.covered_windows(keyed(docs), getattr(module, name), lambda places: [])
        kept = pending.collect()
        assert len(kept) == len({(r["rank"], r["row_key"]) for r in kept}) == 80
        assert all(len(r["anchors"]) <= lengths(r["text"]) - width + 1 for r in kept)
        got = run(docs).collect()
        assert len(got) == 120
        # A null id is the smallest, so its rows keep all and the others lose the passage.
        assert all((r["n_removed"] > 0) == (r["doc_id"] is not None) for r in got)


def test_secrets_copied_inside_one_source(spark):
    wide, narrow = "Qw9" * 8, "Zx7" * 8
    table = [(i, f"key {wide} end", ("en", "de", "fr")[i % 3], "s") for i in range(30)]
    table += [(99, f"key {narrow} end", "en", "s")]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string")
    # One owner with three repositories: the value is copied, unless repositories are left out.
    for r in secrets.find_secrets(docs).collect():
        assert (r["n_live"], r["n_owned"]) == ((1, 1) if r["doc_id"] == 99 else (0, 0))
    assert all(r["n_live"] == r["n_owned"] == 1 for r in secrets.find_secrets(docs, wide_repos=None).collect())


def test_a_text_full_of_secrets(spark):
    """Chunks of matches give the places that one pass gives, and a hundred thousand of them end soon."""
    base = "a" * 30
    text = " ".join(f"k{i} {base[:24 + i % 7]}{'f' * (i % 3)} password={i:06d}xyz Zz{i:06d}" + "Q9" * 8 for i in range(700))
    pattern = {"hex": r"[0-9a-f]{24,}", "assign": r"(?i:password)=([A-Za-z0-9+/_.=-]+)"}
    spans = sorted((m.start(), k, m.end()) for k, p in pattern.items() for m in re.finditer(p, text))
    owned = [(m.start(), "owned", m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text)
             if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]
    apart = [o for o in owned if not any(a < o[2] and o[0] < b for a, _, b in spans)]
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, ("f" * 24 + " ") * 100_000, "en", "t")],
                                 "doc_id bigint, text string, lang string, source string")
    start = time.time()
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    assert time.time() - start < 60
    assert got[1]["spans"] == ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans + apart)) and apart
    assert got[2]["n_hex"] == 100_000 and got[2]["spans"].endswith(f",hex:{25 * 99_999}:{25 * 99_999 + 24}")


def test_near_prints_are_those_of_plain_buckets(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    rows = {(f, int(v)) for f in (0, 3, 11) for v in base[f:f + 30]}
    rows |= {(f, int(np.int64(v) ^ np.int64(1 << int(b)) ^ np.int64(1 << int(c)))) for f, v in rows if v % 2
             for b, c in [rng.choice(62, 2, replace=False)]}
    near = {(f, v) for f, v in rows if any(
        f == g and v != w and ((v ^ w) & (1 << 64) - 1).bit_count() <= 3 for g, w in rows)}
    prints = spark.createDataFrame(sorted(rows), "family int, fp bigint")
    assert {tuple(r) for r in simhash._near_prints(prints).collect()} == near and near


def _plain_mix(rows, weights=(5, 2, 1), passes=3):
    """(id, text, source) rows as often as weighted fair queueing takes them, in exact fractions."""
    size = {i: len(t.encode().split()) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    words = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    total, targets, left = sum(words.values()), {}, list(sources)
    while True:
        room, share = total - sum(targets.values()), sum(weight[s] for s in left)
        full = [s for s in left if Fraction(weight[s] * room, share) > passes * words[s]]
        if not full:
            targets |= {s: Fraction(weight[s] * room, share) for s in left}
            break
        targets |= {s: Fraction(passes * words[s]) for s in full}
        left = [s for s in left if s not in full]
    queue = []
    for k, s in enumerate(sources):
        through = 0
        own = sorted(((hashlib.md5(str(i).encode()).hexdigest(), i, t) for i, t, x in rows if x == s))
        for turn, i, t in own:
            through += size[i]
            queue += [((lap * words[s] + through) / targets[s], k, turn, i, lap, t) for lap in range(passes) if size[i]]
    out, used = [], 0
    for *_, i, _, t in sorted(queue):
        used += size[i]
        if used > total:
            break
        out.append((i, size[i]))
    return out


def test_repeated_rows_queue_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    words = " ".join(WORDS[:50])
    table = [(i, f"{words} a{i}", "a", i) for i in range(150)] + [(500, f"{words} b", "b", i) for i in range(150)]
    table += [(None, "c c", None, 1), (None, "c c", None, 2), (None, None, "a", 3), (7, "", "a", 4)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, source string, copy int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(table)
    for source in ("a", "b", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 51 and all(r["passes"] <= 3 for r in own)
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    mine = Counter((r["doc_id"], r["text"], r["source"]) for r in rows.collect())
    wanted = Counter()
    for r, text in ((r, {500: f"{words} b", None: "c c"}.get(r["doc_id"], f"{words} a{r['doc_id']}")) for r in got if r["passes"]):
        wanted[r["doc_id"], text, r["source"]] += r["passes"]
    assert mine == wanted
    # Copies of one row differ by one pass at most, whichever they are.
    each = Counter(r["copy"] for r in rows.collect() if r["source"] == "b")
    assert max(each.values()) - min(each.get(i, 0) for i in range(150)) <= 1 and max(each.values()) > min(each.get(i, 0) for i in range(150))


def test_dedup_stages_leave_one_of_repeated_rows(spark):
    table = [(5, LONG, "s", i) for i in range(150)] + [(4, LONG, "s", 0), (None, None, "s", 1), (None, "", "s", 2), (None, None, "s", 3)]
    table += [(None, "one two", "s", 1), (None, "one two", "t", 2), (9, " ".join(WORDS[::-1]), "s", 1)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, source string, copies int")
    for run, stays in ((exact.drop_exact_copies, 5), (simhash.drop_near_copies, 4)):
        kept = run(docs)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(
            [(stays, LONG), (0, ""), (0, "one two"), (9, " ".join(WORDS[::-1]))])


def test_pipeline_against_plain_python(spark, tmp_path):
    """Every stage after the language model, worked out row by row."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    common = {"en": "the of and to in is that it was for on are with as his they be at one have".split(),
              "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split()}
    table = []
    for i in range(80):
        lang = ("en", "de")[i % 2]
        words = rng.choice(common[lang], 30 + 3 * i).tolist() if i % 5 else rng.choice(common[lang], 12).tolist()
        table.append([i, " ".join(words), lang, ("a", "b", "c", None)[i % 4]])
    table[40][1], table[42][1] = table[30][1], table[30][1]
    near = table[61][1].split()
    near[5] = "changed"
    table[63][1] = " ".join(near)
    table += [[90, None, "en", "a"], [91, "12 34 !!", "en", "b"]]
    docs = spark.createDataFrame([tuple(r) for r in table], "doc_id bigint, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    accepted = {r["doc_id"] for r in language.accepted_documents(docs).collect()}
    assert 90 not in accepted and 91 not in accepted and len(accepted) > 70
    rows = [(i, t, s) for i, t, _, s in table if i in accepted]
    rows = [r for r in rows if r[0] == max(x[0] for x in rows if x[1] == r[1])]
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t, _ in rows}
    least = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((least[i], least[j]))
                least = {x: low if v == high else v for x, v in least.items()}
    rows = [r for r in rows if least[r[0]] == r[0]]
    assert 30 not in {r[0] for r in rows} and 63 not in {r[0] for r in rows} and 42 in {r[0] for r in rows}
    mixed = _plain_mix(rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted(mixed)
    assert sorted((r["doc_id"], r["size"], r["bucket"], r["bucket_len"], r["batch"], r["slot"], r["padding"]) for r in got) == _plain_pack(
        mixed, packing.BUCKETS, packing.BUDGET)


def test_neighbouring_covered_windows_travel_as_one_row(spark):
    got = windows.joined_runs(*(np.array(x) for x in ([1, 0, 0, 0, 1], [5, 7, 7, 7, 4], [3, 9, 0, 4, 0], [2, 1, 4, 3, 3])))
    assert [x.tolist() for x in got] == [[0, 0, 1, 1], [7, 7, 4, 5], [0, 9, 0, 3], [7, 1, 3, 2]]
    assert [len(x) for x in windows.joined_runs(*[np.zeros(0, np.int64)] * 4)] == [0] * 4
    text = "".join(chr(97 + (i * i * 31 + i // 7) % 26) for i in range(3000))
    docs = spark.createDataFrame([(i, f"{i}-" * 60 + text) for i in range(3)], "doc_id long, text string").coalesce(1)
    texts = keyed(docs).select(F.col("doc_id").alias("rank"), "row_key", "text")
    scheme = suffixes.SCHEME
    scanned = windows.repeated_anchors(texts, scheme)
    assert "route" not in scanned._jdf.queryExecution().optimizedPlan().toString()
    anchors = scanned.groupBy("row_key").agg(F.collect_set(F.shiftright("anchor", 32).cast("int")).alias("anchors"))
    found = windows._kept_segments(texts.join(anchors, "row_key").coalesce(1), scheme)
    gone = found.where("covered AND rank > 0").groupBy("rank").agg(F.count(F.lit(1)), F.sum("count")).collect()
    assert len(gone) == 2 and all(n < 20 and windows_ > 2000 for _, n, windows_ in gone)
    assert found.where("covered AND (anchor <> 0 OR content <> 0)").isEmpty()
