"""Secret spans, told apart by how many owners hold the same value (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.plans.checkpoints import written

# Kinds in their order, and what they match.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
PATTERNS = (
    rf"(?i:{ASSIGN})([A-Za-z0-9+/_.=-]+)",
    r"AKIA[A-Z0-9]{16,}",
    r"[0-9a-f]{24,}",
    r"[A-Za-z0-9+/_=-]{20,}",
)
LEAST_VALUE = 6
WIDE_OWNERS = 3
WIDE_REPOS = 3


def _chunks(items: Column) -> Column:
    """An array cut into about as many pieces as each piece has entries."""
    size = F.ceil(F.sqrt(F.greatest(F.size(items), F.lit(1)))).cast("int")
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0)))
    return F.transform(places, lambda c: F.slice(items, c * size + 1, size))


def _spans(text: Column, kind: int) -> Column:
    """Array of (start, kind, stop, value) in code points, leftmost and without overlap.

    The text between matches, cut out by the same pattern, gives the places. They are added up chunk
    by chunk and the chunks are then moved to where they belong, since an array that grows by one entry
    is copied each time: n matches cost n ** 1.5 copies, not n ** 2.
    """
    pattern = PATTERNS[kind]
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,value:string>>")
    nowhere = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["hit"])
        value = F.regexp_extract(pair["hit"], pattern, 1) if kind == 0 else pair["hit"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), value.alias("value"))
        return F.struct(stop.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    def placed(pairs: Column) -> Column:
        pieces = F.transform(_chunks(pairs), lambda chunk: F.aggregate(chunk, nowhere, add))

        def joined(pieces: Column) -> Column:
            zero = F.array(F.lit(0).cast("bigint"))
            offsets = F.aggregate(pieces, zero, lambda o, p: F.concat(o, F.array(F.element_at(o, -1) + p["at"])))
            moved = F.transform(F.arrays_zip(pieces.alias("piece"), offsets.alias("by")), lambda z: F.transform(
                z["piece"]["found"], lambda s: F.struct(
                    (s["start"] + z["by"]).alias("start"), s["kind"].alias("kind"), (s["stop"] + z["by"]).alias("stop"),
                    s["value"].alias("value"),
                )))
            # There is one offset more than there are pieces.
            return F.flatten(F.filter(moved, lambda m: m.isNotNull()))

        return _named(pieces, joined)

    pairs = F.filter(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: p["hit"].isNotNull()
    )
    return F.when(text.rlike(pattern), _named(pairs, placed)).otherwise(empty)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _apart(others: Column, base: Column) -> Column:
    """Spans of `others` that overlap none of `base`, which is sorted: only chunks that reach a span are looked into."""
    reach = F.transform(_chunks(base), lambda c: F.struct(
        F.array_min(F.transform(c, lambda b: b["start"])).alias("low"), F.array_max(F.transform(c, lambda b: b["stop"])).alias("high"),
        c.alias("spans"),
    ))
    return _named(reach, lambda chunks: F.filter(others, lambda o: ~F.exists(
        chunks, lambda c: F.coalesce((c["low"] < o["stop"]) & (o["start"] < c["high"]), F.lit(False)) & F.exists(
            c["spans"], lambda b: (b["start"] < o["stop"]) & (o["start"] < b["stop"])
        )
    )))


def _candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, owner, repo, base, other): spans of the three base kinds, and looser ones outside them."""
    owner = F.coalesce("source", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"),
        F.coalesce("text", F.lit("")).alias("text"), owner.alias("owner"),
        F.concat_ws("/", owner, F.coalesce("lang", F.lit(""))).alias("repo"),
    )
    text = F.col("text")
    assign = F.filter(_spans(text, 0), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    found = rows.select(
        "doc_id", "row_key", "owner", "repo",
        F.array_sort(F.concat(assign, _spans(text, 1), _spans(text, 2))).alias("base"),
        F.filter(_spans(text, 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")).alias("other"),
    )
    return found.withColumn("other", _apart(F.col("other"), F.col("base")))


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def _digests(spans: Column) -> Column:
    """Values leave the scan as digests only."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.sha2(s["value"], 256).alias("digest")
    ))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")
    )), ",")


def find_secrets(docs: DataFrame, wide_owners: int = WIDE_OWNERS, wide_repos: int | None = WIDE_REPOS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied.

    Base spans are matches of the three fixed patterns. Looser candidates (runs of 20 or more
    key characters with a letter and a digit, outside base spans) are added as kind `owned` when
    their value looks live: the digest of the value is counted over the whole corpus by distinct
    owners (sources) and repositories (source and language); fewer than `wide_owners` owners and fewer
    than `wide_repos` repositories hold it. None leaves repositories out. n_live and n_copied count
    all spans by that rule. Null text is empty; a null source is an owner of its own. Spans of a document are gathered in its row, so they grow with the
    document only. Rows that repeat id and text get the same result.
    """
    scanned = written(_candidates(docs).select(
        "doc_id", "row_key", "owner", "repo", _digests(F.col("base")).alias("base"), _digests(F.col("other")).alias("other")
    ), "scanned")
    every = scanned.where(F.size("base") + F.size("other") > 0).select(
        "doc_id", "row_key", "owner", "repo", F.explode(F.concat("base", "other")).alias("span")
    ).select("doc_id", "row_key", "owner", "repo", "span", F.col("span.digest").alias("digest"))
    pairs = every.select("digest", "owner", "repo").distinct()
    owners = pairs.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"))
    spread = written(owners.groupBy("digest").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")
    ), "spread")
    live = F.col("owners") < wide_owners
    if wide_repos is not None:
        live &= F.col("repos") < wide_repos
    judged = every.join(spread, "digest").select(F.col("doc_id").alias("of_id"), F.col("row_key").alias("of_key"), F.struct(
        "span.start", "span.kind", "span.stop", live.alias("live")
    ).alias("span"))
    per_row = judged.groupBy("of_id", "of_key").agg(F.collect_set("span").alias("judged"))
    out = scanned.select("doc_id", "row_key", "base").join(
        per_row, (F.col("row_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left"
    ).select(
        "doc_id", "base",
        F.coalesce("judged", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,live:boolean>>")).alias("judged"),
    ).withColumn("spans", F.filter("judged", lambda s: (s["kind"] < 3) | s["live"]))

    def count(spans: str, test) -> Column:
        return F.size(F.filter(spans, test)).cast("bigint")

    return out.select(
        "doc_id",
        *[count("base", _of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        count("spans", lambda s: s["kind"] == 3).alias("n_owned"),
        count("spans", lambda s: s["live"]).alias("n_live"), count("spans", lambda s: ~s["live"]).alias("n_copied"),
    )
