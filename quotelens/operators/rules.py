"""Ordered repair rules for misplaced columns.

A rule is a condition on a line record and the fields it rewrites. Every rule sees the
result of the rule before. The chain is one expression, a sequence of transforms over a
one-record array: a rule names its input once, so neither the expression nor a predicate
that the optimizer pushes through it grows with the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens import fixed_values as V
from quotelens.functions.text import any_of, lookup, strip

CHANGED = "changed_rules"
RULE_COLUMNS = ["item_name", "spec", "unit", "maker", "unit_name"]


@dataclass(frozen=True)
class Rule:
    """fires(record) -> the line is changed; updates(record) -> new values of the changed fields."""

    name: str
    fires: Callable[[Column], Column]
    updates: Callable[[Column], dict[str, Column]]

    def step(self, record: Column) -> Column:
        new = self.updates(record)
        fields = {c: new.get(c, record[c]) for c in RULE_COLUMNS}
        changed = F.struct(
            *[value.alias(c) for c, value in fields.items()],
            record["unit_price"].alias("unit_price"),
            F.array_append(record[CHANGED], F.lit(self.name)).alias(CHANGED),
        )
        return F.when(self.fires(record), changed).otherwise(record)


def _val(r: Column, name: str) -> Column:
    return strip(r[name])


def _is_unit(c: Column) -> Column:
    return c.isin(*V.RULE_UNITS)


def _first(r: Column, columns: list[str], test: Callable[[Column], Column]) -> Column:
    """Name of the first field that passes the test, null when none does."""
    return F.coalesce(*[F.when(test(_val(r, c)), F.lit(c)) for c in columns])


def _swap(
    r: Column, columns: list[str], test: Callable[[Column], Column], target: str, value: Callable[[Column], Column]
) -> dict[str, Column]:
    """Swap the first field passing the test with `target`, which gets the canonical value."""
    source = _first(r, columns, test)
    moved = {c: F.when(source == c, _val(r, target)).otherwise(r[c]) for c in columns}
    found = F.coalesce(*[F.when(source == c, value(_val(r, c))) for c in columns])
    return {**moved, target: F.coalesce(found, r[target])}


_UNIT_SOURCES = ["spec", "item_name", "maker", "unit_name"]
_MAKER_SOURCES = ["spec", "item_name", "unit_name", "unit"]


def _unit_value(c: Column) -> Column:
    return lookup(c, V.RULE_UNITS)


def _unit_fires(r: Column) -> Column:
    own = _unit_value(_val(r, "unit"))
    return F.when(own.isNotNull(), own != _val(r, "unit")).otherwise(
        any_of(_is_unit(_val(r, c)) for c in _UNIT_SOURCES)
    )


def _unit_updates(r: Column) -> dict[str, Column]:
    own = _unit_value(_val(r, "unit"))
    swapped = _swap(r, _UNIT_SOURCES, _is_unit, "unit", _unit_value)
    return {
        **{c: F.when(own.isNotNull(), r[c]).otherwise(swapped[c]) for c in _UNIT_SOURCES},
        "unit": F.coalesce(own, swapped["unit"]),
    }


def _is_maker(c: Column) -> Column:
    return F.lower(c).isin(*V.RULE_MAKERS)


def _maker_updates(r: Column) -> dict[str, Column]:
    return _swap(r, _MAKER_SOURCES, _is_maker, "maker", lambda c: lookup(F.lower(c), V.RULE_MAKERS))


def _model(r: Column) -> Column:
    """The unit cell when it holds something other than a unit."""
    unit = _val(r, "unit")
    return F.when(_is_unit(unit), F.lit("")).otherwise(unit)


def _shift_left(r: Column, unit: str) -> dict[str, Column]:
    return {"item_name": _val(r, "spec"), "spec": _model(r), "unit": F.lit(unit)}


def _invalid_updates(r: Column) -> dict[str, Column]:
    maker = _val(r, "maker")
    moved = (_val(r, "spec") == "") & (maker != "") & ~_is_maker(maker)
    return {
        "item_name": _val(r, "spec"),
        "spec": F.when(moved, maker).otherwise(F.lit("")),
        "maker": F.when(moved, F.lit("")).otherwise(r["maker"]),
    }


def _corrections(r: Column) -> list[tuple[Column, dict[str, str]]]:
    out = []
    for match, patch in V.RULE_CORRECTIONS:
        test = F.lit(True)
        for c, v in match.items():
            test = test & (_val(r, c) == v)
        out.append((test, patch))
    return out


def _manual_updates(r: Column) -> dict[str, Column]:
    pairs = _corrections(r)
    out = {}
    for c in sorted({c for _, patch in pairs for c in patch}):
        choice = F
        for test, patch in pairs:
            choice = choice.when(test, F.lit(patch[c]) if c in patch else r[c])
        out[c] = choice.otherwise(r[c])
    return out


def _price_unit(r: Column) -> Column:
    price = F.coalesce(r["unit_price"], F.lit(0))
    return (
        F.when(price < V.RULE_SET_FROM_PRICE, F.lit("EA"))
        .when(price < V.RULE_LUMP_FROM_PRICE, F.lit("SET"))
        .otherwise(F.lit("식"))
    )


RULES: dict[str, Rule] = {
    rule.name: rule
    for rule in [
        Rule("rule_01_unit", _unit_fires, _unit_updates),
        Rule("rule_02_maker", lambda r: any_of(_is_maker(_val(r, c)) for c in _MAKER_SOURCES), _maker_updates),
        Rule(
            "rule_03_spec",
            lambda r: _val(r, "unit").isin(*V.RULE_SPECS),
            lambda r: {"spec": _val(r, "unit"), "unit": F.lit("")},
        ),
        Rule(
            "rule_08_category",
            lambda r: (
                _val(r, "item_name").isin(*V.RULE_CATEGORY_LABELS) | _val(r, "item_name").rlike(V.RULE_OP_LABEL)
            ) & (_val(r, "spec") != ""),
            lambda r: _shift_left(r, "EA"),
        ),
        Rule(
            "rule_09_material",
            lambda r: (_val(r, "item_name") == V.RULE_MATERIAL_NAME) & (_val(r, "spec") == V.RULE_MATERIAL_SPEC)
            & (_val(r, "unit") != "") & ~_is_unit(_val(r, "unit")),
            lambda r: {"item_name": _val(r, "unit"), "spec": F.lit(V.RULE_MATERIAL_SPEC), "unit": F.lit("")},
        ),
        Rule(
            "rule_10_nset",
            lambda r: _val(r, "item_name").rlike(V.RULE_NSET) & (_val(r, "spec") != ""),
            lambda r: _shift_left(r, "SET"),
        ),
        Rule("rule_04_invalid", lambda r: _val(r, "item_name").isin(*V.RULE_INVALID_NAMES), _invalid_updates),
        Rule("rule_05_manual", lambda r: any_of(test for test, _ in _corrections(r)), _manual_updates),
        Rule(
            "rule_06_dup",
            lambda r: (_val(r, "item_name") != "") & (_val(r, "item_name") == _val(r, "spec")),
            lambda r: {"spec": _model(r), "unit": F.when(_model(r) != "", F.lit("EA")).otherwise(r["unit"])},
        ),
        Rule("rule_07_infer", lambda r: _val(r, "unit") == "", lambda r: {"unit": _price_unit(r)}),
    ]
}


def _run(items: DataFrame, rules: list[Rule]) -> DataFrame:
    log = F.col(CHANGED) if CHANGED in items.columns else F.array().cast("array<string>")
    record = F.struct(
        *[F.coalesce(c, F.lit("")).alias(c) for c in RULE_COLUMNS], F.col("unit_price"), log.alias(CHANGED)
    )
    chain = F.array(record)
    for rule in rules:
        chain = F.transform(chain, rule.step)
    out = items.withColumn("__record", F.get(chain, F.lit(0)))
    return out.withColumns({c: F.col(f"__record.{c}") for c in [*RULE_COLUMNS, CHANGED]}).drop("__record")


def apply_rule(items: DataFrame, name: str) -> DataFrame:
    return _run(items, [RULES[name]])


def apply_rules(items: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """All rules in their fixed order; row count never changes.

    With a table of `corrections` (see `correct`), it takes the place of the built-in ones.
    """
    if corrections is None:
        return _run(items, list(RULES.values()))
    names = list(RULES)
    at = names.index("rule_05_manual")
    early, late = ([RULES[n] for n in part] for part in (names[:at], names[at + 1:]))
    return _run(correct(_run(items, early), corrections), late)


def corrections_table(spark: SparkSession) -> DataFrame:
    """The built-in corrections as a table: priority, match_<field> (null matches all), set_<field> (null keeps)."""
    rows = [
        (i, *[match.get(c) for c in RULE_COLUMNS], *[patch.get(c) for c in RULE_COLUMNS])
        for i, (match, patch) in enumerate(V.RULE_CORRECTIONS)
    ]
    fields = [f"{kind}_{c} string" for kind in ("match", "set") for c in RULE_COLUMNS]
    return spark.createDataFrame(rows, ", ".join(["priority bigint", *fields]))


def correct(items: DataFrame, corrections: DataFrame, name: str = "rule_05_manual") -> DataFrame:
    """Lines with the correction of least priority that they match, logged as `name`.

    A correction names values of some fields and leaves the others open. Corrections are grouped by
    which fields they name, at most 2 ** 5 groups; each group is one equi-join on its fields, with
    one row a key, so a line never meets a correction that it does not match. Values are compared
    without surrounding blanks. Equal priorities fall to the smaller values, field by field; a value goes
    before a field that is kept.
    """
    named = F.array(*[F.col(f"match_{c}").isNotNull() for c in RULE_COLUMNS])
    masks = sorted(tuple(r["mask"]) for r in corrections.select(named.alias("mask")).distinct().collect())
    log = F.col(CHANGED) if CHANGED in items.columns else F.array().cast("array<string>")
    out = items.withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in RULE_COLUMNS}, CHANGED: log,
        **{f"__key_{c}": strip(F.coalesce(c, F.lit(""))) for c in RULE_COLUMNS}, "__any": F.lit(1),
    })
    ranked = [v for c in RULE_COLUMNS for v in (F.col(f"set_{c}").isNull().alias(f"keeps_{c}"), F.col(f"set_{c}").alias(c))]
    patch = F.struct("priority", *ranked)
    found = []
    for i, mask in enumerate(masks):
        fields = [c for c, used in zip(RULE_COLUMNS, mask, strict=True) if used]
        keys = [F.col(f"match_{c}").alias(f"__key_{c}") for c in fields] or [F.lit(1).alias("__any")]
        group = corrections.filter(named == F.array(*map(F.lit, mask))).groupBy(*keys).agg(F.min(patch).alias(f"__found_{i}"))
        out = out.join(group, [c for c in group.columns if c != f"__found_{i}"], "left")
        found.append(F.col(f"__found_{i}"))
    best = F.array_min(F.array(*found)) if found else F.lit(None).cast("struct<priority:bigint>")
    chosen = out.withColumn("__best", best)
    if found:
        hit = F.col("__best").isNotNull()
        chosen = chosen.withColumns({
            **{c: F.coalesce(F.col("__best")[c], F.col(c)) for c in RULE_COLUMNS},
            CHANGED: F.when(hit, F.array_append(CHANGED, F.lit(name))).otherwise(F.col(CHANGED)),
        })
    return chosen.select(*items.columns, *([] if CHANGED in items.columns else [CHANGED]))


def rule_counts(repaired: DataFrame) -> DataFrame:
    """How many rows each rule changed; one counter per rule, so nothing is exploded."""
    counts = repaired.agg(
        *[F.count_if(F.array_contains(CHANGED, name)).alias(name) for name in RULES]
    )
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("changed")) for name in RULES])
    return counts.select(F.inline(pairs)).filter("changed > 0")
