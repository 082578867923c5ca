"""Repair rules on lines whose columns were misplaced in known ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens import fixed_values as V
from quotelens.operators import rules as R
from workload import tables as T
from workload.registry import query
from workload.tables import NEEDS, CTE, sql

_CASES = [
    # p_size % 20 -> item_name, spec, unit, maker, unit_name (None keeps the line's value)
    (0, None, "SET", "ABC-1", None, None),
    (1, None, None, "MD", None, None),
    (2, None, "omron", "EA", None, None),
    (3, "기계", None, "EA", "NOT A MAKER", None),
    (4, "구매품", None, "M-100", None, None),
    (5, "(OP10, 한글)", None, "EA", None, None),
    (6, "자재비", "철자재", "강판", None, None),
    (7, "(3set)", None, "X-9", None, None),
    (8, None, "old spec", "4G 0.75", None, None),
    (9, "MBC ASS'Y", None, "EA", "OIL JET VISION UNIT", None),
    (10, "dup", "dup", "MODEL-7", None, None),
    (11, "dup", "dup", "", None, None),
    (12, None, None, "", None, None),
    (13, "서버 전송 프로그램", None, "LOT", None, None),
    (14, None, None, "EA", "BED EQUIPMENT", None),
    (15, "기계", "", "EA", "NOT A MAKER", None),
    (16, None, None, "Keyence", None, None),
    (17, "식", None, "", None, None),
    (18, None, None, "", "LOT", None),
    (19, "DIVERTER", "", "EA", None, None),
]
_COLUMNS = ["item_name", "spec", "unit", "maker", "unit_name"]
_BASE = {"item_name": "item_name", "spec": "coalesce(spec, '')", "unit": "unit", "maker": "maker", "unit_name": "unit_name"}


def _case(column: int) -> str:
    arms = " ".join(
        "WHEN {} THEN '{}'".format(case[0], case[1 + column].replace("'", "''"))
        for case in _CASES if case[1 + column] is not None
    )
    base = _BASE[_COLUMNS[column]]
    return f"CASE p_size % 20 {arms} ELSE {base} END" if arms else base


CTE["messy"] = f"""
SELECT seq, CASE WHEN p_size % 7 = 0 THEN unit_price * 1000 WHEN p_size % 7 = 1 THEN unit_price * 100000 ELSE unit_price END AS unit_price,
  {', '.join(f'{_case(i)} AS {c}' for i, c in enumerate(_COLUMNS))}
FROM lines"""
NEEDS["messy"] = ["lines"]

_UNITS = "('식','EA','SET','M','LOT','AY','MD','M/D')"
_MAKERS = "('robostar','thk외','omron','apex','thk','unicon','keyence','advantech','misumi','festo','닛다모아','smc')"


def _unit(e: str) -> str:
    return f"CASE WHEN trim({e}) = 'MD' THEN 'M/D' ELSE trim({e}) END"


def _maker(e: str) -> str:
    return (f"CASE lower(trim({e})) WHEN 'robostar' THEN 'Robostar' WHEN 'thk외' THEN 'THK외' WHEN 'unicon' THEN 'Unicon'"
            f" WHEN 'keyence' THEN 'Keyence' WHEN 'advantech' THEN 'Advantech' WHEN 'misumi' THEN 'misumi'"
            f" ELSE upper(trim({e})) END")


def _in_units(e: str) -> str:
    return f"trim({e}) IN {_UNITS}"


def _in_makers(e: str) -> str:
    return f"lower(trim({e})) IN {_MAKERS}"


def _model(e: str = "unit") -> str:
    return f"CASE WHEN trim({e}) IN {_UNITS} THEN '' ELSE trim({e}) END"


_U = ["spec", "item_name", "maker", "unit_name"]
_M = ["spec", "item_name", "unit_name", "unit"]
_SPECS = ("('19Ø(녹색)','12Ø(흑색)','16x12(녹색)','12*8(적색)','12*8(흑색)','1G25(노랑)','1G25(녹)','1X2X0.64','1X2X0.8','4G 0.75',"
          "'4G 1','25G 0.75','15G 0.75','12G 0.75','4G 2.5','7G 1','3G 25','1C*25SQ(G)','1C*25SQ(BK)','25G*0.75SQ','7G*1.0SQ')")


def _first(columns: list[str], test) -> str:
    return "CASE " + " ".join(f"WHEN {test(c)} THEN '{c}'" for c in columns) + " END"


# Condition and new values of every rule, written independently in SQL.
RULE_SQL: dict[str, tuple[str, dict[str, str]]] = {
    "rule_01_unit": (
        f"CASE WHEN {_in_units('unit')} THEN trim(unit) = 'MD' ELSE {_first(_U, _in_units)} IS NOT NULL END",
        {**{c: f"CASE WHEN NOT {_in_units('unit')} AND {_first(_U, _in_units)} = '{c}' THEN trim(unit) ELSE {c} END" for c in _U},
         "unit": f"CASE WHEN {_in_units('unit')} THEN {_unit('unit')} ELSE "
                 + "CASE " + " ".join(f"WHEN {_in_units(c)} THEN {_unit(c)}" for c in _U) + " END END"},
    ),
    "rule_02_maker": (
        f"{_first(_M, _in_makers)} IS NOT NULL",
        {**{c: f"CASE WHEN {_first(_M, _in_makers)} = '{c}' THEN trim(maker) ELSE {c} END" for c in _M},
         "maker": "CASE " + " ".join(f"WHEN {_in_makers(c)} THEN {_maker(c)}" for c in _M) + " END"},
    ),
    "rule_03_spec": (f"trim(unit) IN {_SPECS}", {"spec": "trim(unit)", "unit": "''"}),
    "rule_08_category": (
        r"(trim(item_name) IN ('구매품','(유공압품외)','DIVERTER','TURNING POSITION') OR regexp_matches(trim(item_name), '^\(OP[\w\p{L},\s]+\)$')) AND trim(spec) <> ''",
        {"item_name": "trim(spec)", "spec": _model(), "unit": "'EA'"},
    ),
    "rule_09_material": (
        f"trim(item_name) = '자재비' AND trim(spec) = '철자재' AND trim(unit) <> '' AND NOT {_in_units('unit')}",
        {"item_name": "trim(unit)", "spec": "'철자재'", "unit": "''"},
    ),
    "rule_10_nset": (
        r"regexp_matches(trim(item_name), '(?i)^\(\d+SET\)$') AND trim(spec) <> ''",
        {"item_name": "trim(spec)", "spec": _model(), "unit": "'SET'"},
    ),
    "rule_04_invalid": (
        "trim(item_name) = '기계'",
        {"item_name": "trim(spec)",
         "spec": f"CASE WHEN trim(spec) = '' AND trim(maker) <> '' AND NOT {_in_makers('maker')} THEN trim(maker) ELSE '' END",
         "maker": f"CASE WHEN trim(spec) = '' AND trim(maker) <> '' AND NOT {_in_makers('maker')} THEN '' ELSE maker END"},
    ),
    "rule_05_manual": (
        "(trim(item_name) = 'MBC ASS''Y' AND trim(maker) = 'OIL JET VISION UNIT') OR trim(maker) = 'BED EQUIPMENT' OR trim(item_name) = '서버 전송 프로그램'",
        {"item_name": "CASE WHEN trim(item_name) = 'MBC ASS''Y' AND trim(maker) = 'OIL JET VISION UNIT' THEN 'OIL JET VISION UNIT' ELSE item_name END",
         "spec": "CASE WHEN trim(item_name) = 'MBC ASS''Y' AND trim(maker) = 'OIL JET VISION UNIT' THEN 'MBC ASS''Y' WHEN trim(maker) = 'BED EQUIPMENT' THEN 'BED EQUIPMENT' ELSE spec END",
         "maker": "CASE WHEN trim(item_name) = 'MBC ASS''Y' AND trim(maker) = 'OIL JET VISION UNIT' THEN '' WHEN trim(maker) = 'BED EQUIPMENT' THEN '' ELSE maker END",
         "unit": "CASE WHEN trim(item_name) = '서버 전송 프로그램' AND trim(maker) <> 'BED EQUIPMENT' THEN '식' ELSE unit END"},
    ),
    "rule_06_dup": (
        "trim(item_name) <> '' AND trim(item_name) = trim(spec)",
        {"spec": f"CASE WHEN {_in_units('unit')} OR trim(unit) = '' THEN '' ELSE trim(unit) END",
         "unit": f"CASE WHEN {_in_units('unit')} OR trim(unit) = '' THEN unit ELSE 'EA' END"},
    ),
    "rule_07_infer": (
        "trim(unit) = ''",
        {"unit": "CASE WHEN unit_price < 1000000 THEN 'EA' WHEN unit_price < 10000000 THEN 'SET' ELSE '식' END"},
    ),
}


def _rule_step(name: str, source: str) -> str:
    fires, updates = RULE_SQL[name]
    columns = ", ".join(
        f"CASE WHEN hit THEN {updates[c]} ELSE {c} END AS {c}" if c in updates else c for c in _COLUMNS
    )
    return (f"SELECT seq, unit_price, {columns}, CASE WHEN hit THEN changed || '{name};' ELSE changed END AS changed"
            f" FROM (SELECT *, {fires} AS hit FROM {source})")


CTE["step_0"] = "SELECT *, '' AS changed FROM messy"
NEEDS["step_0"] = ["messy"]
for _i, _name in enumerate(RULE_SQL, start=1):
    CTE[f"step_{_i}"] = _rule_step(_name, f"step_{_i - 1}")
    NEEDS[f"step_{_i}"] = [f"step_{_i - 1}"]
_LAST = f"step_{len(RULE_SQL)}"
_OUT = "seq, unit_price, item_name, spec, unit, maker, unit_name, changed"


def _messy(spark, sf):
    price = F.when(F.col("p_size") % 7 == 0, F.col("unit_price") * 1000).when(
        F.col("p_size") % 7 == 1, F.col("unit_price") * 100000
    ).otherwise(F.col("unit_price"))
    case = F.col("p_size") % 20
    values = {}
    for i, name in enumerate(_COLUMNS):
        value = F
        for row in _CASES:
            if row[1 + i] is not None:
                value = value.when(case == row[0], F.lit(row[1 + i]))
        base = F.coalesce(name, F.lit(""))
        values[name] = base if value is F else value.otherwise(base)
    return T.raw_lines(spark, sf).select(
        "seq", price.alias("unit_price"), *[v.alias(n) for n, v in values.items()]
    )


def _shown(df):
    log = F.concat_ws("", F.transform(R.CHANGED, lambda r: F.concat(r, F.lit(";"))))
    return df.withColumn("changed", log).select(*[c.strip() for c in _OUT.split(",")])


def _single(name: str) -> None:
    @query(name, sql(f"SELECT {_OUT} FROM ({_rule_step(name, 'step_0')})", "step_0"))
    def run(spark, sf):
        return _shown(R.apply_rule(_messy(spark, sf), name))


for _name in RULE_SQL:
    if _name != "rule_05_manual":
        _single(_name)

# Corrections from data: a maker's parts of one type, one part name, one part name of a maker, and the built-in ones last.
_PATCH = "NULL AS set_item_name, NULL AS set_spec, NULL AS set_unit, NULL AS set_maker, NULL AS set_unit_name"
_FIXED = ", ".join(
    "({}, {})".format(1_000_000 + i, ", ".join(
        "NULL" if d.get(c) is None else "'{}'".format(d[c].replace("'", "''")) for d in pair for c in _COLUMNS))
    for i, pair in enumerate(V.RULE_CORRECTIONS)
)
_NAMES = ", ".join(f"{kind}_{c}" for kind in ("match", "set") for c in _COLUMNS)
CTE["corrections"] = f"""
SELECT p_partkey AS priority, NULL AS match_item_name, p_type AS match_spec, NULL AS match_unit, p_brand AS match_maker, NULL AS match_unit_name,
  {_PATCH.replace('NULL AS set_unit,', "'TYPE' AS set_unit,")} FROM part WHERE p_partkey % 40 = 0
UNION ALL SELECT p_partkey, p_name, NULL, NULL, NULL, NULL,
  {_PATCH.replace('NULL AS set_spec', "'by name ' || p_partkey AS set_spec")} FROM part WHERE p_partkey % 70 = 0
UNION ALL SELECT p_partkey - 500, p_name, NULL, NULL, p_brand, NULL,
  {_PATCH.replace('NULL AS set_maker', "'' AS set_maker")} FROM part WHERE p_partkey % 30 = 0
UNION ALL SELECT * FROM (VALUES {_FIXED}) t(priority, {_NAMES})"""
NEEDS["corrections"] = []


def _corrections(spark, sf):
    c = F.col
    part = T.load(spark, sf, "part")

    def made(rows, priority, **fields):
        every = [f"{kind}_{name}" for kind in ("match", "set") for name in _COLUMNS]
        return rows.select(priority.cast("bigint").alias("priority"), *[
            fields.get(f, F.lit(None)).cast("string").alias(f) for f in every])

    key = c("p_partkey")
    return (
        made(part.filter(key % 40 == 0), key, match_spec=c("p_type"), match_maker=c("p_brand"), set_unit=F.lit("TYPE"))
        .unionByName(made(part.filter(key % 70 == 0), key, match_item_name=c("p_name"),
                          set_spec=F.concat(F.lit("by name "), key.cast("string"))))
        .unionByName(made(part.filter(key % 30 == 0), key - 500, match_item_name=c("p_name"), match_maker=c("p_brand"),
                          set_maker=F.lit("")))
        .unionByName(R.corrections_table(spark).withColumn("priority", c("priority") + 1_000_000))
    )


_MATCHES = " AND ".join(f"(match_{c} IS NULL OR match_{c} = trim(m.{c}))" for c in _COLUMNS)


_RECORD = ", ".join(f"m.{c}" for c in _COLUMNS)


@query("rule_05_manual", sql(f"""
SELECT seq, unit_price, {', '.join(f'coalesce(b.set_{c}, m.{c}) AS {c}' for c in _COLUMNS)},
  CASE WHEN b.priority IS NULL THEN '' ELSE 'rule_05_manual;' END AS changed
FROM messy m LEFT JOIN (
  SELECT {_RECORD}, c.* FROM (SELECT DISTINCT {_RECORD} FROM messy m) m JOIN corrections c ON {_MATCHES}
  QUALIFY row_number() OVER (PARTITION BY {_RECORD} ORDER BY priority, set_spec, set_unit, set_maker) = 1) b USING ({', '.join(_COLUMNS)})""",
                             "messy", "corrections"))
def rule_05_manual(spark, sf):
    """Every line against a table of corrections with open fields; the least priority wins."""
    return _shown(R.correct(_messy(spark, sf), _corrections(spark, sf)))


@query("rule_chain", sql(f"SELECT {_OUT} FROM {_LAST}", _LAST))
def rule_chain(spark, sf):
    return _shown(R.apply_rules(_messy(spark, sf)))


@query("agg_rule_stats", sql(f"""
SELECT rule, count(*) AS changed FROM (SELECT unnest(string_split(rtrim(changed, ';'), ';')) AS rule FROM {_LAST} WHERE changed <> '')
GROUP BY 1""", _LAST))
def agg_rule_stats(spark, sf):
    return R.rule_counts(R.apply_rules(_messy(spark, sf)))
