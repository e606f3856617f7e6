"""Registered queries over the sources: small files in ``fixtures``, read by the loaders here and by ``read_csv`` in SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leontia.model import LabeledMatrix, LabeledSeries
from leontia.operators import axis as ax
from leontia.plans.supply_use import SupplyUse
from leontia.plans.system import MRIO
from leontia.sources import gloria as g
from leontia.sources.eora import eora
from leontia.sources.text import label_table, lines, numbers, width_of
from leontia.sources.xlsx import read_sheet

ROOT = Path(__file__).resolve().parent / "fixtures"
EORA, RELEASE, ZIPPED = (str(ROOT / n) for n in ("eora", "release", "zipped"))
_TABLES, _SATELLITES = f"{RELEASE}/2019/{g.archive_name(60, 2019)}", f"{RELEASE}/2019/GLORIA_SatelliteAccounts_060_2019"
FILES = {k: f"{_TABLES}/{g.result_file(k, 2019, 60)}" for k in "TYV"} | {k: f"{_SATELLITES}/20260121_{g.satellite_suffix(k, 2019, 60)}" for k in ("TQ", "YQ")}
REGIONS, SECTORS = 3, 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str, f: Callable[[SparkSession], DataFrame]) -> None:
    QUERIES[name] = lambda spark, _: f(spark)
    SQL[name] = sql


def _lines(path: str) -> str:
    return f"(SELECT row_number() OVER () - 1 AS pos, line FROM read_csv('{path}', columns = {{'line': 'VARCHAR'}}, delim = '\x01', header = false, quote = '', escape = '', parallel = false) WHERE line IS NOT NULL)"


def _cells(name: str, path: str, delimiter: str) -> str:
    return f"{name} AS (SELECT pos AS row_pos, i - 1 AS col_pos, coalesce(TRY_CAST(trim(parts[i]) AS DOUBLE), 0) AS value FROM (SELECT pos, string_split(line, '{delimiter}') AS parts FROM {_lines(path)}), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))"


def _labels(name: str, path: str, columns: dict[int, str]) -> str:
    return f"{name} AS (SELECT pos, {', '.join(f'trim(parts[{k}]) AS {n}' for k, n in columns.items())} FROM (SELECT pos, string_split(line, '\t') AS parts FROM {_lines(path)}))"


def _long(m: LabeledMatrix, digits: int = 6) -> DataFrame:
    return m.to_long().withColumn("value", F.round("value", digits))


def _series(s: LabeledSeries, digits: int = 6) -> DataFrame:
    return s.to_df().withColumn("value", F.round("value", digits))


# ---- a folder of matrices with label files

_EORA = ", ".join([
    *[_cells(n, f"{EORA}/{n}.txt", "\t") for n in ("T", "VA", "FD", "Q")],
    _labels("lt", f"{EORA}/labels_T.txt", {2: "CountryCode", 3: "Industry", 4: "Sector"}),
    _labels("lf", f"{EORA}/labels_FD.txt", {2: "CountryCode", 3: "Industry", 4: "Category"}),
    _labels("lv", f"{EORA}/labels_VA.txt", {2: "PrimaryInput"}),
    _labels("lq", f"{EORA}/labels_Q.txt", {1: "Stressor", 2: "Source"}),
    "kt AS (SELECT * FROM lt WHERE CountryCode <> 'ROW')",
    "kf AS (SELECT * FROM lf WHERE CountryCode <> 'ROW')",
    "x AS (SELECT kt.pos, CountryCode, Industry, Sector, sum(value) AS value FROM kt JOIN (SELECT row_pos, value FROM T JOIN kt c ON c.pos = col_pos UNION ALL SELECT row_pos, value FROM FD JOIN kf c ON c.pos = col_pos) v ON v.row_pos = kt.pos GROUP BY ALL)",
])
_T_ROWS = "r.CountryCode AS row_CountryCode, r.Industry AS row_Industry, r.Sector AS row_Sector"
_T_COLS = "c.CountryCode AS col_CountryCode, c.Industry AS col_Industry, c.Sector AS col_Sector"
_register("eora_T", f"WITH {_EORA} SELECT {_T_ROWS}, {_T_COLS}, round(value, 6) AS value FROM T JOIN kt r ON r.pos = row_pos JOIN kt c ON c.pos = col_pos", lambda s: _long(eora(s, EORA).T))
_register("eora_FD", f"WITH {_EORA} SELECT {_T_ROWS}, c.CountryCode AS col_CountryCode, c.Industry AS col_Industry, c.Category AS col_Category, round(value, 6) AS value FROM FD JOIN kt r ON r.pos = row_pos JOIN kf c ON c.pos = col_pos", lambda s: _long(eora(s, EORA).FD))
_register("eora_VA", f"WITH {_EORA} SELECT r.PrimaryInput AS row_PrimaryInput, {_T_COLS}, round(value, 6) AS value FROM VA JOIN lv r ON r.pos = row_pos JOIN kt c ON c.pos = col_pos", lambda s: _long(eora(s, EORA).VA))
_register("eora_X", f"WITH {_EORA} SELECT CountryCode, Industry, Sector, round(value, 6) AS value FROM x", lambda s: _series(eora(s, EORA).X))
_register("eora_A", f"WITH {_EORA} SELECT {_T_ROWS}, {_T_COLS}, round(T.value / c.value, 6) AS value FROM T JOIN kt r ON r.pos = row_pos JOIN x c ON c.pos = col_pos", lambda s: _long(eora(s, EORA).A))
_register("eora_extension", f"WITH {_EORA} SELECT r.Stressor AS row_Stressor, r.Source AS row_Source, {_T_COLS}, round(Q.value / c.value, 6) AS value FROM Q JOIN lq r ON r.pos = row_pos JOIN x c ON c.pos = col_pos", lambda s: _long(eora(s, EORA).env.A))
_register("eora_names", f"WITH {_EORA} SELECT 'country' AS kind, CountryCode AS name FROM kt UNION SELECT 'sector', Sector FROM kt UNION SELECT 'stressor', Stressor FROM lq", lambda s: (lambda m: s.createDataFrame([(k, n) for k, ns in (("country", m.countries()), ("sector", m.sectors()), ("stressor", m.stressors())) for n in ns], "kind string, name string"))(eora(s, EORA)))
_SUB = "JOIN kt r ON r.pos = row_pos AND r.CountryCode <> 'SUD'"
_register(
    "eora_sub_system",
    f"WITH {_EORA} SELECT r.CountryCode, r.Industry, r.Sector, round(sum(value), 6) AS value FROM (SELECT row_pos, value FROM T JOIN kt c ON c.pos = col_pos AND c.CountryCode <> 'SUD' UNION ALL SELECT row_pos, value FROM FD JOIN kf c ON c.pos = col_pos AND c.CountryCode = 'NOR') {_SUB} GROUP BY ALL",
    lambda s: _series(eora(s, EORA).sub_system("CountryCode <> 'SUD'", "CountryCode = 'NOR'").X),
)
_register("eora_filter_columns", f"WITH {_EORA} SELECT {_T_ROWS}, {_T_COLS}, round(value, 6) AS value FROM T JOIN kt r ON r.pos = row_pos JOIN kt c ON c.pos = col_pos AND c.Sector = 'Mining'", lambda s: _long(eora(s, EORA).filter(F.col("Sector") == "Mining", dims=2).T))
_register("eora_labels", f"WITH {_EORA} SELECT pos, CountryCode, Industry, Sector FROM lt", lambda s: label_table(s, f"{EORA}/labels_T.txt", {2: "CountryCode", 3: "Industry", 4: "Sector"}))


# ---- tokens

_register("number_tokens", "SELECT row_pos, col_pos, CAST(value AS DOUBLE) AS value FROM (VALUES (0, 0, 1.5), (0, 1, 2.0), (0, 2, 0.0), (1, 0, 0.0), (1, 1, -3.0), (1, 2, 400.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 7.0)) t(row_pos, col_pos, value)", lambda s: numbers(lines(s, str(ROOT / "tokens.txt")), ",", strict=True).selectExpr("CAST(row_pos AS int) row_pos", "CAST(col_pos AS int) col_pos", "value"))


# ---- the blocks of a release

_BLOCK = ", ".join([
    *[_cells(f"file_{k}", p, ",") for k, p in FILES.items()],
    *[f"{k} AS (SELECT row_pos, col_pos, value, row_pos // {SECTORS} % 2 AS row_kind, col_pos // {SECTORS} % 2 AS col_kind, row_pos // {2 * SECTORS} * {SECTORS} + row_pos % {SECTORS} AS r, col_pos // {2 * SECTORS} * {SECTORS} + col_pos % {SECTORS} AS c FROM file_{k})" for k in FILES],
    "v AS MATERIALIZED (SELECT r AS row_pos, c AS col_pos, value FROM T WHERE row_kind = 0 AND col_kind = 1)",
    "u AS MATERIALIZED (SELECT r AS row_pos, c AS col_pos, value FROM T WHERE row_kind = 1 AND col_kind = 0)",
    "fd AS MATERIALIZED (SELECT r AS row_pos, col_pos, value FROM Y WHERE row_kind = 1)",
    "va AS MATERIALIZED (SELECT row_pos, c AS col_pos, value FROM V_ WHERE col_kind = 0)".replace("V_", "V"),
    "q AS MATERIALIZED (SELECT row_pos, c AS col_pos, value FROM TQ WHERE col_kind = 0)",
]).replace("v AS MATERIALIZED", "supply AS MATERIALIZED")
_XYZ = "SELECT CAST(row_pos AS BIGINT) AS row_pos, CAST(col_pos AS BIGINT) AS col_pos, value FROM"


def _rows(s: SparkSession, kind: str) -> DataFrame:
    return lines(s, FILES[kind])


_register("release_supply", f"WITH {_BLOCK} {_XYZ} supply", lambda s: g.parse_supply_use(_rows(s, "T"), REGIONS, SECTORS)[0])
_register("release_use", f"WITH {_BLOCK} {_XYZ} u", lambda s: g.parse_supply_use(_rows(s, "T"), REGIONS, SECTORS)[1])
_register("release_value_added_block", f"WITH {_BLOCK} {_XYZ} va", lambda s: g.parse_industry_columns(_rows(s, "V"), REGIONS, SECTORS))
_register("release_final_demand_block", f"WITH {_BLOCK} {_XYZ} fd", lambda s: g.parse_product_rows(_rows(s, "Y"), REGIONS, SECTORS))
_register("release_satellite_block", f"WITH {_BLOCK} {_XYZ} q", lambda s: g.parse_industry_columns(_rows(s, "TQ"), REGIONS, SECTORS))
_register("release_household_block", f"WITH {_BLOCK} {_XYZ} file_YQ", lambda s: g.parse_household_satellites(_rows(s, "YQ")))
_register("release_sizes", f"WITH f AS {_lines(FILES['Y'])} SELECT max(len(string_split(line, ','))) // 6 AS regions, count(*) // (2 * (max(len(string_split(line, ','))) // 6)) AS sectors, max(len(string_split(line, ','))) AS width FROM f", lambda s: (lambda y: s.createDataFrame([(*g.detect_dims(y), width_of(y))], "regions long, sectors long, width long"))(_rows(s, "Y")))
_register("block_places", "SELECT p AS place, p // 10 * 5 + p % 5 AS moved, p // 5 % 2 = 1 AS product FROM range(60) t(p)", lambda s: s.range(60).select(F.col("id").alias("place"), g._global("id", 5).alias("moved"), g._is_product("id", 5).alias("product")))
_NAMES = {
    "folder": "GLORIA_MRIOs_60_2019",
    "table": "20260121_120secMother_AllCountries_002_T-Results_2019_060_Markup001(full).csv",
    "purchaser": "20260121_120secMother_AllCountries_002_Y-Results_2021_059_Markup005(full).csv",
    "satellite": "TQ-Results_2019_060_Markup001(full).csv",
}
_register("release_names", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _NAMES.items()) + ") t(kind, name)", lambda s: s.createDataFrame([("folder", g.archive_name(60, 2019)), ("table", g.result_file("T", 2019, 60)), ("purchaser", g.result_file("Y", 2021, 59, "purchaser")), ("satellite", g.satellite_suffix("TQ", 2019, 60))], "kind string, name string"))


def _sut_sums(sut: SupplyUse) -> DataFrame:
    parts = [getattr(sut, n).agg(F.lit(n).alias("part"), F.round(F.sum("value"), 6).alias("total"), F.count_if(F.col("value") != 0).alias("filled")) for n in ("V", "U", "Y", "VA")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_SUT_SQL = f"WITH {_BLOCK} " + " UNION ALL ".join(f"SELECT '{n}' AS part, round(sum(value), 6) AS total, count(*) FILTER (value <> 0) AS filled FROM {t}" for n, t in (("V", "supply"), ("U", "u"), ("Y", "fd"), ("VA", "va")))
_register("release_supply_use", _SUT_SQL, lambda s: _sut_sums(g.parse_sut(s, RELEASE, 2019)))
_register("release_supply_use_zipped", _SUT_SQL, lambda s: _sut_sums(g.parse_sut(s, ZIPPED, 2019)))

_REGION_NAMES, _SECTOR_NAMES, _PAY, _DEMAND, _STRESS = ("AAA", "BBB", "CCC"), ("Grain", "Steel"), ("Pay", "Rent"), tuple(f"h{i}" for i in range(1, 7)), (("CO2", "air", "kt"), ("Land", "soil", "ha"))


def _values(name: str, rows, columns: str) -> str:
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(repr, r)) + ")" for r in rows) + f") t({columns}))"


_SYSTEM = ", ".join([
    _BLOCK,
    "g_ AS (SELECT row_pos AS i, sum(value) AS s FROM supply GROUP BY row_pos)",
    "share AS MATERIALIZED (SELECT row_pos, col_pos, value / s AS value FROM supply JOIN g_ ON i = row_pos WHERE s <> 0 AND value <> 0)",
    "z AS MATERIALIZED (SELECT u.row_pos, share.col_pos, sum(u.value * share.value) AS value FROM u JOIN share ON share.row_pos = u.col_pos GROUP BY ALL)",
    "output AS MATERIALIZED (SELECT row_pos AS pos, sum(value) AS value FROM (SELECT row_pos, value FROM u UNION ALL SELECT row_pos, value FROM fd) GROUP BY row_pos)",
    f"live AS (SELECT DISTINCT row_pos // {SECTORS} AS region FROM (SELECT row_pos, sum(value) AS s FROM z GROUP BY row_pos UNION ALL SELECT col_pos, sum(value) FROM z GROUP BY col_pos) WHERE s <> 0)",
    _values("regions", list(enumerate(_REGION_NAMES)), "region, CountryCode"),
    _values("sectors", list(enumerate(_SECTOR_NAMES)), "k, Sector"),
    f"products AS (SELECT region * {SECTORS} + k AS pos, CountryCode, Sector FROM regions JOIN live USING (region) CROSS JOIN sectors)",
    _values("pay", list(enumerate(_PAY)), "k, Category"),
    f"inputs AS (SELECT region * {len(_PAY)} + k AS pos, CountryCode, Category FROM regions JOIN live USING (region) CROSS JOIN pay)",
    _values("demand_names", list(enumerate(_DEMAND)), "k, Category"),
    f"demands AS (SELECT region * {len(_DEMAND)} + k AS pos, CountryCode, Category FROM regions JOIN live USING (region) CROSS JOIN demand_names)",
    _values("stress", [(i, *x) for i, x in enumerate(_STRESS)], "pos, Stressor, Source, Unit"),
])
_P_ROWS, _P_COLS = "r.CountryCode AS row_CountryCode, r.Sector AS row_Sector", "c.CountryCode AS col_CountryCode, c.Sector AS col_Sector"


def _dense(rows: str, row_names: str, cols: str, col_names: str, cells: str, value: str = "coalesce(x.value, 0)", more: str = "") -> str:
    return f"WITH {_SYSTEM} SELECT {row_names}, {col_names}, round({value}, 6) AS value FROM {rows} r CROSS JOIN {cols} c LEFT JOIN {cells} x ON x.row_pos = r.pos AND x.col_pos = c.pos {more}"


_MADE = "(SELECT {0}.row_pos, share.col_pos, sum({0}.value * share.value) AS value FROM {0} JOIN share ON share.row_pos = {0}.col_pos GROUP BY ALL)"
_OF = "JOIN output o ON o.pos = c.pos"
_SAFE = "CASE WHEN o.value = 0 THEN 1 ELSE o.value END"


def _system(s: SparkSession, path: str = RELEASE, **more) -> MRIO:
    return g.gloria(s, path, 2019, **more)


_Z_SQL = _dense("products", _P_ROWS, "products", _P_COLS, "z")
_register("release_Z", _Z_SQL, lambda s: _long(_system(s).Z))
_register("release_Z_zipped", _Z_SQL, lambda s: _long(_system(s, ZIPPED).Z))
_register("release_A", _dense("products", _P_ROWS, "products", _P_COLS, "z", "CASE WHEN o.value = 0 THEN 0 ELSE coalesce(x.value, 0) / o.value END", _OF), lambda s: _long(_system(s).A))
_register("release_VA", _dense("inputs", "r.CountryCode AS row_CountryCode, r.Category AS row_Category", "products", _P_COLS, _MADE.format("va")), lambda s: _long(_system(s).VA))
_register("release_FD", _dense("products", _P_ROWS, "demands", "c.CountryCode AS col_CountryCode, c.Category AS col_Category", "fd"), lambda s: _long(_system(s).FD))
_register("release_extension", _dense("stress", "r.Stressor AS row_Stressor, r.Source AS row_Source, r.Unit AS row_Unit", "products", _P_COLS, _MADE.format("q"), f"coalesce(x.value, 0) / {_SAFE}", _OF), lambda s: _long(_system(s).env.A))
_register("release_X", f"WITH {_SYSTEM} SELECT CountryCode, Sector, round(value, 6) AS value FROM products JOIN output USING (pos)", lambda s: _series(_system(s).X))
_register("release_full_names", f"WITH {_SYSTEM} SELECT DISTINCT CASE CountryCode WHEN 'AAA' THEN 'Aland' ELSE 'Celand' END AS name FROM products", lambda s: s.createDataFrame([(n,) for n in _system(s, country_names="full").countries()], "name string"))
_register("release_empty_regions", f"WITH {_SYSTEM} SELECT CountryCode AS name FROM regions WHERE region NOT IN (SELECT region FROM live)", lambda s: (lambda found: s.createDataFrame([(n,) for n in _REGION_NAMES if n not in found], "name string"))(_system(s).countries()))
_register("workbook_sheets", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(_STRESS)) + ") t(pos, indicator, head, unit)", lambda s: (lambda t: s.createDataFrame(list(zip(range(len(_STRESS)), t["Sat_indicator"], t["Sat_head_indicator"], t["Sat_unit"])), "pos int, indicator string, head string, unit string"))(read_sheet(f"{RELEASE}/2019/GLORIA_ReadMe_060.xlsx", "Satellites")))
_register("safe_table", "SELECT n, kind, name, CAST(size AS DOUBLE) AS size FROM (VALUES (1, 'dict', 'a', 1.5), (2, 'dict', 'b', 2.25), (1, 'scalars', 'c', 2.5), (1, 'rows', 'd', 3.5)) t(n, kind, name, size)", lambda s: _tables(s))


def _tables(s: SparkSession) -> DataFrame:
    made = {"dict": {"n": [1, 2], "name": ["a", "b"], "size": [1.5, 2.25]}, "scalars": {"n": 1, "name": "c", "size": 2.5}, "rows": [{"n": 1, "name": "d", "size": 3.5}]}
    out = None
    for kind, t in made.items():
        part = ax.safe_table(s, t).selectExpr("CAST(n AS int) n", f"'{kind}' AS kind", "name", "CAST(size AS double) size")
        out = part if out is None else out.unionByName(part)
    return out
