"""Registered queries over the trade system of :mod:`leontia.plans.flows`, each with SQL that gives the same rows.

``SQL`` texts share the common table expressions of ``BASE``; values are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leontia.model import DimensionError, LabeledMatrix, LabeledSeries
from leontia.plans.flows import Flows
from leontia.plans.supply_use import SupplyUse, empty_regions, input_output, product_axis

BASE = """
types AS (SELECT p_type AS Sector, row_number() OVER (ORDER BY p_type) - 1 AS t FROM (SELECT DISTINCT p_type FROM part)),
k AS (SELECT count(*) AS k FROM types),
nations AS (SELECT n_nationkey AS pos, n_name AS CountryCode, r_name AS Region FROM nation JOIN region ON n_regionkey = r_regionkey),
axis AS (SELECT n.pos * k + t AS pos, CountryCode, Region, Sector FROM nations n CROSS JOIN types CROSS JOIN k),
lines AS MATERIALIZED (SELECT s_nationkey * k + t AS row_pos, c_nationkey * k + c_custkey % k AS col_pos, c_nationkey AS nation, l_returnflag = 'R' AS returned,
  l_extendedprice AS price, l_quantity AS Quantity, l_extendedprice * l_tax AS Tax, l_extendedprice * l_discount AS Discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey JOIN types ON p_type = Sector CROSS JOIN k),
zs AS (SELECT row_pos, col_pos, sum(price) AS value FROM lines WHERE NOT returned GROUP BY row_pos, col_pos),
z AS MATERIALIZED (SELECT r.pos AS row_pos, c.pos AS col_pos, coalesce(value, 0) AS value FROM axis r CROSS JOIN axis c LEFT JOIN zs ON zs.row_pos = r.pos AND zs.col_pos = c.pos),
ys AS (SELECT row_pos, nation AS col_pos, sum(price) AS value FROM lines WHERE returned GROUP BY row_pos, nation),
y AS MATERIALIZED (SELECT r.pos AS row_pos, c.pos AS col_pos, coalesce(value, 0) AS value FROM axis r CROSS JOIN nations c LEFT JOIN ys ON ys.row_pos = r.pos AND ys.col_pos = c.pos),
long AS (SELECT r.CountryCode AS row_CountryCode, r.Region AS row_Region, r.Sector AS row_Sector, c.CountryCode AS col_CountryCode, c.Region AS col_Region, c.Sector AS col_Sector, value
  FROM z JOIN axis r ON r.pos = row_pos JOIN axis c ON c.pos = col_pos),
x AS MATERIALIZED (SELECT pos, coalesce(sum(value), 0) AS value FROM axis LEFT JOIN (SELECT row_pos, value FROM z UNION ALL SELECT row_pos, value FROM y) ON row_pos = pos GROUP BY pos),
a AS MATERIALIZED (SELECT row_pos, col_pos, z.value / CASE WHEN x.value = 0 THEN 1 ELSE x.value END AS value FROM z JOIN x ON x.pos = col_pos),
f AS (SELECT 0 AS s, 'Discount' AS Stressor, row_pos AS pos, sum(Discount) AS value FROM lines GROUP BY row_pos UNION ALL SELECT 1, 'Quantity', row_pos, sum(Quantity) FROM lines GROUP BY row_pos UNION ALL SELECT 2, 'Tax', row_pos, sum(Tax) FROM lines GROUP BY row_pos),
fa AS (SELECT s, Stressor, f.pos, f.value / CASE WHEN x.value = 0 THEN 1 ELSE x.value END AS value FROM f JOIN x ON x.pos = f.pos)
"""
STEPS = 300


def _sql(body: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([BASE.strip(), *more])} {body}"


def _solve_sql(demand: str, name: str = "solved") -> list[str]:
    """The Neumann series of a demand (pos, value) as recursive expressions."""
    return [
        f"demand AS ({demand})",
        f"series(n, pos, value) AS (SELECT 0, pos, CAST(value AS DOUBLE) FROM demand UNION ALL SELECT n + 1, a.row_pos, sum(a.value * s.value) FROM series s JOIN a ON a.col_pos = s.pos WHERE n < {STEPS} GROUP BY n + 1, a.row_pos)",
        f"{name} AS (SELECT pos, sum(value) AS value FROM series GROUP BY pos)",
    ]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None, f: Callable[[Flows], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(Flows(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


def _r(df: DataFrame, digits: int = 2, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _long(m: LabeledMatrix, digits: int = 2) -> DataFrame:
    return _r(m.to_long(), digits)


def _out(s: LabeledSeries, digits: int = 2) -> DataFrame:
    return _r(s.df, digits)


# Flows by label.
for _label, _verb in (("CountryCode", "country"), ("Sector", "sector")):
    for _dim, _keys in (("both", (f"row_{_label}", f"col_{_label}")), ("rows", (f"row_{_label}",)), ("cols", (f"col_{_label}",))):
        _k = ", ".join(_keys)
        _register(f"sum_by_{_verb}_{_dim}", _sql(f"SELECT {_k}, round(sum(value), 2) AS value FROM long GROUP BY {_k}"), lambda w, v=_verb, d=_dim: _r(getattr(w.z(), f"sum_by_{v}")(d)))

_AGG = {"sum": "sum(value)", "mean": "avg(value)", "median": "median(value)", "std": "stddev_samp(value)", "var": "var_samp(value)", "min": "min(value)", "max": "max(value)"}
for _f, _s in _AGG.items():
    _d = 1 if _f == "var" else 2
    _expr = f"round({_s} / 1e6, 1)" if _f == "var" else f"round({_s}, 2)"
    _scaled = (lambda df: df.withColumn("value", F.round(F.col("value") / 1e6, 1))) if _f == "var" else _r
    _register(f"groupby_matrix_{_f}", _sql(f"SELECT row_Region, row_Sector, {_expr} AS value FROM long GROUP BY row_Region, row_Sector"), lambda w, f=_f, out=_scaled: out(w.z().groupby_matrix("Region", "Sector", agg_func=f)))
    _register(f"aggregate_rows_{_f}", _sql(f"SELECT row_Sector, col_CountryCode, col_Region, col_Sector, {_expr} AS value FROM long GROUP BY ALL"), lambda w, f=_f, out=_scaled: out(w.z().group_by("Sector").aggregate(f).to_long()))
_register("aggregate_cols_sum", _sql("SELECT row_CountryCode, row_Region, row_Sector, col_Region, round(sum(value), 2) AS value FROM long GROUP BY ALL"), lambda w: _long(w.z().group_by(["Region"], dims=2).aggregate("sum")))
# A mean of cents over 36 cells can lie on a tie; times the number of cells it cannot.
_register(
    "country_summary",
    _sql("SELECT row_CountryCode, col_CountryCode, round(sum(value), 2) AS total_flow, round(avg(value) * count(*), 2) AS mean_times_n, count(*) AS n_sectors FROM long GROUP BY ALL"),
    lambda w: _r(w.z().country_summary().withColumn("mean_times_n", F.col("mean_flow") * F.col("n_sectors")).drop("mean_flow"), 2, ("total_flow", "mean_times_n")),
)
_register(
    "matrix_summary",
    _sql("SELECT round(sum(value), 1) AS total, round(avg(value), 2) AS mean, round(median(value), 2) AS median, round(stddev_samp(value), 2) AS std, round(min(value), 2) AS min_val, round(max(value), 2) AS max_val, count(*) FILTER (value <> 0) AS n_nonzero, count(*) AS n_total FROM z"),
    lambda w: _r(_r(w.z().matrix_summary(), 1, ("total",)), 2, ("mean", "median", "std", "min_val", "max_val")),
)

# Selection.  Keys are of the first nation and part types by name.
_LONG = "SELECT row_CountryCode, row_Region, row_Sector, col_CountryCode, col_Region, col_Sector, round(value, 2) AS value FROM long"


def _first_type(w: Flows) -> str:
    return w.types.where("t = 0").first()["Sector"]


def _nations(w: Flows) -> list[str]:
    return [r["CountryCode"] for r in w.nations.orderBy("pos").limit(3).collect()]


_N = "(SELECT CountryCode FROM nations WHERE pos = {})".format
_T = "(SELECT Sector FROM types WHERE t = 0)"


def _exact(w: Flows) -> DataFrame:
    m, n, t = w.z(), _nations(w), _first_type(w)
    region = {r["CountryCode"]: r["Region"] for r in w.nations.collect()}
    key = lambda c: {"CountryCode": c, "Region": region[c], "Sector": t}
    return w.spark.createDataFrame([(round(m[key(n[0]), key(n[1])], 2),)], "value double")


_register("get_exact", _sql(f"SELECT round(value, 2) AS value FROM long WHERE row_CountryCode = {_N(0)} AND col_CountryCode = {_N(1)} AND row_Sector = {_T} AND col_Sector = {_T}"), _exact)
_register("rows_by_partial_key", _sql(f"{_LONG} WHERE row_CountryCode = {_N(0)}"), lambda w: _long(w.z()[{"CountryCode": _nations(w)[0]}, :]))
_register("row_series_by_key", _sql(f"SELECT c.pos, c.CountryCode, c.Region, c.Sector, round(value, 2) AS value FROM z JOIN axis c ON c.pos = col_pos WHERE row_pos = 0"), lambda w: _out(w.z()[{"CountryCode": _nations(w)[0], "Sector": _first_type(w)}, :]))
_register("cols_by_partial_key", _sql(f"{_LONG} WHERE col_Sector = {_T}"), lambda w: _long(w.z()[:, {"Sector": _first_type(w)}]))
_register("rows_by_key_list", _sql(f"{_LONG} WHERE row_CountryCode IN ({_N(0)}, {_N(2)})"), lambda w: _long(w.z()[[{"CountryCode": _nations(w)[0]}, {"CountryCode": _nations(w)[2]}], :]))
_register("cols_by_key_list", _sql(f"{_LONG} WHERE col_CountryCode = {_N(1)} OR col_Sector = {_T}"), lambda w: _long(w.z()[:, [{"CountryCode": _nations(w)[1]}, {"Sector": _first_type(w)}]]))
_register("mask_both", _sql(f"{_LONG} WHERE row_Region = 'ASIA' AND col_Region = 'EUROPE'"), lambda w: _long(w.z()[[r["Region"] == "ASIA" for r in w.axis.orderBy("pos").collect()], [r["Region"] == "EUROPE" for r in w.axis.orderBy("pos").collect()]]))
_register("filter_rows", _sql(f"{_LONG} WHERE row_Region = 'ASIA'"), lambda w: _long(w.z().filter_rows("Region = 'ASIA'")))
_register("filter_cols", _sql(f"{_LONG} WHERE col_Region <> 'AFRICA'"), lambda w: _long(w.z().filter_cols(F.col("Region") != "AFRICA")))
_register("filter_matrix", _sql(f"{_LONG} WHERE row_Region = 'ASIA' AND col_Sector = {_T}"), lambda w: _long(w.z().filter_matrix(lambda r: r["Region"] == "ASIA", F.col("Sector") == _first_type(w))))
_register("drop_rows", _sql(f"{_LONG} WHERE row_CountryCode <> {_N(0)}"), lambda w: _long(w.z().drop({"CountryCode": _nations(w)[0]})))
_register("drop_cols_keys", _sql(f"{_LONG} WHERE col_CountryCode NOT IN ({_N(0)}, {_N(1)})"), lambda w: _long(w.z().drop([{"CountryCode": c} for c in _nations(w)[:2]], dims=2)))
_register("slice_rows", _sql("SELECT r.new AS pos, r.CountryCode, col_pos, round(value, 2) AS value FROM z JOIN (SELECT *, CASE pos WHEN 4 THEN 0 WHEN 1 THEN 1 END AS new FROM axis WHERE pos IN (1, 4)) r ON r.pos = row_pos"), lambda w: _sliced(w))
_register("slice_cols", _sql(f"{_LONG} WHERE col_CountryCode = {_N(0)}"), lambda w: _long(w.z().slice_cols(range(1, w.k + 1))))


def _sliced(w: Flows) -> DataFrame:
    m = w.z().slice_rows([5, 2])
    return _r(m.cells.join(m.rows.select(F.col("pos").alias("row_pos"), "CountryCode"), "row_pos").select(F.col("row_pos").alias("pos"), "CountryCode", "col_pos", "value"))


# Labels.
_register("mutate_rows", _sql("SELECT lower(row_CountryCode) AS row_low, round(sum(value), 2) AS value FROM long GROUP BY ALL"), lambda w: _r(w.z().mutate_rows(low="lower(CountryCode)").groupby_matrix("low")))
_register("add_calculated_column", _sql("SELECT row_CountryCode || '/' || row_Region AS row_Place, round(avg(value), 2) AS value FROM long GROUP BY ALL"), lambda w: _r(w.z().add_calculated_column("Place", lambda r: f"{r['CountryCode']}/{r['Region']}").groupby_matrix("Place", agg_func="mean")))
_register("select_rows", _sql("SELECT row_Sector, col_CountryCode, col_Region, col_Sector, round(value, 2) AS value FROM long"), lambda w: _long(w.z().select_rows("Sector")))
_register("rename_cols", _sql("SELECT row_CountryCode, row_Region, row_Sector, col_Buyer, round(value, 2) AS value FROM (SELECT *, col_CountryCode AS col_Buyer FROM long)"), lambda w: _long(w.z().select_cols("CountryCode").rename_cols(Buyer="CountryCode")))
_register("countries", _sql("SELECT DISTINCT CountryCode AS name FROM axis"), lambda w: w.spark.createDataFrame([(n,) for n in w.z().countries()], "name string"))
_register("sectors", _sql("SELECT Sector AS name FROM types"), lambda w: w.spark.createDataFrame([(n,) for n in w.z().sectors()], "name string"))
_register("stressors", "SELECT unnest(['Discount', 'Quantity', 'Tax']) AS name", lambda w: w.spark.createDataFrame([(n,) for n in w.system().stressors()], "name string"))

# Shapes.
_register("to_long", _sql(_LONG), lambda w: _long(w.z()))
_register("from_long_roundtrip", _sql(_LONG), lambda w: _long(LabeledMatrix.from_long(w.z().to_long())))
_register("pivot_wide", None, lambda w: _pivot(w))


def _pivot(w: Flows) -> DataFrame:
    m = w.z().group_by("CountryCode").aggregate().group_by("Region", dims=2).aggregate()
    wide = m.pivot_wide("row_CountryCode", "col_Region")
    return _r(wide, 2, tuple(c for c in wide.columns if c != "row_CountryCode"))


SQL["pivot_wide"] = _sql("SELECT row_CountryCode, " + ", ".join(f"round(sum(value) FILTER (col_Region = '{r}'), 2) AS \"{r}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM long GROUP BY row_CountryCode")

# Series and sums.
_register("sum_rows", _sql("SELECT pos, CountryCode, Region, Sector, round(sum(value), 2) AS value FROM z JOIN axis ON pos = row_pos GROUP BY ALL"), lambda w: _out(w.z().sum_rows()))
_register("sum_cols", _sql("SELECT pos, CountryCode, Region, Sector, round(sum(value), 2) AS value FROM z JOIN axis ON pos = col_pos GROUP BY ALL"), lambda w: _out(w.z().sum_cols()))
_register("series_aggregate", _sql("SELECT Region, round(max(v), 2) AS value FROM (SELECT Region, sum(value) AS v FROM z JOIN axis ON pos = row_pos GROUP BY pos, Region) GROUP BY Region"), lambda w: _out(w.z().sum_rows().group_by("Region").aggregate("maximum")).drop("pos"))

# Algebra.
_register("total_output", _sql("SELECT pos, CountryCode, Region, Sector, round(x.value, 2) AS value FROM x JOIN axis USING (pos)"), lambda w: _out(w.system().X))
_register("technical_coefficients", _sql("SELECT row_pos, col_pos, round(value, 6) AS value FROM a"), lambda w: _r(w.system().A.cells, 6))
_DEMAND = "SELECT row_pos AS pos, sum(value) AS value FROM y GROUP BY row_pos"
_register("solve_leontief", _sql("SELECT pos, CountryCode, Region, Sector, round(solved.value, 2) AS value FROM solved JOIN axis USING (pos)", *_solve_sql(_DEMAND), recursive=True), lambda w: (lambda m: _out(m.L.solve(m.Y.sum_rows()), 2))(w.system()))
_INDUCED = "SELECT CountryCode, Sector, round(solved.value, 2) AS InducedProduction FROM solved JOIN axis USING (pos)"
_register("induced_production", _sql(_INDUCED, *_solve_sql(_DEMAND), recursive=True), lambda w: _r(w.system().induced_production(), 2, ("InducedProduction",)))
_SOME = f"SELECT row_pos AS pos, sum(value) AS value FROM y WHERE col_pos IN (0, 2) GROUP BY row_pos"
_register("induced_production_filtered", _sql(f"{_INDUCED} WHERE CountryCode = {_N(1)}", *_solve_sql(_SOME), recursive=True), lambda w: (lambda n: _r(w.system().induced_production([n[0], n[2]], n[1]), 2, ("InducedProduction",)))(_nations(w)))
_register("top5_induced", _sql(f"{_INDUCED} ORDER BY solved.value DESC LIMIT 5", *_solve_sql(_DEMAND), recursive=True), lambda w: _r(w.system().induced_production().orderBy(F.desc("InducedProduction")).limit(5), 2, ("InducedProduction",)))
_register("multiplier_ratio", _sql("SELECT round((SELECT sum(value) FROM solved) / (SELECT sum(value) FROM y), 6) AS ratio", *_solve_sql(_DEMAND), recursive=True), lambda w: _ratio(w))
_register("output_multipliers", _sql("SELECT pos, CountryCode, Region, Sector, round(m.value, 5) AS value FROM (SELECT pos, sum(value) AS value FROM series GROUP BY pos) m JOIN axis USING (pos)", "series(n, pos, value) AS (SELECT 0, pos, 1.0::DOUBLE FROM axis UNION ALL SELECT n + 1, a.col_pos, sum(a.value * s.value) FROM series s JOIN a ON a.row_pos = s.pos WHERE n < 300 GROUP BY n + 1, a.col_pos)", recursive=True), lambda w: _out(w.system().multipliers(), 5))
_register("environmental_impact_vector", _sql("SELECT s AS pos, Stressor, 'lineitem' AS Source, round(sum(fa.value * x.value), 2) AS value FROM fa JOIN x ON x.pos = fa.pos GROUP BY ALL"), lambda w: (lambda m: _out(m.environmental_impact(m.X)))(w.system()))
_register("environmental_impact_scenarios", _sql("SELECT Stressor AS row_Stressor, 'lineitem' AS row_Source, CountryCode AS col_CountryCode, round(sum(fa.value * y.value), 2) AS value FROM fa JOIN y ON y.row_pos = fa.pos JOIN nations ON nations.pos = y.col_pos GROUP BY ALL"), lambda w: (lambda m: _long(m.environmental_impact(m.Y)))(w.system()))


def _ratio(w: Flows) -> DataFrame:
    m = w.system()
    induced = m.induced_production().agg(F.sum("InducedProduction").alias("i"))
    return induced.crossJoin(m.Y.cells.agg(F.sum("value").alias("d"))).select(F.round(F.col("i") / F.col("d"), 6).alias("ratio"))  # one row each


# Systems by group.
_register("mrio_aggregate_rows_T", _sql("SELECT row_Region, col_CountryCode, col_Region, col_Sector, round(sum(value), 2) AS value FROM long GROUP BY ALL"), lambda w: _long(w.system().aggregate("Region").T))
_register("mrio_aggregate_rows_A", _sql("SELECT r.Region AS row_Region, c.pos AS col_pos, round(sum(a.value), 6) AS value FROM a JOIN axis r ON r.pos = row_pos JOIN axis c ON c.pos = col_pos GROUP BY ALL"), lambda w: (lambda m: _r(m.A.cells.join(m.A.rows.select(F.col("pos").alias("row_pos"), F.col("Region").alias("row_Region")), "row_pos").select("row_Region", "col_pos", "value"), 6))(w.system().aggregate("Region")))
_register("mrio_aggregate_rows_X", _sql("SELECT Region, round(sum(x.value), 2) AS value FROM x JOIN axis USING (pos) GROUP BY Region"), lambda w: _out(w.system().aggregate("Region").X).drop("pos"))
_register("mrio_aggregate_cols_T", _sql("SELECT row_CountryCode, row_Region, row_Sector, col_Sector, round(sum(value), 2) AS value FROM long GROUP BY ALL"), lambda w: _long(w.system().aggregate(["Sector"], dims=2).T))
_register("mrio_aggregate_cols_VA", _sql("SELECT 'Quantity' AS row_PrimaryInput, Sector AS col_Sector, round(sum(f.value), 2) AS value FROM f JOIN axis USING (pos) WHERE Stressor = 'Quantity' GROUP BY ALL"), lambda w: _long(w.system().aggregate(["Sector"], dims=2).VA))
_register("mrio_aggregate_cols_env", _sql("SELECT Stressor AS row_Stressor, 'lineitem' AS row_Source, Sector AS col_Sector, round(sum(f.value) / sum(x.value), 6) AS value FROM f JOIN axis USING (pos) JOIN x USING (pos) GROUP BY ALL"), lambda w: _long(w.system().aggregate(["Sector"], dims=2).env.A, 6))
_register("mrio_filter_T", _sql(f"SELECT row_CountryCode, row_Region, row_Sector, col_CountryCode, col_Region, col_Sector, round(value, 2) AS value FROM long WHERE row_Region = 'ASIA'"), lambda w: _long(w.system().filter("Region = 'ASIA'").T))


# Supply and use: supply is Z by nation on the diagonal of types, use is Z itself.
def _supply_use(w: Flows) -> tuple[SupplyUse, DataFrame]:
    z = w.z()
    v = z.cells.where(F.pmod("row_pos", F.lit(w.k)) == F.pmod("col_pos", F.lit(w.k)))
    return SupplyUse(v, z.cells, w.y().cells, w.value_added().cells, w.axis.count(), 25, w.k), w.impacts().cells


_SUT = [
    "v AS (SELECT row_pos, col_pos, value FROM z CROSS JOIN k WHERE row_pos % k = col_pos % k)",
    "g AS (SELECT row_pos AS i, sum(value) AS s FROM v GROUP BY row_pos)",
    "share AS (SELECT row_pos, col_pos, value / s AS value FROM v JOIN g ON i = row_pos WHERE s <> 0)",
    "zz AS (SELECT u.row_pos, t.col_pos, sum(u.value * t.value) AS value FROM z u JOIN share t ON t.row_pos = u.col_pos WHERE u.value <> 0 AND t.value <> 0 GROUP BY ALL)",
]
_register("sut_to_io_Z", _sql("SELECT row_pos, col_pos, round(value, 2) AS value FROM zz", *_SUT), lambda w: _r(input_output(*_supply_use(w))["Z"]))
_register("sut_to_io_A", _sql("SELECT zz.row_pos, zz.col_pos, round(CASE WHEN x.value = 0 THEN 0 ELSE zz.value / x.value END, 6) AS value FROM zz JOIN x ON x.pos = zz.col_pos", *_SUT), lambda w: _r(input_output(*_supply_use(w))["A"], 6))
_register("sut_to_io_VA", _sql("SELECT 0 AS row_pos, share.col_pos, round(sum(f.value * share.value), 2) AS value FROM f JOIN share ON share.row_pos = f.pos WHERE Stressor = 'Quantity' AND share.value <> 0 GROUP BY ALL", *_SUT), lambda w: _r(input_output(*_supply_use(w))["VA"]))
_register("sut_to_io_Q", _sql("SELECT s AS row_pos, share.col_pos, round(sum(f.value * share.value), 2) AS value FROM f JOIN share ON share.row_pos = f.pos WHERE share.value <> 0 GROUP BY ALL", *_SUT), lambda w: _r(input_output(*_supply_use(w))["Q"]))

def _emptied(w: Flows) -> DataFrame:
    """Z without the flows from and to the nations at 3 and 7."""
    gone = lambda c: F.floor(F.col(c) / w.k).isin(3, 7)
    return w.z().cells.withColumn("value", F.when(gone("row_pos") | gone("col_pos"), 0.0).otherwise(F.col("value")))


_register(
    "empty_region_prune",
    _sql("SELECT pos FROM nations WHERE pos NOT IN (SELECT row_pos // k FROM e CROSS JOIN k GROUP BY row_pos, k HAVING sum(value) <> 0) AND pos NOT IN (SELECT col_pos // k FROM e CROSS JOIN k GROUP BY col_pos, k HAVING sum(value) <> 0)", "e AS (SELECT row_pos, col_pos, CASE WHEN row_pos // k IN (3, 7) OR col_pos // k IN (3, 7) THEN 0 ELSE value END AS value FROM z CROSS JOIN k)"),
    lambda w: empty_regions(_emptied(w), w.nations, w.k),
)


# What the verbs share with users of other front ends: one-sided masks, series, keys on the inverse, verbs by side.
def _mask(w: Flows, region: str) -> list[bool]:
    return [r["Region"] == region for r in w.axis.orderBy("pos").collect()]


_EVERY = slice(None)
_register("mask_rows", _sql(f"{_LONG} WHERE row_Region = 'ASIA'"), lambda w: _long(w.z()[_mask(w, "ASIA"), _EVERY]))
_register("mask_cols", _sql(f"{_LONG} WHERE col_Region = 'EUROPE'"), lambda w: _long(w.z()[_EVERY, _mask(w, "EUROPE")]))
_register("places_both", _sql("SELECT i.n AS row_n, j.n AS col_n, round(value, 2) AS value FROM z JOIN (VALUES (0, 4), (1, 0), (2, 0)) i(n, p) ON i.p = row_pos JOIN (VALUES (0, 7), (1, 2)) j(n, p) ON j.p = col_pos"), lambda w: _r(w.z()[[5, 1, 1], [8, 3]].cells.selectExpr("CAST(row_pos AS int) AS row_n", "CAST(col_pos AS int) AS col_n", "value")))
_SUMS = "s AS (SELECT pos, CountryCode, Region, Sector, sum(value) AS value FROM z JOIN axis ON pos = row_pos GROUP BY ALL)"
_S = "SELECT CountryCode, Region, Sector, round(value, 2) AS value FROM s"


def _series(w: Flows) -> LabeledSeries:
    return w.z().sum_rows()


def _tail(s: LabeledSeries) -> DataFrame:
    return _out(s).drop("pos")


_register("series_get", _sql(f"SELECT round(value, 2) AS value FROM s WHERE CountryCode = {_N(1)} AND Sector = {_T}", _SUMS), lambda w: w.spark.createDataFrame([(round(_series(w)[{"CountryCode": _nations(w)[1], "Region": w.nations.where("pos = 1").first()["Region"], "Sector": _first_type(w)}], 2),)], "value double"))
_register("series_mask", _sql(f"{_S} WHERE Region = 'AFRICA'", _SUMS), lambda w: _tail(_series(w)[_mask(w, "AFRICA")]))
_register("series_places", _sql("SELECT i.n AS pos, CountryCode, round(value, 2) AS value FROM s JOIN (VALUES (0, 8), (1, 3), (2, 3)) i(n, p) ON i.p = pos", _SUMS), lambda w: _out(_series(w)[_EVERY, [9, 4, 4]]).selectExpr("CAST(pos AS int) AS pos", "CountryCode", "value"))
_register("series_length", _sql("SELECT count(*) AS n FROM s", _SUMS), lambda w: w.spark.createDataFrame([(len(_series(w)),)], "n long"))
_register("series_filter", _sql(f"{_S} WHERE Region <> 'ASIA' AND Sector = {_T}", _SUMS), lambda w: _tail(_series(w).filter((F.col("Region") != "ASIA") & (F.col("Sector") == _first_type(w)))))
_register("series_mutate_select", _sql("SELECT upper(Sector) AS Loud, CountryCode AS Nation, round(value, 2) AS value FROM s", _SUMS), lambda w: _tail(_series(w).mutate(Loud="upper(Sector)").select("Loud", "CountryCode").rename(Nation="CountryCode")))
_register("series_relocate", _sql("SELECT Sector, CountryCode, Region, round(value, 2) AS value FROM s", _SUMS), lambda w: _tail(_series(w).relocate("Sector")))
_register("series_slice", _sql(f"{_S} WHERE pos IN (1, 2, 3)", _SUMS), lambda w: _tail(_series(w).slice([2, 3, 4])))
_register("series_update_indices", _sql("SELECT 'n' || CAST(pos AS VARCHAR) AS label, round(value, 2) AS value FROM s", _SUMS), lambda w: _tail(_series(w).update_indices(w.axis.select("pos", F.concat(F.lit("n"), F.col("pos").cast("string")).alias("label")))))
for _f, _s in (("sum", "sum"), ("std", "stddev_samp"), ("min", "min")):
    _register(f"series_aggregate_{_f}", _sql(f"SELECT Region, round({_s}(value), 2) AS value FROM s GROUP BY Region", _SUMS), lambda w, f=_f: _tail(_series(w).group_by("Region").aggregate(f)))
_register("aliases", _sql("SELECT 'Z' AS name, round(sum(value), 1) AS total FROM z UNION ALL SELECT 'Y', round(sum(value), 1) FROM y"), lambda w: (lambda m: m.Z.cells.agg(F.lit("Z").alias("name"), F.round(F.sum("value"), 1).alias("total")).unionByName(m.Y.cells.agg(F.lit("Y").alias("name"), F.round(F.sum("value"), 1).alias("total"))))(w.system()))
_UNIT = f"unit AS (SELECT 0 AS n, pos, CASE WHEN pos = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM axis)"
_INVERSE = [_UNIT, f"column_(n, pos, value) AS (SELECT n, pos, value FROM unit UNION ALL SELECT n + 1, a.row_pos, sum(a.value * s.value) FROM column_ s JOIN a ON a.col_pos = s.pos WHERE n < {STEPS} GROUP BY n + 1, a.row_pos)"]


def _key(w: Flows, pos: int) -> dict:
    row = w.axis.where(F.col("pos") == pos).first().asDict()
    row.pop("pos")
    return row


_register("inverse_column_by_key", _sql("SELECT CountryCode, Region, Sector, round(sum(value), 6) AS value FROM column_ JOIN axis USING (pos) GROUP BY ALL", *_INVERSE, recursive=True), lambda w: _out(w.system().L[_EVERY, _key(w, 2)], 6).drop("pos"))
_register("inverse_cell_by_key", _sql("SELECT round(sum(value), 6) AS value FROM column_ WHERE pos = 4", *_INVERSE, recursive=True), lambda w: w.spark.createDataFrame([(round(w.system().L[_key(w, 4), _key(w, 2)], 6),)], "value double"))
_register("filter_dims", _sql(f"{_LONG} WHERE col_Sector = {_T}"), lambda w: _long(w.z().filter(F.col("Sector") == _first_type(w), dims=2)))
_register("drop_in_place", _sql(f"{_LONG} WHERE row_Sector <> {_T}"), lambda w: _long(w.z().drop_mut({"Sector": _first_type(w)})))
_register("drop_nothing", _sql(_LONG), lambda w: _long(w.z().drop({"CountryCode": "NOWHERE"})))
_register("update_row_indices", _sql("SELECT 'r' || CAST(row_pos AS VARCHAR) AS row_label, c.CountryCode AS col_CountryCode, round(sum(value), 2) AS value FROM z JOIN axis c ON c.pos = col_pos GROUP BY ALL"), lambda w: _r(w.z().update_row_indices(w.axis.select("pos", F.concat(F.lit("r"), F.col("pos").cast("string")).alias("label"))).to_long().groupBy("row_label", "col_CountryCode").agg(F.sum("value").alias("value"))))
_register("update_col_indices", _sql("SELECT r.CountryCode AS row_CountryCode, CAST(col_pos % 4 AS INTEGER) AS col_four, round(sum(value), 2) AS value FROM z JOIN axis r ON r.pos = row_pos GROUP BY ALL"), lambda w: _r(w.z().update_col_indices(w.axis.select("pos", (F.col("pos") % 4).cast("int").alias("four"))).to_long().groupBy("row_CountryCode", "col_four").agg(F.sum("value").alias("value"))))
_register("mutate_cols", _sql("SELECT col_CountryCode || '-' || col_Sector AS col_Both, round(sum(value), 2) AS value FROM long GROUP BY ALL"), lambda w: _r(w.z().mutate_cols(Both="concat(CountryCode, '-', Sector)").groupby_matrix("Both", rows=False)))
_register("relocate_rows", _sql("SELECT row_Sector, row_CountryCode, row_Region, col_Region, round(sum(value), 2) AS value FROM long GROUP BY ALL"), lambda w: _r(w.z().relocate_rows("Sector").select_cols("Region").to_long().groupBy("row_Sector", "row_CountryCode", "row_Region", "col_Region").agg(F.sum("value").alias("value"))))
_register("summarise", _sql("SELECT row_Region, col_CountryCode, col_Region, col_Sector, round(stddev_samp(value), 2) AS value FROM long GROUP BY ALL"), lambda w: _long(w.z().group_by("Region").summarise("std")))
_register("aggregate_callable", _sql("SELECT row_Region, col_CountryCode, col_Region, col_Sector, round(max(value) - min(value), 2) AS value FROM long GROUP BY ALL"), lambda w: _long(w.z().group_by("Region").aggregate(lambda v: F.max(v) - F.min(v))))
_register("groupby_callable", _sql("SELECT row_Sector, round(sum(value * value) / 1e6, 1) AS value FROM long GROUP BY ALL"), lambda w: w.z().groupby_matrix("Sector", agg_func=lambda v: F.sum(v * v)).withColumn("value", F.round(F.col("value") / 1e6, 1)))
_register("pipe_and_arrange", _sql("SELECT row_CountryCode, col_CountryCode, round(sum(value), 2) AS value FROM long GROUP BY ALL ORDER BY sum(value) DESC, 1, 2 LIMIT 20"), lambda w: _r(w.z().pipe(lambda long: long.groupBy("row_CountryCode", "col_CountryCode").agg(F.sum("value").alias("value")).orderBy(F.desc("value"), "row_CountryCode", "col_CountryCode").limit(20))))
_register("shape", _sql("SELECT (SELECT count(*) FROM axis) AS n_rows, (SELECT count(*) FROM nations) AS n_cols, (SELECT count(*) FROM y) AS n_cells"), lambda w: (lambda m: w.spark.createDataFrame([(*m.shape, len(m))], "n_rows long, n_cols long, n_cells long"))(w.y()))
_register("head", _sql("SELECT row_CountryCode, row_Sector, col_CountryCode, col_Sector, round(value, 2) AS value FROM (SELECT r.CountryCode AS row_CountryCode, r.Sector AS row_Sector, c.CountryCode AS col_CountryCode, c.Sector AS col_Sector, value FROM z JOIN axis r ON r.pos = row_pos JOIN axis c ON c.pos = col_pos ORDER BY row_pos, col_pos LIMIT 6)"), lambda w: _r(w.z().head()).drop("row_Region", "col_Region"))
_register("create_from_arrays", "SELECT a // 3 AS row_n, a % 3 AS col_n, CAST(a * 1.5 AS DOUBLE) AS value FROM range(12) t(a)", lambda w: _created(w))
_register("from_long_last_wins", "SELECT * FROM (VALUES ('a', 'x', 3.0::DOUBLE), ('a', 'y', 0.0), ('b', 'x', 0.0), ('b', 'y', 1.0)) t(row_r, col_c, value)", lambda w: LabeledMatrix.from_long(w.spark.createDataFrame([(1, "b", "y", 9.0), (2, "a", "x", 7.0), (3, "b", "y", 1.0), (4, "a", "x", 3.0)], "t int, row_r string, col_c string, value double"), order="t").to_long())
_register("sizes_are_checked", "SELECT unnest(['key', 'mask', 'matrix', 'place', 'series']) AS name", lambda w: _checked(w))
_register("impact_of_arrays", _sql("SELECT Stressor AS row_Stressor, CAST(n AS INTEGER) AS col_Scenario, round(sum(fa.value * (n + fa.pos % 3)), 4) AS value FROM fa CROSS JOIN range(1, 3) t(n) GROUP BY ALL"), lambda w: _scenarios(w))
_register("sub_system_output", _sql("SELECT CountryCode, Region, Sector, round(sum(value), 2) AS value FROM (SELECT row_pos, value FROM z JOIN axis c ON c.pos = col_pos AND c.Region = 'ASIA' UNION ALL SELECT row_pos, y.value FROM y JOIN nations ON nations.pos = col_pos AND CountryCode = (SELECT CountryCode FROM nations WHERE pos = 1)) JOIN axis ON axis.pos = row_pos AND Region = 'ASIA' GROUP BY ALL"), lambda w: _tail(w.system().sub_system("Region = 'ASIA'", F.col("CountryCode") == _nations(w)[1]).X))
_register("system_filter_cols", _sql(f"{_LONG} WHERE col_Region = 'ASIA'"), lambda w: _long(w.system().filter(lambda r: r["Region"] == "ASIA", dims=2).T))
_register("system_filter_extension", _sql("SELECT row_CountryCode, row_Region, row_Sector, col_CountryCode, col_Region, col_Sector, round(value, 2) AS value FROM long WHERE row_Region = 'ASIA'"), lambda w: _long(w.system().filter("Region = 'ASIA'").env.F))
_register("product_axis", _sql("SELECT n.pos * 2 + i AS pos, CountryCode, Category FROM nations n CROSS JOIN (VALUES (0, 'a'), (1, 'b')) t(i, Category)"), lambda w: product_axis(w.nations, w.spark.createDataFrame([(0, "a"), (1, "b")], "pos long, Category string"), "Category"))


def _created(w: Flows) -> DataFrame:
    m = LabeledMatrix.create(w.spark, [[1.5 * (3 * i + j) for j in range(3)] for i in range(4)], {"n": [0, 1, 2]}, [{"n": i} for i in range(4)])
    return m.to_long()


def _checked(w: Flows) -> DataFrame:
    m, s = LabeledMatrix.create(w.spark, [[1, 2]], {"c": ["x", "y"]}, {"r": ["a"]}), LabeledSeries.create(w.spark, [1.0], {"r": ["a"]})
    tried = {
        "matrix": (DimensionError, lambda: LabeledMatrix.create(w.spark, [[1, 2]], {"c": ["x"]}, {"r": ["a"]})),
        "series": (DimensionError, lambda: LabeledSeries.create(w.spark, [1.0, 2.0], {"r": ["a"]})),
        "mask": (IndexError, lambda: m[[True, False], _EVERY]),
        "place": (IndexError, lambda: s[[2]]),
        "key": (IndexError, lambda: m[{"r": "b"}, _EVERY]),
    }
    raised = []
    for name, (error, f) in tried.items():
        try:
            f()
        except error:
            raised.append((name,))
    return w.spark.createDataFrame(raised, "name string")


def _scenarios(w: Flows) -> DataFrame:
    n = w.axis.count()
    wide = [[float(k + p % 3) for k in (1, 2)] for p in range(n)]
    return _long(w.system().environmental_impact(wide), 4).drop("row_Source").withColumn("col_Scenario", F.col("col_Scenario").cast("int"))
