import numpy as np
import pytest
from pyspark.sql import functions as F

from leontia import DimensionError, LabeledMatrix, LabeledSeries
from leontia.functions.aggregates import resolve


def grid(n, m, step=1):
    return np.arange(1, n * m + 1, dtype=float).reshape(n, m) * step


@pytest.fixture(scope="module")
def trade(spark):
    """4 x 4, two countries by two sectors on both axes."""
    axis = {"Country": ["USA", "USA", "CHN", "CHN"], "Sector": ["Agriculture", "Manufacturing"] * 2}
    return LabeledMatrix.create(spark, grid(4, 4), axis, axis)


@pytest.fixture(scope="module")
def rich(spark):
    """4 x 3 with labels of several types."""
    rows = {"Country": ["USA", "CHN", "DEU", "JPN"], "Region": ["America", "Asia", "Europe", "Asia"], "GDP": [21, 14, 4, None], "Developed": [True, False, True, True]}
    return LabeledMatrix.create(spark, grid(4, 3), {"Sector": ["Agr", "Man", "Ser"], "Type": ["Primary", "Secondary", "Tertiary"]}, rows)


def keys(n, c):
    return [{"Country": a, "Sector": b} for a, b in zip(n, c)]


def test_sizes_must_fit(spark):
    with pytest.raises(DimensionError):
        LabeledMatrix.create(spark, grid(2, 2), {"a": [1]}, {"b": [1, 2]})
    with pytest.raises(DimensionError):
        LabeledSeries.create(spark, [1.0], {"a": [1, 2]})


def test_cells_and_series_by_key(spark):
    rows, cols = {"Country": ["USA", "CHN", "DEU"], "Sector": ["Agr", "Man", "Ser"]}, {"Country": ["USA", "CHN"], "Sector": ["Agr", "Man"]}
    m = LabeledMatrix.create(spark, grid(3, 2), cols, rows)
    usa, chn, deu = keys(["USA", "CHN", "DEU"], ["Agr", "Man", "Ser"])
    assert (m[usa, usa], m[chn, chn], m[deu, chn]) == (1, 4, 6)
    with pytest.raises(IndexError):
        m[deu, deu]
    with pytest.raises(IndexError):
        m[{"Country": "FRA"}, :]
    assert m[{"Country": "DEU"}, :].to_numpy().tolist() == [5, 6]
    assert m[:, {"Sector": "Man"}].to_numpy().tolist() == [2, 4, 6]
    assert m[[{"Country": "DEU"}, {"Sector": "Agr"}], :].to_numpy().tolist() == [[1, 2], [5, 6]]


def test_partial_keys_masks_places(trade):
    assert trade[{"Country": "CHN"}, :].to_numpy().tolist() == grid(4, 4)[2:].tolist()
    assert trade[:, [{"Sector": "Agriculture"}]].to_numpy().tolist() == grid(4, 4)[:, ::2].tolist()
    assert trade[[True, False, False, True], [False, True, True, False]].to_numpy().tolist() == [[2, 3], [14, 15]]
    assert trade[[4, 1, 1], :].to_numpy().tolist() == grid(4, 4)[[3, 0, 0]].tolist()
    assert trade[[2], [3, 1]].to_numpy().tolist() == [[7, 5]]
    assert trade[[True, False, False, False], :].shape == (1, 4)
    for bad in ([True], [0], [5]):
        with pytest.raises(IndexError):
            trade[bad, :]


def test_repeated_keys_find_the_last(spark):
    axis = {"Country": ["A", "A", "B"]}
    m = LabeledMatrix.create(spark, grid(3, 3), axis, axis)
    assert m[{"Country": "A"}, {"Country": "A"}] == 5
    assert m[{"Country": "A"}, :].to_numpy().tolist() == [4, 5, 6]
    assert m.drop({"Country": "A"}).to_numpy().tolist() == [[1, 2, 3], [7, 8, 9]]
    assert m.filter_rows("Country = 'A'").shape == (2, 3)


def test_filters(rich):
    asia = rich.filter_rows(lambda r: r["Region"] == "Asia")
    assert asia.to_numpy().tolist() == [[4, 5, 6], [10, 11, 12]] and asia.countries() == ["CHN", "JPN"]
    assert rich.filter_rows("Region = 'None'").shape == (0, 3)
    assert rich.filter_matrix(F.col("Developed"), "Type IN ('Primary', 'Tertiary')").to_numpy().tolist() == [[1, 3], [7, 9], [10, 12]]
    assert rich.filter("GDP > 5").shape == (2, 3) and rich.filter("Type = 'Primary'", dims=2).shape == (4, 1)
    assert rich.filter_rows("GDP IS NULL").to_numpy().tolist() == [[10, 11, 12]]
    with pytest.raises(IndexError):
        rich.filter("true", dims=3)


def test_drop(rich):
    assert rich.drop({"Country": "CHN"}).to_numpy().tolist() == grid(4, 3)[[0, 2, 3]].tolist()
    assert rich.drop([{"Sector": "Agr"}, {"Type": "Tertiary"}], dims=2).to_numpy().tolist() == grid(4, 3)[:, [1]].tolist()
    assert rich.drop({"Country": "XXX"}).shape == (4, 3)
    assert rich.drop({"GDP": None}).shape == (3, 3)
    m = rich.select_rows("Country")
    assert m.drop_mut({"Country": "USA"}) is m and m.shape == (3, 3)


def test_labels(rich):
    m = rich.mutate_rows(low=F.lower("Country"), big=lambda r: (r["GDP"] or 0) > 10).rename_cols(Kind="Type").relocate_rows("low")
    assert m.rows.columns[:2] == ["pos", "low"] and m.cols.columns == ["pos", "Sector", "Kind"]
    assert [r.big for r in m.rows.orderBy("pos").collect()] == [True, True, False, False]
    assert m.select_rows("Region").shape == (4, 3) and m.add_calculated_column("x", "upper(Sector)", to_rows=False).cols.columns[-1] == "x"
    assert rich.slice_rows([1, 2]).countries() == ["USA", "CHN"] and rich.slice_cols([2, 3]).sectors() == ["Man", "Ser"]
    assert rich.update_row_indices(rich.rows.select("pos", "Region")).cells is rich.cells


def test_group_and_aggregate(trade):
    rows = trade.group_by("Country").aggregate()
    assert rows.to_numpy().tolist() == [[6, 8, 10, 12], [22, 24, 26, 28]] and rows.countries()[0] == "USA"
    assert trade.group_by(["Sector"], dims=2).aggregate("Sum").to_numpy().tolist() == [[4, 6], [12, 14], [20, 22], [28, 30]]
    assert trade.group_by("Country").aggregate(F.max).to_numpy().tolist() == [[5, 6, 7, 8], [13, 14, 15, 16]]
    with pytest.raises(ValueError):
        trade.group_by("Country", dims=0)
    with pytest.raises(ValueError):
        trade.group_by("Country").aggregate("nonsense")
    got = {r.row_Country: r.value for r in trade.groupby_matrix("Country", agg_func="median").collect()}
    assert got == {"USA": 4.5, "CHN": 12.5}


def test_aggregate_names_and_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", float("nan")), ("b", 5.0)], "k string, v double")
    out = {r.k: r for r in df.groupBy("k").agg(*[resolve(n)(F.col("v")).alias(n.replace(".", "_")) for n in ("min", "MAX", "base.minimum", "std", "Statistics.var", "sum")]).collect()}
    assert np.isnan(out["a"]["min"]) and np.isnan(out["a"]["MAX"]) and out["b"]["base_minimum"] == 5
    assert np.isnan(out["b"]["std"]) and np.isnan(out["b"]["Statistics_var"]) and out["b"]["sum"] == 5
    assert df.where("false").agg(resolve("sum")(F.col("v")).alias("s")).first().s == 0
    with pytest.raises(ValueError):
        resolve("base.min")


def test_summaries(spark):
    m = LabeledMatrix.create(spark, [[1, 0, 3], [0, 5, 6], [7, 8, 0]], {"Sector": ["X", "Y", "Z"]}, {"Country": ["A", "B", "C"]})
    s = m.matrix_summary().first()
    assert (s.total, s.min_val, s.max_val, s.n_nonzero, s.n_total, s["median"]) == (30, 0, 8, 6, 9, 3)
    assert abs(s["mean"] - 30 / 9) < 1e-12 and abs(s["std"] - 3.24037034920393) < 1e-12
    codes = {"CountryCode": ["USA", "CHN", "DEU"], "Sector": ["a", "b", "a"]}
    b = LabeledMatrix.create(spark, [[10, 5, 8], [12, 15, 20], [3, 7, 25]], codes, codes)
    rows = b.country_summary().collect()
    assert len(rows) == 9 and (rows[0].row_CountryCode, rows[0].col_CountryCode, rows[0].total_flow, rows[0].n_sectors) == ("DEU", "DEU", 25, 1)
    assert {r.row_CountryCode: r.value for r in b.sum_by_country("rows").collect()} == {"USA": 23, "CHN": 47, "DEU": 35}
    assert {r.col_Sector: r.value for r in b.sum_by_sector("cols").collect()} == {"a": 78, "b": 27} and b.sum_by_country("anything").count() == 9
    assert b.sum_rows().to_numpy().tolist() == [23, 47, 35] and b.sum_cols().to_numpy().tolist() == [25, 27, 53]
    assert b.filter_cols("false").sum_rows().to_numpy().tolist() == [0, 0, 0]


def test_long_and_pivot(rich, trade):
    long = rich.to_long("v")
    assert long.columns == ["row_Country", "row_Region", "row_GDP", "row_Developed", "col_Sector", "col_Type", "v"] and long.count() == 12
    back = LabeledMatrix.from_long(long, value_col="v")
    assert back.to_long("v").exceptAll(long).isEmpty()
    wide = rich.pivot_wide(["row_Country"], "col_Sector")
    assert wide.where("row_Country = 'USA'").first().asDict() == {"row_Country": "USA", "Agr": 1, "Man": 2, "Ser": 3}
    with pytest.raises(ValueError):
        trade.pivot_wide("row_Country", "col_Country")
    assert trade.pivot_wide("row_Country", "col_Country", agg="sum").where("row_Country = 'CHN'").first()["USA"] == 46
    assert rich.pipe(lambda df: df.count()) == 12


def test_from_long_fills_and_takes_the_last(spark):
    df = spark.createDataFrame([(1, "b", "x", 1.0), (2, "a", "y", 2.0), (3, "b", "x", 9.0), (4, None, "x", 4.0)], "i int, row_r string, col_c string, value double")
    m = LabeledMatrix.from_long(df, order="i")
    assert m.to_numpy().tolist() == [[9, 0], [0, 2], [4, 0]] and [r.r for r in m.rows.orderBy("pos").collect()] == ["b", "a", None]


def test_series(spark):
    s = LabeledSeries.create(spark, [100, 200, 150, 300], {"Country": ["USA", "CHN", "DEU", "USA"], "Sector": list("abcd"), "GDP": [1.0, 2.0, None, 4.0]})
    assert len(s) == 4 and s[{"Country": "CHN", "Sector": "b", "GDP": 2.0}] == 200
    assert s[[True, False, False, True]].to_numpy().tolist() == [100, 300] and s[[3, 1]].to_numpy().tolist() == [150, 100]
    assert s.filter("GDP IS NULL").to_numpy().tolist() == [150] and s.slice([2]).to_numpy().tolist() == [200]
    g = s.group_by("Country").aggregate("sum")
    assert g.to_numpy().tolist() == [400, 200, 150] and s.mutate(z="upper(Sector)").rename(y="z").relocate("y").axis.columns[1] == "y"
    empty = LabeledSeries.create(spark, [], {"Country": []})
    assert len(empty) == 0
    with pytest.raises(IndexError):
        s[{"Country": "XXX", "Sector": "b", "GDP": 2.0}]
