import numpy as np
import pytest

from leontia import MRIO, DimensionError, EnvironmentalExtension, LabeledMatrix, LabeledSeries, LeontiefSystem
from leontia.plans.supply_use import SupplyUse, assemble
from leontia.operators.axis import numbered

AXIS = {"CountryCode": ["AUT", "DEU"], "Sector": ["A", "B"]}


@pytest.fixture(scope="module")
def small(spark):
    z = LabeledMatrix.create(spark, [[10, 2], [3, 8]], AXIS, AXIS)
    return MRIO.of(z, LabeledMatrix.create(spark, [[5], [7]], {"CountryCode": ["AUT"], "Category": ["C"]}, AXIS), LabeledMatrix.create(spark, [[4, 6]], AXIS, {"PrimaryInput": ["W"]}))


@pytest.mark.parametrize("method", ["dense", "neumann"])
def test_solve(spark, method):
    a = LabeledMatrix.create(spark, [[0.2, 0.1], [0.3, 0.2]], AXIS, AXIS)
    system = LeontiefSystem(a, method)
    assert np.allclose(system.solve([10.0, 20.0]).to_numpy(), [16.393442623, 31.147540984])
    both = system.solve(np.array([[10, 2], [20, 4]])).to_numpy()
    assert np.allclose(both, np.linalg.solve(np.eye(2) - [[0.2, 0.1], [0.3, 0.2]], [[10, 2], [20, 4]]))
    with pytest.raises(DimensionError):
        system.solve([1.0])
    with pytest.raises(TypeError):
        system.solve(["a", "b"])


def test_neumann_must_converge(spark):
    with pytest.raises(ValueError):
        LeontiefSystem(LabeledMatrix.create(spark, [[0, 9], [9, 0]], AXIS, AXIS), "neumann").solve([1.0, 1.0])


def test_small_system(small):
    assert small.X.to_numpy().tolist() == [17, 18] and small.Z is small.T and small.Y is small.FD
    assert np.allclose(small.L.data.to_numpy(), [[2.65625, 0.53125], [0.84375, 1.96875]])
    assert np.allclose(small.multipliers().to_numpy(), [3.5, 2.5]) and np.allclose(small.L.solve([10, 20]).to_numpy(), [37.1875, 47.8125])
    assert np.isclose(small.L[{"CountryCode": "AUT", "Sector": "A"}, {"CountryCode": "DEU", "Sector": "B"}], 0.53125)
    assert small.env.F is small.T and small.countries() == ["AUT", "DEU"] and small.sectors() == ["A", "B"] and small.stressors() == []
    got = {(r.CountryCode, r.Sector): r.InducedProduction for r in small.induced_production().collect()}
    assert np.isclose(got["AUT", "A"], 17) and np.isclose(got["DEU", "B"], 18)
    assert [r.CountryCode for r in small.induced_production("AUT", ["DEU"]).collect()] == ["DEU"]


def test_filtered_and_not_square(small):
    f = small.filter("CountryCode = 'AUT'")
    assert f.T.shape == (1, 2) and f.VA.shape == (1, 1) and f.FD.shape == (1, 1) and f.L is None and f.X.to_numpy().tolist() == [0]
    with pytest.raises(ValueError):
        f.induced_production()
    s = small.sub_system("Sector = 'B'")
    assert s.T.to_numpy().tolist() == [[8]] and s.X.to_numpy().tolist() == [15]


def test_zero_output_divides_as_one(spark):
    x = LabeledSeries.create(spark, [0.0, 10.0], AXIS)
    f = LabeledMatrix.create(spark, [[1, 2], [3, 4]], AXIS, {"Stressor": ["CO2", "Water"]})
    env = EnvironmentalExtension.of(f, x)
    assert env.A.to_numpy().tolist() == [[1, 0.2], [3, 0.4]] and env.stressors() == ["CO2", "Water"]


def test_impacts(spark):
    axis = {"CountryCode": ["USA", "CHN", "DEU"], "Sector": ["a", "b", "c"]}
    f = LabeledMatrix.create(spark, [[10, 20, 30], [40, 50, 60], [70, 80, 90]], axis, {"Stressor": ["CO2", "Water", "Land"], "Source": ["x", "y", "z"]})
    env = EnvironmentalExtension.of(f, LabeledSeries.create(spark, [100, 200, 300], axis))
    assert np.allclose(env.impact([100, 200, 300]).to_numpy(), [60, 150, 240]) and np.allclose(env.impact([10, 10, 10]).to_numpy(), [3, 8.5, 14])
    many = env.impact([[100, 0], [0, 200], [0, 0]])
    assert np.allclose(many.to_numpy(), [[10, 20], [40, 50], [70, 80]]) and [r.Scenario for r in many.cols.orderBy("pos").collect()] == [1, 2]
    labeled = env.impact(LabeledMatrix.create(spark, [[1], [1], [1]], {"Who": ["me"]}, axis))
    assert labeled.cols.first().Who == "me" and env.impact(LabeledSeries.create(spark, [0, 0, 0], axis)).to_numpy().tolist() == [0, 0, 0]
    with pytest.raises(DimensionError):
        env.impact([1, 2])


def test_aggregated_system(spark):
    axis = {"CountryCode": ["A", "A", "B", "B"], "Sector": ["x", "y", "x", "y"]}
    m = lambda d, c, r: LabeledMatrix.create(spark, d, c, r)
    t = m([[10, 1, 5, 1], [1, 15, 1, 4], [4, 2, 10, 3], [2, 3, 2, 18]], axis, axis)
    x = LabeledSeries.create(spark, [10, 20, 30, 40], axis)
    f = m([[1, 2, 3, 4], [5, 6, 7, 8]], axis, {"Stressor": ["CO2", "Water"]})
    fd = m([[5, 1], [3, 7], [1, 3], [3, 7]], {"CountryCode": ["A", "B"]}, axis)
    s = MRIO(t, t, m([[1, 3, 2, 4], [1, 1, 2, 2]], axis, {"PrimaryInput": ["p", "q"]}), fd, None, x, EnvironmentalExtension.of(f, x))
    r = s.aggregate("Sector")
    assert r.T.to_numpy().tolist() == [[14, 3, 15, 4], [3, 18, 3, 22]] and r.X.to_numpy().tolist() == [40, 60] and r.L is None
    assert np.allclose(r.A.to_numpy(), [[1.4, 0.15, 0.5, 0.1], [0.3, 0.9, 0.1, 0.55]]) and r.VA.to_numpy().tolist() == [[3, 7], [3, 3]]
    assert r.FD.to_numpy().tolist() == [[6, 4], [6, 14]] and r.env.F is f and np.allclose(r.env.A.to_numpy(), [[0.1, 0.1, 0.1, 0.1], [0.5, 0.3, 7 / 30, 0.2]])
    c = s.aggregate(["CountryCode"], dims=2)
    assert c.T.to_numpy().tolist() == [[11, 6], [16, 5], [6, 13], [5, 20]] and c.env.F.to_numpy().tolist() == [[3, 7], [11, 15]]
    assert np.allclose(c.env.A.to_numpy(), [[0.1, 0.1], [11 / 30, 15 / 70]]) and c.X.to_numpy().tolist() == [10, 20, 30, 40] and c.FD.shape == (4, 2)


def cells(spark, a):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(np.asarray(a, float))], "row_pos long, col_pos long, value double")


def test_supply_use(spark):
    sut = SupplyUse(cells(spark, np.diag([1, 2, 3, 4])), cells(spark, np.eye(4) / 2), cells(spark, np.eye(4)), cells(spark, 2 * np.eye(4)), 4, 2, 2)
    names = lambda n, v: numbered(spark, [{n: x} for x in v])
    m = assemble(sut, cells(spark, [[10, 20, 30, 40], [1, 2, 3, 4]]), names("CountryCode", ["A", "B"]), names("Sector", ["s", "t"]), numbered(spark, [{"CountryCode": c, "Category": k} for c in "AB" for k in "vw"]), names("Category", ["c", "d"]), names("Stressor", ["CO2", "H2O"]))
    assert np.allclose(m.T.to_numpy(), np.eye(4) / 2) and np.allclose(m.A.to_numpy(), np.eye(4) / 3) and np.allclose(m.X.to_numpy(), 1.5)
    assert np.allclose(m.L.data.to_numpy(), 1.5 * np.eye(4)) and np.allclose(m.env.A.to_numpy(), [[20 / 3, 40 / 3, 20, 80 / 3], [2 / 3, 4 / 3, 2, 8 / 3]])
    assert np.allclose(m.VA.to_numpy(), 2 * np.eye(4)) and m.FD.shape == (4, 4)
    dead = SupplyUse(cells(spark, np.diag([1, 2, 0, 0])), cells(spark, np.diag([0.5, 0.5, 0, 0])), cells(spark, np.eye(4)), cells(spark, np.eye(4)), 4, 2, 2)
    p = assemble(dead, cells(spark, [[1, 2, 3, 4]]), names("CountryCode", ["A", "B"]), names("Sector", ["s", "t"]), numbered(spark, [{"CountryCode": c, "Category": k} for c in "AB" for k in "vw"]), names("Category", ["c", "d"]), names("Stressor", ["CO2"]))
    assert p.T.shape == (2, 2) and p.countries() == ["A"] and p.VA.shape == (2, 2) and p.FD.shape == (2, 2)
