"""The MRIO system: transactions, final demand, value added and extensions, and what is derived from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leontia.model import DimensionError, LabeledMatrix, LabeledSeries
from leontia.operators import axis as ax
from leontia.plans.algebra import LeontiefSystem, per_output, technical_coefficients, total_output

__all__ = ["MRIO", "EnvironmentalExtension", "LeontiefSystem"]


def _among(axis: DataFrame, kept: DataFrame) -> DataFrame:
    """The axis at the positions of ``kept``, renumbered."""
    return ax.renumbered(axis.join(kept, "pos", "left_semi"))


@dataclass
class EnvironmentalExtension:
    """Direct impacts F (stressor x sector) and intensities A = F / output; positional order F, A."""

    F: LabeledMatrix
    A: LabeledMatrix

    @classmethod
    def of(cls, f: LabeledMatrix, x: LabeledSeries) -> EnvironmentalExtension:
        return cls(f, LabeledMatrix(per_output(f.cells, x.df), f.cols, f.rows))

    def countries(self) -> list[Any]:
        return self.F.countries()

    def sectors(self) -> list[Any]:
        return self.F.sectors()

    def stressors(self) -> list[Any]:
        return [r[0] for r in self.F.rows.groupBy("Stressor").agg(F.min("pos").alias("p")).orderBy("p").collect()] if "Stressor" in self.F.rows.columns else []

    country, sector, stressor = countries, sectors, stressors

    def impact(self, production: LabeledSeries | LabeledMatrix | Sequence | np.ndarray) -> LabeledSeries | LabeledMatrix:
        """A p: a vector gives a series over stressors, an array of scenarios columns ``Scenario`` 1..n, a labeled matrix its own columns."""
        n, spark = self.A.cols.count(), self.A.spark
        single = False
        if isinstance(production, LabeledSeries):
            given, single = len(production), True
            cells = production.df.select(F.col("pos").alias("col_pos"), F.lit(0).cast("long").alias("scenario"), F.col("value").alias("p"))
            cols = None
        elif isinstance(production, LabeledMatrix):
            given, cols = production.rows.count(), production.cols
            cells = production.cells.select(F.col("row_pos").alias("col_pos"), F.col("col_pos").alias("scenario"), F.col("value").alias("p"))
        else:
            values = np.asarray(production, float)
            given, single = len(values), values.ndim == 1
            wide = values[:, None] if single else values
            cells = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(wide)], "col_pos long, scenario long, p double")
            cols = None if single else ax.numbered(spark, [{"Scenario": k + 1} for k in range(wide.shape[1])])
        if given != n:
            raise DimensionError(f"{n} sectors, a production of {given}")
        sums = self.A.cells.join(cells, "col_pos").groupBy("row_pos", "scenario").agg(F.sum(F.col("value") * F.col("p")).alias("value"))
        if single:
            return LabeledSeries(self.A.rows.join(sums.select(F.col("row_pos").alias("pos"), "value"), "pos"))
        return LabeledMatrix(sums.select("row_pos", F.col("scenario").alias("col_pos"), "value"), cols, self.A.rows)


class MRIO:
    """T (also Z), FD (also Y), VA, output X, coefficients A, Leontief system L, extension env."""

    def __init__(self, A: LabeledMatrix, T: LabeledMatrix, VA: LabeledMatrix, FD: LabeledMatrix, L: LeontiefSystem | None, X: LabeledSeries, env: EnvironmentalExtension):
        self.A, self.T, self.VA, self.FD, self.L, self.X, self.env = A, T, VA, FD, L, X, env

    @classmethod
    def of(cls, Z: LabeledMatrix, Y: LabeledMatrix, VA: LabeledMatrix, env: EnvironmentalExtension | None = None, impacts: LabeledMatrix | None = None) -> MRIO:
        """From the three tables.  Without an extension, env is (Z, A); a Z that is not square has no output and no solution."""
        if Z.rows.count() != Z.cols.count():
            zero = LabeledSeries(Z.rows.withColumn("value", F.lit(0.0)))
            return cls(Z, Z, VA, Y, None, zero, env or EnvironmentalExtension(Z, Z))
        x = total_output(Z, Y)
        a = technical_coefficients(Z, x)
        env = env or (EnvironmentalExtension.of(impacts, x) if impacts is not None else EnvironmentalExtension(Z, a))
        return cls(a, Z, VA, Y, LeontiefSystem(a), x, env)

    @property
    def Z(self) -> LabeledMatrix:
        return self.T

    @property
    def Y(self) -> LabeledMatrix:
        return self.FD

    def countries(self) -> list[Any]:
        return self.T.countries()

    def sectors(self) -> list[Any]:
        return self.T.sectors()

    def stressors(self) -> list[Any]:
        return self.env.stressors()

    country, sector, stressor = countries, sectors, stressors

    def __repr__(self) -> str:
        return f"MRIO({self.T!r})"

    def filter(self, predicate: ax.Predicate, dims: int = 1) -> MRIO:
        """By labels of Z: rows of Z and Y and columns of VA (dims 1), or columns of Z and VA (dims 2).  The extension is replaced by (Z, A)."""
        kept = ax.by_predicate(self.T.rows if dims == 1 else self.T.cols, predicate).select("pos")
        if dims == 1:
            return MRIO.of(self.T._rows_at(_among(self.T.rows, kept)), self.FD._rows_at(_among(self.FD.rows, kept)), self.VA._cols_at(_among(self.VA.cols, kept)))
        return MRIO.of(self.T._cols_at(_among(self.T.cols, kept)), self.FD, self.VA._cols_at(_among(self.VA.cols, kept)))

    def sub_system(self, predicate: ax.Predicate, demand: ax.Predicate | None = None) -> MRIO:
        """Sectors that a predicate keeps, on both axes, with their demand (columns by ``demand``), value added and impacts."""
        kept = ax.by_predicate(self.T.rows, predicate).select("pos")
        z = self.T._rows_at(_among(self.T.rows, kept))._cols_at(_among(self.T.cols, kept))
        y, va, f = self.FD._rows_at(_among(self.FD.rows, kept)), self.VA._cols_at(_among(self.VA.cols, kept)), self.env.F._cols_at(_among(self.env.F.cols, kept))
        return MRIO.of(z, y if demand is None else y.filter_cols(demand), va, impacts=f)

    def aggregate(self, columns: str | Sequence[str], dims: int = 1, agg_func: str | Callable = "sum") -> MRIO:
        """dims 1 groups the rows of Z and Y, the columns of VA, and X; dims 2 the columns of Z, VA and env.F, and of Y where it has the labels.  Coefficients are made anew."""
        columns = [columns] if isinstance(columns, str) else list(columns)
        if dims not in (1, 2):
            raise ValueError("dims is 1 for rows or 2 for columns")
        z = self.T.group_by(columns, dims).aggregate(agg_func)
        va = self.VA.group_by(columns, 2).aggregate(agg_func)
        x = self.X.group_by(*columns).aggregate(agg_func)
        if dims == 1:
            fd, out, f, divisor = self.FD.group_by(columns, 1).aggregate(agg_func), x, self.env.F, self.X
        else:
            fd = self.FD.group_by(columns, 2).aggregate(agg_func) if set(columns) <= set(self.FD.cols.columns) else self.FD
            out, f, divisor = self.X, self.env.F.group_by(columns, 2).aggregate(agg_func), x
        a = LabeledMatrix(per_output(z.cells, divisor.df), z.cols, z.rows)
        square = z.rows.count() == z.cols.count()
        return MRIO(a, z, va, fd, LeontiefSystem(a) if square else None, out, EnvironmentalExtension.of(f, divisor))

    def environmental_impact(self, production: Any) -> LabeledSeries | LabeledMatrix:
        return self.env.impact(production)

    def induced_production(self, consumer_countries: str | Sequence[str] = (), producer_countries: str | Sequence[str] = ()) -> DataFrame:
        """CountryCode, Sector, InducedProduction: the output that the final demand of consumers calls for, at the producers (none given: all)."""
        if self.L is None:
            raise ValueError("a system that is not square has no solution")
        consumers, producers = ([c] if isinstance(c, str) else list(c) for c in (consumer_countries, producer_countries))
        demand = self.FD.filter_cols(F.col("CountryCode").isin(consumers)) if consumers else self.FD
        out = self.L.solve(demand.sum_rows()).df
        if producers:
            out = out.where(F.col("CountryCode").isin(producers))
        return out.select("CountryCode", "Sector", F.col("value").alias("InducedProduction"))

    def multipliers(self) -> LabeledSeries:
        """Output multipliers: the column sums of the inverse."""
        return self.L.data.sum_cols()
