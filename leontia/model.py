"""Labeled matrices and series as DataFrames.

A matrix is three DataFrames: dense ``cells`` (row_pos, col_pos, value) and two axes (pos, labels...).
Every verb is a plan over these; labels are joined to cells last, where a result needs them.  Zeros are
cells and count as such.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leontia.functions.aggregates import resolve
from leontia.operators import axis as ax

ALL = slice(None)


class DimensionError(ValueError):
    """Sizes that do not fit each other."""


def _is_mask(x: Any) -> bool:
    return isinstance(x, (list, tuple, np.ndarray)) and len(x) > 0 and all(isinstance(v, (bool, np.bool_)) for v in x)


def _is_places(x: Any) -> bool:
    return isinstance(x, (list, tuple, range, np.ndarray)) and all(isinstance(v, (int, np.integer)) and not isinstance(v, bool) for v in x)


class LabeledSeries:
    """A vector with labels: ``df`` has pos, labels... and value."""

    def __init__(self, df: DataFrame):
        self.df = df.withColumns({"pos": F.col("pos").cast("long"), "value": F.col("value").cast("double")})

    @classmethod
    def create(cls, spark: SparkSession, data: Sequence[float], cols: Any) -> LabeledSeries:
        axis = ax.numbered(spark, cols)
        data = [float(v) for v in data]
        if axis.count() != len(data):
            raise DimensionError(f"{len(data)} values, {axis.count()} labels")
        return cls(axis.join(spark.createDataFrame(list(enumerate(data)), "pos long, value double"), "pos"))

    @property
    def axis(self) -> DataFrame:
        return self.df.drop("value")

    def __len__(self) -> int:
        return self.df.count()

    def __repr__(self) -> str:
        return f"LabeledSeries({', '.join(ax.labels(self.axis))})"

    def to_numpy(self) -> np.ndarray:
        return np.array([r["value"] for r in self.df.orderBy("pos").select("value").collect()], float)

    def to_df(self) -> DataFrame:
        return self.df.drop("pos")

    def _with(self, axis: DataFrame) -> LabeledSeries:
        """The values at an axis that has ``old`` beside ``pos``."""
        return LabeledSeries(axis.join(self.df.select(F.col("pos").alias("old"), "value"), "old").drop("old"))

    def __getitem__(self, key: Any) -> Any:
        if isinstance(key, tuple) and len(key) == 2 and key[0] == ALL:
            key = key[1]
        if isinstance(key, dict):
            if set(key) != set(ax.labels(self.axis)):
                raise IndexError("a value is looked up by its full key")
            hit = ax.by_keys(self.axis, [key]).join(self.df.select("pos", "value"), "pos").first()
            if hit is None:
                raise IndexError(f"no value at {key}")
            return hit["value"]
        n = len(self)
        if _is_mask(key):
            if len(key) != n:
                raise IndexError(f"a mask of {len(key)} for {n} values")
            return self._with(ax.renumbered(ax.by_mask(self.axis, key)))
        if _is_places(key):
            if any(not 1 <= k <= n for k in key):
                raise IndexError("a place is outside the series")
            return self._with(ax.by_places(self.axis, key))
        raise TypeError("a series takes a key, a mask or places")

    def filter(self, predicate: ax.Predicate) -> LabeledSeries:
        return self._with(ax.renumbered(ax.by_predicate(self.axis, predicate)))

    def mutate(self, **columns: Any) -> LabeledSeries:
        axis = self.axis
        for name, f in columns.items():
            axis = ax.evaluated(axis, name, f)
        return self.update_indices(axis)

    def select(self, *columns: str) -> LabeledSeries:
        return LabeledSeries(self.df.select("pos", *columns, "value"))

    def rename(self, **new_old: str) -> LabeledSeries:
        return LabeledSeries(self.df.withColumnsRenamed({old: new for new, old in new_old.items()}))

    def relocate(self, *columns: str) -> LabeledSeries:
        rest = [c for c in ax.labels(self.axis) if c not in columns]
        return self.select(*columns, *rest)

    def slice(self, places: Sequence[int]) -> LabeledSeries:
        return self[list(places)]

    def update_indices(self, axis: DataFrame) -> LabeledSeries:
        return LabeledSeries(axis.join(self.df.select("pos", "value"), "pos"))

    def group_by(self, *columns: str) -> GroupedSeries:
        return GroupedSeries(self, list(columns))


class GroupedSeries:
    def __init__(self, series: LabeledSeries, columns: list[str]):
        self.series, self.columns = series, columns

    def aggregate(self, func: str | Callable[[Column], Column] = "sum") -> LabeledSeries:
        new, members = ax.grouped(self.series.axis, self.columns)
        values = self.series.df.select(F.col("pos").alias("old"), "value").join(members, "old")
        return LabeledSeries(new.join(values.groupBy("pos").agg(resolve(func)(F.col("value")).alias("value")), "pos"))


class LabeledMatrix:
    """A dense matrix with labels on rows and columns.  Arguments run columns before rows."""

    def __init__(self, cells: DataFrame, cols: DataFrame, rows: DataFrame):
        self.cells, self.cols, self.rows = cells, cols, rows
        self.spark = cells.sparkSession

    @classmethod
    def create(cls, spark: SparkSession, data: Any, cols: Any, rows: Any) -> LabeledMatrix:
        """From a driver-side array (or a DataFrame of cells), column labels and row labels."""
        cols, rows = ax.numbered(spark, cols), ax.numbered(spark, rows)
        if isinstance(data, DataFrame):
            return cls(data.select(F.col("row_pos").cast("long"), F.col("col_pos").cast("long"), F.col("value").cast("double")), cols, rows)
        data = np.asarray(data, float)
        shape = (rows.count(), cols.count())
        if data.ndim != 2 or data.shape != shape:
            raise DimensionError(f"data of shape {data.shape}, labels for {shape}")
        row, col = (x.ravel().astype(np.int64) for x in np.indices(shape))
        return cls(spark.createDataFrame(pa.table({"row_pos": row, "col_pos": col, "value": data.ravel()})), cols, rows)

    # ---- out of the model

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows.count(), self.cols.count()

    def __len__(self) -> int:
        n, m = self.shape
        return n * m

    def head(self, n: int = 6) -> DataFrame:
        """The long form of the first ``n`` cells, row by row."""
        first = self.cells.orderBy("row_pos", "col_pos").limit(n)
        return LabeledMatrix(first, self.cols, self.rows).to_long()

    def __dir__(self) -> list[str]:
        return sorted({*super().__dir__(), "cells", "cols", "rows"})

    def __repr__(self) -> str:
        return f"LabeledMatrix(rows: {', '.join(ax.labels(self.rows))}; columns: {', '.join(ax.labels(self.cols))})"

    def to_numpy(self) -> np.ndarray:
        out = np.zeros(self.shape)
        found = self.cells.toPandas()
        out[found["row_pos"], found["col_pos"]] = found["value"]
        return out

    def to_long(self, value_name: str = "value") -> DataFrame:
        """One row a cell: row_<label>..., col_<label>..., value."""
        rows = self.rows.select(F.col("pos").alias("row_pos"), *[F.col(c).alias(f"row_{c}") for c in ax.labels(self.rows)])
        cols = self.cols.select(F.col("pos").alias("col_pos"), *[F.col(c).alias(f"col_{c}") for c in ax.labels(self.cols)])
        named = [c for c in (*rows.columns, *cols.columns) if c not in ("row_pos", "col_pos")]
        return self.cells.join(rows, "row_pos").join(cols, "col_pos").select(*named, F.col("value").alias(value_name))

    to_df = to_long

    def pipe(self, f: Callable[[DataFrame], Any]) -> Any:
        return f(self.to_long())

    @classmethod
    def from_long(cls, df: DataFrame, value_col: str = "value", row_prefix: str = "row_", col_prefix: str = "col_", order: str | None = None) -> LabeledMatrix:
        """Axes are the distinct labels in order of first appearance; absent pairs are 0, of repeated pairs the last counts.

        Order is that of the column ``order``, else that in which Spark reads the rows, which only a table in files has.
        """
        row_of = {c: c.removeprefix(row_prefix) for c in df.columns if c.startswith(row_prefix)}
        col_of = {c: c.removeprefix(col_prefix) for c in df.columns if c.startswith(col_prefix)}
        if not row_of or not col_of or value_col not in df.columns:
            raise ValueError("the table lacks row, column or value columns")

        if order is None:
            order = next(n for n in map("seq{}".format, range(len(df.columns) + 1)) if n not in df.columns)
            df = df.withColumn(order, F.monotonically_increasing_id())

        def axis(names: dict[str, str]) -> DataFrame:
            first = df.groupBy(*names).agg(F.min(order).alias("first"))
            return ax.renumbered(first.withColumn("pos", F.lit(0)), "first").select("pos", *[F.col(k).alias(v) for k, v in names.items()])

        rows, cols = axis(row_of), axis(col_of)
        same = lambda a, names: [F.col(f"d.{k}").eqNullSafe(F.col(f"{a}.{v}")) for k, v in names.items()]
        last = F.max_by(F.col(f"d.{value_col}"), F.col(f"d.{order}"))
        placed = df.alias("d").join(rows.alias("r"), same("r", row_of)).join(cols.alias("c"), same("c", col_of))
        placed = placed.groupBy(F.col("r.pos").alias("row_pos"), F.col("c.pos").alias("col_pos")).agg(last.cast("double").alias("value"))
        return cls(densify(placed, rows, cols), cols, rows)

    # ---- selection

    def _rows_at(self, axis: DataFrame) -> LabeledMatrix:
        moved = self.cells.join(axis.select(F.col("old").alias("row_pos"), "pos"), "row_pos").select(F.col("pos").alias("row_pos"), "col_pos", "value")
        return LabeledMatrix(moved, self.cols, axis.drop("old"))

    def _cols_at(self, axis: DataFrame) -> LabeledMatrix:
        moved = self.cells.join(axis.select(F.col("old").alias("col_pos"), "pos"), "col_pos").select("row_pos", F.col("pos").alias("col_pos"), "value")
        return LabeledMatrix(moved, axis.drop("old"), self.rows)

    def _part(self, axis: DataFrame, key: Any) -> DataFrame:
        n = axis.count()
        if _is_mask(key):
            if len(key) != n:
                raise IndexError(f"a mask of {len(key)} for {n} labels")
            return ax.renumbered(ax.by_mask(axis, key))
        if _is_places(key):
            if any(not 1 <= k <= n for k in key):
                raise IndexError("a place is outside the axis")
            return ax.by_places(axis, key)
        hit = ax.by_keys(axis, [key] if isinstance(key, dict) else list(key))
        if hit.isEmpty():
            raise IndexError(f"nothing at {key}")
        return ax.renumbered(hit)

    def __getitem__(self, key: Any) -> Any:
        """m[rows, cols], each a key, a list of keys, a mask, places from 1, or ``:``."""
        r, c = key
        if isinstance(r, dict) and isinstance(c, dict):
            if set(r) != set(ax.labels(self.rows)) or set(c) != set(ax.labels(self.cols)):
                raise IndexError("a cell is looked up by full keys")
            row, col = ax.by_keys(self.rows, [r]).first(), ax.by_keys(self.cols, [c]).first()
            if row is None or col is None:
                raise IndexError(f"no cell at {r}, {c}")
            return self.cells.where((F.col("row_pos") == row["pos"]) & (F.col("col_pos") == col["pos"])).first()["value"]
        out = self
        if not (isinstance(r, slice) and r == ALL):
            out = out._rows_at(self._part(self.rows, r))
        if not (isinstance(c, slice) and c == ALL):
            out = out._cols_at(self._part(self.cols, c))
        if isinstance(r, dict) and out.rows.count() == 1:
            return LabeledSeries(out.cols.join(out.cells.select(F.col("col_pos").alias("pos"), "value"), "pos"))
        if isinstance(c, dict) and out.cols.count() == 1:
            return LabeledSeries(out.rows.join(out.cells.select(F.col("row_pos").alias("pos"), "value"), "pos"))
        return out

    def filter_rows(self, predicate: ax.Predicate) -> LabeledMatrix:
        return self._rows_at(ax.renumbered(ax.by_predicate(self.rows, predicate)))

    def filter_cols(self, predicate: ax.Predicate) -> LabeledMatrix:
        return self._cols_at(ax.renumbered(ax.by_predicate(self.cols, predicate)))

    def filter(self, predicate: ax.Predicate, dims: int = 1) -> LabeledMatrix:
        _check_dims(dims, IndexError)
        return self.filter_rows(predicate) if dims == 1 else self.filter_cols(predicate)

    def filter_matrix(self, rows: ax.Predicate, cols: ax.Predicate) -> LabeledMatrix:
        return self.filter_rows(rows).filter_cols(cols)

    def drop(self, keys: ax.Key | Sequence[ax.Key], dims: int = 1) -> LabeledMatrix:
        """Without what the keys match; keys that match nothing are no error."""
        _check_dims(dims, IndexError)
        axis = self.rows if dims == 1 else self.cols
        gone = ax.by_keys(axis, [keys] if isinstance(keys, dict) else list(keys)).select("pos")
        kept = ax.renumbered(axis.join(gone, "pos", "left_anti"))
        return self._rows_at(kept) if dims == 1 else self._cols_at(kept)

    def drop_mut(self, key: ax.Key, dims: int = 1) -> LabeledMatrix:
        """As :meth:`drop`, in place."""
        out = self.drop(key, dims)
        self.cells, self.cols, self.rows = out.cells, out.cols, out.rows
        return self

    def slice_rows(self, places: Sequence[int]) -> LabeledMatrix:
        return self[list(places), :]

    def slice_cols(self, places: Sequence[int]) -> LabeledMatrix:
        return self[:, list(places)]

    # ---- labels

    def update_row_indices(self, axis: DataFrame) -> LabeledMatrix:
        return LabeledMatrix(self.cells, self.cols, axis)

    def update_col_indices(self, axis: DataFrame) -> LabeledMatrix:
        return LabeledMatrix(self.cells, axis, self.rows)

    def add_calculated_column(self, name: str, f: Any, to_rows: bool = True) -> LabeledMatrix:
        return self.update_row_indices(ax.evaluated(self.rows, name, f)) if to_rows else self.update_col_indices(ax.evaluated(self.cols, name, f))

    def mutate_rows(self, **columns: Any) -> LabeledMatrix:
        out = self
        for name, f in columns.items():
            out = out.add_calculated_column(name, f, True)
        return out

    def mutate_cols(self, **columns: Any) -> LabeledMatrix:
        out = self
        for name, f in columns.items():
            out = out.add_calculated_column(name, f, False)
        return out

    def select_rows(self, *columns: str) -> LabeledMatrix:
        return self.update_row_indices(self.rows.select("pos", *columns))

    def select_cols(self, *columns: str) -> LabeledMatrix:
        return self.update_col_indices(self.cols.select("pos", *columns))

    def rename_rows(self, **new_old: str) -> LabeledMatrix:
        return self.update_row_indices(self.rows.withColumnsRenamed({old: new for new, old in new_old.items()}))

    def rename_cols(self, **new_old: str) -> LabeledMatrix:
        return self.update_col_indices(self.cols.withColumnsRenamed({old: new for new, old in new_old.items()}))

    def relocate_rows(self, *columns: str) -> LabeledMatrix:
        return self.select_rows(*columns, *[c for c in ax.labels(self.rows) if c not in columns])

    def relocate_cols(self, *columns: str) -> LabeledMatrix:
        return self.select_cols(*columns, *[c for c in ax.labels(self.cols) if c not in columns])

    # ---- aggregation

    def group_by(self, columns: str | Sequence[str], dims: int = 1) -> GroupedMatrix:
        _check_dims(dims, ValueError)
        return GroupedMatrix(self, [columns] if isinstance(columns, str) else list(columns), dims)

    def groupby_matrix(self, *columns: str, agg_func: str | Callable = "sum", rows: bool = True, value_name: str = "value") -> DataFrame:
        """The long form grouped by labels of one side."""
        side = "row_" if rows else "col_"
        keys = [F.col(side + c) for c in columns]
        return self.to_long(value_name).groupBy(*keys).agg(resolve(agg_func)(F.col(value_name)).alias(value_name))

    def _sum_by(self, label: str, dimension: str) -> DataFrame:
        keys = {"rows": [f"row_{label}"], "cols": [f"col_{label}"]}.get(dimension, [f"row_{label}", f"col_{label}"])
        return self.to_long().groupBy(*keys).agg(F.sum("value").alias("value"))

    def sum_by_country(self, dimension: str = "both") -> DataFrame:
        return self._sum_by("CountryCode", dimension)

    def sum_by_sector(self, dimension: str = "both") -> DataFrame:
        return self._sum_by("Sector", dimension)

    def matrix_summary(self) -> DataFrame:
        v = F.col("value")
        named = {"total": "sum", "mean": "mean", "median": "median", "std": "std", "min_val": "min", "max_val": "max"}
        return self.cells.agg(*[resolve(f)(v).alias(n) for n, f in named.items()], F.count_if(v != 0).alias("n_nonzero"), F.count(F.lit(1)).alias("n_total"))

    def country_summary(self) -> DataFrame:
        keys = ["row_CountryCode", "col_CountryCode"]
        out = self.to_long().groupBy(*keys).agg(F.sum("value").alias("total_flow"), F.avg("value").alias("mean_flow"), F.count(F.lit(1)).alias("n_sectors"))
        return out.orderBy(F.desc("total_flow"), *keys)

    def _sums(self, side: str, axis: DataFrame) -> LabeledSeries:
        sums = self.cells.groupBy(F.col(side).alias("pos")).agg(F.sum("value").alias("value"))
        return LabeledSeries(axis.join(sums, "pos", "left").withColumn("value", F.coalesce("value", F.lit(0.0))))

    def sum_rows(self) -> LabeledSeries:
        """The sum of each row."""
        return self._sums("row_pos", self.rows)

    def sum_cols(self) -> LabeledSeries:
        """The sum of each column."""
        return self._sums("col_pos", self.cols)

    def pivot_wide(self, row_vars: str | Sequence[str], col_var: str, value_var: str = "value", agg: str | None = None) -> DataFrame:
        """One row for the row variables, one column for each value of ``col_var``; several cells for a place are an error unless ``agg`` is given."""
        row_vars = [row_vars] if isinstance(row_vars, str) else list(row_vars)
        long = self.to_long(value_var)
        if agg is None and not long.groupBy(*row_vars, col_var).count().where("count > 1").isEmpty():
            raise ValueError("several values for one place; give agg")
        values = [r[0] for r in long.select(col_var).distinct().orderBy(col_var).collect()]
        return long.groupBy(*row_vars).pivot(col_var, values).agg(resolve(agg)(F.col(value_var)) if agg else F.first(value_var))

    # ---- names

    def _names(self, *labels_: str) -> list[Any]:
        found = []
        for side, axis in enumerate((self.rows, self.cols)):
            name = next((n for n in labels_ if n in axis.columns), None)
            if name:
                found.append(axis.select(F.col(name).alias("name"), F.lit(side).alias("side"), "pos"))
        if not found:
            return []
        both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return [r["name"] for r in both.groupBy("name").agg(F.min(F.struct("side", "pos")).alias("first")).orderBy("first").collect()]

    def countries(self) -> list[Any]:
        return self._names("CountryCode", "Country")

    def sectors(self) -> list[Any]:
        return self._names("Sector", "Industry")

    def stressors(self) -> list[Any]:
        return self._names("Stressor")

    country, sector, stressor = countries, sectors, stressors


class GroupedMatrix:
    """A matrix with a grouping of one axis."""

    def __init__(self, matrix: LabeledMatrix, columns: list[str], dims: int):
        self.matrix, self.columns, self.dims = matrix, columns, dims

    def aggregate(self, func: str | Callable[[Column], Column] = "sum") -> LabeledMatrix:
        """Each group becomes one row (or column); groups stand in order of first appearance."""
        m, f = self.matrix, resolve(func)
        side, other = ("row_pos", "col_pos") if self.dims == 1 else ("col_pos", "row_pos")
        new, members = ax.grouped(m.rows if self.dims == 1 else m.cols, self.columns)
        cells = m.cells.join(members.withColumnsRenamed({"old": side}), side).groupBy(F.col("pos").alias("new"), other).agg(f(F.col("value")).alias("value"))
        cells = cells.withColumnRenamed("new", side).select("row_pos", "col_pos", "value")
        return LabeledMatrix(cells, m.cols, new) if self.dims == 1 else LabeledMatrix(cells, new, m.rows)

    summarise = aggregate


def densify(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """All places of two axes, 0 where ``cells`` has none.  A dense matrix has that many cells by definition."""
    places = rows.select(F.col("pos").alias("row_pos")).crossJoin(cols.select(F.col("pos").alias("col_pos")))
    return places.join(cells, ["row_pos", "col_pos"], "left").select("row_pos", "col_pos", F.coalesce("value", F.lit(0.0)).alias("value"))


def _check_dims(dims: int, error: type[Exception]) -> None:
    if dims not in (1, 2):
        raise error("dims is 1 for rows or 2 for columns")
