"""Products and solutions over cells: joins with aggregation, and the two ways to a Leontief solution."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leontia.model import DimensionError, LabeledMatrix, LabeledSeries

#: Up to this many sectors one worker solves by LU (8 bytes a cell, 72 MB); beyond it, by Neumann series.
DENSE_MOST = 3000
TOLERANCE, MAX_STEPS = 1e-12, 2000


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not sc.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="leontia-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of the product; zero cells do not move."""
    left = a.where("value <> 0").select(F.col("row_pos"), F.col("col_pos").alias("k"), F.col("value").alias("x"))
    right = b.where("value <> 0").select(F.col("row_pos").alias("k"), F.col("col_pos"), F.col("value").alias("y"))
    return left.join(right, "k").groupBy("row_pos", "col_pos").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def total_output(t: LabeledMatrix, y: LabeledMatrix) -> LabeledSeries:
    """x_i: the row sums of intermediate and final demand."""
    sums = t.cells.select("row_pos", "value").unionByName(y.cells.select("row_pos", "value")).groupBy(F.col("row_pos").alias("pos")).agg(F.sum("value").alias("value"))
    return LabeledSeries(t.rows.join(sums, "pos", "left").withColumn("value", F.coalesce("value", F.lit(0.0))))


def per_output(cells: DataFrame, x: DataFrame) -> DataFrame:
    """Cells divided by their column's output (pos, value), where an output of 0 divides as 1."""
    by = x.select(F.col("pos").alias("col_pos"), F.when(F.col("value") == 0, 1.0).otherwise(F.col("value")).alias("x"))
    return cells.join(by, "col_pos").select("row_pos", "col_pos", (F.col("value") / F.col("x")).alias("value"))


def technical_coefficients(t: LabeledMatrix, x: LabeledSeries) -> LabeledMatrix:
    return LabeledMatrix(per_output(t.cells, x.df), t.cols, t.rows)


class LeontiefSystem:
    """(I - A) x = d, solved for demands; the inverse is made only when asked for."""

    def __init__(self, a: LabeledMatrix, method: str = "auto"):
        if method not in ("auto", "dense", "neumann"):
            raise ValueError("method is auto, dense or neumann")
        self.a, self.method = a, method
        self._n: int | None = None
        self._inverse: LabeledMatrix | None = None

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self.a.rows.count()
        return self._n

    def _dense(self) -> bool:
        return self.method == "dense" or (self.method == "auto" and self.n <= DENSE_MOST)

    def _solved(self, demand: DataFrame) -> DataFrame:
        """(row_pos, col_pos, value) of the solutions of demands (row_pos, col_pos, value), one a column."""
        if self._dense():
            n = self.n
            tagged = self.a.cells.where("value <> 0").select(F.lit(0).alias("part"), "row_pos", "col_pos", "value").unionByName(demand.select(F.lit(1).alias("part"), "row_pos", "col_pos", "value"))

            def solve(f: pd.DataFrame) -> pd.DataFrame:
                a, d = f[f["part"] == 0], f[f["part"] == 1]
                left = np.eye(n)
                left[a["row_pos"], a["col_pos"]] -= a["value"]
                names, col = np.unique(d["col_pos"], return_inverse=True)
                right = np.zeros((n, len(names)))
                right[d["row_pos"], col] = d["value"]
                out = np.linalg.solve(left, right)
                return pd.DataFrame({"row_pos": np.repeat(np.arange(n), len(names)), "col_pos": np.tile(names, n), "value": out.ravel()})

            return tagged.groupBy().applyInPandas(solve, "row_pos long, col_pos long, value double")
        a = written(self.a.cells.where("value <> 0"))
        term = written(demand.where("value <> 0").select("row_pos", "col_pos", "value"))
        terms, first = [term], None
        for _ in range(MAX_STEPS):
            size = term.agg(F.max(F.abs("value"))).first()[0]
            if size is None:
                break
            first = first or size
            if size <= TOLERANCE * first:
                break
            if size > 1e12 * first:
                raise ValueError("the series does not converge")
            term = written(matmul(a, term))
            terms.append(term)
            if len(terms) == 32:  # keep the plan small
                terms = [written(_added(terms))]
        else:
            raise ValueError("the series does not converge")
        return _added(terms)

    def solve(self, demand: LabeledSeries | LabeledMatrix | list | np.ndarray) -> LabeledSeries | LabeledMatrix:
        """The output that a demand (or each column of a demand matrix) calls for."""
        spark = self.a.spark
        if isinstance(demand, LabeledMatrix):
            if demand.rows.count() != self.n:
                raise DimensionError(f"{self.n} sectors, {demand.rows.count()} demands")
            dense = demand.rows.select(F.col("pos").alias("row_pos")).crossJoin(demand.cols.select(F.col("pos").alias("col_pos")))
            solved = dense.join(self._solved(demand.cells), ["row_pos", "col_pos"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
            return LabeledMatrix(solved, demand.cols, self.a.rows)
        if not isinstance(demand, LabeledSeries):
            values = np.asarray(demand)
            if values.dtype.kind not in "iuf":
                raise TypeError("a demand is numeric")
            if values.ndim == 2:
                return self.solve(LabeledMatrix.create(spark, values, [{"Scenario": k + 1} for k in range(values.shape[1])], [{"n": k} for k in range(len(values))]))
            demand = LabeledSeries.create(spark, values, [{"n": k} for k in range(len(values))])
        if len(demand) != self.n:
            raise DimensionError(f"{self.n} sectors, {len(demand)} demands")
        solved = self._solved(demand.df.select(F.col("pos").alias("row_pos"), F.lit(0).cast("long").alias("col_pos"), "value"))
        return LabeledSeries(self.a.rows.join(solved.select(F.col("row_pos").alias("pos"), "value"), "pos", "left").withColumn("value", F.coalesce("value", F.lit(0.0))))

    @property
    def data(self) -> LabeledMatrix:
        """The inverse of I - A."""
        if self._inverse is None:
            one = self.a.rows.select(F.col("pos").alias("row_pos"), F.col("pos").alias("col_pos"), F.lit(1.0).alias("value"))
            self._inverse = LabeledMatrix(self._solved(one) if self._dense() else self.solve(LabeledMatrix(one, self.a.cols, self.a.rows)).cells, self.a.cols, self.a.rows)
        return self._inverse

    inverse = data

    def __getitem__(self, key):
        return self.data[key]

    def update_row_indices(self, axis: DataFrame) -> LeontiefSystem:
        return LeontiefSystem(self.a.update_row_indices(axis), self.method)

    def update_col_indices(self, axis: DataFrame) -> LeontiefSystem:
        return LeontiefSystem(self.a.update_col_indices(axis), self.method)


def _added(terms: list[DataFrame]) -> DataFrame:
    out = terms[0]
    for t in terms[1:]:
        out = out.unionByName(t)
    return out.groupBy("row_pos", "col_pos").agg(F.sum("value").alias("value"))
