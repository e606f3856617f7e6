"""Axes: small DataFrames (pos, metadata...) that label the rows or columns of a matrix.

A position is a long from 0.  An axis has at most some ten thousand rows, so numbering it anew in one window
is cheap; cells, of which there may be very many, are only ever joined with axes on positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Key = Mapping[str, Any]
Predicate = Column | str | Callable[[dict], bool]


def safe_table(spark: SparkSession, table: Any) -> DataFrame:
    """A DataFrame of metadata from a DataFrame, pandas table, dict of columns (scalars make one row) or rows of dicts."""
    if isinstance(table, DataFrame):
        return table
    if isinstance(table, pd.DataFrame):
        frame = table
    elif isinstance(table, Mapping):
        scalar = all(isinstance(v, str) or not isinstance(v, Iterable) for v in table.values())
        frame = pd.DataFrame({k: [v] if scalar else list(v) for k, v in table.items()})
    else:
        frame = pd.DataFrame(list(table))
    frame = frame.astype(object).where(frame.notna(), None)
    return spark.createDataFrame(frame.to_dict("records"), _schema(frame)) if len(frame) else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in frame.columns) or "none string")


def _schema(frame: pd.DataFrame) -> str:
    def kind(values) -> str:
        types = {type(v) for v in values if v is not None}
        if types <= {bool}:
            return "boolean" if types else "string"
        if all(issubclass(t, int) or "int" in t.__name__ for t in types):
            return "long"
        return "double" if all(issubclass(t, (int, float)) or "int" in t.__name__ for t in types) else "string"

    return ", ".join(f"`{c}` {kind(frame[c])}" for c in frame.columns)


def numbered(spark: SparkSession, table: Any) -> DataFrame:
    """An axis in the order of a driver-side table; a DataFrame must bring its own ``pos``."""
    if isinstance(table, DataFrame):
        if "pos" not in table.columns:
            raise ValueError("an axis given as a DataFrame needs a column pos")
        return table.withColumn("pos", F.col("pos").cast("long"))
    frame = pd.DataFrame(table if not isinstance(table, Mapping) else {k: [v] if isinstance(v, str) or not isinstance(v, Iterable) else list(v) for k, v in table.items()})
    frame = frame.drop(columns="pos", errors="ignore")
    frame.insert(0, "pos", range(len(frame)))
    if not len(frame):
        return spark.createDataFrame([], ", ".join(["pos long", *(f"`{c}` string" for c in frame.columns if c != "pos")]))
    return safe_table(spark, frame)


def labels(axis: DataFrame) -> list[str]:
    return [c for c in axis.columns if c != "pos"]


def renumbered(axis: DataFrame, order: str = "pos") -> DataFrame:
    """``old`` beside a new, gapless ``pos`` in the order of ``order``."""
    return axis.withColumn("old", F.col("pos")).withColumn("pos", (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))


def match(key: Key) -> Column:
    """The condition that a (partial) key sets; null matches null."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()], F.lit(True))


def by_keys(axis: DataFrame, keys: Sequence[Key]) -> DataFrame:
    """The axis rows that any of the keys matches; of rows with equal labels only the last can be found by key."""
    unknown = {k for key in keys for k in key} - set(labels(axis))
    if unknown:
        raise KeyError(f"the axis has no {sorted(unknown)}")
    last = axis.withColumn("last", F.max("pos").over(Window.partitionBy(*labels(axis)))).where("pos = last").drop("last")
    return last.where(reduce(lambda a, b: a | b, [match(k) for k in keys], F.lit(False)))


def by_predicate(axis: DataFrame, predicate: Predicate) -> DataFrame:
    """Rows for which a Column, an SQL text, or a function of the row's labels holds; null counts as false."""
    if isinstance(predicate, str):
        return axis.where(predicate)
    if isinstance(predicate, Column):
        return axis.where(predicate)
    kept = [r["pos"] for r in axis.collect() if predicate({k: v for k, v in r.asDict().items() if k != "pos"})]
    return at(axis, kept)


def by_mask(axis: DataFrame, mask: Sequence[bool]) -> DataFrame:
    return at(axis, [i for i, m in enumerate(mask) if m])


def at(axis: DataFrame, kept: Sequence[int]) -> DataFrame:
    """The axis rows at the given positions, by a join, as there may be many."""
    places = axis.sparkSession.createDataFrame(pa.table({"pos": pa.array(list(kept), pa.int64())}))
    return axis.join(places, "pos", "left_semi")


def by_places(axis: DataFrame, places: Sequence[int]) -> DataFrame:
    """``old`` beside ``pos`` for places counted from 1; order and repeats are kept."""
    spark = axis.sparkSession
    wanted = spark.createDataFrame([(i, p - 1) for i, p in enumerate(places)], "new long, pos long")
    return wanted.join(axis, "pos").withColumn("old", F.col("pos")).withColumn("pos", F.col("new")).drop("new")


def grouped(axis: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(new axis of the groups in order of first appearance, (old, pos) of each member)."""
    missing = [c for c in columns if c not in axis.columns]
    if missing:
        raise KeyError(f"the axis has no {missing}")
    first = axis.groupBy(*columns).agg(F.min("pos").alias("first"))
    new = first.withColumn("pos", (F.row_number().over(Window.orderBy("first")) - 1).cast("long")).select("pos", *columns)
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"g.{c}")) for c in columns])
    return new, axis.alias("a").join(new.alias("g"), same).select(F.col("a.pos").alias("old"), F.col("g.pos").alias("pos"))


def evaluated(axis: DataFrame, name: str, f: Column | str | Callable[[dict], Any]) -> DataFrame:
    """The axis with a column more, from a Column, an SQL text, or a function of the row's labels."""
    if isinstance(f, Column):
        return axis.withColumn(name, f)
    if isinstance(f, str):
        return axis.withColumn(name, F.expr(f))
    rows = [(r["pos"], f({k: v for k, v in r.asDict().items() if k != "pos"})) for r in axis.collect()]
    values = safe_table(axis.sparkSession, pd.DataFrame(rows, columns=["pos", name]))
    return axis.drop(name).join(values.withColumn("pos", F.col("pos").cast("long")), "pos")
