"""Folders of the Eora kind: T, VA, FD and Q as numbers, and a label file for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leontia.model import LabeledMatrix, LabeledSeries
from leontia.plans.system import MRIO, EnvironmentalExtension
from leontia.sources.text import label_table, lines, numbers

# The label columns of each file, by place, and the code of the rest of the world.
LABELS = {
    "T": {2: "CountryCode", 3: "Industry", 4: "Sector"},
    "VA": {2: "PrimaryInput"},
    "FD": {2: "CountryCode", 3: "Industry", 4: "Category"},
    "Q": {1: "Stressor", 2: "Source"},
}
REST = "ROW"


def _cells(spark: SparkSession, path: str, name: str) -> DataFrame:
    return numbers(lines(spark, f"{path}/{name}.txt"), "\t" if _has_tab(spark, f"{path}/{name}.txt") else ",", strict=True)


def _has_tab(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).first()
    return first is not None and "\t" in first[0]


def read_extension(spark: SparkSession, path: str, x: LabeledSeries, sectors: DataFrame) -> EnvironmentalExtension:
    """Q over the kept sectors; ``sectors`` is the full axis of the files."""
    q = LabeledMatrix(_cells(spark, path, "Q"), sectors, label_table(spark, f"{path}/labels_Q.txt", LABELS["Q"]))
    return EnvironmentalExtension.of(q.filter_cols(F.col("CountryCode") != REST), x)


def eora(spark: SparkSession, path: str) -> MRIO:
    """The system of a folder, without what belongs to the rest of the world."""
    t_axis, va_axis, fd_axis = (label_table(spark, f"{path}/labels_{n}.txt", LABELS[n]) for n in ("T", "VA", "FD"))
    known = F.col("CountryCode") != REST
    t = LabeledMatrix(_cells(spark, path, "T"), t_axis, t_axis).filter_matrix(known, known)
    fd = LabeledMatrix(_cells(spark, path, "FD"), fd_axis, t_axis).filter_matrix(known, known)
    va = LabeledMatrix(_cells(spark, path, "VA"), t_axis, va_axis).filter_cols(known)
    out = MRIO.of(t, fd, va)
    out.env = read_extension(spark, path, out.X, t_axis)
    return out


